"""Values that must equal those of the extraction rules everywhere. Plain lists, in natural order."""

# Words that are labels of fields, not values (lower case).
LABEL_WORDS = (
    "advogado agência aluno anexo ano aprovado assinatura assunto autenticação autor banco c.p.f. carga cargo carimbo carteirinha categoria cep certifico cfop cid cid-10 cidade cliente "
    "clínica cnh cnpj cofins coleta comarca competência comprovante conselho consumidor consumo conta contador convênio coordenador cor cpf cpf/cnpj crc crm crédito csll cst ct-e curso "
    "código data decisão declaramos declaração declaro desconto descrição despacho despesa destinatário dia diagnóstico digital diretor discente disciplina docente documento débito email "
    "embarcador emissor emitente empresa endereço especialidade estado exame faculdade favorecido filiação fornecedor frequência frete função graduação gênero histórico hora horário "
    "hospital icms idade identidade identificador identificação imposto informações inscrição instituição ipi irpj iss juiz juros lançamento lucro material matrícula medição modalidade "
    "modelo motorista multa média médico mês nacionalidade nascimento naturalidade nome nota nº número oab objeto obs observações paciente parte passaporte país período peso petição pis "
    "placa plano prazo procedimento processo produto professor protocolo página pós-graduação qtde quantidade r.g. ra raça receita recibo referência registro remetente reprovado requerente "
    "requerido responsável resultado rg rntrc réu saldo seccional secretário seguro semestre sentença sexo seção situação status subseção subtotal série telefone tipo titular "
    "transportadora tribunal tributo uf unidade universidade validade valor vara volume zona"
).split()

# Phrases that are labels although none of their words is one, or that are longer than three words.
LABEL_PHRASES = (
    "base de cálculo", "cadastro de pessoa física", "carteira nacional de habilitação", "carteira profissional", "chave de acesso", "chave pix", "código da unidade consumidora",
    "cond. de pagamento", "cópia autenticada", "forma de pagamento", "leitura anterior", "leitura atual", "linha digitável", "local de emissão", "natureza da operação", "nfe relacionada",
    "número da nota fiscal", "razão social", "recebemos de", "referente a", "total a pagar", "título de eleitor", "vencimento anterior", "órgão de classe",
)

# Codes of the federal units.
UF_CODES = "AC AL AM AP BA CE DF ES GO MA MG MS MT PA PB PE PI PR RJ RN RO RR RS SC SE SP TO".split()

# Letters in label and type patterns.
LETTERS = "a-záàâãéêíóôõúç"

# Delimiters of a box, in the order in which they are tried.
DELIMITERS = (r"\s+-\s+", r"\s+\|\s+", r"\s*:\s+", r"\s+/\s+", r"\s+•\s+", r"\s*,\s+", r"\s+")

# Words of field names and descriptions that tell the expected format.
FORMAT_WORDS = {
    "date": ("data", "date", "nascimento", "expedicao", "vencimento", "validade"),
    "time": ("hora", "time", "horario"),
    "number": ("numero", "number", "num", "cpf", "cnpj", "registro", "quantidade", "valor"),
}

# Patterns by which a value is repaired, in the order in which they are tried.
REPAIRS = {
    "date": (r"\d{2}[/-]\d{2}[/-]\d{4}", r"\d{4}[/-]\d{2}[/-]\d{2}"),
    "time": (r"\d{1,2}:\d{2}:\d{2}", r"\d{1,2}:\d{2}"),
    "number": (r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\d{11}", r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", r"\d{14}", r"\d+[.,]\d+", r"\d+"),
}

# Hash thresholds (exclusive), page size without blocks, thresholds and weights of the scores.
FULL_THRESHOLD, HALF_THRESHOLD = 20, 15
PAGE_WIDTH, PAGE_HEIGHT = 800.0, 1000.0
BLOCK_WEIGHTS = {"spatial": 0.30, "variability": 0.15, "proximity": 0.10, "length": 0.25, "type": 0.20}
SEGMENT_WEIGHTS = {"type": 0.35, "length": 0.25, "position": 0.20, "keyword": 0.15, "label": 0.05}
MIN_SCORE, SAME_BOX, PARTIAL_RATIO = 0.3, 5.0, 0.9
