"""Table-driven cases of the scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import bits, fields, fixed, formats, geometry, scores, text


def one(spark, make, *args):
    """The value of ``make`` on literal arguments."""
    names = [f"a{i}" for i in range(len(args))]
    kinds = ", ".join(f"{n} {'double' if isinstance(a, float) else 'int' if isinstance(a, int) else 'array<string>' if isinstance(a, list) else 'string'}" for n, a in zip(names, args, strict=True))
    return spark.createDataFrame([args], kinds).select(make(*[F.col(n) for n in names]).alias("x")).first()["x"]


def many(spark, make, cases):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", make(F.col("c")).alias("x")).orderBy("i").collect()
    return [(c, r["x"]) for (c, _), r in zip(cases, rows, strict=True)]


TYPES = [
    ("12/03/2020", "date"), ("99-99/9999", "date"), ("9:05", "time"), ("R$ 1.234,56", "money"), ("R$", "text"), ("1.234", "number"), ("1.234.567,89", "number"),
    ("EUROPA", "text"), ("123-45", "text"), ("", "text"), (None, "text"), ("€ 5", "money"), ("12 345", "number"),
]
SEGMENTS = [("PR", "uf"), ("XX", "abbreviation"), ("OAB", "abbreviation"), ("101943", "number"), ("Silva", "text")]
WORDS = [("12", "number"), ("PR", "uppercase"), ("A", "mixed"), ("ab", "lowercase"), ("Ab", "mixed"), ("-", "other")]
LABELS = [("Nome:", True), ("CPF", True), ("nota final", True), ("MARIA SILVA", False), ("carteira nacional de habilitação", True), ("x-", True), ("", False)]


@pytest.mark.parametrize("make,cases", [(text.infer_type, TYPES), (text.segment_type, SEGMENTS), (text.word_type, WORDS), (text.is_label, LABELS)])
def test_classes(spark, make, cases):
    assert many(spark, make, cases) == cases


def test_segment_box(spark):
    cases = [
        ("101943 PR CONSELHO SECCIONAL - PARANÁ", ["101943 PR CONSELHO SECCIONAL", "PARANÁ"]), ("a b", ["a", "b"]), (": a b", ["a", "b"]), (": abc", [":", "abc"]), ("abc", ["abc"]), ("  ", []), (None, []),
    ]
    assert many(spark, text.segment_box, cases) == cases


def test_null_like_and_fold(spark):
    assert many(spark, text.null_like, [(x, None) for x in ("NULL", "None", "", " null ", "x")]) == [("NULL", None), ("None", None), ("", None), (" null ", " null "), ("x", "x")]
    assert many(spark, text.fold, [(" JOSÉ\n da  Silva ", 0), (None, 0)]) == [(" JOSÉ\n da  Silva ", "jose da silva"), (None, "")]


def test_formats(spark):
    cases = [
        ("12/03/2020", "date", True, "date"), ("12/03/2020", "number", False, "date"), ("PR", "uf", True, "uf"), ("1_000", "number", True, "number"), ("nan", "number", True, "number"),
        ("x", None, True, None), ("12:99", "time", True, "time"), ("abc", "number", False, None), ("-", "number", False, None), ("1e5", "number", True, "number"), ("-5", "number", True, "number"),
    ]
    for v, kind, valid, found in cases:
        assert tuple(one(spark, formats.validate_format, v, kind)) == (valid, found), v


def test_matching_and_expected(spark):
    for v, kind, want in [("CPF 123.456.789-09 x", "number", "123.456.789-09"), ("12345678901234", "number", "12345678901"), ("v 12,5", "number", "12,5"), ("sala pr 1", "uf", "PR"), ("x", "number", None)]:
        assert one(spark, formats.extract_matching, v, kind) == want
    for name, desc, want in [("uf", None, "uf"), ("uf_emissor", "", None), ("nascimento", None, "date"), ("numero", None, "number"), ("Número", None, None), ("campo", "a hora", "time")]:
        assert one(spark, formats.expected_format, name, desc) == want


def test_repair(spark):
    assert tuple(one(spark, formats.repair, "em 12/03/2020", "date")) == ("12/03/2020", False)
    assert tuple(one(spark, formats.repair, "abc", "date")) == (None, True)
    assert tuple(one(spark, formats.repair, None, "date")) == (None, False)


@pytest.mark.parametrize("n,want", [(10, 1), (11, 1), (13, 0.7), (15, 0.5), (18, 0.08), (20, 0), (21, 0), (4, 0.44), (1, 0.26), (0, 0)])
def test_length_similarity(spark, n, want):
    assert one(spark, scores.length_similarity, "x" * n, 10.0) == pytest.approx(want)


def test_length_scores(spark):
    for n, want in [(11, 1), (13, 0.8), (15, 0.6), (20, 0.4), (25, 0.1), (40, 0)]:
        assert one(spark, scores.segment_length, n, 10.0) == pytest.approx(want)
    for t, kind, want in [("R$ 5,00", "number", 0.7), ("abc", "date", 0.2), ("abc", None, 0.5), ("abc", "text", 1.0)]:
        assert one(spark, scores.type_match, t, kind) == want


def _box(x, y, w=10.0, h=10.0, page=0):
    return F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + w).alias("x1"), F.lit(y + h).alias("y1"), F.lit(page).alias("page"))


def test_geometry(spark):
    at = lambda d, page=0: spark.range(1).select(geometry.spatial_similarity(_box(0.0, 0.0), _box(d, 0.0, page=page), F.lit(800.0), F.lit(1000.0)), geometry.proximity_bonus(_box(0.0, 0.0), _box(d, 0.0))).first()
    for d, spatial in [(0.0, 1.0), (20.0, 0.0), (20.001, 0.199990), (40.0, 0.0), (90.0, 0.0)]:
        assert at(d)[0] == pytest.approx(spatial, abs=1e-4)
    assert at(0.0, 1)[0] == 0
    for d, bonus in [(10.0, 0.15), (30.0, 0.075), (50.0, 0.0), (51.0, 0.0)]:
        assert at(d)[1] == pytest.approx(bonus)


def test_best_score_is_below_its_bound(spark):
    best = spark.range(1).select(scores.block_scores(_box(0.0, 0.0), _box(0.0, 0.0), F.lit("abcdefghij"), F.lit(10.0), F.lit("text"), F.lit(800.0), F.lit(1000.0))["score"]).first()[0]
    assert best == pytest.approx(0.915)
    assert sum(fixed.BLOCK_WEIGHTS.values()) == pytest.approx(1)


def test_bits(spark):
    h = lambda a, b: one(spark, lambda x, y: bits.hamming(bits.from_hex(x), bits.from_hex(y)), a, b)
    assert (h("f", "0"), h("zz", "0"), h("ffffffffffffffff", "0")) == (4, 999, 64)
    assert one(spark, lambda x: bits.to_hex(bits.from_hex(x)), "0abc") == "abc"
    cases = [((19, 14, 64), True, 33), ((20, 0, 0), False, 20), ((5, 15, 15), False, 20), ((19, None, None), True, 19)]
    for (f, left, right), match, score in cases:
        ones = lambda n: F.lit(None if n is None else (1 << n) - 1 - (1 << 64 if n == 64 else 0)).cast("bigint")
        zero = F.struct(*[F.lit(0).cast("bigint").alias(k) for k in ("full", "left", "right")])
        other = F.struct(ones(f).alias("full"), ones(left).alias("left"), ones(right).alias("right"))
        assert tuple(spark.range(1).select(bits.hash_match(zero, other)).first()[0]) == (match, score)
    maj = lambda xs: spark.createDataFrame([(x,) for x in xs], "h long").agg(bits.majority(F.col("h"))).first()[0]
    assert (maj([1, 0]), maj([1, 1, 0]), maj([-1, -1, 5])) == (0, 1, -1)


def test_positional_split(spark):
    s = lambda t, n: one(spark, lambda x: fields.positional_split(x, F.lit(n)), t)
    assert s("101943 PR CONSELHO - PARANÁ", 3) == ["101943", "PR", "CONSELHO - PARANÁ"]
    assert s("a b", 3) == ["a", "b", None]
    assert s("a", 3) is None
    assert s(" ", 2) == [None, None]
    assert s("a  b  c  d", 2) == ["a", "b  c  d"]


FIELDS = lambda *fs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(t).cast("string").alias("type"), F.lit(a).cast("double").alias("avg_length")) for n, d, t, a in fs])


def test_sequential_values(spark):
    f = FIELDS(("nome", "", "text", 18.0), ("uf", "", "text", 2.0), ("numero", "", "number", 4.0))
    assert one(spark, lambda t: fields.sequential_values(t, f), "77 - PR | MARIA SILVA") == {"nome": "MARIA SILVA", "uf": "PR", "numero": "77"}
    inferred = FIELDS(("numero_x", "", None, None), ("nome", "", None, None))
    assert one(spark, lambda t: fields.sequential_values(t, inferred), "77") == {"numero_x": None, "nome": "77"}


def test_match_segments_is_one_to_one(spark):
    f = FIELDS(("a", "", "text", 5.0), ("b", "", "text", 5.0), ("c", "", "number", 3.0))
    got = one(spark, lambda t: fields.match_segments(text.segment_box(t), f, F.lit(None).cast("array<string>")), "maria | silva | 123")
    assert got == {"a": "maria", "b": "silva", "c": "123"}
    assert one(spark, lambda t: fields.box_values(t, FIELDS(("a", "", "number", 3.0)), F.lit(None).cast("array<string>")), "xy - 123") == {"a": "123"}


def test_substrings(spark):
    cut = lambda t, k, a: one(spark, fields.substring_by_type, t, k, a)
    assert cut("Pedido 12 de 2024", "number", 4.0) == "2024"
    assert cut("em 12/03/2020 as 9:05", "date", 10.0) == "12/03/2020"
    assert cut("abc", "number", 5.0) == "abc"
    assert cut("Maria da Silva Souza Lima", "text", 8.0) == "Maria da"
    t = lambda x: one(spark, fields.truncate, x, 10.0)
    assert (t("abcdefghij klm nop"), t("abcd efghijklmnop"), t("abc")) == ("abcdefghij", "abcd efghijkl", "abc")


def test_template_id_ignores_order(spark):
    make = lambda *n: spark.range(1).select(fields.template_id(F.lit("x"), F.array(*map(F.lit, n)))).first()[0]
    assert make("b", "a") == make("a", "b") != make("a", "c")
    assert make("b", "a") == "x_" + hashlib.md5(b"x:a|b").hexdigest()[:8]


def test_match_segments_against_a_loop(spark):
    """Several fields compete for segments: best scores first, ties by field then segment, one to one."""
    import random

    from fieldweave.functions import fields, scores

    r, about = random.Random(2), [("nome", "name of the part", "text", 20.0), ("marca", "brand steel", "text", 8.0), ("uf", "", "uf", 2.0), ("numero", "number", "number", None)]
    boxes = [[r.choice(["steel plate", "PR", "101943", "brand X", "Nome:", "CPF", "12/03/2020", "a", "polished brass name"]) for _ in range(r.randint(1, 6))] for _ in range(60)]
    pattern = ["number", "text", "uf"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(boxes)], "id int, s array<string>")
    f = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(t).alias("type"), F.lit(a).cast("double").alias("avg_length")) for n, d, t, a in about])
    got = {x.id: x.m for x in df.select("id", fields.match_segments(F.col("s"), f, F.array(*map(F.lit, pattern))).alias("m")).collect()}
    flat = df.select("id", F.posexplode("s").alias("j", "seg"), F.size("s").alias("n"))
    told = {}
    for i, (n, d, t, a) in enumerate(about):
        place = F.lit(pattern.index(t)) if t in pattern else F.lit(None).cast("int")
        score = scores.segment_score(F.col("seg"), F.col("j"), F.col("n"), F.lit(d), F.lit(t), F.lit(a).cast("double"), place)
        for x in flat.select("id", "j", score.alias("score")).collect():
            told[(x.id, i, x.j)] = x.score
    for k, segments in enumerate(boxes):
        taken_fields, taken_segments, want = set(), set(), {n: None for n, *_ in about}
        for i, j in sorted(((i, j) for i in range(4) for j in range(len(segments))), key=lambda p: (-told[(k, *p)], *p)):
            if told[(k, i, j)] >= 0.3 and i not in taken_fields and j not in taken_segments:
                taken_fields.add(i)
                taken_segments.add(j)
                want[about[i][0]] = segments[j]
        assert got[k] == want
