"""Queries of scans, sinks, memory and cache: what is written is read again and has to be what the SQL says of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import bits, fields, fixed, scores
from .operators import blocks, cache, knowledge, matching, templates
from .plans import extraction, memory, providers
from .plans.memory import Memory
from .plans.stage import work_folder
from .queries import _BEST_SQL, BOXES_SQL, V_SQL, T, boxes, lines, query, s_strip, s_type, values
from .sources import readers, writers

# --- data sets, results and cache ---------------------------------------------------------------------------


@query("""SELECT p_partkey AS entry_idx, p_brand AS label, 'files/' || p_partkey || '.pdf' AS pdf_path, 0 AS fpos, 'nome' AS name, 'the "name" of ' || p_name AS description FROM part
UNION ALL SELECT p_partkey, p_brand, 'files/' || p_partkey || '.pdf', 1, 'a tipo', p_type FROM part""")
def q_dataset_scan(spark, sf):
    """Data set files of all parts, one for each brand, over many lines; fields keep their order."""
    p = T(spark, sf, "part")
    schema = F.to_json(F.create_map(F.lit("nome"), F.concat(F.lit('the "name" of '), "p_name"), F.lit("a tipo"), F.col("p_type")))
    entry = F.concat(F.lit('{"label": '), F.to_json(F.array("p_brand")).substr(F.lit(2), F.length(F.to_json(F.array("p_brand"))) - 2), F.lit(', "extraction_schema":\n  '), schema, F.lit(', "pdf_path": "files/'), F.col("p_partkey").cast("string"), F.lit('.pdf"}'))
    path = work_folder(spark, "dataset")
    files = p.select("p_brand", "p_partkey", entry.alias("e")).groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(F.struct("p_partkey", "e")))["e"], ",\n").alias("value"))
    files.select(F.concat(F.lit("[\n"), "value", F.lit("\n]\n")).alias("value"), F.md5("p_brand").alias("file")).write.partitionBy("file").text(path)
    found = readers.read_dataset(spark, path).select("label", "pdf_path", F.inline("fields"))
    return found.select(F.regexp_extract("pdf_path", r"(\d+)", 1).cast("long").alias("entry_idx"), "label", "pdf_path", "fpos", "name", "description")


_RESULTS_SQL = "SELECT CAST(s_suppkey AS VARCHAR) AS file, 'nome' AS field, s_name AS value FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'saldo', NULL FROM supplier"


def _results(spark, sf):
    s = T(spark, sf, "supplier")
    data = F.map_from_arrays(F.array(F.lit("nome"), F.lit("saldo")), F.array(F.col("s_name"), F.lit(None).cast("string")))
    return s.select(F.concat(F.lit("files/"), F.col("s_suppkey").cast("string"), F.lit(".pdf")).alias("doc_id"), data.alias("extracted_data"))


@query(_RESULTS_SQL)
def q_results_scan(spark, sf):
    """A JSON file per document, as they are written, read back."""
    path = work_folder(spark, "results")
    writers.write_documents(_results(spark, sf), path, code_version="7")
    return readers.read_results(spark, path)


@query("""SELECT sha256(chr(123) || chr(10) || '  "nome": "' || s_name || '",' || chr(10) || '  "saldo": null' || chr(10) || chr(125)) AS sha256 FROM supplier""")
def q_file_digest(spark, sf):
    """Digests of the files of results: the indented JSON with nulls, byte by byte."""
    path = work_folder(spark, "digests")
    writers.write_documents(_results(spark, sf), path)
    return readers.read_binary(spark, path).select("sha256")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, '7' AS code_version, s_name AS nome FROM supplier")
def q_result_cache_scan(spark, sf):
    """Results and their version files as cache entries."""
    path = work_folder(spark, "results")
    writers.write_documents(_results(spark, sf), path, code_version="7")
    return readers.read_result_cache(spark, path).select("key", "code_version", F.col("extracted_data")["nome"].alias("nome"))


@query("""SELECT 'files/' || s_suppkey || '.pdf' AS key, s_suppkey % 2 = 0 AS hit, CASE WHEN s_suppkey % 2 = 1 THEN 'version' END AS reason, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS nome FROM supplier""")
def q_cache_round_trip(spark, sf):
    """Entries are written twice, the second time half of them by other code: the last one counts, once."""
    path, r = work_folder(spark, "cache"), _results(spark, sf)
    odd = F.regexp_extract("doc_id", r"(\d+)", 1).cast("long") % 2 == 1
    writers.write_cache(r, path, "1")
    writers.write_cache(r.where(~odd), path, "1")
    writers.write_cache(r.where(odd), path, "2")
    requests = r.select(F.col("doc_id").alias("key"), F.timestamp_seconds(F.lit(0)).alias("mtime"), F.array(F.lit("nome")).alias("fields"))
    entries = readers.read_cache(spark, path)
    probed = cache.probe(requests, entries, "1").join(cache.latest(entries), "key")
    return probed.select("key", "hit", "reason", F.when(F.col("hit"), cache.project(F.col("e.extracted_data"), F.col("fields"))["nome"]).alias("nome"))


@query("SELECT r_regionkey AS id, list_contains(['AFRICA', 'ASIA'], r_name) AS has, CASE WHEN r_name = 'ASIA' THEN 'x' END AS asia FROM region")
def q_project(spark, sf):
    """Cached values of the requested fields only; what has no value is null."""
    r = T(spark, sf, "region").withColumn("m", F.create_map(F.col("r_name"), F.lit("x")))
    p = r.select("r_regionkey", cache.project(F.col("m"), F.array(F.lit("ASIA"), F.lit("AFRICA"))).alias("p"))
    return p.select(F.col("r_regionkey").alias("id"), (F.coalesce(F.col("p")["ASIA"], F.col("p")["AFRICA"]).isNotNull()).alias("has"), F.col("p")["ASIA"].alias("asia"))


@query("SELECT substr(sha256(string_agg(CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE sha256(n_name) END, '' ORDER BY n_nationkey)), 1, 16) AS code_version FROM nation")
def q_code_version(spark, sf):
    """The digest of modules; every fifth one is missing and counts by its name."""
    n = T(spark, sf, "nation")
    return cache.code_version(n.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name").cast("binary")).alias("content")))


@query("""WITH x AS (SELECT 'files/' || s_suppkey || '.pdf' AS doc_id, CAST(s_suppkey AS VARCHAR) AS s FROM supplier UNION ALL SELECT 'more/' || n_nationkey || '.pdf', CAST(n_nationkey AS VARCHAR) FROM nation)
SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN s || '-' || substr(md5(doc_id), 1, 8) ELSE s END AS stem FROM x""")
def q_output_names(spark, sf):
    """Names of result files; those of equal names in other folders don't overwrite each other."""
    n = T(spark, sf, "nation").select(F.concat(F.lit("more/"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("doc_id"))
    return writers.output_names(_results(spark, sf).select("doc_id").unionByName(n))


@query("SELECT s_suppkey AS id, s_name AS nome, n_name AS pais FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_combined_results(spark, sf):
    """All results as JSON lines, written once and read back."""
    s = T(spark, sf, "supplier").join(T(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    path = work_folder(spark, "combined")
    writers.write_combined(s.select(F.col("s_suppkey").alias("id"), F.create_map(F.lit("nome"), F.col("s_name"), F.lit("pais"), F.col("n_name")).alias("extracted_data")), path)
    back = spark.read.schema("id long, extracted_data map<string,string>").json(path)
    return back.select("id", F.col("extracted_data")["nome"].alias("nome"), F.col("extracted_data")["pais"].alias("pais"))


# --- memory -----------------------------------------------------------------------------------------------


_KNOWN_SQL = f"""{V_SQL}, o AS (SELECT field, id, {s_type("value")} AS type, CASE WHEN id % 3 = 0 THEN 'partial' ELSE 'exact' END AS mode, length({s_strip("value")}) AS n FROM v WHERE {s_strip("value")} <> ''),
t AS (SELECT field, type, count(*) AS c, min(id) AS f FROM o GROUP BY 1, 2), m AS (SELECT field, mode, count(*) AS c, min(id) AS f FROM o GROUP BY 1, 2)
SELECT 't_' || a.field AS template_id, a.field, round(a.avg, 6) AS avg_length, a.n, b.type, c.mode AS extraction_mode FROM (SELECT field, avg(n) AS avg, count(*) AS n FROM o GROUP BY field) a
JOIN (SELECT field, arg_max(type, struct_pack(c := c, f := -f)) AS type FROM t GROUP BY field) b ON a.field = b.field JOIN (SELECT field, arg_max(mode, struct_pack(c := c, f := -f)) AS mode FROM m GROUP BY field) c ON a.field = c.field"""


def _observed(spark, sf):
    v = values(spark, sf).select(F.concat(F.lit("t_"), "field").alias("template_id"), "field", "value", F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "partial").otherwise("exact").alias("mode"))
    return v


@query(f"WITH {_KNOWN_SQL}")
def q_knowledge_upsert(spark, sf):
    """What is stored of the first observations with what the later ones add is what all of them together say."""
    v = _observed(spark, sf)
    empty = Memory.empty(spark)
    path = work_folder(spark, "memory")
    for some in (v.where("seq <= 100"), v.where("seq > 100 and seq <= 500"), v.where("seq > 500")):
        known = Memory.load(spark, path)
        learned = knowledge.learn_fields(some).withColumn("label", F.lit("t"))
        known.learn(empty.templates, empty.fields, empty.patterns, learned, empty.delimiters.withColumn("seq", F.col("first"))).save(path)
    return Memory.load(spark, path).knowledge.select("template_id", "field", F.round("avg_length", 6).alias("avg_length"), "n", "type", "extraction_mode")


@query("""WITH g AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS n FROM part GROUP BY p_brand)
SELECT p_brand || '_' || substr(md5(p_brand || ':' || array_to_string(n, '|')), 1, 8) AS template_id, unnest(n) AS field FROM g WHERE p_brand = (SELECT min(p_brand) FROM part)""")
def q_knowledge_lookup(spark, sf):
    """Knowledge of a label and its fields, whatever their order."""
    p = T(spark, sf, "part")
    names = p.groupBy("p_brand").agg(F.collect_set("p_type").alias("names"))
    known = names.select(fields.template_id(F.col("p_brand"), F.col("names")).alias("template_id"), F.col("p_brand").alias("label"), F.explode("names").alias("field"))
    spec = Memory.empty(spark).knowledge
    memory_ = Memory.empty(spark)
    wanted = names.orderBy("p_brand").first()
    from dataclasses import replace

    memory_ = replace(memory_, knowledge=known.unionByName(spec, allowMissingColumns=True))
    return memory_.for_extraction(wanted["p_brand"], sorted(wanted["names"], reverse=True)).select("template_id", "field")


@query("SELECT o_custkey AS template, arg_max(o_orderstatus, o_orderkey) AS label, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def q_keep_last(spark, sf):
    """A store that overwrites: of the rows of a key the last one stays."""
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("template"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("seq"))
    return templates.keep_last(o, "template", "seq")


@query(f"""WITH {BOXES_SQL}, d AS (SELECT id, unnest([{", ".join("'" + d.replace("'", "''") + "'" for d in fixed.DELIMITERS)}]) AS d FROM boxes), j AS (SELECT 't' || b.id % 3 AS template_id, b.id, d.d FROM boxes b JOIN d ON b.id = d.id WHERE regexp_matches(b.box, d.d)),
c AS (SELECT template_id, d, count(*) AS frequency, min(id) AS first FROM j GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY frequency DESC, first, d) AS rank FROM c)
SELECT template_id, CAST(len(list(d)) AS BIGINT) AS n, max(frequency) AS most, min(frequency) AS least FROM r WHERE rank <= 5 GROUP BY 1""")
def q_split_rules(spark, sf):
    """The five most frequent delimiters of each template, out of a stored memory that was added to twice."""
    occurs = F.array_compact(F.array(*[F.when(F.col("box").rlike(d), F.lit(d)) for d in fixed.DELIMITERS]))
    found = boxes(spark, sf).select(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("template_id"), F.col("id").alias("seq"), F.explode(occurs).alias("delimiter"))
    known = Memory.empty(spark)
    for part in (found.where("seq <= 10000000"), found.where("seq > 10000000")):
        known = known.learn(known.templates.limit(0), known.fields.limit(0), known.patterns.limit(0), known.knowledge.limit(0), part)
    counts = known.delimiters.join(known.split_rules(), "template_id").where(F.array_contains("delimiters", F.col("delimiter")))
    return counts.groupBy("template_id").agg(F.count("*").alias("n"), F.max("frequency").alias("most"), F.min("frequency").alias("least"))


@query("""WITH p AS (SELECT l_orderkey AS id, l_quantity AS x0, l_discount AS y0, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2, 3)
SELECT id, CAST(count(*) AS BIGINT) AS n, arg_min(x0, struct_pack(f := first, x := x0, y := y0)) AS x0, arg_max(x0, struct_pack(f := first, x := x0, y := y0)) AS last FROM p GROUP BY id""")
def q_alternatives_once(spark, sf):
    """Alternative places of a field: each start once, in order of sight; half of them were known before."""
    place = F.struct(F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0).alias("page"))
    told = T(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", place.alias("p"))))["p"].alias("ps"))
    half = F.floor(F.size("ps") / 2).cast("int")
    once = memory.add_positions(memory.add_positions(F.lit(None).cast(f"array<{memory.BOX}>"), F.slice("ps", F.lit(1), half)), F.slice("ps", half + 1, F.size("ps")))
    return told.select("id", once.alias("ps")).select("id", F.size("ps").cast("long").alias("n"), F.get("ps", F.lit(0))["x0"].alias("x0"), F.element_at("ps", -1)["x0"].alias("last"))


@query("""SELECT o_orderpriority AS label, CASE WHEN regexp_matches(lower(trim(min(a))), 'rígida|rigida|rigid|stricted') THEN 'stricted' ELSE 'flexible' END AS structure FROM (
SELECT o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ' Rígida.' WHEN '2' THEN 'RIGID' WHEN '3' THEN 'flexível' ELSE 'talvez' END AS a FROM orders) GROUP BY 1""")
def q_structures(spark, sf):
    """Labels as a classifier's answers have them; what it doesn't know is flexible."""
    o = T(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"))
    kind = F.substring("label", 1, 1)
    answers = o.distinct().select("label", F.when(kind == "1", " Rígida.").when(kind == "2", "RIGID").when(kind == "3", "flexível").otherwise("talvez").alias("answer"))
    return providers.classify_labels(o, answers)


# --- scores that other queries use only in part -------------------------------------------------------------


@query(f"WITH {_BEST_SQL.partition("g AS (SELECT")[0].rstrip().rstrip(",")} SELECT doc_id, CAST(rank AS INTEGER) AS rank, block_idx, round(score, 6) AS score FROM f WHERE rank <= 3")
def q_top_candidates(spark, sf):
    """The three best blocks of each field."""
    l = lines(spark, sf)  # noqa: E741
    lang = T(spark, sf, "documents").select("doc_id", "lang")
    avg = l.join(lang, "doc_id").groupBy("lang").agg((F.avg(F.length("text")) / 2).alias("avg_length"))
    mid = l.groupBy("doc_id").agg(F.floor(F.median("block_idx")).alias("mid")).join(lang, "doc_id").join(avg, "lang")
    y = F.col("mid") * 12.0 + 3
    ref = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(120.0).alias("x1"), (y + 10).alias("y1"), F.lit(0).alias("page"))
    refs = mid.select("doc_id", F.lit("f").alias("field"), ref.alias("ref"), "avg_length", F.lit("text").alias("type"))
    return matching.top_blocks(refs, l).select("doc_id", "rank", "block_idx", F.round("scores.score", 6).alias("score"))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, abs((l_linenumber - 1) / 6.0::DOUBLE - (l_partkey % 7) / 6.0::DOUBLE) AS d FROM lineitem)
SELECT l_orderkey AS id, l_linenumber AS i, l_partkey AS p, CASE WHEN d <= 0.1::DOUBLE THEN 1.0::DOUBLE WHEN d <= 0.2::DOUBLE THEN 0.8::DOUBLE WHEN d <= 0.3::DOUBLE THEN 0.6::DOUBLE ELSE round(greatest(0.0::DOUBLE, 0.4::DOUBLE - d * 0.5::DOUBLE), 9) END AS score FROM x""")
def q_segment_position(spark, sf):
    """How near a segment is to its expected place among seven."""
    l = T(spark, sf, "lineitem")  # noqa: E741
    score = scores.segment_position((F.col("l_linenumber") - 1).cast("double"), (F.col("l_partkey") % 7).cast("double"), F.lit(7))
    return l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), F.round(score, 9).alias("score"))


@query("""WITH h AS (SELECT o_orderkey, lower(printf('%x', o_orderkey * 7919)) AS a, CASE WHEN o_orderkey % 10 = 0 THEN 'no hash' ELSE lower(printf('%x', o_custkey * 104729)) END AS b, xor(o_orderkey * 7919, o_custkey * 104729) AS x FROM orders)
SELECT o_orderkey AS id, a, CASE WHEN b = 'no hash' THEN 999 ELSE bit_count(x) END AS distance FROM h""")
def q_hash_texts(spark, sf):
    """Hashes as hex texts; what is no hash is farther than any."""
    o = T(spark, sf, "orders")
    a, b = bits.to_hex(F.col("o_orderkey") * 7919), F.when(F.col("o_orderkey") % 10 == 0, "no hash").otherwise(bits.to_hex(F.col("o_custkey") * 104729))
    return o.select(F.col("o_orderkey").alias("id"), a.alias("a"), bits.hamming(bits.from_hex(a), bits.from_hex(b)).cast("int").alias("distance"))


@query("SELECT o_custkey AS id, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def q_running_mean(spark, sf):
    """The mean of values that come one after the other."""
    o = T(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice")))["o_totalprice"].alias("v"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("n"))
    mean = F.aggregate("v", start, lambda d, x: F.struct(knowledge.running_mean(d["m"], x, d["n"]).alias("m"), (d["n"] + 1).alias("n")))["m"]
    return o.select("id", F.round(mean, 6).alias("mean"))


@query("""SELECT 'some' AS what, f AS field, CAST(count(*) AS BIGINT) AS n FROM part, (SELECT unnest(['nome', 'tipo']) AS f) GROUP BY f HAVING f = 'tipo'
UNION ALL SELECT 'all', f, CAST(count(*) AS BIGINT) FROM part, (SELECT unnest(['nome', 'tipo']) AS f) GROUP BY f""")
def q_requested_fields(spark, sf):
    """Requests for named fields only, and for all where none are named."""
    r = T(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.lit("nome"), F.lit("tipo"))).alias("field"))
    told = lambda df, what: df.groupBy("field").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "field", "n")
    return told(extraction.only(r, ["tipo"]), "some").unionByName(told(extraction.only(r, []), "all"))


@query(f"""WITH {V_SQL} SELECT field, id, CASE WHEN field = 'cpf' THEN value END AS given, value IS NOT NULL AS there FROM v""")
def q_flexible_text(spark, sf):
    """Documents without a layout: one block without a place for the whole text, read by the provider alone."""
    v = values(spark, sf)
    docs = v.select(F.concat_ws("#", "field", F.col("id").cast("string")).alias("doc_id"), "value", "field", "id")
    texts = blocks.simple_text(blocks.from_text(docs, "doc_id", "value"))
    answers = providers.TableProvider(docs.where("field = 'cpf'").select("doc_id", "field", "value")).extract(docs.select("doc_id", "field"), texts)
    joined = docs.join(answers.select("doc_id", F.col("value").alias("given")), "doc_id").join(texts, "doc_id", "left")
    return joined.select("field", "id", "given", F.col("text").isNotNull().alias("there"))
