"""Operators on small tables, the query catalogue against DuckDB, and the cascade end to end."""

import os

import pytest
from pyspark.sql import functions as F

from fieldweave import queries
from fieldweave.operators import blocks, cache, evaluate, knowledge, matching, templates
from fieldweave.plans import extraction, providers
from fieldweave.plans.config import Config
from fieldweave.plans.memory import BOX, SCHEMAS, Memory, add_positions
from fieldweave.plans.run import Documents, run
from fieldweave.sources import readers, writers
from fieldweave.streaming.queue import label_queues

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.SQL])
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    ours = sorted([tuple(map(_same, r)) for r in got.select(*cols).collect()], key=repr)
    theirs = sorted([tuple(map(_same, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()], key=repr)
    assert ours == theirs


def test_leader_clusters_against_a_loop(spark):
    h = queries.hashed(spark, SF)
    got = {r.doc_id: (r.leader, r.is_leader) for r in templates.leader_clusters(h).collect()}
    mask, leaders, want = (1 << 64) - 1, {}, {}
    for r in sorted(h.collect(), key=lambda r: r.seq):
        near = []
        for k in leaders.setdefault(r.label, []):
            full, left, right = (bin((a ^ b) & mask).count("1") for a, b in zip((r.full, r.left, r.right), (k.full, k.left, k.right), strict=True))
            if full < 20 and min(left, right) < 15:
                near.append((full + min(left, right), len(near), k.doc_id))
        if near:
            want[r.doc_id] = (min(near)[2], False)
        else:
            leaders[r.label].append(r)
            want[r.doc_id] = (r.doc_id, True)
    assert got == want
    # one label for all, in rounds, by broadcast and by the index; and with leaders known before
    one = h.withColumn("label", F.lit("x"))
    want = rows(templates.leader_clusters(one), "doc_id", "leader", "is_leader")
    for most, first in ((50_000, 20), (0, 150)):
        assert rows(templates.leader_clusters(one, first_round=first, broadcast_rows=most), "doc_id", "leader", "is_leader") == want
    half = one.orderBy("seq").limit(100)
    before = {r.doc_id for r in half.collect()}
    known = half.join(templates.leader_clusters(half).where("is_leader").select("doc_id"), "doc_id").withColumnRenamed("doc_id", "template")
    rest = one.join(half.select("doc_id"), "doc_id", "left_anti")
    assert rows(templates.leader_clusters(rest, known), "doc_id", "leader", "is_leader") == [w for w in want if w[0] not in before]


def test_match_templates_by_index_as_by_broadcast(spark):
    import random

    r, made = random.Random(3), []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [[r.getrandbits(64) for _ in range(3)] for _ in range(4)]
    for i in range(60):  # near each other at all distances around the limits, some without halves
        hashes = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 22))) for b in r.choice(base)]
        made.append((i, "ab"[i % 2], i, *[None if j and i % 7 == 0 else signed(x) for j, x in enumerate(hashes)]))
    d = spark.createDataFrame(made, "doc_id long, label string, seq long, full long, left long, right long")
    t = d.withColumn("template", F.col("doc_id") + 1000)
    pairs = rows(templates.near_pairs(d, t))
    assert rows(templates.match_templates(d, t)) == rows(templates.match_templates(d, t, broadcast_rows=0))
    assert len(pairs) > 100 and pairs == rows(templates.near_pairs(d, t, broadcast_rows=0))


def test_leaders_of_unlike_documents_are_told_without_the_fold(spark, monkeypatch):
    import random

    r, fold, seen = random.Random(5), templates._fold, spark.sparkContext.accumulator(0)

    def counting(batches):
        def tell():
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return fold(tell())

    h = [(i, "x", i, *[r.getrandbits(63) for _ in range(3)]) for i in range(400)]
    h += [(i + 400, "x", i + 400, *h[i % 7][3:]) for i in range(100)]  # copies
    d = spark.createDataFrame(h, "doc_id long, label string, seq long, full long, left long, right long")
    want = rows(templates.leader_clusters(d))
    monkeypatch.setattr(templates, "_fold", counting)
    monkeypatch.setattr(templates, "BLOCK", 50)
    assert rows(templates.leader_clusters(d, first_round=50, broadcast_rows=0)) == want
    assert seen.value <= 60  # the first rounds; each of the 400 before


def test_text_hashes_as_raster_hash(spark):
    from fieldweave.functions import bits

    got = {r.doc_id: (r.full, r.left, r.right) for r in queries.hashed(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in queries.T(spark, SF, "documents").where(F.length("text") >= 2).collect()}
    cut = lambda t: [ord(t[len(t) * i // 72]) for i in range(72)]
    pixels = [(k, cut(t), cut(t[: len(t) // 2]), cut(t[len(t) // 2 :])) for k, t in texts.items()]
    p = spark.createDataFrame(pixels, "doc_id long, full array<int>, left array<int>, right array<int>")
    assert got == {r[0]: tuple(r[1:]) for r in p.select("doc_id", *[bits.raster_hash(F.col(k)) for k in ("full", "left", "right")]).collect()}


def test_equal_hashes_are_matched_without_pairs(spark, monkeypatch):
    made = [(i, "ab"[i % 2], i, i // 8, None if i % 5 == 0 else i % 3, i % 4) for i in range(64)]
    d = spark.createDataFrame(made, "doc_id long, label string, seq long, full long, left long, right long")
    t = d.withColumn("template", F.col("doc_id"))
    best = F.min_by(F.struct("template", "score"), F.struct("score", "seq"))
    want = rows(templates.near_pairs(d, t).groupBy("doc_id", "label").agg(best.alias("b")).select("doc_id", "label", "b.*"))
    monkeypatch.delattr(templates, "near_pairs")
    assert rows(templates.match_templates(d, t, broadcast_rows=0)) == want


def test_first_match_rules(spark):
    b = spark.createDataFrame([(1, 0, 0, "MARIA DA SILVA", 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    v = spark.createDataFrame([(1, "a", "maria da silva"), (1, "b", "MARIA"), (1, "c", "MARIA DA SILV"), (1, "d", " "), (1, "e", "MARIA DA SILVA SOUZA")], "doc_id long, field string, value string")
    assert rows(matching.first_match(v, b), "field", "mode") == [("a", "exact"), ("b", "partial")]


def test_first_match_brings_texts_to_one_form_before_they_meet(spark):
    b = spark.createDataFrame([(1, 0, 0, " A ", 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    v = spark.createDataFrame([(1, "a", "a")], "doc_id long, field string, value string")
    plan = matching.first_match(v, b)._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if "Join" in line]
    assert len(met) == 1 and "regexp_replace" not in met[0]


def test_spans_to_blocks(spark):
    s = spark.createDataFrame([("d", 0, 0, 0, 0, " Nome ", 1.0, 1.0, 5.0, 2.0), ("d", 0, 0, 0, 1, " ", 0.0, 0.0, 9.0, 9.0), ("d", 0, 0, 1, 0, "Maria", 1.0, 3.0, 6.0, 4.0), ("d", 0, 1, 0, 0, "  ", 1.0, 1.0, 2.0, 2.0)], readers.SPANS)
    assert rows(blocks.from_spans(s), "block_idx", "text", "x0", "y0", "x1", "y1") == [(0, "Nome Maria", 1.0, 1.0, 6.0, 4.0)]


def test_knowledge_ties(spark):
    v = spark.createDataFrame([(i, "t", "f", x, "exact") for i, x in enumerate(["abc", "PR", "12", "13", "xyz", None, " "])], "seq long, template_id string, field string, value string, mode string")
    r = knowledge.learn_fields(v).first()
    assert (r["type"], r["n"], r["type_history"]) == ("text", 5, {"text": 3, "number": 2})
    t = spark.createDataFrame([(0, "a", "text"), (1, "a", "uf"), (2, "a", "uf"), (3, "a", "text")], "seq long, k string, v string")
    assert rows(knowledge.first_most(t, ["k"], "v", "seq")) == [("a", "text", 2)]
    mean = spark.createDataFrame([(0.0, 7.0, 0), (4.0, 8.0, 1)], "a double, v double, n int").select(knowledge.running_mean(F.col("a"), F.col("v"), F.col("n"))).collect()
    assert [m[0] for m in mean] == [7.0, 6.0]


def test_run_stats(spark):
    t = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 1.0), ("b", 1, 2.0)], "k string, i int, v double")
    got = {r.k: (r["count"], r.median, round(r["std"], 4), r["first"]) for r in knowledge.run_stats(t, ["k"], "v", ["i"]).collect()}
    assert got == {"a": (1, 2.0, 0.0, 2.0), "b": (2, 1.5, 0.7071, 1.0)}


def test_cache_rules(spark):
    r = spark.createDataFrame([(k, 10, ["a", "b"]) for k in "vwxyz"], "key string, mtime int, fields array<string>")
    e = spark.createDataFrame([("v", 10, ["a", "b", "c"], "1"), ("w", 9, ["a", "b"], "1"), ("x", 10, ["a"], "1"), ("y", 10, ["a", "b"], None)], "key string, mtime int, fields array<string>, code_version string")
    assert rows(cache.probe(r, e, "1"), "key", "reason") == [("v", None), ("w", "stale"), ("x", "fields"), ("y", "version"), ("z", "absent")]
    assert rows(cache.misses(r, e, "1"), "key") == [("w",), ("x",), ("y",), ("z",)]
    assert rows(cache.hits(r, cache.without(e), "1"), "key") == []


def test_evaluation_report(spark):
    p = spark.createDataFrame([("f1", "a", "José"), ("f1", "b", "x"), ("f2", "a", "1")], "file string, field string, value string")
    g = spark.createDataFrame([("f1", "a", " jose "), ("f1", "b", "y"), ("f1", "c", None), ("f3", "a", "1")], "file string, field string, value string")
    parts = evaluate.evaluate(p, g)
    assert rows(parts["fields"], "file", "field", "matched") == [("f1", "a", True), ("f1", "b", False), ("f1", "c", True)]
    told = writers.report(parts)
    assert "accuracy 66.67" in told and "missing: f3" in told and "extra: f2" in told and "'x' instead of 'y'" in told
    swapped = evaluate.evaluate(g, p)
    assert rows(swapped["fields"], "file", "field", "matched") == rows(parts["fields"], "file", "field", "matched")


def test_dataset_and_results_round_trip(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"label": "oab", "extraction_schema": {"z": "last", "a": "first"}, "pdf_path": "files/x.pdf"}, {"label": "", "extraction_schema": {}, "pdf_path": "y"}]')
    entries = readers.read_dataset(spark, str(tmp_path / "d.json"))
    assert [f.name for f in entries.orderBy("entry_idx").first().fields] == ["z", "a"]
    assert readers.valid_entries(entries).count() == 1
    out = spark.createDataFrame([("files/x.pdf", "z", 0, "1"), ("files/x.pdf", "a", 1, None)], "doc_id string, field string, fpos int, value string")
    maps = writers.result_maps(out)
    assert maps.select(writers.as_json("extracted_data")).first()[0] == '{"z":"1","a":null}'
    written = writers.write_documents(maps, f"file://{tmp_path}/out", code_version="7")
    assert written.first().file.endswith("/out/x.json")
    assert (tmp_path / "out/x.json").read_text() == '{\n  "z": "1",\n  "a": null\n}'
    assert rows(readers.read_result_cache(spark, str(tmp_path / "out")), "key", "code_version") == [("x", "7")]
    two = maps.unionByName(maps.withColumn("doc_id", F.lit("more/x.pdf")))
    assert len({r.stem for r in writers.output_names(two).collect()}) == 2
    writers.write_combined(maps, str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all")).count() == 1
    for version in ("7", "8"):  # the entry written last counts, and is found once
        writers.write_cache(maps, str(tmp_path / "cache"), version)
    wanted = spark.sql("SELECT 'files/x.pdf' AS key, timestamp'2020-01-01' AS mtime, array('z') AS fields")
    stored = readers.read_cache(spark, str(tmp_path / "cache"))
    assert rows(cache.probe(wanted, stored, "8"), "hit") == [(True,)] and rows(cache.probe(wanted, stored, "7"), "reason") == [("version",)]
    assert cache.latest(stored).select(cache.project(F.col("e.extracted_data"), F.array(F.lit("z"), F.lit("q")))).first()[0] == {"z": "1", "q": None}
    assert readers.read_cache(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "r").mkdir()
    (tmp_path / "r/x.json").write_text('{"z": "1", "a": null}')
    (tmp_path / "r/x.meta.json").write_text('{"code_version": "7"}')
    assert rows(readers.read_results(spark, str(tmp_path / "r"))) == [("x", "a", None), ("x", "z", "1")]
    (tmp_path / "r/empty.json").write_text("{}")
    (tmp_path / "r/bad.json").write_text("{")
    found = readers.read_results(spark, str(tmp_path / "r"))
    assert sorted(r.file for r in found.where("field is null").collect()) == ["bad", "empty"]
    assert rows(evaluate.missing_files(found, found)) == [] and evaluate.compare_fields(found, found).count() == 2
    assert rows(readers.read_result_cache(spark, str(tmp_path / "r")).where("key = 'x'"), "key", "code_version") == [("x", "7")]
    assert readers.read_or_empty(spark, str(tmp_path / "none"), readers.TEMPLATES).count() == 0


def test_binary_scan_and_raster_hash(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.bin").write_bytes(b"abc")
    assert readers.read_binary(spark, str(tmp_path)).first().sha256.startswith("ba7816bf")
    ramp = np.tile(np.arange(90), (80, 1))
    assert readers.difference_hash(ramp) == -1 and readers.difference_hash(ramp[:, ::-1]) == 0
    page = np.random.default_rng(0).integers(0, 256, (1100, 850)).astype(np.uint8)
    assert readers.resample(page, 800, 1131).shape == (1131, 800) and (readers.resample(np.full((50, 40), 7), 9, 8, "lanczos") == 7).all()
    assert len(set(readers.raster_hashes(page))) == 3
    assert readers.masked(np.zeros((1135, 804), np.uint8))[200, 100] == 255


def _cascade_inputs(spark):
    layout = lambda d, name, number, date: [(d, 0, 0, "Nome:", 10.0, 10.0, 60.0, 20.0), (d, 0, 1, name, 70.0, 10.0, 200.0, 20.0), (d, 0, 2, f"{number} PR", 70.0, 40.0, 160.0, 50.0), (d, 0, 3, date, 70.0, 70.0, 160.0, 80.0)]
    b = layout("d1", "MARIA SILVA", "101943", "12/03/2020") + layout("d2", "JOANA SOUZA", "201944", "em 13/04/2021") + layout("d3", "ANA", "7", "x")
    bl = spark.createDataFrame(b, "doc_id string, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    f = F.array(*[F.struct(F.lit(i).alias("fpos"), F.lit(n).alias("name"), F.lit("").alias("description")) for i, n in enumerate(("nome", "numero", "uf", "data"))])
    e = spark.createDataFrame([("d1", "oab", 0), ("d2", "oab", 1), ("d3", "carta", 2)], "doc_id string, label string, seq long").withColumn("fields", f)
    h = spark.createDataFrame([("d1", 0, 0, 0), ("d2", 7, 1, 1), ("d3", -1, -1, -1)], "doc_id string, full long, left long, right long")
    kinds = spark.createDataFrame([("oab", "stricted"), ("carta", "flexible")], "label string, structure string")
    gold = spark.createDataFrame([("d1", "nome", "MARIA SILVA"), ("d1", "numero", "101943"), ("d1", "uf", "PR"), ("d1", "data", "12/03/2020"), ("d3", "nome", "ANA"), ("d3", "uf", "null")], "doc_id string, field string, value string")
    return e, bl, h, kinds, providers.TableProvider(gold)


def test_cascade_end_to_end(spark):
    got = {(r.doc_id, r.field): (r.method, r.value) for r in extraction.process(*_cascade_inputs(spark)).collect()}
    assert got[("d1", "nome")] == ("llm_learning", "MARIA SILVA")
    assert {f: got[("d2", f)] for f in ("nome", "numero", "uf", "data")} == {"nome": ("positional", "JOANA SOUZA"), "numero": ("positional", "201944"), "uf": ("positional", "PR"), "data": ("positional", "13/04/2021")}
    assert got[("d3", "nome")] == ("llm_flexible", "ANA") and got[("d3", "uf")] == ("llm_flexible", None)
    assert len(got) == 12


def test_call_provider(spark):
    def connect():
        def ask(text, schema):
            if "bad" in text:
                raise RuntimeError
            return '{"a": "' + text[:1] + '", "b": "None", "z": 1}'

        return ask

    w = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "a", "x")], "doc_id long, field string, description string")
    t = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, text string")
    assert sorted(rows(providers.CallProvider(connect).extract(w, t)), key=repr) == sorted([(1, "a", "g"), (1, "b", None), (2, "a", None)], key=repr)


def test_alternatives(spark):
    e, bl, *_ = _cascade_inputs(spark)
    box = lambda y: (70.0, y, 160.0, y + 10, 0)
    shape = "template string, field string, position struct<x0:double,y0:double,x1:double,y1:double,page:int>, mode string, alternatives array<struct<x0:double,y0:double,x1:double,y1:double,page:int>>"
    tf = spark.createDataFrame([("t", "data", None, None, [box(40.0), box(70.0)])], shape)
    req = spark.createDataFrame([("d1", "oab", "t", "oab_1", "data", 0, "")], "doc_id string, label string, template string, template_id string, field string, fpos int, description string")
    pats = spark.createDataFrame([], "template string, box_text string, field string, segment int")
    know = spark.createDataFrame([], readers.KNOWLEDGE)
    assert rows(extraction.by_alternatives(req, bl, tf, pats, know)) == [("d1", "data", "12/03/2020")]


def test_merge_knowledge_as_if_at_once(spark):
    v = spark.createDataFrame([(i, "t", "fg"[i % 2], x, m) for i, (x, m) in enumerate([("abc", "exact"), ("PR", "partial"), ("12", None), ("13", "partial"), ("xyz", "partial"), (None, "exact"), ("7", "exact")])], "seq long, template_id string, field string, value string, mode string")
    whole = knowledge.learn_fields(v)
    for at in (0, 1, 3, 7):
        merged = knowledge.merge_knowledge(knowledge.learn_fields(v.where(F.col("seq") < at)), knowledge.learn_fields(v.where(F.col("seq") >= at)))
        told = lambda df: sorted((r.template_id, r.field, round(r.avg_length, 9), r.n, r.type, list(r.type_history.items()), r.extraction_mode, list((r.mode_history or {}).items())) for r in df.collect())
        assert told(merged) == told(whole)


def test_memory_round_trip_and_lookups(spark, tmp_path):
    path = str(tmp_path / "memory")
    assert Memory.load(spark, path).templates.count() == 0
    e, bl, h, kinds, provider = _cascade_inputs(spark)
    memory = extraction.process_with(e, bl, h, kinds, provider, Memory.empty(spark)).memory
    assert memory.save(path) == 1 and memory.save(path) == 2
    back = Memory.load(spark, path)
    for name in SCHEMAS:
        assert rows(getattr(back, name).select(F.to_json(F.struct("*")))) == rows(getattr(memory, name).select(F.to_json(F.struct("*"))))
    name = back.templates.first().template
    assert rows(back.part(name, "mode")) == [("data", "exact"), ("nome", "exact"), ("numero", "partial"), ("uf", "partial")]
    assert back.for_extraction("oab", ["uf", "data", "nome", "numero"]).count() == 4 and back.for_extraction("oab", ["uf"]).count() == 0
    assert back.split_rules().first().sequence == ["number", "uf"]
    assert back.cleared().templates.count() == 0 and back.template(name).count() == 1
    box = lambda x, y: (x, y, 1.0, 1.0, 0)
    a = spark.createDataFrame([([box(1.0, 1.0)], [box(1.0, 1.0), box(2.0, 1.0), box(2.0, 1.0)]), (None, [box(3.0, 3.0)])], f"a array<{BOX}>, b array<{BOX}>")
    assert [len(r[0]) for r in a.select(add_positions(F.col("a"), F.col("b"))).collect()] == [2, 1]


class _Counting:
    """A provider that remembers what it was asked."""

    def __init__(self, provider):
        self.provider, self.asked = provider, []

    def extract(self, wanted, texts):
        self.asked += [tuple(r) for r in wanted.select("doc_id", "field").collect()]
        return self.provider.extract(wanted, texts)


def test_two_runs(spark, tmp_path):
    """The second run takes stored results and layouts, and asks for less."""
    lay = lambda d, name, date, y=70.0: [(d, 0, 0, "Nome:", 10.0, 10.0, 60.0, 20.0), (d, 0, 1, name, 70.0, 10.0, 200.0, 20.0), (d, 0, 2, date, 70.0, y, 160.0, y + 10), (d, 0, 3, "PR", 400.0, 400.0, 420.0, 410.0)]
    made = [lay("f/a.pdf", "MARIA SILVA", "12/03/2020"), lay("f/b.pdf", "JOANA SOUZA", "13/04/2021"), lay("f/c.pdf", "PEDRO LIMA", "31-12"), lay("f/d.pdf", "RUI COSTA", "15/06/2023")]
    made[2].append(("f/c.pdf", 0, 4, "14/05/2022", 300.0, 300.0, 360.0, 310.0))
    bl = spark.createDataFrame(sum(made, []), "doc_id string, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    h = spark.createDataFrame([(f"f/{c}.pdf", i, i, i) for i, c in enumerate("abcd")], "doc_id string, full long, left long, right long")
    files = bl.select("doc_id", F.timestamp_seconds(F.lit(1_000_000)).alias("mtime")).distinct()
    errors = spark.createDataFrame([("f/e.pdf", "broken")], "doc_id string, error string")
    docs = Documents(bl, h, files.unionByName(spark.sql("SELECT 'f/e.pdf' AS doc_id, timestamp_seconds(1000000) AS mtime")), errors)
    schema = '{"nome": "o nome", "data": "a data"}'
    import json

    def entries(names):
        (tmp_path / "d.json").write_text(json.dumps([{"label": "oab", "extraction_schema": json.loads(schema), "pdf_path": f"f/{c}.pdf"} for c in names]))
        return readers.read_dataset(spark, str(tmp_path / "d.json"))

    def provider(names):
        gold = {"a": ("MARIA SILVA", "12/03/2020"), "b": ("JOANA SOUZA", "13/04/2021"), "c": ("PEDRO LIMA", "14/05/2022"), "d": ("RUI COSTA", "15/06/2023")}
        table = [(f"f/{c}.pdf#{i}", f, v) for i, c in enumerate(names) if c in gold for f, v in zip(("nome", "data"), gold[c], strict=True)]
        return _Counting(providers.TableProvider(spark.createDataFrame(table, "doc_id string, field string, value string")))

    labels = lambda df: df.select("label", F.lit("stricted").alias("structure"), F.lit(None).cast("string").alias("error"))
    results, memory = f"file://{tmp_path}/results", str(tmp_path / "memory")
    first = provider("abec")
    one = run(spark, entries("abec"), docs, first, labels, results=results, memory=memory, config=Config(benchmark=True))
    got = {r.pdf_path: r for r in one.results.collect()}
    assert (got["f/a.pdf"].extraction_method, got["f/b.pdf"].extraction_method) == ("llm_learning", "positional")
    assert got["f/b.pdf"].extracted_data == {"nome": "JOANA SOUZA", "data": "13/04/2021"} and got["f/c.pdf"].extracted_data["data"] == "14/05/2022"
    assert got["f/e.pdf"].error == "broken" and got["f/e.pdf"].extracted_data == {"nome": None, "data": None}
    assert json.loads((tmp_path / "results/documents/b.json").read_text()) == {"nome": "JOANA SOUZA", "data": "13/04/2021"}
    stats = one.stats()
    assert (stats["count"], stats["total_fields"], stats["llm_fields_used"]) == (4, 8, 3) and stats["first_s"] > 0
    assert [a for a in first.asked if a[0] != "f/a.pdf#0"] == [("f/c.pdf#3", "data")]  # what stands there is no date
    assert [(r.field, r.alternatives[0].y0) for r in one.memory.fields.where("size(alternatives) > 0").collect()] == [("data", 300.0)]
    second = provider("abecd")
    two = run(spark, entries("abecd"), docs, second, labels, results=results, memory=memory)
    got = {r.pdf_path: r for r in two.results.collect()}
    assert [got[f"f/{c}.pdf"].extraction_method for c in "abcd"] == ["cached", "cached", "cached", "positional"]
    assert got["f/d.pdf"].extracted_data == {"nome": "RUI COSTA", "data": "15/06/2023"}
    assert second.asked == []


def test_classifier_attempts(spark):
    def connect():
        calls = {}

        def ask(label):
            calls[label] = calls.get(label, 0) + 1
            if label == "never" or calls[label] < 3:
                raise RuntimeError("busy")
            return " Rígida. "

        return ask

    labels = spark.createDataFrame([("oab",), ("oab",), ("never",)], "label string")
    assert sorted(map(tuple, providers.ask_structures(labels, connect).collect())) == [("never", None, "RuntimeError: busy"), ("oab", "stricted", None)]
    assert sorted(map(tuple, providers.ask_structures(labels.limit(1), connect, tries=2).collect())) == [("oab", None, "RuntimeError: busy")]


def test_command(spark, tmp_path, capsys, monkeypatch):
    from fieldweave import cli

    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    (tmp_path / "d.json").write_text('[{"label": "oab", "extraction_schema": {"nome": "x"}, "pdf_path": "f/a.pdf"}]')
    spark.createDataFrame([("f/a.pdf", 0, 0, "MARIA", 1.0, 1.0, 2.0, 2.0)], "doc_id string, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double").write.parquet(str(tmp_path / "blocks"))
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold/a.json").write_text('{"nome": "MARIA"}')
    out = f"file://{tmp_path}/results"
    assert cli.main(["run", str(tmp_path / "d.json"), "--blocks", str(tmp_path / "blocks"), "--results", out, "--memory", str(tmp_path / "m"), "--answers", str(tmp_path / "gold"), "--flexible", "oab", "--benchmark"]) == 0
    assert "Fields via LLM: 1 / 1" in capsys.readouterr().out
    assert cli.main(["evaluate", f"{out}/documents", str(tmp_path / "gold")]) == 0
    assert "accuracy 100.00 %" in capsys.readouterr().out
    assert cli.main(["dataset", str(tmp_path / "d.json")]) == 0 and capsys.readouterr().out == "oab: 1\n"
    assert cli.main(["run", str(tmp_path / "none.json"), "--answers", "x"]) == 1


def test_label_queue_stream(spark, tmp_path):
    h = queries.hashed(spark, SF).select("doc_id", "label", "full", "left", "right")
    h.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(h.schema).parquet(str(tmp_path / "in"))
    q = label_queues(stream).writeStream.format("memory").queryName("queues").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.doc_id: r.leader for r in templates.leader_clusters(queries.hashed(spark, SF)).collect()}
    assert {r.doc_id: r.leader for r in spark.sql("SELECT * FROM queues").collect()} == want


def test_windowed_counts_leave_out_late_rows(spark, tmp_path):
    import datetime as dt

    from fieldweave.streaming.queue import windowed_counts

    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    shape = "t timestamp, k string, value double"
    for i, minutes in enumerate(([1, 2, 31], [3, 26, 60], [90])):  # 3 comes after 31 - 10, 26 in time
        spark.createDataFrame([(at(m), "a", 1.0) for m in minutes], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
            q = windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    got = {r.window.start.minute + 60 * r.window.start.hour: r.n for r in spark.sql("SELECT * FROM windows").collect()}
    assert got[0] == 2 and got[25] == 1 and got[30] == 1 and 90 not in got
