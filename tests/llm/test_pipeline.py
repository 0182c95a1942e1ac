"""The corpus pipeline on a fixture, stage by stage, and the entries of the queries."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fieldweave.llm import packing, quality, queries, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns and rows
        if name != "source_mix":
            assert len({r.doc_id for r in rows}) == len(rows) <= before
            before = len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_duplicates_of_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    t = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)]
    ids = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (7, t[3]), (7, t[3] + " more"), (8, t[4]), (9, t[4]), (None, t[5]), (3, t[5]), (5, None), (5, "")]
    rows = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in ids], "doc_id long, text string, lang string, source string, n_chars long")
    rows = rows.select(*[rows[c].cast(docs.schema[c].dataType) for c in docs.columns])
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, rows, SF).collect()]
    one = [x for x in got if x[1].startswith(t[3])]  # t[3] and "more" are near-duplicates of one id
    assert len(one) == 1 and one[0][0] == 7
    assert sorted(((i is not None, i or 0, x) for i, x in got if (i, x) not in one)) == sorted([(False, 0, t[0]), (False, 0, t[1]), (True, 7, t[2]), (True, 8, t[4]), (False, 0, t[5]), (True, 5, "")])


def test_stages_with_odd_rows_and_clashing_names(spark):
    """Nulls, empty texts, repeated rows and columns with the stages' own names, through all stages, and an empty table."""
    long = " ".join(f"word{i}" for i in range(3000))
    shared = " ".join(f"shared{i}" for i in range(60))
    texts = [None, "", "   ", "one", long, f"{shared} and then {long[:400]}", f"so it was {shared}", "plain text of a few words that is like nothing else here", None]
    rows = [(None if i in (3, 8) else i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None if t is None else len(t), i) for i, t in enumerate(texts)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, quality int"
    docs = spark.createDataFrame([*rows, rows[4]], shape)
    for c in ("near", "repeats", "mix", "_page", "_raw", "_host", "_path", "_near_id", "c0", "score"):
        docs = docs.withColumn(c, F.lit("own"))
    model = quality.train(docs, spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 1)], "doc_id long, quality int"))
    judged = quality.judge(docs, model)
    assert judged.count() == 10 and {r.quality for r in judged.collect()} == set(range(9))
    now = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        now = spark.createDataFrame(out.collect(), now.schema)
        assert {r.near for r in now.collect()} <= {"own"}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert now.where("contains(text, 'shared1 ')").count() == 0  # the passage that two documents share
    kept = {r.doc_id for r in now.collect()}
    assert 4 in kept and 7 in kept
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= now.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_brute_force(spark):
    """Each stage but the classifier on what the one before it kept: the rows that the rules give, worked out one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    now = {r.doc_id: r for r in docs.collect()}

    def next_of(name):
        out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(list(now.values()), docs.schema), SF)
        return out.collect()

    sets = {}
    for i, r in now.items():
        w = _words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    group, ids = {i: i for i in sets}, sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = group[a], group[b]
                group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    got = {r.doc_id: r for r in next_of("near_duplicates")}
    assert set(got) == {i for i, g in group.items() if i == g} and len(got) < len(now)
    now = got

    length = corpus_pipeline.PASSAGE_BYTES
    data = {i: (r.text or "").encode() for i, r in now.items()}
    seen = Counter(d[k : k + length] for d in data.values() for k in range(len(d) - length + 1))
    got = {r.doc_id: r for r in next_of("repeated_passages")}
    assert set(got) == set(now)
    for i, d in data.items():
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        at, kept = 0, []
        for c in d.decode():
            n = len(c.encode())
            kept.append(c if not all(gone[at : at + n]) else "")
            at += n
        assert (got[i].text or "") == "".join(kept), i
        assert got[i].n_chars == (len(got[i].text) if any(gone) else now[i].n_chars)
    now = got

    size = {i: len(_words(r.text)) for i, r in now.items()}
    sources = sorted({r.source for r in now.values() if r.source is not None}) + [None] * any(r.source is None for r in now.values())
    total = {s: sum(size[i] for i, r in now.items() if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sources)}
    left, target, budget = set(sources), {}, 1.5 * sum(total.values())
    while True:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        budget -= sum(target[s] for s in over)
        left -= over
    target |= share if left else {}
    got = next_of("source_mix")
    copies = Counter(r.doc_id for r in got)
    assert set(copies.values()) <= {1, 2} and all(now[r.doc_id] == r for r in got)
    for s in sources:
        step = target[s] / total[s] if total[s] else 0.0
        mine = sorted((len(bin(size[i])) - 2, size[i], i) for i, r in now.items() if r.source == s)
        offset = int(hashlib.md5(f"7:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        for n, (_, _, i) in enumerate(mine):
            assert copies[i] == int((n + 1) * step + offset) - int(n * step + offset)

    library, want = tokens.Tokens(), Counter()
    for r in got:
        ids = np.append(library.whole(r.text or ""), np.uint32(2))
        want.update((r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for i, (a, b) in enumerate(packing.cut(len(ids), 1024)))
    packed = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(got, docs.schema), SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        ends = 0
        for offset, n in sorted(placed):
            assert offset == ends
            ends += n
        assert ends <= 1024
    least = -(-sum(r.length for r in packed) // 1024)
    assert len(by) <= 1.03 * least + 1


def test_names():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
