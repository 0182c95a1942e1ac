"""Removal of byte strings that stand more than once, within or across documents.

A window is a string of ``length`` bytes; every byte of a window that also starts elsewhere goes.

1. A map finds each document's runs of windows with one least ``gram`` hash. Equal windows have equal
   least hashes, so runs whose hash occurs once (most) are done; about one run per ``length - gram``
   bytes is compared, not every window.
2. Runs of other hashes get their bytes. Runs that are alike as a whole are counted by a digest, with
   partial sums before the exchange, and repeat entirely.
3. What differs under one hash is sorted as suffixes (:mod:`suffixes`) in tasks of bounded bytes. A
   hash whose different runs have more bytes than a task holds (a passage with thousands of
   surroundings) is thinned out first: a count of window hashes, with partial sums, tells which windows
   can repeat at all; what is left of the runs is cut to them, and equal cuts are one again. Only if
   even these exceed a task are they compared without it, by digests of their windows' bytes.
4. The spans go back to their documents.

A run has at most ``RUN_WINDOWS`` windows, so a text of one repeated byte is many small runs, not one.

Texts cross the network twice, by (id, digest), which no copy shares with many others; copies of one
text are known from a count of digests and never meet. Nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .suffixes import BYTE, U64, anchors, mix, repeated, slice_hashes
from .tables import fresh
from .textbuf import pieces, prefix_hashes

LENGTH, TASK_BYTES, RUN_WINDOWS = 400, 1 << 19, 1024
_RUNS = "array<struct<h: long, at: int, n: int, again: int>>"


def _identity(key: str, text: str) -> list[Column]:
    """Id (null as the least long) and text digest: the same for repeated rows only."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.unhex(F.md5(whole.cast("binary"))).alias("_digest"), whole.alias("_text")]


def _find_runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(2)):
                found = [anchors(data[a:b], length, gram, most=RUN_WINDOWS) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                h, at, n, again = (np.concatenate([f[i] for f in found]) for i in range(4))
                ends = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at, n, again))], ["h", "at", "n", "again"])
                cut = slice(first, last)
                yield pa.RecordBatch.from_arrays([batch.column(0)[cut], batch.column(1)[cut], pa.ListArray.from_arrays(pa.array(ends), struct)], ["_id", "_digest", "runs"])

    return run


def _get_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_digest", "h", "at", "n", "again", "bytes"]
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py().encode()
                for r in batch.column(3)[i].as_py():
                    piece = data[r["at"] : r["at"] + r["n"] - 1 + length]
                    out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *r.values(), piece))
                    size += len(piece)
                if size > 4 << 20 or (out and i == batch.num_rows - 1):
                    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0

    return run


def _sort_suffixes(length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("h").to_numpy().view(np.uint64)
        alone = table.column("copies").to_numpy() == 1
        found = repeated(table.column("bytes").to_pylist(), keys, alone, length, gram)
        ranges = [[{"a": a, "b": b} for a, b in f] for f in found]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        done = pa.table({"h": table.column("h"), "digest": table.column("digest"), "ranges": pa.array(ranges, kind)})
        return done.filter(pa.array([bool(r) for r in ranges], pa.bool_()))

    return run


def _all_windows(length: int):
    """``(kind, bytes)`` to a row for each window: ``kind``, its place, and a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, spots, hashes, size = [], [], [], 0
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                at = np.arange(len(data) - length + 1)
                hashes.append(mix(slice_hashes(prefix_hashes(BYTE[data]), at, at + length)).view(np.int64))
                kinds.append(np.full(len(at), batch.column(0)[i].as_py()))
                spots.append(at.astype(np.int32))
                size += len(at)
                if size >= 1 << 16 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kinds, spots, hashes)], ["kind", "w", "w1"])
                    kinds, spots, hashes, size = [], [], [], 0

    return run


def _cut_to(length: int):
    """Runs and the windows of them that may repeat, to the runs of such windows with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "digest", "copies", "from", "bytes"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            out = []
            for h, digest, copies, data, ws in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.sort(np.array(ws))
                cuts = np.flatnonzero(np.diff(w) > 1) + 1
                out += [(h, digest, copies, int(r[0]), data[r[0] : r[-1] + length]) for r in np.split(w, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)

    return run


def _digest_windows(length: int):
    """``(part, bytes)`` to a row for each window with the digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(data) - length + 1
                told = [hashlib.md5(data[w : w + length]).digest() for w in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(told, pa.binary())], ["part", "w", "told"])

    return run


_RANGES = "array<struct<a: int, b: int>>"


def _open_groups(kinds: DataFrame, name: str) -> DataFrame:
    """Kinds under a hash that has several, or one that may repeat itself, some of them standing once; ``total``: bytes of the hash."""
    sizes = kinds.groupBy("h").agg(F.count("*").alias("c"), F.min("copies").alias("least"), F.max("again").alias("again"), F.sum(F.octet_length("bytes")).alias("total"))
    sizes = materialize(sizes.where("least = 1 and (c > 1 or again = 1)").select("h", "total"), name)
    return kinds.join(sizes, "h")


def _sorted(groups: DataFrame, length: int, gram: int, task_bytes: int) -> DataFrame:
    """``h, digest, ranges`` of the kinds of groups that a task can hold, by suffix sort."""
    total = groups.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = max(1, -(-total // task_bytes))
    dealt = groups.select(F.pmod(F.xxhash64("h"), F.lit(tasks)).cast("int").alias("_task"), "h", "digest", "copies", "bytes")
    return dealt.repartition(tasks, "_task").groupBy("_task").applyInArrow(_sort_suffixes(length, gram), f"h long, digest binary, ranges {_RANGES}")


def _thinned(large: DataFrame, length: int, gram: int, task_bytes: int) -> DataFrame:
    """``h, digest, ranges`` of the kinds of groups that no task holds."""
    large = materialize(large.select(F.monotonically_increasing_id().alias("kind"), "h", "digest", "copies", "bytes"), "large")
    windows = large.select("kind", "bytes").mapInArrow(_all_windows(length), "kind long, w int, w1 long")
    twice = materialize(windows.groupBy("w1").agg(F.count("*").alias("c")).where("c > 1").select("w1"), "twice")
    left = windows.join(twice, "w1").groupBy("kind").agg(F.collect_list("w").alias("ws"))
    cut = large.join(left, "kind").select("h", "digest", "copies", "bytes", "ws").mapInArrow(_cut_to(length), "h long, digest binary, copies long, from int, bytes binary")
    cut = materialize(cut.withColumn("cut", F.unhex(F.md5("bytes"))), "cuts")
    parts = cut.groupBy("h", "cut").agg(F.count("*").alias("n"), F.max("copies").alias("most"), F.first("bytes").alias("bytes"))
    parts = materialize(parts.select("h", F.col("cut").alias("digest"), F.greatest("n", "most").alias("copies"), F.lit(1).alias("again"), "bytes"), "parts")
    open_ = _open_groups(parts, "part-sizes")
    again = _sorted(open_.where(F.col("total") <= task_bytes), length, gram, task_bytes)
    rest = materialize(open_.where(F.col("total") > task_bytes).select(F.monotonically_increasing_id().alias("part"), "h", "digest", "copies", "bytes"), "rest")
    every = rest.select("part", "bytes").mapInArrow(_digest_windows(length), "part long, w int, told binary")
    alike = materialize(every.groupBy("told").agg(F.count("*").alias("c")).where("c > 1").select("told"), "alike")
    found = every.join(alike, "told").groupBy("part").agg(F.collect_list(F.struct(F.col("w").alias("a"), (F.col("w") + 1).alias("b"))).alias("ranges"))
    counted = rest.where("copies = 1").join(found, "part").select("h", "digest", "ranges")
    entire = parts.where("copies > 1").select("h", "digest", F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("bytes") - length + 1).alias("b"))).alias("ranges"))
    inner = entire.unionByName(again).unionByName(counted).select("h", F.col("digest").alias("cut"), "ranges")
    alone = cut.where("copies = 1").select("h", "digest", "from", "cut").join(inner, ["h", "cut"])
    moved = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("from")).alias("a"), (r["b"] + F.col("from")).alias("b")))
    return alone.select("h", "digest", moved.alias("ranges"))


def find_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", *, length: int = LENGTH, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``_id, _digest, whole, spans`` for each (id, text) with bytes to remove; one row each.

    ``whole`` says that all bytes go, as the text stands twice; else ``spans`` has struct ``(a, b)``
    of bytes, which may overlap.
    """
    gram = length // 2
    rows = docs.select(*_identity(key, text))
    first = materialize(rows.mapInArrow(_find_runs(length, gram), f"_id long, _digest binary, runs {_RUNS}"), "runs")
    texts = first.where(F.size("runs") > 0).groupBy("_digest").agg(F.min("_id").alias("_id"), F.count("*").alias("copies"))
    texts = materialize(texts, "texts")
    runs = first.join(texts.select("_id", "_digest"), ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"])
    runs = materialize(runs.select("_id", "_digest", F.inline("runs")), "anchors")
    # what is stored is read by both sides of a join as it is, so that a hot key's partition can be split
    hot = materialize(runs.groupBy("h").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 or again = 1").select("h"), "hot")
    own = runs.join(hot, "h").groupBy("_id", "_digest").agg(F.collect_list(F.struct("h", "at", "n", "again")).alias("runs"))
    placed = rows.where(F.octet_length("_text") >= length).join(own, ["_id", "_digest"]).select("_id", "_digest", "_text", "runs")
    held = placed.mapInArrow(_get_bytes(length), "_id long, _digest binary, h long, at int, n int, again int, bytes binary")
    held = materialize(held.withColumn("digest", F.unhex(F.md5("bytes"))), "held")
    kinds = materialize(held.groupBy("h", "digest").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("again").alias("again"), F.first("bytes").alias("bytes")), "kinds")
    open_ = _open_groups(kinds, "sizes")
    sorted_ = _sorted(open_.where(F.col("total") <= task_bytes), length, gram, task_bytes)
    thinned = _thinned(open_.where(F.col("total") > task_bytes), length, gram, task_bytes)
    entire = kinds.where("copies > 1").select("h", "digest", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("ranges"))
    ranges = materialize(entire.unionByName(sorted_).unionByName(thinned), "ranges")
    spans = held.select("_id", "_digest", "h", "digest", "at").join(ranges, ["h", "digest"]).select("_id", "_digest", F.transform("ranges", lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"] - 1 + length).alias("b"))).alias("s"))
    spans = spans.groupBy("_id", "_digest").agg(F.flatten(F.collect_list("s")).alias("spans"))
    many = first.where(F.size("runs") > 0).select("_id", "_digest").distinct().join(texts.where("copies > 1").select("_digest"), "_digest").select("_id", "_digest")
    return many.withColumn("whole", F.lit(True)).join(spans, ["_id", "_digest"], "full").select("_id", "_digest", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole").isNull(), F.col("spans")).alias("spans"))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", *, length: int = LENGTH, **options) -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``repeats``.

    It has ``n_bytes, n_removed, n_spans`` (maximal runs), ``kept`` (the remaining bytes) and ``text``
    (the same as a string, where a character that a cut would split stays whole). A null text counts
    as empty; repeated rows repeat each other; ids may be null or repeated; an empty table gives an
    empty result. Where ``docs`` has a column ``repeats``, the new one is called ``repeats_``.
    """
    found = find_repeats(docs, text, key, length=length, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], *_identity(key, text))
    joined = rows.join(found, ["_id", "_digest"], "left").select(*names, "_text", "whole", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, columns = len(names), []
            for t, whole, spans in zip(batch.column(n), batch.column(n + 1), batch.column(n + 2), strict=True):
                data = t.as_py().encode()
                cuts = [(0, len(data))] if whole.as_py() else _merge([(s["a"], s["b"]) for s in spans.as_py() or []])
                if not cuts:
                    columns.append((len(data), 0, 0, data, t.as_py()))
                    continue
                kept, chars, at = [], [], 0
                for a, b in [*cuts, (len(data), len(data))]:
                    kept.append(data[at:a])
                    x, y = at, a
                    while 0 < x < len(data) and data[x] & 0xC0 == 0x80:
                        x -= 1
                    while y < len(data) and data[y] & 0xC0 == 0x80:
                        y += 1
                    chars.append(data[x:y])
                    at = b
                columns.append((len(data), sum(b - a for a, b in cuts), len(cuts), b"".join(kept), b"".join(chars).decode()))
            kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("text", pa.string())]
            values = list(zip(*columns, strict=True)) or [[]] * 5
            struct = pa.StructArray.from_arrays([pa.array(v, k) for v, (_, k) in zip(values, kinds, strict=True)], [k for k, _ in kinds])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], struct], [*names, "repeats"])

    shape = rows.select(*names, F.expr("named_struct('n_bytes', 0L, 'n_removed', 0L, 'n_spans', 0L, 'kept', X'', 'text', '')").alias("repeats")).schema
    own = fresh(docs, "repeats")
    return joined.mapInArrow(run, shape).toDF(*docs.columns, own)


def query(spark, sf_dir: str) -> DataFrame:
    """``op10_remove_repeats``: what stays of all documents; ``text`` is the kept text, with characters that a cut would split."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = F.col("repeats")
    return remove_repeats(docs).select("doc_id", r["n_bytes"].alias("n_bytes"), r["n_removed"].alias("n_removed"), r["n_spans"].alias("n_spans"), F.sha2(r["kept"], 256).alias("kept_sha256"), r["text"].alias("text"))
