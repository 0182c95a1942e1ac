"""Near-duplicates by MinHash with sequential Bayesian verification.

1. A map makes each document's set of word shingles, its size, a digest of the set and its MinHash
   signature. Documents of one set are one class from here on (partial sums, no pairs).
2. Bands of the signatures propose candidates. A bucket gives a star from its least class only, so
   its pairs are as many as its members; classes that these stars link are one for what follows.
3. A bucket that still holds several components could hide links between its other members. Bounds on
   their distance to the bucket's least class rule out nearly all without a pair; the others are proposed by
   the rarest shingles of their full sets (prefix filter), which loses no link.
4. Every candidate pair is verified in batches of its signatures: after each, the pair goes if the
   posterior probability that its similarity reaches the threshold is below ``miss``. Survivors are
   compared on their full sets.
5. Components of the links, by alternating stars.

Scale: the text is read twice and crosses the network once, for classes in candidate pairs only by
(id, digest). Every other exchange holds hashes, ids and signatures. Nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .scratch import materialize
from .tables import fresh
from .textbuf import U64, mix, pieces, words

SHINGLE, PERCENT, BANDS, ROWS, BATCH, MISS = 5, 80, 32, 4, 16, 1e-7
_SEED = np.random.default_rng(20250101)
_ODD = _SEED.integers(0, 1 << 63, 1024, dtype=U64) * U64(2) + U64(1)
_XOR = _SEED.integers(0, 1 << 63, 1024, dtype=U64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row.

    A text of fewer than ``k`` words has one shingle, the whole sequence; one without words has none.
    """
    h, _, first = words(data, offsets)
    n = max(0, len(h) - k + 1)
    every = np.zeros(n, U64)
    for i in range(k):
        every += h[i : i + n] * _ODD[i]
    every = mix(every)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * _ODD[: b - a]).sum(dtype=U64) + U64(b - a)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The least of ``size`` hash functions over each set, as 32-bit numbers; 0 for empty sets."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), size), np.uint32)
    if full:
        flat = np.concatenate([sets[i] for i in full])
        begins = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for f in range(size):
            out[full, f] = np.minimum.reduceat((flat ^ _XOR[f]) * _ODD[f], begins) >> U64(32)
    return out


def least_matches(threshold: float, size: int, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """``(hashes compared, least matches to go on)`` by the posterior of a uniform prior.

    With m of n hashes equal the similarity's posterior is Beta(m + 1, n - m + 1), whose upper tail at
    t is the chance of at most m successes among n + 1 trials of probability t.
    """
    out = []
    for n in range(batch, size + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _describe(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                sig = signatures(sets, size)
                cols = [batch.column(0)[first:last], pa.array(map(len, sets), pa.int64()), pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "digest", "sig"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1), 1 << 20):
                sets = shingle_sets(data, offsets, k)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "shingles"])

    return run


def _promising(threshold: float, size: int, miss: float):
    limits = least_matches(threshold, size, BATCH, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, size) for c in (batch.column(2), batch.column(3)))
            left, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in limits:
                matches += (one[left, done:n] == two[left, done:n]).sum(1)
                enough = matches >= least
                left, matches, done = left[enough], matches[enough], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left)), batch.column(1).take(pa.array(left))], ["a", "b"])

    return run


def verify(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, size: int, miss: float = MISS) -> DataFrame:
    """``(a, b)`` candidates to those whose sets have ``100 * common >= percent * union``."""
    sig = classes.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("s1")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("s2")), "b")
    likely = both.select("a", "b", "s1", "s2").mapInArrow(_promising(percent / 100, size, miss), "a long, b long")
    full = likely.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return full.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n")).where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def _residual_pairs(shared: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates among classes that share a bucket with another component.

    Let h be a bucket's least class, d(x) the number of shingles in which x and h differ, u(x) those of x
    that no other such class has, and t the threshold. A link of x and y means that they differ in at
    most K = (1 - t) / (1 + t) * (n(x) + n(y)) shingles. As they differ in d(x) + d(y) less twice what they differ
    from h in common, and u(x), u(y) are not in common, ``d(x) <= d(y) - 2 u(y) + K`` and the reverse
    hold. So a class whose d exceeds the group's greatest d - 2 u by more than its greatest K can't be
    linked to anyone there: one maximum a group, no pairs. For copies with changed words nearly all go by this.
    Of the rest, linked sets share one of their ``n - ceil(t n) + 1`` rarest shingles, and pairs keep to all bounds.
    """
    t = percent / 100
    gap = (1 - t) / (1 + t)
    placed = shared.join(parts, F.col("id") == F.col("node"), "left").select("bucket", "head", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    around = materialize(placed.join(mixed, "bucket", "left_semi").select("head", "id", "component").distinct(), "around")
    members = around.select("id").distinct()
    items = materialize(members.join(sets, "id").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "items")
    # stored, so that the join reads both sides as they are and the partition of a hot shingle can be split
    often = materialize(items.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "often")
    known = items.join(often, "s", "left").groupBy("id", "n").agg(F.count_if(F.col("df").isNull()).alias("u"), F.sort_array(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "s")))).alias("shared"))
    prefix = F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1  # in order of rarity: own shingles come first and meet nobody
    known = known.select("id", "n", "u", F.slice("shared", 1, F.greatest(prefix - F.col("u"), F.lit(0)).cast("int"))["s"].alias("rare"))
    both = around.join(sets, "id").withColumnRenamed("shingles", "x").join(sets.select(F.col("id").alias("head"), F.col("shingles").alias("y")), "head")
    far = both.select("head", "id", "component", (F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))).alias("d"))
    main = around.where("head = id").select("head", F.col("component").alias("main"))
    rows = far.join(known, "id").join(main, "head").withColumn("e", F.col("d") - 2 * F.col("u"))
    rows = materialize(rows, "hubs")
    most = rows.groupBy("head").agg(F.max("e").alias("most"))
    open_ = rows.join(most, "head").where(F.col("d") <= F.col("most") + gap * F.col("n") * (1 + 1 / t) + 1e-6)
    ids = open_.groupBy("id", "component", "n", "u").agg(F.collect_list(F.struct("head", "main", "d", "e")).alias("hubs"), F.first("rare").alias("rare"))
    ids = ids.withColumn("outside", F.exists("hubs", lambda h: h["main"] != F.col("component")))
    items = materialize(ids.select("id", "component", "n", "u", "hubs", "outside", F.posexplode("rare").alias("at", "s")), "rare")
    lively = materialize(items.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("s"), "lively")
    items = items.join(lively, "s").withColumn("left", F.col("n") - F.col("u") - F.col("at"))  # from this shingle on
    named = lambda x: items.select("s", *[F.col(c).alias(c + x) for c in ("id", "component", "n", "left", "hubs", "outside")])
    met = named("1").where("outside1").join(named("2"), "s")  # one of the two is outside of a bucket's main component
    k = gap * (F.col("n1") + F.col("n2")) + 1e-6
    near = F.exists("hubs1", lambda g: F.exists("hubs2", lambda h: (g["head"] == h["head"]) & (g["d"] <= h["e"] + k) & (h["d"] <= g["e"] + k)))
    # at the first shingle in common, what is left of both must be enough
    sizes = (F.least("left1", "left2") * (1 + t) + 1e-6 >= t * (F.col("n1") + F.col("n2"))) & (F.col("n1") + 1e-6 >= t * F.col("n2")) & (F.col("n2") + 1e-6 >= t * F.col("n1"))
    met = met.where((F.col("component1") != F.col("component2")) & (~F.col("outside2") | (F.col("id1") < F.col("id2"))) & sizes & near)
    return met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", *, shingle: int = SHINGLE, percent: int = PERCENT,
    bands: int = BANDS, rows: int = ROWS, miss: float = MISS, number_rows: bool = False,
) -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``near``: ``n_shingles, component_id, kept``.

    Documents are linked where ``100 * common >= percent * union`` holds for their sets; a component's
    id is its least ``key``; ``kept`` marks one document with that key. Null and empty texts, and those
    without words, have empty sets and are linked with nothing. Repeated rows of one key and text are one
    document, other texts of that key are others; ``number_rows`` adds a field ``row`` that counts them from 1. A null key counts as the least long. Where ``docs`` has a column ``near``, the new one
    is called ``near_``. An empty table gives an empty result.
    """
    size = bands * rows
    identity = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by_text = F.xxhash64(identity, F.md5(whole.cast("binary")))
    # ids that stand for several texts don't tell documents apart: then a hash of both does
    texts = docs.select(identity.alias("k"), by_text.alias("d")).groupBy("k").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    several = bool(texts.where("lo < hi").take(1))
    own_id = by_text if several else identity
    told = docs.select(own_id.alias("id"), whole.alias("t")).mapInArrow(_describe(shingle, size), "id long, n long, digest binary, sig binary")
    told = materialize(told, "described")
    classes = materialize(told.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * rows * 4 + 1, F.lit(rows * 4))))
    buckets = classes.select("id", F.explode(parts).alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("c")).where("c > 1").select("bucket", "head")
    shared = materialize(buckets.join(heads, "bucket"), "buckets")
    stars = shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    wanted = shared.select("id").distinct()
    chosen = told.join(wanted, "id", "left_semi").join(classes.select("id", "digest"), ["id", "digest"], "left_semi").select("id").distinct()
    source = docs.select(own_id.alias("id"), whole.alias("t")).join(chosen, "id", "left_semi").dropDuplicates(["id"])
    sets = materialize(source.mapInArrow(_sets(shingle), "id long, shingles array<long>"), "sets")
    first = materialize(verify(stars, classes, sets, percent, size, miss), "links")
    linked = components(first)
    more = verify(_residual_pairs(shared, linked, sets, percent), classes, sets, percent, size, miss)
    # copies of one set: every id of a class to the class
    joined = components(first.unionByName(more))
    of_class = classes.join(joined, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"))
    labels = told.join(of_class, "digest", "left").groupBy("id").agg(F.max("n").alias("n"), F.min(F.coalesce("component", "id")).alias("component"))
    first_id = F.col("component")
    if several:
        keys = docs.select(own_id.alias("id"), identity.alias("k")).distinct()
        least = labels.join(keys, "id").groupBy("component").agg(F.min(F.struct("k", "id")).alias("least"))
        labels = labels.join(least, "component").select("id", "n", F.col("least.k").alias("component"), F.col("least.id").alias("first"))
        first_id = F.col("first")
    own, by = fresh(docs, "near"), fresh(docs, "_near_id")
    named = labels.select(F.col("id").alias(by), F.struct(F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == first_id).alias("kept")).alias(own))
    joined = docs.withColumn(by, own_id).join(named, by)
    if number_rows:
        nth = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64(text)))
        joined = joined.withColumn(own, F.col(own).withField("row", nth))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], own)


def query(spark, sf_dir: str) -> DataFrame:
    """``op7_near_duplicates``: shingles of 3 words and a similarity of 0.85, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.col("near")
    return near_duplicates(docs, shingle=3, percent=85).select("doc_id", n["n_shingles"].alias("n_shingles"), n["component_id"].alias("component_id"), n["kept"].alias("kept"))
