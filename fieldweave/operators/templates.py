"""Templates: nearest known layout by fingerprints, leaders of new layouts, and lookups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans.stage import stored

#: Templates up to this many rows are sent to all tasks; more of them are compared block by block.
BROADCAST_ROWS = 4_096
#: Rows of a label in a block, and blocks of a label at most: beyond both, blocks grow.
BLOCK, MOST_BLOCKS = 16_384, 32
#: Rows that are compared at once in a block: documents by templates.
GROUP, TILE = 64, 16_384
#: Documents that one round of finding leaders goes through at first, how a round grows, and most rounds and passes of a round.
FIRST_ROUND, GROWTH, MOST_ROUNDS, MOST_PASSES = 16_384, 4, 6, 4
_HASHES = ("full", "left", "right")


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _hits(asked: list[np.ndarray], known: list[np.ndarray], before: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs of two sides ``seq, full, left, right, halves``, both in order of ``seq``: rows of each and scores.

    All whole hashes are compared, a few hundred thousand pairs at a time in buffers that stay in a core's cache; only
    the few that are near are looked up by their halves.
    """
    d_seq, d_full, d_left, d_right, d_halves = asked
    t_seq, t_full, t_left, t_right, t_halves = known
    wide = min(TILE, -(-len(t_seq) // 8) * 8)
    bits, far, near = np.empty(wide, np.uint64), np.empty((GROUP, wide), np.uint8), np.zeros((GROUP, wide), bool)
    for at in range(0, len(d_seq), GROUP):
        some = d_full[at : at + GROUP]
        end = np.searchsorted(t_seq, d_seq[at + len(some) - 1]) if before else len(t_seq)
        for low in range(0, end, TILE):
            tile = t_full[low : min(low + TILE, end)]
            n = len(tile)
            near[:, n:] = False
            for g, h in enumerate(some):
                np.bitwise_xor(tile, h, out=bits[:n])
                np.bitwise_count(bits[:n], out=far[g, :n])
                np.less(far[g, :n], fixed.FULL_THRESHOLD, out=near[g, :n])
            eights = np.flatnonzero(near[: len(some)].view(np.uint64))  # eight answers a step
            which, nth = np.nonzero(near.reshape(-1, 8)[eights])
            g, j = np.divmod(eights[which] * 8 + nth, wide)
            score, g, j = far[g, j].astype(np.int64), g + at, j + low
            halves = d_halves[g] & t_halves[j]
            half = np.minimum(np.bitwise_count(d_left[g] ^ t_left[j]), np.bitwise_count(d_right[g] ^ t_right[j]))
            fine = ~halves | (half < fixed.HALF_THRESHOLD)
            if before:
                fine &= t_seq[j] < d_seq[g]
            yield g[fine], j[fine], score[fine] + np.where(halves, half, 0)[fine]


def _side(rows: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    rows = rows.sort_by("seq")
    hashes = [rows[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for c in _HASHES]
    halves = rows["left"].is_valid().to_numpy() & rows["right"].is_valid().to_numpy()
    return rows, [rows["seq"].to_numpy(), *hashes, halves]


def _blocks(asked: DataFrame, known: DataFrame, pairs: str, before: bool = False) -> DataFrame:
    """``doc_id, label, template, seq, score`` of near pairs, found block by block: ``all`` of them, or the ``best`` of a
    document in each block of templates (the lowest score, then ``seq``).

    Each side of a label is dealt into blocks by count, and every block meets every block in a task of its own, so the work
    of one label spreads over all workers; a row is sent once for each block of the other side. Fingerprints of unlike
    pages are near random: an index of chunks of them would leave a twelfth of the pairs, at a row of a join for each,
    which is far more than comparing all in place.
    """
    spark = asked.sparkSession
    asked = asked.where(F.col("full").isNotNull()).select("doc_id", "label", F.col("seq").cast("long").alias("seq") if "seq" in asked.columns else F.lit(0).cast("long").alias("seq"), *_HASHES)
    known = known.where(F.col("full").isNotNull()).select("template", "label", F.col("seq").cast("long").alias("seq"), *_HASHES)
    parts = lambda n: F.least(F.lit(MOST_BLOCKS), F.ceil(F.col(n) / BLOCK)).cast("int")
    sides = [df.groupBy("label").count().where(F.col("count") > BLOCK).withColumn("count", parts("count")).withColumnRenamed("count", n) for df, n in ((asked, "ds"), (known, "ts"))]
    large = {r.label: (r.ds or 1, r.ts or 1) for r in sides[0].join(sides[1], "label", "full").collect()}  # few: labels with more than a block
    sizes = spark.createDataFrame([(k, *v) for k, v in large.items()], "label string, ds int, ts int")
    one = F.lit(1)

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        put = df.join(F.broadcast(sizes), "label", "left") if large else df.withColumn("ds", one).withColumn("ts", one)
        put = put.withColumn(own[0], F.pmod(F.xxhash64(key), F.coalesce(own, one)).cast("int"))
        return put.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("ds", "ts")

    kinds = {k: df.schema[k].dataType.simpleString() for df, k in ((asked, "doc_id"), (known, "template"))}
    left = dealt(asked, "doc_id", "ds", "ts").withColumn("template", F.lit(None).cast(kinds["template"])).withColumn("asks", F.lit(True))
    right = dealt(known, "template", "ts", "ds").withColumn("doc_id", F.lit(None).cast(kinds["doc_id"])).withColumn("asks", F.lit(False))

    def compare(rows: pa.Table) -> pa.Table:
        (docs, d), (known, t) = _side(rows.filter(rows["asks"])), _side(rows.filter(pc.invert(rows["asks"])))
        found = list(_hits(d, t, before)) if len(docs) and len(known) else []
        g, j, score = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        if pairs == "best":
            first = np.lexsort((j, score, g))
            first = first[np.concatenate([[True], g[first][1:] != g[first][:-1]])] if len(first) else first
            g, j, score = g[first], j[first], score[first]
        by, at = docs.take(pa.array(g)), known.take(pa.array(j))
        return pa.table({"doc_id": by["doc_id"], "label": by["label"], "template": at["template"], "seq": at["seq"], "score": pa.array(score)})

    tasks = sum(ds * ts for ds, ts in large.values())
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, 3 * tasks))  # a count of its own: small rows, long work
    met = left.unionByName(right).repartition(wide, "label", "d", "t").groupBy("label", "d", "t")
    return met.applyInArrow(compare, f"doc_id {kinds['doc_id']}, label string, template {kinds['template']}, seq long, score long")


def near_pairs(docs: DataFrame, templates: DataFrame, broadcast_rows: int = BROADCAST_ROWS, before: bool = False, pairs: str = "all") -> DataFrame:
    """``doc_id, label, template, seq, score`` of all templates near a document; ``before``: with a lower ``seq`` than its own.

    With ``pairs="best"`` some that are not a document's best may be left out.
    """
    known = templates.where(F.col("full").isNotNull()).select("template", "label", "seq", *[F.col(c).alias(f"t_{c}") for c in _HASHES])
    if known.limit(broadcast_rows + 1).count() > broadcast_rows:
        return _blocks(docs, templates, pairs, before)
    asked = docs.where(F.col("full").isNotNull()).select("doc_id", "label", *[F.col("seq").alias("d_seq")] * before, *[F.col(c).alias(f"d_{c}") for c in _HASHES])
    met = asked.join(F.broadcast(known), "label")
    whole, left, right = (_far(F.col(f"d_{c}"), F.col(f"t_{c}")) for c in _HASHES)
    halves = left.isNotNull() & right.isNotNull()
    if before:
        met = met.where("seq < d_seq")
    # the cheap test first: it leaves a thousandth of the pairs for the others
    close = met.where(whole < fixed.FULL_THRESHOLD).where(~halves | (F.least(left, right) < fixed.HALF_THRESHOLD))
    return close.select("doc_id", "label", "template", "seq", (whole + F.when(halves, F.least(left, right)).otherwise(0)).cast("bigint").alias("score"))


def _equal(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """``doc_id, label, template, score`` of documents with a template at no distance: the one stored first of these.

    That is an equality join: the wholes are equal, and one half is or either side lacks halves.
    """
    halves = F.col("left").isNotNull() & F.col("right").isNotNull()
    key = lambda k, v: F.struct(F.lit(k).alias("kind"), v.cast("bigint").alias("half"))
    left, right, any_, lacks = key("left", F.col("left")), key("right", F.col("right")), key("any", F.lit(0)), key("lacks", F.lit(0))
    asked = docs.where(F.col("full").isNotNull()).select("doc_id", "label", "full", F.explode(F.when(halves, F.array(left, right, lacks)).otherwise(F.array(any_))).alias("k"))
    known = templates.where(F.col("full").isNotNull()).select("template", "label", "seq", "full", F.explode(F.when(halves, F.array(left, right, any_)).otherwise(F.array(lacks, any_))).alias("k"))
    known = known.groupBy("label", "full", "k").agg(F.min_by("template", "seq").alias("template"), F.min("seq").alias("seq"))
    return asked.join(known, ["label", "full", "k"]).groupBy("doc_id", "label").agg(F.min_by("template", "seq").alias("template")).withColumn("score", F.lit(0).cast("bigint"))


def match_templates(docs: DataFrame, templates: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, label, template, score``: the nearest template of the label, ties to the one stored first.

    ``docs`` has ``doc_id, label, full, left, right``; ``templates`` has ``template, label, seq, full, left, right``.
    A few templates (counted) go to every task and are compared there one by one. With many, documents whose hashes are
    a template's are settled by an equality join, for nothing is nearer; only the others are compared, block by block.
    """
    best = F.min_by(F.struct("template", "score"), F.struct("score", "seq"))
    nearest = lambda some: near_pairs(some, templates, broadcast_rows, pairs="best").groupBy("doc_id", "label").agg(best.alias("b")).select("doc_id", "label", "b.*")
    if templates.where(F.col("full").isNotNull()).limit(broadcast_rows + 1).count() <= broadcast_rows:
        return nearest(docs)
    equal = stored(_equal(docs, templates))
    rest = stored(docs.where(F.col("full").isNotNull()).select("doc_id", "label", *_HASHES).join(equal, ["doc_id", "label"], "left_anti"))
    return equal.unionByName(nearest(rest)) if rest.take(1) else equal


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by label and order to ``doc_id, label, leader, is_leader``; a row is compared with all leaders of its label at once."""
    label, ids, kept, n = object(), np.zeros(0, np.int64), np.zeros((0, 3), np.uint64), 0
    for batch in batches:
        hashes = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in (2, 3, 4)], 1)
        docs, labels = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        leader, leads = np.zeros(len(docs), np.int64), np.zeros(len(docs), bool)
        for r, h in enumerate(hashes):
            if labels[r] != label:
                label, n = labels[r], 0
            far = np.bitwise_count(kept[:n, 0] ^ h[0])
            near = np.flatnonzero(far < fixed.FULL_THRESHOLD)
            half = np.bitwise_count(kept[near, 1:] ^ h[1:]).min(1) if len(near) else near
            fine = half < fixed.HALF_THRESHOLD
            if fine.any():
                near, half = near[fine], half[fine]
                leader[r] = ids[near[np.argmin(far[near].astype(int) + half)]]
                continue
            if n == len(ids):
                ids, kept = np.resize(ids, max(64, 2 * n)), np.resize(kept, (max(64, 2 * n), 3))
            ids[n], kept[n], n = docs[r], h, n + 1
            leader[r], leads[r] = docs[r], True
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leader), pa.array(leads)], ["doc_id", "label", "leader", "is_leader"])


def leader_clusters(docs: DataFrame, known: DataFrame | None = None, first_round: int = FIRST_ROUND, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, label, leader, is_leader``: in order of ``seq``, a document joins the nearest leader of its
    label before it or becomes one. ``known`` leaders (``template`` in place of ``doc_id``) stand before all.

    Whether a document leads depends on those before it, which is a fold; but the fold has to see only documents
    that can't be told without it. Of documents with equal hashes only the first can lead. These go in rounds of growing
    length: the documents of a round are matched with the leaders so far, in parallel, and what stays open is told by
    :func:`_leading`. Few rows are open once layouts have been seen. A last join finds the nearest leaders.
    """
    cols = ["doc_id", "label", "seq", *_HASHES]
    hashed = docs.where(F.col("full").isNotNull() & F.col("left").isNotNull() & F.col("right").isNotNull()).select(*cols)
    if known is None and hashed.limit(first_round + 1).count() <= first_round:
        return _folded(hashed)
    hashed = stored(hashed)
    firsts = stored(hashed.groupBy("label", *_HASHES).agg(F.min_by("doc_id", "seq").alias("doc_id"), F.min("seq").alias("seq")).select(*cols))
    n = firsts.count()
    rounds = min(MOST_ROUNDS, max(0, math.ceil(math.log(n / first_round, GROWTH)))) if n > first_round else 0
    leaders = stored(known.select(F.col("template").cast("long").alias("template"), *cols[1:])) if known is not None else None
    shares = [float(GROWTH) ** -k for k in range(rounds, 0, -1)]
    cuts = firsts.approxQuantile("seq", shares, float(GROWTH) ** -(rounds + 1)) if shares else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = firsts.where((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        if leaders is not None:
            part = _without(part, leaders, broadcast_rows)
        more = _leading(part, first_round, broadcast_rows).select(F.col("doc_id").alias("template"), *cols[1:])
        leaders = stored(more if leaders is None else leaders.unionByName(more))
    as_leader = leaders.select(F.col("template").alias("leader"), "label", *_HASHES)
    # the copies of a leader, itself included, have no nearer one
    copies = hashed.join(as_leader, ["label", *_HASHES]).select("doc_id", "label", "leader", (F.col("doc_id") == F.col("leader")).alias("is_leader"))
    others = hashed.join(as_leader, ["label", *_HASHES], "left_anti")
    best = F.min_by("template", F.struct("score", "seq"))
    led = near_pairs(others, leaders, broadcast_rows, before=True, pairs="best").groupBy("doc_id", "label").agg(best.alias("leader"))
    return copies.unionByName(led.withColumn("is_leader", F.lit(False)))


def _folded(some: DataFrame) -> DataFrame:
    shape = "doc_id long, label string, leader long, is_leader boolean"
    return some.repartition("label").sortWithinPartitions("label", "seq").select("doc_id", "label", *_HASHES).mapInArrow(_fold, shape)


def _without(some: DataFrame, leaders: DataFrame, broadcast_rows: int) -> DataFrame:
    """Documents with no leader near and before them."""
    return some.join(near_pairs(some, leaders, broadcast_rows, before=True, pairs="best").select("doc_id").distinct(), "doc_id", "left_anti")


def _leading(some: DataFrame, few: int, broadcast_rows: int) -> DataFrame:
    """Those of ``some`` documents that lead, where no other has to be looked at.

    A document with none near and before it leads, and all that are near a leader before them don't: two comparisons that
    need no order. What neither tells goes through them again, and through the fold once it is few, or after some passes.
    """
    told = None
    for _ in range(MOST_PASSES):
        some = stored(some)
        if some.limit(few + 1).count() <= few:
            break
        lead = stored(_without(some, some.withColumnRenamed("doc_id", "template"), broadcast_rows))
        some = _without(some.join(lead.select("doc_id"), "doc_id", "left_anti"), lead.withColumnRenamed("doc_id", "template"), broadcast_rows)
        told = lead if told is None else told.unionByName(lead)
    else:
        some = stored(some)
    last = some.join(_folded(some).where("is_leader").select("doc_id"), "doc_id")
    return last if told is None else told.unionByName(last)


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row stored under each key: how a store that overwrites reads."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
