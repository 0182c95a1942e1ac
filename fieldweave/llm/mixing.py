"""Mixing sources to target weights by systematic sampling.

Each document expects ``target / source_size`` copies. Documents of a source stand in a fixed
order, a prefix sum of the expected copies runs along it from one random offset, and a document is
emitted once for each integer that its step crosses. The order goes by size class, so a source's
words come as near to its target as its copies do.

Scale: only counts for each (source, size class, bucket) are summed across a source; the running
number inside such a cell comes from a window over the cell alone. ``bucket`` splits a source (or
a size that a third of all rows share) into cells of about ``cell_rows`` rows at any input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize
from .tables import WORD, fresh

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, CEILING, CELL_ROWS, SEED = 1.5, 2.0, 16384, 7


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cells(source: str, key: str, size: Column, buckets: int) -> list[Column]:
    """Source (null apart from every string), size class and bucket of a row."""
    return [
        F.col(source).isNull().alias("_null"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.length(F.bin(size)).alias("_class"),
        F.coalesce(F.pmod(F.col(key), F.lit(buckets)), F.lit(0)).cast("long").alias("_bucket"),
    ]


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``(_null, _source, source_size)`` to the same with ``target``.

    Sources by code point, null last, take ``weights`` in turn. ``share`` of all sizes is divided by
    weight; a target stops at ``ceiling`` times its source's size and the excess goes to the others
    by weight until none is above. In order of ``ceiling * size / weight`` the capped sources come
    first, so the level of the rest follows from running sums. It rises while sources that are above
    their ceiling are set to it and falls beyond them: the highest level is the one. No loop is needed.
    """
    order = W.orderBy("_null", F.encode("_source", "UTF-8"))
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    ranked = W.orderBy("_ratio", "_null", F.encode("_source", "UTF-8"))
    all_rows = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (share * F.col("_all") - F.coalesce(F.sum("_cap").over(before), zero)) / F.sum("_weight").over(ranked.rowsBetween(W.currentRow, W.unboundedFollowing))
    return (
        sizes.select("_null", "_source", "source_size", weight.alias("_weight"), F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_all"))
        .withColumn("_cap", ceiling * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(all_rows))
        .select("_null", "_source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))
    )


def mix_sources(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", *, weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, ceiling: float = CEILING, cell_rows: int = CELL_ROWS, seed: int = SEED, size: str | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` and a struct column ``mix`` (``size, source_size, target, copies``).

    ``size`` names a column that already holds sizes (whole numbers); else words of ``text`` count.
    A null text has size 0, a null source is a source of its own, repeated rows count one by one,
    ties of size go by ``key``, a null key stands first, an empty table gives an empty result. Where
    ``docs`` has a column ``mix``, the new one is called ``mix_``. A source of size 0 has target 0
    and copies 0.
    """
    buckets = max(1, -(-docs.count() // cell_rows))
    own = fresh(docs, "mix")
    keys = ["_null", "_source", "_class", "_bucket"]
    # plain columns beside those of docs, so that what the caller doesn't ask for is never read or moved
    outer = [f"_mix{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, outer, strict=True))
    rows = docs.toDF(*outer)
    measured = F.coalesce(F.col(at[size]), F.lit(0)).cast("long") if size else word_count(F.col(at[text]))
    rows = rows.withColumn("_size", measured)
    rows = rows.select("*", *_cells(at[source], at[key], F.col("_size"), buckets))
    cells = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum")), "cells")
    targets = source_targets(cells.groupBy("_null", "_source").agg(F.sum("_sum").alias("source_size")), weights, share, ceiling)
    before = W.partitionBy("_null", "_source").orderBy("_class", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_source"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    starts = starts.join(targets, ["_null", "_source"]).select(*keys, "_start", "source_size", "target", offset.alias("_offset"))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy("_size", at[key])))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("_start") + F.col("_nth")
    copies = (F.floor(upto * F.col("_step") + F.col("_offset")) - F.floor((upto - 1) * F.col("_step") + F.col("_offset"))).cast("long")
    joined = rows.join(starts, keys).withColumn("_step", step)
    return joined.select(*[F.col(n).alias(c) for n, c in zip(outer, docs.columns, strict=True)], F.struct(F.col("_size").alias("size"), "source_size", "target", copies.alias("copies")).alias(own))


def take_mix(mixed: DataFrame, mix: str = "mix") -> DataFrame:
    """The mix itself: each row as often as it is taken, without the column ``mix``."""
    return mixed.where(F.col(mix)["copies"] > 0).withColumn(mix, F.explode(F.array_repeat(F.lit(1), F.col(mix)["copies"].cast("int")))).drop(mix)


def query(spark, sf_dir: str) -> DataFrame:
    """``op8_mix_sources``: sizes, targets and words taken of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = F.col("mix")
    # words are counted once and kept beside the keys: counts and steps then read no text
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix_sources(sized, size="size").select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).alias("taken"))


SQL = rf"""
WITH docs AS (
  SELECT doc_id, source IS NULL AS src_null, coalesce(source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (SELECT greatest(1, CAST(ceil(count(*) / {CELL_ROWS}.0) AS BIGINT)) FROM documents) AS buckets
  FROM documents
), keyed AS (
  SELECT *, length(bin(size)) AS cls, coalesce(((doc_id % buckets) + buckets) % buckets, 0) AS bucket FROM docs
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY src_null, src ORDER BY cls, bucket, size, doc_id NULLS FIRST) AS nth,
         CAST(sum(size) OVER (PARTITION BY src_null, src) AS BIGINT) AS source_size
  FROM keyed
), sources AS (
  SELECT src_null, src, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][((row_number() OVER (ORDER BY src_null, encode(src)) - 1) % 3) + 1] AS DOUBLE) AS weight
  FROM keyed GROUP BY src_null, src
), ratios AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * total
     - coalesce(sum(cap) OVER (ORDER BY ratio, src_null, encode(src) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / sum(weight) OVER (ORDER BY ratio, src_null, encode(src) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM ratios
), targets AS (
  SELECT src_null, src, least(cap, weight * max(lvl) OVER ()) AS target FROM levels
), steps AS (
  SELECT o.*, t.target, CASE WHEN source_size > 0 THEN t.target / source_size ELSE 0.0::DOUBLE END AS step,
         CAST(('0x' || substr(md5('{SEED}:' || o.src), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS off
  FROM ordered o JOIN targets t ON o.src_null = t.src_null AND o.src = t.src
)
SELECT doc_id, size, source_size, target,
       CAST((floor(nth * step + off) - floor((nth - 1) * step + off)) * size AS BIGINT) AS taken
FROM steps
"""
