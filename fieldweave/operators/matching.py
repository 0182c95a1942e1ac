"""Joins of fields with blocks: the best block by score, first matches by content, boxes shared by fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scores import block_scores
from ..functions.text import strip
from .blocks import page_sizes, size_or_default

BOX = ("x0", "y0", "x1", "y1", "page")


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in BOX])


def score_blocks(refs: DataFrame, blocks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every field with every block of its page, with ``scores``.

    ``refs`` has ``doc_id, field, ref`` (a box), ``avg_length`` and ``type`` (null if unknown). Page sizes come
    from all blocks of the document. Documents join by key; a document's blocks stay together.
    """
    sized = blocks.join(page_sizes(blocks), "doc_id")
    width, height = size_or_default(F.col("width"), F.col("height"))
    pairs = refs.join(sized.withColumnRenamed("page", "_page"), "doc_id").where(F.coalesce("_page", F.lit(0)) == F.coalesce(F.col("ref.page"), F.lit(0)))
    there = F.struct("x0", "y0", "x1", "y1", F.col("_page").alias("page"))
    scores = block_scores(F.col("ref"), there, F.coalesce("text", F.lit("")), F.col("avg_length"), F.col("type"), width, height)
    return pairs.select(*refs.columns, *keep, "block_idx", "text", there.alias("box"), scores.alias("scores"))


def best_blocks(refs: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """The block of each field: the best score, ties to the earlier block, 0.3 at least.

    Is the best text longer than 1.8 times the average, the next one of at most 1.5 times takes its place, if its
    score is 0.25 or more and its length's above 0.3; else there is none. One window over a field's
    blocks: the decision for the best and the substitute are aggregates, not another sort.
    """
    scored = score_blocks(refs, blocks)
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    order = W.partitionBy(*by).orderBy(F.desc("scores.score"), "block_idx")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("_first_length", F.first(n).over(order))
    avg = F.when(F.col("avg_length") > 0, F.col("avg_length"))
    too_long = F.coalesce(F.col("_first_length") > avg * 1.8, F.lit(False))
    fine = F.when(~too_long, (F.col("rank") == 1) & (F.col("scores.score") >= fixed.MIN_SCORE)).otherwise(
        (F.col("rank") > 1) & (n <= avg * 1.5) & (F.col("scores.score") >= 0.25) & (F.col("scores.length") > 0.3)
    )
    cols = [c for c in scored.columns if c not in by]
    return ranked.where(fine).groupBy(*by).agg(F.min_by(F.struct(*cols), "rank").alias("b")).select(*by, "b.*")


def top_blocks(refs: DataFrame, blocks: DataFrame, most: int = 3, by: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """The ``most`` best blocks of each field with their scores and ``rank``: what a decision was taken from."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("scores.score"), "block_idx"))
    return score_blocks(refs, blocks).withColumn("rank", rank).where(F.col("rank") <= most)


def first_match(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where each value stands: ``doc_id, field, value, block_idx, mode`` and the block's box.

    Texts compare trimmed and in lower case. Equal is ``exact``; else one must hold the other and the value be
    shorter than 0.9 of the block: ``partial``. The first such block wins. Blank values have no place.
    """
    # both are brought to one form before they meet: after the join, that would be done anew in each comparison of each pair
    wanted = values.withColumn("_v", F.lower(strip(F.col("value")))).where("_v <> ''")
    pairs = wanted.join(blocks.withColumn("_t", F.lower(strip(F.coalesce("text", F.lit(""))))), "doc_id")
    exact = F.col("_v") == F.col("_t")
    partial = (F.contains("_t", "_v") | F.contains("_v", "_t")) & (F.length("_v") < F.length("_t") * fixed.PARTIAL_RATIO)
    found = pairs.where(exact | partial).withColumn("mode", F.when(exact, "exact").otherwise("partial"))
    place = [c for c in ("block_idx", "page", "text", "x0", "y0", "x1", "y1") if c in blocks.columns]
    at = F.struct(*[F.col(c) for c in ("page", "block_idx") if c in place])
    return found.groupBy(*values.columns).agg(F.min_by(F.struct("mode", *place), at).alias("m")).select(*values.columns, "m.*")


def same_box(refs: DataFrame, near: float = fixed.SAME_BOX, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of fields whose boxes start within ``near`` of each other on one page, both ways and themselves.

    ``refs`` has ``field, fpos, page, x0, y0``. A band join: starts fall into cells as wide as the band, one side asks
    its cell and the neighbours, so it is an equality join however many boxes there are.
    """
    cell = lambda c: F.floor(c / near).cast("long")
    left = refs.select(*by, "page", F.col("field").alias("a"), F.col("x0").alias("ax"), F.col("y0").alias("ay"))
    left = left.withColumn("cx", F.explode(F.sequence(cell(F.col("ax")) - 1, cell(F.col("ax")) + 1))).withColumn("cy", F.explode(F.sequence(cell(F.col("ay")) - 1, cell(F.col("ay")) + 1)))
    right = refs.select(*by, "page", F.col("field").alias("b"), F.col("fpos").alias("b_pos"), F.col("x0").alias("bx"), F.col("y0").alias("by"), cell(F.col("x0")).alias("cx"), cell(F.col("y0")).alias("cy"))
    met = left.join(right, [*by, "page", "cx", "cy"])
    return met.where((F.abs(F.col("ax") - F.col("bx")) < near) & (F.abs(F.col("ay") - F.col("by")) < near)).select(*by, "page", "a", "b", "b_pos")
