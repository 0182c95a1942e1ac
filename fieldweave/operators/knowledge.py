"""What is known of a label's fields: types, lengths, modes, patterns and delimiters, all by aggregation.

Knowledge is a fold over observations in order, but everything in it depends on counts and on which
kind was seen first; so it is grouped sums with a least sequence number, partial before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, infer_type, strip


def first_most(rows: DataFrame, by: list[str], kind: str, order: str) -> DataFrame:
    """The most frequent ``kind`` of each group, a tie to the one seen first, with its count."""
    counts = rows.groupBy(*by, kind).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(kind, "n"), F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{kind}", "b.n")


def learn_fields(rows: DataFrame, by: tuple[str, ...] = ("template_id", "field"), order: str = "seq") -> DataFrame:
    """``rows`` with ``value``, ``mode`` and ``seq`` to ``type, avg_length, n, type_history, extraction_mode, mode_history``.

    Blank values are not observed, a null ``mode`` counts for no mode. ``avg_length`` is the mean of trimmed lengths.
    """
    keys = list(by)
    seen = rows.where(~blank(F.col("value"))).select(*keys, order, infer_type(F.col("value")).alias("type"), F.col("mode").alias("extraction_mode"), F.length(strip(F.col("value"))).alias("_n"))
    base = seen.groupBy(*keys).agg(F.avg("_n").alias("avg_length"), F.count("*").alias("n"))
    for kind, history in (("type", "type_history"), ("extraction_mode", "mode_history")):
        counts = seen.where(F.col(kind).isNotNull()).groupBy(*keys, kind).agg(F.count("*").alias("c"), F.min(order).alias("first"))
        told = F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("first", kind, "c"))), lambda e: F.struct(e[kind], e["c"])))
        base = base.join(counts.groupBy(*keys).agg(told.alias(history)), keys, "left").withColumn(kind, most_frequent(F.col(history)))
    return base


def most_frequent(history: Column) -> Column:
    """The kind with the highest count of a map in order of first sight; a tie goes to the one seen first."""
    ranked = F.transform(F.map_entries(history), lambda e, i: F.struct(e["value"].alias("n"), (-i).alias("i"), e["key"].alias("kind")))
    return F.array_max(ranked)["kind"]


def _merge_history(old: Column, new: Column) -> Column:
    """Counts of both; kinds keep the order in which they were first seen."""
    none = F.create_map().cast("map<string,bigint>")
    a, b = F.coalesce(old, none), F.coalesce(new, none)
    seen = F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("key"), (e["value"] + F.coalesce(F.try_element_at(b, e["key"]), F.lit(0))).alias("value")))
    more = F.filter(F.map_entries(b), lambda e: ~F.map_contains_key(a, e["key"]))
    return F.map_from_entries(F.concat(seen, more))


def merge_knowledge(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ("template_id", "field")) -> DataFrame:
    """Stored knowledge with what was learned since, as if all observations had come in order.

    Both have the columns of :func:`learn_fields` and maybe ``label``. Counts and histories add up, the mean is weighted by
    its counts, and type and mode are the most frequent again. Fields that one side lacks stay as the other has them.
    """
    keys = list(by)
    side = lambda df, x: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(x))
    joined = side(old, "a").join(side(new, "b"), keys, "full")
    n0, n1 = F.coalesce("a.n", F.lit(0)).cast("long"), F.coalesce("b.n", F.lit(0)).cast("long")
    mean = (F.coalesce("a.avg_length", F.lit(0.0)) * n0 + F.coalesce("b.avg_length", F.lit(0.0)) * n1) / (n0 + n1)
    types, modes = _merge_history(F.col("a.type_history"), F.col("b.type_history")), _merge_history(F.col("a.mode_history"), F.col("b.mode_history"))
    label = [F.coalesce("a.label", "b.label").alias("label")] if "label" in old.columns and "label" in new.columns else []
    out = joined.select(*keys, *label, mean.alias("avg_length"), (n0 + n1).alias("n"), types.alias("type_history"), modes.alias("mode_history"))
    return out.withColumns({"type": most_frequent(F.col("type_history")), "extraction_mode": most_frequent(F.col("mode_history"))}).select(old.columns)


def running_mean(average, value, n):
    """The mean of ``n`` values and one more."""
    return F.when(n == 0, value.cast("double")).otherwise((average * n + value) / (n + 1))


def learn_patterns(rows: DataFrame, by: tuple[str, ...] = ("template_id",), sequence: str = "sequence", order: str = "seq") -> DataFrame:
    """Sequences of types with their frequency and first place; the reader takes the first one, not the most frequent."""
    return rows.groupBy(*by, sequence).agg(F.count("*").alias("frequency"), F.min(order).alias("first"))


def learn_delimiters(rows: DataFrame, by: tuple[str, ...] = ("template_id",), delimiter: str = "delimiter", order: str = "seq", most: int = 5, counted: bool = False) -> DataFrame:
    """The ``most`` frequent delimiters of each template, ties to the one seen first; ``counted``: rows have ``frequency`` and ``first``."""
    counts = rows if counted else rows.groupBy(*by, delimiter).agg(F.count("*").alias("frequency"), F.min(order).alias("first"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("frequency"), "first"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def run_stats(times: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Count, total, least, greatest, median, mean, sample deviation (0 for one value) and the first value."""
    v = F.col(value)
    return times.groupBy(*by).agg(
        F.count(v).alias("count"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"),
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min_by(v, F.struct(*order)).alias("first"),
    )
