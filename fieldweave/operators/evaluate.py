"""Accuracy against gold values: long tables ``file, field, value`` on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold


def compare_fields(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``file, field, predicted, gold, matched`` over the union of fields, for files on both sides.

    A field that one side lacks is null there; null equals empty; values compare folded. A file without
    fields is a row with a null field: it counts as a file, not as a field.
    """
    files = predicted.select("file").intersect(gold.select("file"))
    p, g = (x.where(F.col("field").isNotNull()).join(files, "file", "left_semi").select("file", "field", F.col("value").alias(n)) for x, n in ((predicted, "predicted"), (gold, "gold")))
    return p.join(g, ["file", "field"], "full").select("file", "field", "predicted", "gold", (fold(F.col("predicted")) == fold(F.col("gold"))).alias("matched"))


def accuracy(compared: DataFrame) -> DataFrame:
    """Fields, matches and percent for each file, and for all files together (``file`` null)."""
    out = compared.rollup("file").agg(F.count("*").alias("total_fields"), F.count_if("matched").alias("correct_fields"), F.grouping("file").alias("overall"))
    return out.withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct_fields") * 100.0, F.col("total_fields")), F.lit(0.0)))


def missing_files(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``file, side``: gold files without a result are ``missing``, results without gold ``extra``."""
    p, g = predicted.select("file").distinct(), gold.select("file").distinct()
    return g.join(p, "file", "left_anti").select("file", F.lit("missing").alias("side")).unionByName(p.join(g, "file", "left_anti").select("file", F.lit("extra").alias("side")))


def error_report(compared: DataFrame, examples: int = 5, width: int = 50) -> DataFrame:
    """Up to ``examples`` errors of each field by file name, with the field's number of errors; values cut."""
    wrong = compared.where(~F.col("matched"))
    counts = wrong.groupBy("field").agg(F.count("*").alias("errors"))
    nth = F.row_number().over(W.partitionBy("field").orderBy("file"))
    cut = lambda c: F.substring(F.coalesce(c, F.lit("null")), 1, width).alias(c)
    return wrong.withColumn("nth", nth).where(F.col("nth") <= examples).join(counts, "field").select("field", "errors", "nth", "file", cut("predicted"), cut("gold"))


def evaluate(predicted: DataFrame, gold: DataFrame) -> dict[str, DataFrame]:
    """All parts of an evaluation by name."""
    compared = compare_fields(predicted, gold)
    return {"fields": compared, "accuracy": accuracy(compared), "files": missing_files(predicted, gold), "errors": error_report(compared)}
