"""Results that can be used again: an entry is valid for an input no newer, one code version and known fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probe(requests: DataFrame, entries: DataFrame, code_version: str | None = None) -> DataFrame:
    """``requests`` (``key, mtime, fields``) with ``hit`` and ``reason``, by ``entries`` (``key, mtime, fields, code_version``).

    Of several entries of a key, as rewriting leaves them, the one written last counts.
    """
    joined = requests.join(latest(entries), "key", "left")
    stale = F.col("mtime").isNull() | (F.col("mtime") > F.col("e.mtime"))
    other = F.lit(False) if code_version is None else F.coalesce(F.col("e.code_version") != code_version, F.lit(True))
    lacking = F.size(F.array_except("fields", "e.fields")) > 0
    reason = F.when(F.col("e").isNull(), "absent").when(stale, "stale").when(other, "version").when(lacking, "fields")
    return joined.select(*requests.columns, reason.isNull().alias("hit"), reason.alias("reason"))


def latest(entries: DataFrame) -> DataFrame:
    """``key, e``: the last entry of each key."""
    return entries.groupBy("key").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "key"]), "mtime").alias("e"))


def hits(requests: DataFrame, entries: DataFrame, code_version: str | None = None) -> DataFrame:
    return probe(requests, entries, code_version).where("hit").select(*requests.columns)


def misses(requests: DataFrame, entries: DataFrame, code_version: str | None = None) -> DataFrame:
    return requests.join(hits(requests, entries, code_version).select("key"), "key", "left_anti")


def project(values, fields):
    """Cached values (a map) of the requested fields only; fields without a value are null."""
    return F.map_from_arrays(fields, F.transform(fields, lambda f: F.try_element_at(values, f)))


def same_schema(a, b):
    return F.array_sort(a) == F.array_sort(b)


def code_version(modules: DataFrame) -> DataFrame:
    """One row: 16 hex digits over the modules' digests in order; a missing module counts by its name.

    ``modules`` has ``seq, name, content`` (binary or null); a handful of rows.
    """
    part = F.coalesce(F.sha2("content", 256), F.col("name"))
    told = F.array_join(F.sort_array(F.collect_list(F.struct("seq", part.alias("p"))))["p"], "")
    return modules.agg(F.substring(F.sha2(told, 256), 1, 16).alias("code_version"))


def without(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries after clearing: all, or those of some keys, lose their version and so never hit again."""
    gone = F.lit(True) if keys is None else F.col("key").isin(keys)
    return entries.withColumn("code_version", F.when(~gone, F.col("code_version")))
