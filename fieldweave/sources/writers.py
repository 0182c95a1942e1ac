"""Sinks: results per document, all results together, the cache, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .readers import file_stem


def result_maps(values: DataFrame) -> DataFrame:
    """``doc_id, field, fpos, value`` to one map per document, fields in schema order, nulls kept."""
    entries = F.sort_array(F.collect_list(F.struct("fpos", "field", "value")))
    return values.groupBy("doc_id").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["field"], e["value"]))).alias("extracted_data"))


def as_json(data):
    return F.to_json(data, {"ignoreNullFields": "false"})


def output_names(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """``results`` with ``stem``: a document's file name without its ending; equal names of different paths get a digest of the path."""
    stem = file_stem(F.col(key))
    several = F.count("*").over(W.partitionBy("stem")) > 1
    named = results.withColumn("stem", stem)
    return named.withColumn("stem", F.when(several, F.concat("stem", F.lit("-"), F.substring(F.md5(F.col(key)), 1, 8))).otherwise(F.col("stem")))


def write_documents(results: DataFrame, path: str, key: str = "doc_id", code_version: str | None = None) -> DataFrame:
    """A file ``<stem>.json`` for each document with its fields only, indented, nulls kept; ``key, file`` of what was written.

    With ``code_version`` a file ``<stem>.meta.json`` with the version stands beside it. A task that runs again writes the
    same files again. Results in their millions belong into :func:`write_combined`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        for batch in batches:
            for stem, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts = {f"{stem}.json": json.dumps(json.loads(data), ensure_ascii=False, indent=2)}
                if code_version is not None:
                    texts[f"{stem}.meta.json"] = json.dumps({"code_version": code_version}, indent=2)
                for name, text in texts.items():
                    with system.open_output_stream(f"{at}/{name}") as out:
                        out.write(text.encode())
            files = [f"{path}/{s}.json" for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string())], ["key", "file"])

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at, recursive=True)
    rows = output_names(results, key).select(F.col(key).cast("string").alias("key"), "stem", as_json("extracted_data").alias("data"))
    rows.mapInArrow(run, "key string, file string").write.format("noop").mode("overwrite").save()
    return rows.select("key", F.concat(F.lit(f"{path}/"), "stem", F.lit(".json")).alias("file"))


def write_combined(results: DataFrame, path: str) -> None:
    """All result records, written once, as JSON lines with their nulls."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_cache(results: DataFrame, path: str, code_version: str) -> None:
    """Cache entries of results (``doc_id, extracted_data``): their fields and values, the version of the code, the time of writing."""
    entries = results.select(F.col("doc_id").cast("string").alias("key"), F.current_timestamp().alias("mtime"), F.map_keys("extracted_data").alias("fields"), F.lit(code_version).alias("code_version"), "extracted_data")
    entries.write.mode("append").parquet(path)


def report_lines(parts: dict[str, DataFrame], most: int = 10) -> Iterator[str]:
    """A text report of an evaluation, line by line: totals, all files by name, missing and extra ones, all errors by count.

    Only missing and extra files stop, at ``most``; the rest is streamed and never held at once.
    """
    for r in parts["accuracy"].where("overall = 1").take(1):
        yield f"fields {r.total_fields}, correct {r.correct_fields}, accuracy {r.accuracy:.2f} %"
    for r in parts["accuracy"].where("overall = 0").orderBy("file").toLocalIterator():
        yield f"  {r.file}: {r.correct_fields}/{r.total_fields}"
    for side in ("missing", "extra"):
        found = parts["files"].where(F.col("side") == side).orderBy("file").limit(most).collect()
        if found:
            yield f"{side}: {', '.join(r.file for r in found)}"
    for r in parts["errors"].orderBy(F.desc("errors"), "field", "nth").toLocalIterator():
        yield f"  {r.field} ({r.errors}) {r.file}: {r.predicted!r} instead of {r.gold!r}"


def report(parts: dict[str, DataFrame], most: int = 10) -> str:
    return "\n".join(report_lines(parts, most))
