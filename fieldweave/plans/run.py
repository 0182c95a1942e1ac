"""A run over a data set: stored results, classification, extraction, learning, and all that is written.

Files that can't be read and labels that can't be classified concern their own documents only: these get null fields and an
error, and are not stored, so that a later run tries them again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as block_ops
from ..operators import cache
from ..operators.knowledge import run_stats
from ..sources import readers, writers
from .config import Config
from .extraction import process_with
from .memory import Memory
from .stage import stored


@dataclass(frozen=True)
class Documents:
    """What was read of the files: ``blocks`` and ``hashes`` by ``doc_id`` (the path), ``files`` (``doc_id, mtime``), ``errors`` (``doc_id, error``)."""

    blocks: DataFrame
    hashes: DataFrame
    files: DataFrame
    errors: DataFrame


@dataclass(frozen=True)
class Run:
    """``results`` (``pdf_path, label, extraction_method, template_hash, extracted_data, error``), ``times`` and counts of fields."""

    results: DataFrame
    times: DataFrame
    memory: Memory
    total_fields: int = 0
    asked_fields: int = 0

    def stats(self) -> dict:
        """Count, total, least, greatest, median, mean and deviation of the seconds of a document, the first one's, and fields asked for."""
        s = run_stats(self.times.withColumn("all", F.lit(1)), ["all"], "seconds", ["seq"]).first()
        names = {"count": "count", "total": "total_s", "min": "min_s", "max": "max_s", "median": "median_s", "mean": "mean_s", "std": "std_s", "first": "first_s"}
        out = {v: (s[k] if s else 0) for k, v in names.items()}
        return out | {"llm_fields_used": self.asked_fields, "total_fields": self.total_fields}


def code_version(spark: SparkSession) -> str:
    """A digest of the modules that results depend on."""
    rows = []
    for package in ("functions", "operators", "plans"):
        folder = resources.files(f"fieldweave.{package}")
        rows += [(f"{package}/{f.name}", bytearray(f.read_bytes())) for f in folder.iterdir() if f.name.endswith(".py")]
    modules = spark.createDataFrame([(i, *r) for i, r in enumerate(sorted(rows))], "seq int, name string, content binary")
    return cache.code_version(modules).first()[0]


def read_documents(spark: SparkSession, path: str) -> Documents:
    """Blocks and page hashes of PDF files; needs the optional PDF library."""
    files = readers.read_binary(spark, path)
    spans, hashes = stored(readers.pdf_spans(files)), stored(readers.page_hashes(files))
    errors = spans.where("error is not null").select("doc_id", "error").unionByName(hashes.where("error is not null").select("doc_id", "error"))
    return Documents(block_ops.from_spans(spans.where("error is null")), hashes.drop("error"), files.select("doc_id", "mtime"), errors.groupBy("doc_id").agg(F.min("error").alias("error")))


def _classified(labels: DataFrame, memory: Memory, classify) -> tuple[DataFrame, DataFrame]:
    """``label, structure`` and ``label, error``: what memory has, and for new labels what ``classify`` (a function of labels) gives."""
    new = labels.join(memory.structures, "label", "left_anti")
    got = stored(classify(new)) if new.take(1) else new.select("label", F.lit(None).cast("string").alias("structure"), F.lit(None).cast("string").alias("error"))
    known = memory.structures.unionByName(got.where("structure is not null").select("label", "structure"))
    return stored(known), got.where("error is not null").select("label", "error")


def run(spark: SparkSession, entries: DataFrame, documents: Documents, provider, classify, *, results: str | None = None, memory: str | None = None, config: Config = Config()) -> Run:  # noqa: B008
    """Work through ``entries`` (``entry_idx, label, pdf_path, fields`` as :func:`readers.read_dataset` gives them).

    ``provider`` answers for fields, ``classify`` gives ``label, structure, error`` for labels. ``results`` is a folder for
    results per document, all results and stored results, ``memory`` one for what was learned; either may be left out.
    """
    began = time.perf_counter()
    version = code_version(spark)
    known = Memory.load(spark, memory) if memory else Memory.empty(spark)
    rows = readers.valid_entries(entries).withColumn("doc_id", F.concat("pdf_path", F.lit("#"), F.col("entry_idx").cast("string"))).withColumn("seq", F.col("entry_idx").cast("long"))
    rows = stored(rows.select("doc_id", "pdf_path", "label", "fields", "seq"))
    of_file = lambda df: df.withColumnRenamed("doc_id", "pdf_path").join(rows.select("doc_id", "pdf_path"), "pdf_path").drop("pdf_path")
    names = F.col("fields")["name"]
    requests = rows.join(documents.files.withColumnRenamed("doc_id", "pdf_path"), "pdf_path", "left").select(F.col("pdf_path").alias("key"), "mtime", names.alias("fields"), "doc_id")
    use_cache = config.cache and results is not None
    stored_results = readers.read_cache(spark, f"{results}/cache") if use_cache else spark.createDataFrame([], readers.CACHE)
    probed = stored(cache.probe(requests, stored_results, version))
    found = probed.where("hit").join(cache.latest(stored_results), "key").select("doc_id", cache.project(F.col("e.extracted_data"), F.col("fields")).alias("extracted_data"))
    left = rows.join(probed.where("not hit").select("doc_id"), "doc_id", "left_semi")
    structures, unclassified = _classified(left.select("label").distinct(), known, classify)
    known = replace(known, structures=structures)
    lost = rows.join(documents.files.withColumnRenamed("doc_id", "pdf_path"), "pdf_path", "left_anti").select("doc_id", F.lit("the file is not there").alias("error"))
    bad = of_file(documents.errors).select("doc_id", "error").unionByName(lost).unionByName(left.join(unclassified, "label").select("doc_id", "error"))
    bad = stored(bad.join(left.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("error").alias("error")))
    work = stored(left.join(bad, "doc_id", "left_anti"))
    blocks, hashes = stored(of_file(documents.blocks)), stored(of_file(documents.hashes))
    prepared = time.perf_counter() - began
    n = work.count()
    cuts = work.approxQuantile("seq", [i / config.batches for i in range(1, config.batches)], 0.0) if config.batches > 1 and n else []
    values, times = None, []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = work.where((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        began = time.perf_counter()
        out = process_with(part.select("doc_id", "label", "fields", "seq"), blocks, hashes, structures, provider, known)
        done, known = stored(out.values), replace(out.memory, **{name: stored(getattr(out.memory, name)) for name in ("fields", "patterns")})
        values = done if values is None else values.unionByName(done)
        times.append((low, high, time.perf_counter() - began))
    maps = stored(writers.result_maps(values))
    how = values.groupBy("doc_id").agg(F.min("method").alias("extraction_method"), F.min("template").alias("template_hash"))
    nulls = F.map_from_arrays(names, F.array_repeat(F.lit(None).cast("string"), F.size("fields")))
    done = rows.join(maps, "doc_id").join(how, "doc_id").select("doc_id", "pdf_path", "label", "extraction_method", "template_hash", "extracted_data", F.lit(None).cast("string").alias("error"), "seq")
    failed = rows.join(bad, "doc_id").select("doc_id", "pdf_path", "label", F.lit(None).cast("string").alias("extraction_method"), F.lit(None).cast("string").alias("template_hash"), nulls.alias("extracted_data"), "error", "seq")
    fresh = stored(done.unionByName(failed))
    cached = rows.join(found, "doc_id").select("doc_id", "pdf_path", "label", F.lit("cached").alias("extraction_method"), F.lit(None).cast("string").alias("template_hash"), "extracted_data", F.lit(None).cast("string").alias("error"), "seq")
    whole = stored(fresh.unionByName(cached))
    if results:
        outputs = fresh.select(F.col("pdf_path").alias("doc_id"), "extracted_data", "error", "seq")
        outputs = outputs.groupBy("doc_id").agg(F.max_by(F.struct("extracted_data", "error"), "seq").alias("r")).select("doc_id", "r.*")  # of one file twice the last one stays
        writers.write_documents(outputs, f"{results}/documents", code_version=version if use_cache else None)
        if config.incremental:
            writers.write_combined(fresh.drop("doc_id", "seq"), f"{results}/output")
        if use_cache:
            writers.write_cache(outputs.where("error is null"), f"{results}/cache", version)
    if memory:
        known.save(memory)
    share = prepared / max(1, n)
    seconds = F.lit(None).cast("double")
    for low, high, s in times:
        inside = (F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high)
        docs_in = work.where(inside).count() if config.benchmark else 1
        seconds = F.when(inside, F.lit(s / max(1, docs_in) + share)).otherwise(seconds)
    raw = fresh.select("doc_id", "seq", seconds.alias("seconds")) if config.benchmark else spark.createDataFrame([], "doc_id string, seq long, seconds double")
    total = rows.agg(F.coalesce(F.sum(F.size("fields")), F.lit(0))).first()[0] if config.benchmark else 0
    asked = values.where(F.col("how").isin("asked", "asked_again", "none")).count() if config.benchmark else 0
    return Run(whole.drop("seq"), raw, known, total, asked)
