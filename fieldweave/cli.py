"""The engine from a shell.

``python -m fieldweave.cli run DATASET --results DIR`` works through a data set, ``... evaluate RESULTS GOLD`` compares folders
of results, ``... dataset DATASET`` counts the valid entries of each label.
"""

from __future__ import annotations

import argparse
import sys
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate
from .plans import providers
from .plans.config import Config
from .plans.run import Documents, read_documents
from .plans.run import run as run_dataset
from .sources import readers, writers


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


def _documents(spark: SparkSession, a) -> Documents:
    """PDF files, or tables of blocks and hashes that were made elsewhere."""
    if not a.blocks:
        return read_documents(spark, a.files)
    blocks = spark.read.parquet(a.blocks)
    hashes = spark.read.parquet(a.hashes) if a.hashes else spark.createDataFrame([], readers.HASHES)
    if a.mtimes:
        files = spark.read.parquet(a.mtimes)
    else:
        files = blocks.select("doc_id").distinct().withColumn("mtime", F.lit(0).cast("timestamp"))
    return Documents(blocks, hashes, files, spark.createDataFrame([], "doc_id string, error string"))


def _run(spark: SparkSession, a) -> None:
    entries = readers.read_dataset(spark, a.path)
    if a.answers:
        table = readers.read_results(spark, a.answers).withColumnRenamed("file", "stem").where("field is not null")
        keys = entries.select(F.concat("pdf_path", F.lit("#"), F.col("entry_idx").cast("string")).alias("doc_id"), readers.file_stem(F.col("pdf_path")).alias("stem"))
        provider = providers.TableProvider(keys.join(table, "stem").select("doc_id", "field", "value"))
    elif a.provider:
        provider = providers.CallProvider(_named(a.provider))
    else:
        raise ValueError("who answers for fields? --provider module:function or --answers FOLDER")
    flexible = set(a.flexible or [])
    if a.classifier:
        classify = lambda labels: providers.ask_structures(labels, _named(a.classifier))
    else:
        classify = lambda labels: labels.select("label", F.when(F.col("label").isin(*flexible), "flexible").otherwise("stricted").alias("structure"), F.lit(None).cast("string").alias("error"))
    config = Config(benchmark=a.benchmark, cache=not a.no_cache, incremental=not a.no_combined, batches=a.batches)
    done = run_dataset(spark, entries, _documents(spark, a), provider, classify, results=a.results, memory=a.memory, config=config)
    if a.benchmark:
        s = done.stats()
        print("\n=== Benchmark Summary ===")
        print(f"Files: {s['count']}")
        print(f"Total: {s['total_s']:.3f}s | First: {s['first_s']:.3f}s")
        print(f"Min: {s['min_s']:.3f}s | Median: {s['median_s']:.3f}s | Mean: {s['mean_s']:.3f}s | Std: {s['std_s']:.3f}s | Max: {s['max_s']:.3f}s")
        print("\n=== LLM Usage ===")
        print(f"Fields via LLM: {s['llm_fields_used']} / {s['total_fields']}")


def main(argv: list[str] | None = None) -> int:
    """0, or 1 with the reason on standard error."""
    p = argparse.ArgumentParser(prog="fieldweave")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="what", required=True)
    r = sub.add_parser("run", help="extract the fields of a data set")
    r.add_argument("path")
    r.add_argument("--files", default="files", help="folder or pattern of the PDF files")
    r.add_argument("--blocks", help="Parquet table of blocks instead of PDF files; with --hashes and --mtimes")
    r.add_argument("--hashes")
    r.add_argument("--mtimes")
    r.add_argument("--results", default="results")
    r.add_argument("--memory", default="templates")
    r.add_argument("--provider", help="module:function that gives a function (text, {field: description}) to JSON")
    r.add_argument("--answers", help="folder of JSON results that answer instead of a service")
    r.add_argument("--classifier", help="module:function that gives a function from a label to an answer")
    r.add_argument("--flexible", nargs="*", help="labels of flexible documents where no classifier is asked")
    r.add_argument("--batches", type=int, default=1)
    r.add_argument("--benchmark", action="store_true")
    r.add_argument("--parallel", action="store_true", help="accepted for compatibility: labels always run side by side")
    r.add_argument("--no-cache", action="store_true")
    r.add_argument("--no-combined", action="store_true")
    e = sub.add_parser("evaluate", help="accuracy of a folder of results against gold values")
    e.add_argument("results")
    e.add_argument("gold")
    d = sub.add_parser("dataset", help="valid entries of a data set, by label")
    d.add_argument("path")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("fieldweave").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    try:
        if a.what == "run":
            _run(spark, a)
        elif a.what == "evaluate":
            for line in writers.report_lines(evaluate.evaluate(readers.read_results(spark, a.results), readers.read_results(spark, a.gold))):
                print(line)
        else:
            for row in readers.valid_entries(readers.read_dataset(spark, a.path)).groupBy("label").count().orderBy("label").toLocalIterator():
                print(f"{row['label']}: {row['count']}")
        return 0
    except Exception as error:  # the exit code tells a shell; the message tells a reader
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
