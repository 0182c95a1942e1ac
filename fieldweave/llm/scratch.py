"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset and all runs on one
machine (tests, a laptop) a local temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_paths: dict[str, list[tuple[SparkSession, str]]] = defaultdict(list)
_scope = ["session"]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a slash at its end."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes with its scope or with the driver."""
    path = f"{shared_dir(spark)}/fieldweave-{name}-{uuid.uuid4().hex}"
    _paths[_scope[0]].append((spark, path))
    return path


#: What goes to a Python worker at once: texts of any length are bounded by bytes, and both sides hold a few of these batches.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside send :data:`BATCHES`; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written inside belong to ``name``."""
    before, _scope[0] = _scope[0], name
    try:
        yield
    finally:
        _scope[0] = before


def release(name: str) -> None:
    """Delete what was written under ``name``; call it once results are stored elsewhere."""
    for spark, path in _paths.pop(name, []):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: its folder goes with it
            return


@atexit.register
def _release_all() -> None:
    for name in list(_paths):
        release(name)
