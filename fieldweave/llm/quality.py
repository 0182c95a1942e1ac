"""Document quality by hierarchical empirical Bayes.

A classifier of dense text features gives each document's evidence. Sites are judged by all of their
documents: the mean of a host is shrunk to the mean of all hosts and the mean of a path to that of its host,
each by as many documents as the spread between groups is worth (method of moments), so a sparse
site says little and a site with none of its own says what its parent says. The posterior log odds
of a document are its evidence, less the global prior, plus its path's.

Scale: texts are read once, in a map. Host and path statistics are grouped sums with partial sums
before the exchange, so a hot host is one row a task. They come back by a broadcast join where they have at
most ``broadcast_groups`` rows (counted), else by a join that can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees
from .features import Words, describe
from .scratch import materialize
from .tables import fresh
from .textbuf import pieces

SAMPLE, BROADCAST_GROUPS, KEEP, MOST_PRIOR = 12000, 20000, 0.5, 10000.0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Trees:
    """The document classifier, from at most ``sample`` labelled rows, chosen by a hash of ``key``.

    That bound makes the labels small enough to send to every task, so the texts stay where they are.
    """
    few = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(9), key).alias("o")).orderBy("o", "y").limit(sample)
    known = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), key).join(F.broadcast(few), F.col(key) == F.col("_key")).select("t", "y", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(0)):
                x = describe(Words(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(1)[first:last], batch.column(2)[first:last], pa.array([r.tobytes() for r in x], pa.binary())], ["y", "o", "x"])

    got = known.mapInArrow(run, "y int, o long, x binary").orderBy("o", "x", "y").limit(sample).collect()
    width = describe(Words(np.zeros(0, np.uint8), np.zeros(2, np.int64))).shape[1]
    return fit_trees(np.array([np.frombuffer(r["x"]) for r in got]).reshape(-1, width), np.array([r["y"] for r in got], float))


def evidence(docs: DataFrame, model: Trees, text: str, carried: list[str], names: list[str]) -> DataFrame:
    """The columns ``carried``, called ``names``, and ``raw``, the classifier's log odds; a null text is an empty one."""
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names, strict=True)], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(len(names))):
                cut = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], pa.array(model.raw(describe(Words(data, offsets))))], [*names, "raw"])

    return rows.mapInArrow(run, rows.select(*names, F.lit(0.0).alias("raw")).schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _prior_rows(groups: DataFrame, n: str, mean: str, parent: float | str) -> float:
    """How many documents the parent's mean is worth: from the spread of group means about it.

    With v = m (1 - m), the means' expected squared distance is v (1 + k) / (1 + k) / n + v / (1 + k)
    in a beta-binomial model; one k is solved for from the sums over groups.
    """
    of = F.lit(parent) if isinstance(parent, float) else F.col(parent)
    v = of * (1 - of)
    row = groups.agg(F.sum(F.col(n) * (F.col(mean) - of) ** 2).alias("q"), F.sum(v * (F.col(n) - 1)).alias("w"), F.sum(v).alias("u")).first()
    if not row["w"] or row["w"] <= 0:
        return MOST_PRIOR
    between = max((row["q"] - row["u"]) / row["w"], 0.0)  # the share of variance that lies between groups
    return min(MOST_PRIOR, max(1.0, 1 / between - 1)) if between > 0 else MOST_PRIOR


def judge(
    docs: DataFrame, model: Trees, text: str = "text", host: str = "source", path: str = "lang", *, carried: list[str] | None = None,
    keep: float = KEEP, broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """The columns ``carried`` (all, by default) with a struct ``quality``: ``document, host, path, score, kept``.

    ``document`` is the classifier's probability, ``host`` and ``path`` the shrunken means, ``score`` the
    posterior. A null host or path is a group of its own; repeated rows count each; an empty table gives an
    empty result. Where a column ``quality`` is there, the new one is called ``quality_``.
    """
    carried = carried or docs.columns
    extra = [c for c in (host, path) if c not in carried]
    # names of its own inside, so that a caller's column may be called anything
    names = [f"c{i}" for i in range(len(carried) + len(extra))]
    at = dict(zip([*carried, *extra], names, strict=True))
    scored = materialize(evidence(docs, model, text, [*carried, *extra], names), "evidence")
    good = 1 / (1 + F.exp(-F.col("raw")))
    group = [F.struct(F.col(at[host]).alias("g")).alias("_host"), F.struct(F.col(at[path]).alias("g")).alias("_path")]
    paths = materialize(scored.select(*group, good.alias("g")).groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("g").alias("s")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    mean = float((total["s"] or 0.0) + 1) / ((total["n"] or 0) + 2)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), (F.sum("s") / F.sum("n")).alias("hm"))
    worth = _prior_rows(hosts, "hn", "hm", mean)
    hosts = hosts.select("_host", ((F.col("hn") * F.col("hm") + worth * mean) / (F.col("hn") + worth)).alias("host"))
    sites = paths.join(hosts, "_host").withColumn("m", F.col("s") / F.col("n"))
    inner = _prior_rows(sites, "n", "m", "host")
    sites = sites.select("_host", "_path", "host", ((F.col("s") + inner * F.col("host")) / (F.col("n") + inner)).alias("path"))
    if total["groups"] <= broadcast_groups:
        sites = F.broadcast(sites)
    prior = float(np.log(mean / (1 - mean)))
    joined = scored.select("*", *group).join(sites, ["_host", "_path"])
    odds = F.col("raw") - prior + _logit(F.least(F.greatest("path", F.lit(1e-6)), F.lit(1 - 1e-6)))
    score = 1 / (1 + F.exp(-odds))
    own = fresh(docs.select(*[F.col(f"`{c}`") for c in carried]), "quality")
    return joined.select(*[F.col(at[c]).alias(c) for c in carried], F.struct(good.alias("document"), "host", "path", score.alias("score"), (score >= keep).alias("kept")).alias(own))


def model_for(spark, sf_dir: str, docs: DataFrame) -> Trees:
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op6_judge_quality``: evidence, site means and posterior of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    q = F.col("quality")
    judged = judge(docs, model_for(spark, sf_dir, docs), carried=["doc_id", "source", "lang"])
    return judged.select("doc_id", *[q[c].alias(c) for c in ("document", "host", "path", "score", "kept")])
