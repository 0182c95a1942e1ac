"""A corpus from raw documents: five stages, each a DataFrame to a DataFrame.

``STAGES`` lists them in order. Each takes ``(spark, docs, sf_dir)`` and works on all that the one
before kept; all but the last return the columns of ``documents``. :func:`run` writes every stage as
Parquet into the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import mixing, neardup, packing, quality, repeats, scratch
from fieldweave.llm.tables import fresh

#: Repeated passages of this many bytes go: about 40 words, so that passages of over 50 words are found.
PASSAGE_BYTES = 200
#: SQL can't express the classifier, the signatures or the tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def _stage(work):
    """What a stage wrote in between goes once the next one begins: its result is stored by then."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release("pipeline")
        with scratch.scope("pipeline"):
            return work(spark, docs, sf_dir)

    stage.__name__, stage.__doc__ = work.__name__, work.__doc__
    return stage


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged by their site; a null source or language is one of its own; each repeated row is judged
    like the others. Columns of ``docs`` may have any names. An empty table stays empty.
    """
    judged = quality.judge(docs, quality.model_for(spark, sf_dir, docs))
    return judged.where(F.col(fresh(docs, "quality"))["kept"]).select(docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id.

    Of repeated rows of one id and text one stays. Texts without words are like nothing else; null and repeated ids with
    different texts are different documents. Columns of ``docs`` may have any names. An empty table stays empty.
    """
    near = F.col(fresh(docs, "near"))
    return neardup.near_duplicates(docs, number_rows=True).where(near["kept"] & (near["row"] == 1)).select(docs.columns)


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand more than once go from the texts; a document stays even if nothing is left of it.

    A null text stays null. Repeated rows repeat each other, so nothing is left of them. ``n_chars`` follows the text
    where something went. Columns of ``docs`` may have any names. An empty table stays empty.
    """
    done, found = repeats.remove_repeats(docs, length=PASSAGE_BYTES), F.col(fresh(docs, "repeats"))
    new = {"text": F.when(F.col("text").isNull(), F.col("text")).otherwise(found["text"]), "n_chars": F.when(found["n_removed"] > 0, F.length(found["text"]).cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, twice at most.

    A null source is a source of its own; texts without words count as size 0 and go along by their source's rate. Columns of
    ``docs`` may have any names. An empty table stays empty.
    """
    own = fresh(docs, "mix")
    return mixing.take_mix(mixing.mix_sources(docs), own).select(docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places.

    A null or empty text is one piece, the end id alone; repeated rows and null ids stay as they are; a long text has many
    pieces. Other columns are left out. An empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
