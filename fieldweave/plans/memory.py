"""What runs know of layouts and fields: tables that a folder keeps from run to run.

An upsert makes new tables from the stored ones and from what was learned; nothing is changed in place. A
folder holds a version of every table, and a version counts once its commit is written, so a run that fails leaves
the version before it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import template_id
from ..operators.knowledge import learn_delimiters, merge_knowledge
from ..operators.templates import keep_last

BOX = "struct<x0:double,y0:double,x1:double,y1:double,page:int>"
SCHEMAS = {
    "templates": "template string, label string, seq long, full long, left long, right long, pdf_path string",
    "fields": f"template string, field string, position {BOX}, mode string, alternatives array<{BOX}>, value string",
    "patterns": "template string, template_id string, seq long, box_text string, sequence array<string>, field string, segment int",
    "knowledge": "template_id string, label string, field string, type string, avg_length double, n long, type_history map<string,long>, extraction_mode string, mode_history map<string,long>",
    "sequences": "template_id string, sequence array<string>, frequency long, first long",
    "delimiters": "template_id string, delimiter string, frequency long, first long",
    "structures": "label string, structure string",
}


def add_positions(old: Column, new: Column) -> Column:
    """``old`` boxes and those of ``new`` that start where no box before them does, in order."""
    none = F.array().cast(f"array<{BOX}>")
    there = lambda done, p: F.exists(done, lambda d: (d["x0"] == p["x0"]) & (d["y0"] == p["y0"]))
    return F.aggregate(F.coalesce(new, none), F.coalesce(old, none), lambda done, p: F.when(there(done, p), done).otherwise(F.concat(done, F.array(p))))


@dataclass(frozen=True)
class Memory:
    """Tables by the names and shapes of :data:`SCHEMAS`."""

    templates: DataFrame
    fields: DataFrame
    patterns: DataFrame
    knowledge: DataFrame
    sequences: DataFrame
    delimiters: DataFrame
    structures: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Memory:
        return Memory(**{name: spark.createDataFrame([], shape) for name, shape in SCHEMAS.items()})

    @staticmethod
    def load(spark: SparkSession, path: str) -> Memory:
        """The last committed version below ``path``; an empty memory where there is none that can be read."""
        try:
            last = spark.read.schema("version long").parquet(f"{path}/commits").agg(F.max("version")).first()[0]
            return Memory(**{name: spark.read.schema(shape).parquet(f"{path}/{name}/version={last}") for name, shape in SCHEMAS.items()})
        except AnalysisException:
            return Memory.empty(spark)

    def save(self, path: str) -> int:
        """A new version of all tables, then its commit."""
        spark = self.templates.sparkSession
        try:
            version = (spark.read.schema("version long").parquet(f"{path}/commits").agg(F.max("version")).first()[0] or 0) + 1
        except AnalysisException:
            version = 1
        for name in SCHEMAS:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
        spark.createDataFrame([(version,)], "version long").write.mode("append").parquet(f"{path}/commits")
        return version

    def learn(self, templates: DataFrame, fields: DataFrame, patterns: DataFrame, knowledge: DataFrame, delimiters: DataFrame) -> Memory:
        """With the leaders' learning: new layouts, positions, box patterns, and the fields' statistics merged."""
        known = keep_last(self.templates.withColumn("_new", F.lit(0)).unionByName(templates.withColumn("_new", F.lit(1)), allowMissingColumns=True), "template", "_new").drop("_new")
        more = self._with_positions(fields, None)
        fresh = patterns.join(self.patterns.select("template", "box_text").distinct(), ["template", "box_text"], "left_anti")
        boxes = patterns.select("template_id", "seq", "box_text", "sequence").distinct()
        sequences = boxes.groupBy("template_id", "sequence").agg(F.count("*").alias("frequency"), F.min("seq").alias("first"))
        counted = delimiters.groupBy("template_id", "delimiter").agg(F.count("*").alias("frequency"), F.min("seq").alias("first"))
        return replace(
            self, templates=known, fields=more, patterns=self.patterns.unionByName(fresh.select(self.patterns.columns)), knowledge=merge_knowledge(self.knowledge, knowledge),
            sequences=_add_counts(self.sequences, sequences, "sequence"), delimiters=_add_counts(self.delimiters, counted, "delimiter"),
        )

    def relearn(self, fields: DataFrame, alternatives: DataFrame, patterns: DataFrame) -> Memory:
        """With what followers' answers teach: positions that replace, alternatives that are added, patterns of boxes that had none."""
        fresh = patterns.join(self.patterns.select("template", "box_text").distinct(), ["template", "box_text"], "left_anti")
        return replace(self, fields=self._with_positions(fields, alternatives), patterns=self.patterns.unionByName(fresh.select(self.patterns.columns)))

    def _with_positions(self, fields: DataFrame, alternatives: DataFrame | None) -> DataFrame:
        keys = ["template", "field"]
        new = fields.select(*keys, F.col("position").alias("p"), F.col("mode").alias("m"), F.col("value").alias("v"))
        joined = self.fields.join(new, keys, "full")
        if alternatives is None:
            more = F.lit(None).cast(f"array<{BOX}>")
        else:
            joined, more = joined.join(alternatives.select(*keys, F.col("alternatives").alias("a")), keys, "full"), F.col("a")
        return joined.select(*keys, F.coalesce("p", "position").alias("position"), F.coalesce("m", "mode").alias("mode"), add_positions(F.col("alternatives"), more).alias("alternatives"), F.coalesce("v", "value").alias("value"))

    # lookups

    def template(self, name: str) -> DataFrame:
        return self.templates.where(F.col("template") == name)

    def part(self, name: str, part: str) -> DataFrame:
        """One part (``position``, ``mode``, ``alternatives``, ``value``) of a template's fields, where it is there."""
        there = F.size(part) > 0 if part == "alternatives" else F.col(part).isNotNull()
        return self.fields.where((F.col("template") == name) & there).select("field", part)

    def for_extraction(self, label: str, names: list[str]) -> DataFrame:
        """Knowledge of a label's fields by the digest of label and names; no rows where it is new."""
        return self.knowledge.where(F.col("template_id") == template_id(F.lit(label), F.array(*[F.lit(n) for n in names])))

    def split_rules(self) -> DataFrame:
        """``template_id, delimiters, sequence``: the five most frequent delimiters, and the first sequence of types."""
        top = learn_delimiters(self.delimiters, counted=True).groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct("rank", "delimiter")))["delimiter"].alias("delimiters"))
        first = self.sequences.groupBy("template_id").agg(F.min_by("sequence", "first").alias("sequence"))
        return top.join(first, "template_id", "full")

    def cleared(self, templates: bool = True, structures: bool = False) -> Memory:
        """Without its templates, or its classification of labels."""
        gone = [n for n in SCHEMAS if (n == "structures") == structures and (structures or templates)]
        return replace(self, **{n: getattr(self, n).limit(0) for n in gone})


def _add_counts(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    both = old.unionByName(new.select(old.columns))
    return both.groupBy("template_id", kind).agg(F.sum("frequency").alias("frequency"), F.min("first").alias("first"))


assert [f.name for f in fields(Memory)] == list(SCHEMAS)
