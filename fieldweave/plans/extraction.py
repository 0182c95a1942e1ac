"""The cascade: cached, by position, by alternative positions, repaired, asked for; then learned.

One set-oriented plan for all documents: what a step leaves open is the input of the next one. Templates
are tables:

* ``template_fields``: ``template, field, position, mode, alternatives`` (boxes)
* ``patterns``: ``template, box_text, field, segment`` for boxes with several fields
* ``knowledge``: ``template_id, field, type, avg_length, extraction_mode``

A request is a row ``doc_id, label, template, template_id, field, fpos, description``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.bits import to_hex
from ..functions.fields import box_values, substring_by_type, template_id, truncate
from ..functions.formats import expected_format, repair, validate_format
from ..functions.text import blank, learn_pattern, let, null_like, segment_box, strip
from ..operators.blocks import simple_text
from ..operators.knowledge import learn_fields
from ..operators.matching import best_blocks, first_match, same_box
from ..operators.templates import leader_clusters, match_templates
from .memory import Memory
from .stage import stored

_BY = ("doc_id", "field")


def requests_of(entries: DataFrame) -> DataFrame:
    """Entries (``doc_id, label, fields``) to requests without a template yet."""
    tid = template_id(F.col("label"), F.col("fields")["name"])
    return entries.withColumn("template_id", tid).select("doc_id", "label", "template_id", F.explode("fields").alias("f")).select("doc_id", "label", "template_id", F.col("f.name").alias("field"), "f.fpos", "f.description")


def only(requests: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Requests for ``fields``; for all, where none are named."""
    return requests.where(F.col("field").isin(fields)) if fields else requests


def by_position(requests: DataFrame, blocks: DataFrame, template_fields: DataFrame, patterns: DataFrame, knowledge: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``requests`` with ``value``: each field from the best block for its position in the template.

    A field that is part of a box, or whose box has a learned pattern, is cut out of it; the first such field
    of a box also gives the others of its box, unless they come out empty. ``rules`` (``template_id, delimiters,
    sequence``) has what was learned of splitting boxes with one field.
    """
    if rules is None:
        rules = requests.sparkSession.createDataFrame([], "template_id string, delimiters array<string>, sequence array<string>")
    known = requests.join(template_fields.select("template", "field", "position", "mode"), ["template", "field"], "left")
    known = known.join(knowledge.select("template_id", "field", "type", "avg_length", "extraction_mode"), ["template_id", "field"], "left")
    known = known.withColumn("mode", F.coalesce("extraction_mode", "mode"))
    placed = stored(known.where(F.col("position").isNotNull()).withColumn("ref", F.col("position")))
    found = best_blocks(placed.select("doc_id", "template", "field", "fpos", "ref", "mode", "type", "avg_length"), blocks).withColumn("text", strip(F.col("text")))
    boxes = patterns.groupBy("template", "box_text").agg(F.map_from_entries(F.collect_list(F.struct("field", "segment"))).alias("segments"))
    found = found.join(boxes, (found["template"] == boxes["template"]) & (F.col("text") == F.col("box_text")), "left").drop(boxes["template"])
    group = same_box(placed.select("doc_id", "field", "fpos", "ref.page", "ref.x0", "ref.y0"))
    about = placed.select("doc_id", F.col("field").alias("b"), F.struct(F.col("field").alias("name"), F.col("description").alias("description"), F.col("type").alias("type"), F.col("avg_length").cast("double").alias("avg_length")).alias("f"))
    shared = group.join(about, ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("field")).agg(F.sort_array(F.collect_list(F.struct("b_pos", "f")))["f"].alias("fields"))
    of_template = placed.select(*_BY, "template_id").join(rules, "template_id")
    cut = stored(found.join(shared, list(_BY)).join(of_template.drop("template_id"), list(_BY), "left"))
    nth = F.try_element_at("segments", "field")
    learned = F.when(nth.isNotNull(), let(segment_box(F.col("text")), lambda p: F.when(nth < F.size(p), F.get(p, nth))))
    partial = (F.coalesce(F.col("mode"), F.lit("")) == "partial") | F.col("segments").isNotNull()
    opens = partial & nth.isNull()  # cuts the whole box and may give the others
    cut = cut.withColumn("learned", learned).withColumn("partial", partial).withColumn("opens", opens)
    marks = F.coalesce("delimiters", F.array(*[F.lit(d) for d in fixed.DELIMITERS]))
    cut = cut.withColumn("values", F.when(F.col("partial") & F.col("learned").isNull(), box_values(F.col("text"), F.col("fields"), F.col("sequence"), marks)))
    cut = cut.withColumn("mine", F.try_element_at("values", "field"))
    whole = substring_by_type(F.col("text"), F.col("type"), F.col("avg_length"))
    kept = F.col("partial") & (~F.col("opens") | ~blank(F.col("mine")))  # a box without this field gives the most likely part
    own = F.when(F.col("learned").isNotNull(), F.col("learned")).when(kept, F.col("mine")).otherwise(whole)
    own = let(own, lambda o: null_like(F.when(~blank(o), truncate(o, F.col("avg_length"))).otherwise(o)))
    cut = stored(cut.select(*_BY, "fpos", "opens", "values", own.alias("own")))
    given = cut.where("opens").select("doc_id", F.col("fpos").alias("giver"), F.col("field").alias("from"), F.explode("values").alias("field", "v")).where("field <> from and v is not null")
    given = given.groupBy(*_BY).agg(F.min_by("v", "giver").alias("given"), F.min("giver").alias("giver"))
    out = cut.select(*_BY, "own")
    joined = requests.join(out, list(_BY), "left").join(given, list(_BY), "left")
    return joined.select(*requests.columns, F.coalesce(F.when(F.col("giver") < F.col("fpos"), F.col("given")), F.col("own")).alias("value"))


def by_alternatives(left: DataFrame, blocks: DataFrame, template_fields: DataFrame, patterns: DataFrame, knowledge: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The first alternative position of each open field that gives a value of the expected format."""
    alts = left.join(template_fields.select("template", "field", F.posexplode("alternatives").alias("alt", "position")), ["template", "field"])
    # a position of its own is looked up alone: no other field shares its box
    asked = alts.select("label", F.concat_ws("\u0001", "doc_id", F.col("alt").cast("string")).alias("doc_id"), "template_id", F.concat_ws("\u0001", "template", F.col("alt").cast("string"), "field").alias("template"), "field", "fpos", "description", "alt", F.col("doc_id").alias("of"), "position")
    fields = asked.select("template", "field", "position", F.lit(None).cast("string").alias("mode")).distinct()
    pages = blocks.join(asked.select(F.col("of").alias("doc_id"), F.col("doc_id").alias("as")).distinct(), "doc_id").drop("doc_id").withColumnRenamed("as", "doc_id")
    tried = by_position(asked.drop("position"), pages, fields, patterns, knowledge, rules)
    expected = expected_format(F.col("field"), F.col("description"))
    good = tried.where(F.col("value").isNotNull() & validate_format(F.col("value"), expected)["valid"])
    return good.groupBy(F.col("of").alias("doc_id"), "field").agg(F.min_by("value", "alt").alias("alternative"))


def extract(requests: DataFrame, blocks: DataFrame, template_fields: DataFrame, patterns: DataFrame, knowledge: DataFrame, provider, rules: DataFrame | None = None) -> DataFrame:
    """``requests`` with ``value`` and ``method``: position, alternative, repaired, asked (again or first) or none.

    A value of the wrong format is replaced by what the provider says, whatever it says; a missing one only by
    what it knows. The provider sees just these fields.
    """
    first = stored(by_position(requests, blocks, template_fields, patterns, knowledge, rules))
    alternatives = by_alternatives(first.where("value is null").drop("value"), blocks, template_fields, patterns, knowledge, rules)
    tried = first.join(alternatives, list(_BY), "left").withColumn("raw", F.coalesce("value", "alternative"))
    checked = tried.withColumn("r", repair(F.col("raw"), expected_format(F.col("field"), F.col("description"))))
    checked = stored(checked)
    wanted = checked.where("r.value is null").select("doc_id", "field", "description")
    answers = provider.extract(wanted, simple_text(blocks)).withColumnRenamed("value", "answer")
    done = checked.join(answers, list(_BY), "left")
    how = (
        F.when(F.col("r.invalid"), "asked_again").when(F.col("r.value").isNull(), F.when(F.col("answer").isNotNull(), "asked").otherwise("none"))
        .when(F.col("r.value") != F.col("raw"), "repaired").when(F.col("value").isNull(), "alternative").otherwise("position")
    )
    return done.select(*requests.columns, F.coalesce("r.value", "answer").alias("value"), how.alias("method"))


def learn_templates(values: DataFrame, blocks: DataFrame, order: Column | str = "seq") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Positions, box patterns, knowledge and delimiters from ``doc_id, template, template_id, field, fpos, value, seq``.

    The box of several values is learned if it has as many segments; values and segments are paired by likeness,
    one to one.
    """
    found = stored(first_match(values.select("doc_id", "template", "template_id", "field", "fpos", "value", "seq"), blocks))
    place = F.struct("x0", "y0", "x1", "y1", "page")
    latest = found.groupBy("template", "field").agg(F.max_by(F.struct(place.alias("position"), "mode", "value"), order).alias("l"))
    fields = latest.select("template", "field", "l.*", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,page:int>>").alias("alternatives"))
    boxed = found.groupBy("doc_id", "template", "template_id", "seq", F.col("text").alias("box_text")).agg(F.sort_array(F.collect_list(F.struct("fpos", "field", "value"))).alias("fs"))
    boxed = stored(boxed.where(F.size("fs") > 1).withColumn("parts", segment_box(F.col("box_text")))).where(F.size("parts") >= F.size("fs"))
    low = lambda c: F.lower(strip(c))

    def likeness(v: Column, s: Column) -> Column:
        t = F.lower(s)
        ratio = F.least(F.length(v), F.length(t)) / F.greatest(F.length(v), F.length(t), F.lit(1))
        return F.when(F.contains(t, v) | F.contains(v, t), ratio + F.when(v == t, 0.5).otherwise(0.0))

    with_parts = lambda f, i: let(low(f["value"]), lambda v: F.transform("parts", lambda s, j: F.struct((-likeness(v, s)).alias("score"), i.alias("i"), j.alias("j"), f["field"].alias("field"))))
    pairs = F.flatten(F.transform("fs", with_parts))
    pairs = F.array_sort(F.filter(pairs, lambda p: p["score"].isNotNull()))
    taken = F.aggregate(pairs, F.array().cast("array<struct<score:double,i:int,j:int,field:string>>"), lambda a, p: F.when(F.exists(a, lambda d: (d["i"] == p["i"]) | (d["j"] == p["j"])), a).otherwise(F.concat(a, F.array(p))))
    patterns = boxed.select("template", "template_id", "seq", "box_text", learn_pattern(F.col("parts")).alias("sequence"), F.explode(taken).alias("p"))
    patterns = patterns.select("template", "template_id", "seq", "box_text", "sequence", F.col("p.field").alias("field"), F.col("p.j").alias("segment"))
    observed = values.join(found.select("doc_id", "field", "mode"), list(_BY), "left")
    knowledge = learn_fields(observed)
    occurs = F.array(*[F.when(F.col("box_text").rlike(d), F.lit(d)) for d in fixed.DELIMITERS])
    delimiters = boxed.select("template_id", "seq", F.explode(F.array_compact(occurs)).alias("delimiter"))
    return fields, patterns, knowledge, delimiters


@dataclass(frozen=True)
class Outcome:
    """``values`` (``doc_id, label, method, how, template, field, fpos, value``) and what is known afterwards."""

    values: DataFrame
    memory: Memory


def process_with(entries: DataFrame, blocks: DataFrame, hashes: DataFrame, structures: DataFrame, provider, memory: Memory) -> Outcome:
    """All entries (``doc_id, label, fields, seq``) by what ``memory`` has of layouts, and what they add to it.

    In each label's order, a document without a near layout in memory or before it leads a new one: all of its fields are
    asked for and its template is learned. Its followers are read by position. Documents of flexible labels, and those without
    a hash, are only asked for. A follower sees the knowledge of all leaders, so results don't depend on
    how labels are spread over workers. What followers' answers teach counts from the next call on:

    * where a value had the wrong format, the places of the given values are alternatives, each place once;
    * where a value was missing, the document's values are looked up again, and the last document's places, modes and
      patterns of new boxes go to the template.
    """
    old = F.lit(-(1 << 40)) + F.col("seq")  # stored layouts stand before all documents
    kinds = entries.join(structures, "label", "left").withColumn("strict", F.coalesce(F.col("structure") == "stricted", F.lit(False)))
    ranked = stored(kinds.where("strict").select("doc_id", "label", "seq").join(hashes, "doc_id"))
    numbers = ranked.select(F.col("seq").alias("doc_id"), "label", "seq", "full", "left", "right")
    known = memory.templates.where("full is not null").select(old.alias("template"), "label", old.alias("seq"), "full", "left", "right", F.col("template").alias("name"))
    some = bool(known.take(1))
    clusters = leader_clusters(numbers, known.drop("name") if some else None).select(F.col("doc_id").alias("seq"), "leader", "is_leader")
    name = F.concat_ws("_", "label", *[to_hex(F.col(c)) for c in ("full", "left", "right")])
    names = ranked.select(F.col("seq").alias("leader"), name.alias("template")).unionByName(known.select(F.col("template").alias("leader"), F.col("name").alias("template")))
    asked = requests_of(kinds.select("doc_id", "label", "fields")).join(kinds.select("doc_id", "seq"), "doc_id").join(clusters, "seq", "left").join(names, "leader", "left")
    asked = stored(asked)
    alone = asked.where("is_leader is null or is_leader")
    answers = provider.extract(alone.select("doc_id", "field", "description"), simple_text(blocks))
    led = stored(alone.join(answers, list(_BY), "left").withColumn("method", F.when(F.col("is_leader"), "llm_learning").otherwise("llm_flexible")))
    leading = led.where("is_leader")
    fields, patterns, knowledge, delimiters = map(stored, learn_templates(leading, blocks))
    labels = leading.select("template_id", "label").distinct()
    leaders = ranked.join(leading.select("seq").distinct(), "seq", "left_semi").select(name.alias("template"), "label", "seq", "full", "left", "right", F.col("doc_id").cast("string").alias("pdf_path"))
    learned = memory.learn(leaders, fields, patterns, knowledge.join(labels, "template_id"), delimiters)
    learned = replace(learned, **{n: stored(getattr(learned, n)) for n in ("templates", "fields", "patterns", "knowledge", "sequences", "delimiters")})
    followers = asked.where("not is_leader").select("doc_id", "label", "template", "template_id", "field", "fpos", "description", "seq")
    boxes = learned.patterns.select("template", "box_text", "field", "segment")
    read = extract(followers.drop("seq"), blocks, learned.fields, boxes, learned.knowledge, provider, learned.split_rules())
    read = stored(read.withColumnRenamed("method", "how").withColumn("method", F.lit("positional")).join(followers.select("doc_id", "seq").distinct(), "doc_id"))
    open_docs = read.where(F.col("how").isin("asked", "none")).select("doc_id").distinct()
    again, boxed, _, _ = learn_templates(read.join(open_docs, "doc_id", "left_semi"), blocks)
    given = first_match(read.where("how = 'asked_again' and value is not null").select("doc_id", "template", "field", "value", "seq"), blocks)
    places = given.groupBy("template", "field").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct("x0", "y0", "x1", "y1", "page").alias("p"))))["p"].alias("alternatives"))
    memory = learned.relearn(again, places, boxed)
    cols = ["doc_id", "label", "method", "how", "template", "field", "fpos", "value"]
    return Outcome(led.withColumn("how", F.lit("asked")).select(*cols).unionByName(read.select(*cols)), memory)


def process(entries: DataFrame, blocks: DataFrame, hashes: DataFrame, structures: DataFrame, provider) -> DataFrame:
    """``doc_id, label, method, template, field, fpos, value`` for all entries, by nothing but themselves; see :func:`process_with`."""
    return process_with(entries, blocks, hashes, structures, provider, Memory.empty(entries.sparkSession)).values.drop("how")


__all__ = ["Outcome", "by_alternatives", "by_position", "extract", "learn_templates", "match_templates", "only", "process", "process_with", "requests_of"]
