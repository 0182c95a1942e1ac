"""Values of fields out of the text of a box, as Columns.

``fields`` is an array of structs ``name, description, type, avg_length`` in schema order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .scores import segment_score
from .text import _upper, blank, let, segment_box, split_words, strip

_VALUES = "map<string,string>"


def template_id(label: Column, names: Column) -> Column:
    """Label and eight hex digits of a digest over label and sorted names."""
    told = F.concat(label, F.lit(":"), F.array_join(F.array_sort(names), "|"))
    return F.concat(label, F.lit("_"), F.substring(F.md5(told), 1, 8))


def positional_split(text: Column, n: Column) -> Column:
    """``n`` values from left to right, the last one all the rest; null if there are too few words."""
    t, words = strip(text), split_words(text)
    rest = F.call_function("regexp_extract", t, F.concat(F.lit(r"(?s)^(?:\S+\s+){"), (n - 1).cast("string"), F.lit(r"}(.*)$")), F.lit(1))
    heads = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < n - 1, F.get(words, i)).otherwise(F.when(rest == "", None).otherwise(rest)))
    return F.when(n < 1, None).when(blank(text), F.array_repeat(F.lit(None).cast("string"), n)).when(F.size(words) >= n - 1, heads)


def sequential_values(text: Column, fields: Column) -> Column:
    """Values by kind, for a box with too few words: numbers first, then words of a fixed length of
    2 to 4, then what is left. What was taken leaves the text. Fields without a value are null."""
    lower = lambda f: F.lower(f["name"])
    has = lambda f, *words: lower(f).rlike("|".join(words))
    average = lambda f: F.when(f["avg_length"] != 0, f["avg_length"])
    own = lambda f: F.coalesce(f["type"], F.lit("text"))
    numeric = lambda f: (own(f) == "number") | (own(f).isin("text", "") & has(f, "num", "inscricao", "codigo") & F.coalesce(average(f) < 10, F.lit(True)))
    state = lambda f: own(f).isin("text", "") & ~has(f, "num", "inscricao", "codigo") & has(f, "uf", "estado", "seccional") & average(f).isNull()
    size = lambda f: F.when(state(f), 2.0).otherwise(F.coalesce(average(f), F.lit(0.0)))
    rank = lambda f: F.when(numeric(f), 0).when(size(f).between(2, 4), 1).otherwise(2)
    order = F.array_sort(F.transform(fields, lambda f, i: F.struct(rank(f).alias("rank"), (-size(f)).alias("size"), i.alias("i"), f["name"].alias("name"), own(f).alias("type"), average(f).alias("avg"))))

    def take(done: Column, f: Column) -> Column:
        rest = done["rest"]
        fixed_size = f["avg"].between(2, 4)
        pattern = F.when(f["type"] == "number", F.lit(r"(?s)^(\D*)(\d+)(.*)$")).when(fixed_size, F.concat(F.lit(r"(?sU)^(.*?)\b(\w{"), F.floor(f["avg"]).cast("string"), F.lit(r"})\b(.*)$")))
        part = lambda i: F.call_function("regexp_extract", rest, pattern, F.lit(i))
        found = F.coalesce(part(2) != "", F.lit(False))
        before, after = F.regexp_replace(part(1), r"\s+$", ""), F.regexp_replace(part(3), r"^[\s\-|]+", "")
        joined = strip(F.concat_ws(" ", F.when(before != "", before), F.when(after != "", after)))
        whole = (f["rank"] == 2) | F.coalesce(f["avg"] > 10, F.lit(False))
        add = lambda value, left: F.struct(left.alias("rest"), F.map_concat(done["out"], F.map_from_arrays(F.array(f["name"]), F.array(value))).alias("out"))
        return F.when(blank(rest), done).when(found, add(part(2), joined)).when(whole, add(strip(rest), F.lit(""))).otherwise(done)

    start = F.struct(strip(F.coalesce(text, F.lit(""))).alias("rest"), F.create_map().cast(_VALUES).alias("out"))
    got = F.aggregate(order, start, take)["out"]
    names = F.transform(fields, lambda f: f["name"])
    return F.map_from_arrays(names, F.transform(names, lambda n: F.try_element_at(got, n)))


def match_segments(segments: Column, fields: Column, pattern: Column) -> Column:
    """Segments to fields, one to one, best score first; ties by field, then by segment; 0.3 at least.

    ``pattern`` is the learned sequence of types, or null.
    """
    return let(segments, lambda s: _match(s, fields, pattern))


def _match(segments: Column, fields: Column, pattern: Column) -> Column:
    total = F.size(segments)
    place = lambda f: F.when(f["type"].isNotNull() & F.array_contains(pattern, f["type"]), F.array_position(pattern, f["type"]) - 1)
    pairs = F.flatten(F.transform(fields, lambda f, i: F.transform(segments, lambda s, j: F.struct(
        (-segment_score(s, j, total, f["description"], f["type"], f["avg_length"], place(f))).alias("score"), i.alias("field"), j.alias("segment")))))

    def step(done: Column, p: Column) -> Column:
        taken = F.exists(done, lambda d: (d["field"] == p["field"]) | (d["segment"] == p["segment"]))
        return F.when((p["score"] > -fixed.MIN_SCORE) | taken, done).otherwise(F.concat(done, F.array(p)))

    chosen = F.aggregate(F.array_sort(pairs), F.array().cast("array<struct<score:double,field:int,segment:int>>"), step)
    names = F.transform(fields, lambda f: f["name"])
    pick = lambda c: F.transform(fields, lambda f, i: F.get(segments, F.get(F.filter(c, lambda x: x["field"] == i), F.lit(0))["segment"]))
    return F.map_from_arrays(names, let(chosen, pick))


def box_values(text: Column, fields: Column, pattern: Column, delimiters: Column | None = None) -> Column:
    """All fields of a box: several by position or in sequence, a single one by its best segment."""
    names = F.transform(fields, lambda f: f["name"])
    n = F.size(fields)
    segments = segment_box(text) if delimiters is None else segment_box(text, delimiters)
    none = F.map_from_arrays(names, F.array_repeat(F.lit(None).cast("string"), n))
    several = let(positional_split(text, n), lambda s: F.when(s.isNotNull(), F.map_from_arrays(names, s)).otherwise(sequential_values(text, fields)))
    return F.when(blank(text), none).when(n > 1, several).otherwise(match_segments(segments, fields, pattern))


def _cut(t: Column, average: Column, ratio: float, least: float) -> Column:
    """The first ``ratio`` of the average, back to the last space if that leaves more than ``least`` of it."""

    def back(head: Column) -> Column:
        space = F.when(F.instr(head, " ") > 0, F.length(head) - F.instr(F.reverse(head), " ")).otherwise(-1)  # from 0
        return let(space, lambda s: strip(F.when(s > average * least, F.substring(head, F.lit(1), s.cast("int"))).otherwise(head)))

    return let(F.substring(t, F.lit(1), F.floor(average * ratio).cast("int")), back)


def substring_by_type(text: Column, expected: Column, average: Column) -> Column:
    """The part of a box's text that looks most like the field; the whole text if nothing does."""
    avg = F.when(average != 0, average)
    return let(strip(text), lambda t: let(split_words(t), lambda words: _substring(text, t, words, expected, avg)))


def _substring(text: Column, t: Column, words: Column, expected: Column, avg: Column) -> Column:
    digits = F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0))
    nearest = F.array_min(F.transform(digits, lambda d, i: F.struct(F.abs(F.length(d) - avg).alias("d"), i.alias("i"), d.alias("v"))))["v"]
    number = F.when(avg.isNull(), F.get(digits, F.lit(0))).otherwise(nearest)
    target = F.floor(avg).cast("int")
    short = F.get(F.filter(words, lambda w: F.length(w).between(2, 4) & (F.abs(F.length(w) - target) <= 1) & (_upper(w) | w.rlike(r"^\p{L}+$"))), F.lit(0))
    last = F.size(words)
    spans = F.flatten(F.transform(words, lambda w, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(6), last - i)), lambda k: F.struct(i.alias("i"), k.alias("k"), F.array_join(F.slice(words, i + 1, k), " ").alias("v")))))
    scored = F.transform(spans, lambda s: F.struct(F.when(F.abs(F.length(s["v"]) - target) <= 2, -1).otherwise(F.abs(F.length(s["v"]) - target)).alias("d"), s["i"].alias("i"), s["k"].alias("k"), s["v"].alias("v")))
    span = F.array_min(scored)["v"]
    telling = F.array_join(F.filter(words, lambda w: ~w.rlike(r"^\d+$") & (F.length(w) > 2)), " ")
    words_value = F.when(avg.isNull(), F.when(telling != "", telling)).otherwise(F.coalesce(F.when(target <= 4, short), span))
    when_ = F.coalesce(F.regexp_substr(t, F.lit(r"\d{2}[/-]\d{2}[/-]\d{4}")), F.regexp_substr(t, F.lit(r"\d{1,2}:\d{2}")))
    found = F.when(expected == "number", number).when(expected == "text", words_value).when(expected.isin("date", "time"), when_)
    rest = F.when(F.length(t) > avg * 1.5, _cut(t, avg, 1.3, 0.7)).otherwise(t)
    return F.when(blank(text), text).when(F.length(t) <= avg * 1.3, t).otherwise(F.coalesce(found, rest))


def truncate(text: Column, average: Column, ratio: float = 1.3) -> Column:
    cut = lambda t: F.when(F.length(t) > F.floor(average * ratio), _cut(t, average, ratio, 0.8)).otherwise(t)
    return F.when(average.isNull() | (average == 0), text).otherwise(let(strip(text), cut))
