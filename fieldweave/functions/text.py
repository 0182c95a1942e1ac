"""Text as Columns: trimming, labels, types, word classes and segments. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_CURRENCY = r"(?iu)R\s*\$|\$|USD|EUR|€|£|BRL"
_STRINGS = "array<string>"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, also where ``f`` uses it inside of array functions."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def split_words(c: Column) -> Column:
    """Words between runs of white space; none for a blank text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalize(c: Column) -> Column:
    return F.lower(strip(c))


def null_like(c: Column) -> Column:
    """Null for the strings null, none and the empty one, in any case; anything else stays as it is."""
    return F.when(F.lower(c).isin("null", "none", ""), F.lit(None).cast("string")).otherwise(c)


_ACCENTS = str.maketrans(
    "áàâãäåéèêëíìîïóòôõöúùûüçñýÿāăąćčďēėęěğīįłńňőøřśşšţťūůűųźżž", "aaaaaaeeeeiiiiooooouuuucnyyaaaccdeeeegiilnnoorsssttuuuuzzz"
)
_FROM, _TO = "".join(map(chr, _ACCENTS)), "".join(map(chr, _ACCENTS.values()))


def fold(c: Column) -> Column:
    """For comparing values: trimmed, white space as one space, lower case, no accents; null is empty."""
    marks = F.regexp_replace(F.translate(F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\s+", " ")), _FROM, _TO), r"\p{Mn}", "")
    return marks


def is_label(c: Column, words: Sequence[str] = fixed.LABEL_WORDS, phrases: Sequence[str] = fixed.LABEL_PHRASES) -> Column:
    """Whether a text is the name of a field: listed, letters and a colon, or up to three words with a listed one."""
    n, t = normalize(c), strip(c)
    parts = split_words(n)
    shaped = t.rlike(rf"(?iu)^[{fixed.LETTERS}\s]+:\s*$") | t.rlike(rf"(?iu)^\s*[{fixed.LETTERS}]+[:\-]\s*$")
    listed = n.isin(*words, *phrases)
    few = (F.size(parts) <= 3) & F.exists(parts, lambda w: w.isin(*words))
    return F.coalesce(listed | shaped | few, F.lit(False))


def variability(c: Column) -> Column:
    """1 for a value, 0 for a blank text or a label; what else could raise or lower it is clipped away."""
    return F.when(blank(c) | is_label(c), F.lit(0.0)).otherwise(F.lit(1.0))


def infer_type(c: Column) -> Column:
    """``date``, ``time``, ``money``, ``number`` or ``text``."""
    v = strip(F.coalesce(c, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, _CURRENCY, ""), r"\s", ""), "[.,]", "")
    tight = F.regexp_replace(v, r"\s", "")
    return (
        F.when(v == "", "text")
        .when(v.rlike(r"^\d{2}[/-]\d{2}[/-]\d{4}$"), "date")
        .when(v.rlike(r"^\d{1,2}:\d{2}$"), "time")
        .when(F.regexp_replace(v, _CURRENCY, "").rlike(rf"(?iu)[{fixed.LETTERS}]"), "text")
        .when(v.rlike(_CURRENCY) & bare.rlike(r"^\d+$"), "money")
        .when(tight.rlike(r"^(\d+|\d+[.,]\d+|\d{1,3}([.,]\d{3})*([.,]\d+)?)$"), "number")
        .otherwise("text")
    )


def _upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def word_type(w: Column) -> Column:
    """``number``, ``uppercase``, ``lowercase``, ``mixed`` (a capital first) or ``other``."""
    return (
        F.when(w.rlike(r"^\d+$"), "number")
        .when(_upper(w) & (F.length(w) >= 2), "uppercase")
        .when(w.rlike(r"\p{Ll}") & ~w.rlike(r"[\p{Lu}\p{Lt}]"), "lowercase")
        .when(w.rlike(r"^\p{Lu}"), "mixed")
        .otherwise("other")
    )


def segment_type(c: Column) -> Column:
    """:func:`infer_type`, and for texts ``uf`` and ``abbreviation``."""
    v = strip(F.coalesce(c, F.lit("")))
    base = infer_type(v)
    return F.when((base == "text") & v.isin(*fixed.UF_CODES), "uf").when((base == "text") & (F.length(v) <= 4) & _upper(v), "abbreviation").otherwise(base)


def token_transitions(c: Column) -> Column:
    """Neighbouring words of one class, joined; the text itself if there is one class only.

    Each word's class is found once; runs begin where it changes, so a text takes time by its words, not their square.
    """
    nothing = F.array().cast(_STRINGS)

    def cut(words: Column, kinds: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(words) - 1)
        begins = F.filter(every, lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)))
        return let(begins, lambda at: F.transform(at, lambda a, n: F.array_join(F.slice(words, a + 1, F.coalesce(F.get(at, n + 1), F.size(words)) - a), " ")))

    def runs(words: Column) -> Column:
        split = let(F.transform(words, word_type), lambda kinds: cut(words, kinds))
        return F.when(F.size(words) > 1, split).otherwise(words)

    found = let(split_words(c), runs)
    return F.when(F.coalesce(c, F.lit("")) == "", nothing).otherwise(let(found, lambda r: F.when(F.size(r) > 1, r).otherwise(F.array(c))))


def segment_box(c: Column, delimiters: Sequence[str] | Column = fixed.DELIMITERS) -> Column:
    """A box's segments: each delimiter in turn splits the piece that is left until there are several.

    A delimiter may be a Column of patterns, such as those learned for a template. If none splits,
    classes of words do, on the original text.
    """
    patterns = delimiters if isinstance(delimiters, Column) else F.array(*[F.lit(d) for d in delimiters])

    def step(done: Column, d: Column) -> Column:
        parts = F.filter(F.transform(F.split(done[0], d), strip), lambda x: x != "")
        return F.when(F.size(done) == 1, let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(done))).otherwise(done)

    def cut(t: Column) -> Column:
        split = let(F.aggregate(patterns, F.array(t).cast(_STRINGS), step), lambda s: F.when(F.size(s) > 1, s).otherwise(token_transitions(t)))
        return F.when(t == "", F.array().cast(_STRINGS)).otherwise(split)

    return let(strip(F.coalesce(c, F.lit(""))), cut)


def learn_pattern(segments: Column) -> Column:
    return F.transform(segments, segment_type)


def label_penalty(c: Column) -> Column:
    t = strip(F.lower(c))
    shaped = t.rlike(rf"(?iu)^[{fixed.LETTERS}\s]+:\s*$") | t.rlike(rf"(?iu)^[{fixed.LETTERS}\s]+-\s*$")
    return F.when(t.endswith(":"), 0.8).when(shaped, 0.6).when((F.length(t) <= 3) & t.rlike(r"^\p{L}+$"), 0.3).otherwise(0.0)


def keywords(c: Column) -> Column:
    """Words of four letters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0))
