"""Formats of values: recognising, expecting and repairing them, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import strip

_INT = r"[+-]?\d+(_\d+)*"
_FLOAT = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?(e[+-]?\d+(_\d+)*)?|\.\d+(_\d+)*(e[+-]?\d+(_\d+)*)?|nan|inf|infinity)$"


def _any(v: Column, *patterns: str) -> Column:
    return F.coalesce(v.rlike("^(" + "|".join(patterns) + ")$"), F.lit(False))


def is_date(c: Column) -> Column:
    return _any(strip(c), r"\d{2}[/-]\d{2}[/-]\d{4}", r"\d{4}[/-]\d{2}[/-]\d{2}")


def is_time(c: Column) -> Column:
    return _any(strip(c), r"\d{1,2}:\d{2}(:\d{2})?")


def is_number(c: Column) -> Column:
    """Masked identifiers, digits with one separator, and whatever else parses as a whole or decimal
    number once spaces, dots, commas and slashes are gone; so ``1_000``, ``nan`` and ``1e5`` count."""
    v = strip(c)
    bare = F.regexp_replace(v, "[ .,/]", "")
    bare = F.when(F.length(bare) > 1, F.regexp_replace(bare, "-", "")).otherwise(bare)
    masked = _any(v, r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", r"\d+([.,]\d+)?")
    return masked | _any(strip(bare), _INT) | F.coalesce(F.replace(v, F.lit(","), F.lit(".")).rlike(_FLOAT), F.lit(False))


def is_uf(c: Column) -> Column:
    return _any(strip(c), "[A-Za-z]{2}")


def expected_format(name: Column, description: Column) -> Column:
    """``uf``, ``date``, ``time``, ``number`` or null, from a field's name and description."""
    told = F.concat(F.lower(name), F.lit(" "), F.lower(F.coalesce(description, F.lit(""))))
    out = F.when(told.rlike(r"(?U)\buf\b"), "uf")
    for kind, words in fixed.FORMAT_WORDS.items():
        out = out.when(told.rlike("|".join(words)), kind)
    return out


def detected_format(c: Column) -> Column:
    return F.when(is_date(c), "date").when(is_time(c), "time").when(is_number(c), "number").when(is_uf(c), "uf")


def validate_format(c: Column, expected: Column) -> Column:
    """``(valid, detected)``: without an expectation everything is valid and nothing is detected."""
    found = F.when(expected.isNotNull(), detected_format(c))
    return F.struct((expected.isNull() | F.coalesce(found == expected, F.lit(False))).alias("valid"), found.alias("detected"))


def extract_matching(c: Column, expected: Column) -> Column:
    """The first part of a value that has the expected format, in capitals, or null."""
    first = lambda patterns: F.coalesce(*[F.regexp_substr(c, F.lit(p)) for p in patterns])
    out = F.when(expected == "uf", F.regexp_substr(c, F.lit(r"(?U)\b[A-Za-z]{2}\b")))
    for kind, patterns in fixed.REPAIRS.items():
        out = out.when(expected == kind, first(patterns))
    return F.upper(out)


def repair(c: Column, expected: Column) -> Column:
    """``(value, invalid)``: a valid value stays, another gives its matching part if that is valid, or null."""
    part = extract_matching(c, expected)
    fine = c.isNull() | validate_format(c, expected)["valid"]
    mended = part.isNotNull() & (part != c) & validate_format(part, expected)["valid"]
    return F.struct(F.when(fine, c).when(mended, part).alias("value"), (~fine & ~F.coalesce(mended, F.lit(False))).alias("invalid"))
