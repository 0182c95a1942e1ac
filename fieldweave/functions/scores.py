"""Scores of blocks and of segments against what a field looks like, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .geometry import proximity_bonus, spatial_similarity
from .text import infer_type, keywords, label_penalty, segment_type, strip, variability


def length_similarity(text: Column, average: Column) -> Column:
    """How a text's length fits: unknown 0.5, as expected 1, falling, 0 above twice the average."""
    n = F.length(strip(text))
    rel = F.abs(n - average) / F.greatest(average, F.lit(1.0))
    return (
        F.when(average.isNull() | (average == 0), 0.5)
        .when(n == 0, 0.0)
        .when(n > average * 2.0, 0.0)
        .when(n > average * 1.5, F.greatest(F.lit(0.0), 0.2 - (n - average * 1.5) / average * 0.4))
        .when(rel <= 0.1, 1.0)
        .when(rel <= 0.3, 1.0 - (rel - 0.1) * 1.5)
        .when(rel <= 0.5, 0.7 - (rel - 0.3) * 1.0)
        .otherwise(F.greatest(F.lit(0.2), 0.5 - (rel - 0.5) * 0.6))
    )


def type_match(text: Column, expected: Column) -> Column:
    found = infer_type(text)
    kin = ((expected == "money") & (found == "number")) | ((expected == "number") & (found == "money"))
    return F.when(expected.isNull(), 0.5).when(found == expected, 1.0).when(kin, 0.7).otherwise(0.2)


def block_scores(ref: Column, box: Column, text: Column, average: Column, expected: Column, width: Column, height: Column) -> Column:
    """The five terms of a block's score and their weighted sum, ``score``."""
    t = strip(text)
    w = fixed.BLOCK_WEIGHTS
    terms = {
        "spatial": spatial_similarity(ref, box, width, height), "variability": variability(t), "proximity": proximity_bonus(ref, box),
        "length": length_similarity(t, average), "type": type_match(t, expected),
    }
    total = w["spatial"] * terms["spatial"] + w["variability"] * terms["variability"] + w["proximity"] * terms["proximity"] + w["length"] * terms["length"] + w["type"] * terms["type"]
    return F.struct(*[c.alias(k) for k, c in terms.items()], total.alias("score"))


def segment_type_match(found: Column, expected: Column) -> Column:
    pair = lambda a, b: ((found == a) & (expected == b)) | ((found == b) & (expected == a))
    return F.when(expected.isNull(), 0.5).when(found == expected, 1.0).when(pair("abbreviation", "text"), 0.7).when(pair("uf", "text"), 0.6).otherwise(0.0)


def segment_length(n: Column, average: Column) -> Column:
    rel = F.abs(n - average) / F.greatest(average, F.lit(1.0))
    steps = F.when(average.isNull() | (average == 0), 0.5).when(rel <= 0.1, 1.0).when(rel <= 0.3, 0.8).when(rel <= 0.5, 0.6).when(rel <= 1.0, 0.4)
    return steps.otherwise(F.greatest(F.lit(0.0), 0.2 - (rel - 1.0) * 0.2))


def segment_position(index: Column, expected: Column, total: Column) -> Column:
    last = F.greatest(total - 1, F.lit(1))
    diff = F.abs(index / last - expected / last)
    return F.when(expected.isNull(), 0.5).when(diff <= 0.1, 1.0).when(diff <= 0.2, 0.8).when(diff <= 0.3, 0.6).otherwise(F.greatest(F.lit(0.0), 0.4 - diff * 0.5))


def keyword_match(segment: Column, description: Column) -> Column:
    """Twice the share of a description's longer words that the segment has, 1 at most."""
    wanted, there = keywords(description), keywords(segment)
    hits = F.size(F.filter(wanted, lambda w: F.array_contains(there, w)))
    return F.when((F.size(wanted) == 0) | (F.size(there) == 0), 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.size(wanted), F.lit(1)) * 2.0))


def segment_score(segment: Column, index: Column, total: Column, description: Column, expected: Column, average: Column, position: Column) -> Column:
    w = fixed.SEGMENT_WEIGHTS
    return (
        w["type"] * segment_type_match(segment_type(segment), expected) + w["length"] * segment_length(F.length(segment), average)
        + w["position"] * segment_position(index, position, total) + w["keyword"] * keyword_match(segment, description) - w["label"] * label_penalty(segment)
    )
