"""64-bit fingerprints in BIGINT columns: hex forms, Hamming distance, the template rule, majority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

FAR = 999  # distance of what is no hash


def from_hex(c: Column) -> Column:
    """A hex string of up to 16 digits as the BIGINT of the same bits; null for anything else."""
    return F.when(c.rlike("(?i)^[0-9a-f]{1,16}$"), F.conv(c, 16, -10).cast("bigint"))


def to_hex(c: Column) -> Column:
    """Lower case, without leading zeros."""
    return F.lower(F.hex(c))


def hamming(a: Column, b: Column) -> Column:
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(FAR))


def hash_match(a: Column, b: Column, full: int = fixed.FULL_THRESHOLD, half: int = fixed.HALF_THRESHOLD) -> Column:
    """``(match, score)`` of two structs ``full, left, right``.

    Without all half hashes the full distance decides and is the score; with them one half has to be near
    as well, and its distance adds to the score.
    """
    whole, left, right = (F.bit_count(a[k].bitwiseXOR(b[k])) for k in ("full", "left", "right"))
    halves = left.isNotNull() & right.isNotNull()
    near = (whole < full) & (~halves | (F.least(left, right) < half))
    return F.struct(F.coalesce(near, F.lit(False)).alias("match"), (whole + F.when(halves, F.least(left, right)).otherwise(0)).cast("bigint").alias("score"))


def raster_hash(pixels: Column) -> Column:
    """Difference hash of 72 values, 8 rows of 9: bit i is set where a value is above its left neighbour."""
    bits = [F.when(F.get(pixels, F.lit(9 * y + x + 1)) > F.get(pixels, F.lit(9 * y + x)), F.shiftleft(F.lit(1).cast("bigint"), 63 - (8 * y + x))).otherwise(F.lit(0).cast("bigint")) for y in range(8) for x in range(8)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def majority(hashes: Column) -> Column:
    """Aggregate: each bit is set where more than half of the hashes have it."""
    out = None
    for i in range(64):
        bit = F.shiftrightunsigned(hashes, i).bitwiseAND(F.lit(1).cast("bigint"))
        set_ = F.when(2 * F.sum(bit) > F.count(hashes), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))
        out = set_ if out is None else out.bitwiseOR(set_)
    return F.when(F.count(hashes) > 0, out)
