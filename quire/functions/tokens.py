"""Token estimates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges of characters that count 0.6 each.
WIDE_RANGES = ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF))
WIDE_CLASS = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in WIDE_RANGES) + "]"
NARROW_CLASS = "[^" + WIDE_CLASS[1:]


def wide_chars(text: Column) -> Column:
    """The number of characters of the wide scripts."""
    return F.length(F.regexp_replace(text, NARROW_CLASS, ""))


def estimate_tokens(text: Column) -> Column:
    """floor(c*0.6 + (n-c)*0.3 + 0.999), at least 1, and 0 for null or empty; BIGINT."""
    c = wide_chars(text)
    raw = F.floor(c * F.lit(0.6) + (F.length(text) - c) * F.lit(0.3) + F.lit(0.999))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), raw)).cast("bigint")


def estimate_output(tokens: Column) -> Column:
    """Expected output of a unit without calibration: floor(1.3 t) + 512, not clamped."""
    return (F.floor(tokens * F.lit(1.3)) + 512).cast("bigint")


def bytes_estimate(text: Column) -> Column:
    """(bytes + 3) // 4, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("bigint")
