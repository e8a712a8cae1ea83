"""Column functions over single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(value: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def interval_text(point: str, low: str, high: str) -> Column:
    """A share and its interval in percent: ``91.26 [85.04, 96.45]``, or n/a."""
    parts = [F.format_string("%.2f", 100 * F.col(c)) for c in (point, low, high)]
    known = F.col(point).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()
    return F.when(known, F.concat(parts[0], F.lit(" ["), parts[1], F.lit(", "), parts[2], F.lit("]"))).otherwise(F.lit("n/a"))


def hashed(value: Column, digits: int) -> Column:
    """The first hex digits of the MD5 of a text as a number: a reproducible order or draw."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, digits), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def letterbox(width: str, height: str, size: int) -> Column:
    """Left, top, width and height of an image scaled into a square canvas; halves round to even."""
    scale = F.least(F.lit(float(size)) / F.col(width), F.lit(float(size)) / F.col(height))
    w, h = (F.greatest(F.lit(1), F.bround(F.col(c) * scale, 0).cast("int")) for c in (width, height))
    return F.struct(F.floor((size - w) / 2).cast("int").alias("left"), F.floor((size - h) / 2).cast("int").alias("top"), w.alias("width"), h.alias("height"))


def mass_fraction(inside: str, whole: str) -> Column:
    """Share of the mass that is inside; null without mass."""
    return F.when(F.col(whole) > 0, F.col(inside) / F.col(whole))


def plausible_share(part: str, whole: str) -> Column:
    return (F.col(part) / F.greatest(F.col(whole), F.lit(1))).between(0.05, 0.6)
