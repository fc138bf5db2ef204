"""Numeric helpers: casts and rounding with the reference's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col_


def safe_int(c) -> Column:
    """TRY_CAST(text AS INTEGER) of the reference's engine: trims blanks, rounds
    a decimal text half away from zero ('12.5' -> 13), gives NULL when the
    text is not a number."""
    return F.round(F.trim(col_(c).cast("string")).try_cast("double")).try_cast("int")


def to_int(c, dtype: T.DataType) -> Column:
    """Strict CAST(x AS INTEGER): integral input casts directly, fractional input
    rounds half to even first (the reference engine's double->int rule); text
    uses the strict (ANSI) cast, which fails loudly on garbage like the reference."""
    c = col_(c)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("int")
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.rint(c).cast("int")
    return c.cast("int")


def pct1(num, den) -> Column:
    """ROUND(num / NULLIF(den, 0) * 100, 1) in double precision (half away)."""
    return F.round(col_(num).cast("double") / F.nullif(col_(den), F.lit(0)) * 100, 1)


def pct1_float32(num, den) -> Column:
    """ROUND(num::FLOAT / NULLIF(den, 0) * 100, 1) with 32-bit float steps, as
    the reference's mart computes it: each step is done in double and rounded
    to float (exact for one division or one product of small operands), the
    result is a FloatType."""
    q = (col_(num).cast("double") / F.nullif(col_(den), F.lit(0)).cast("double")).cast("float")
    p = (q.cast("double") * 100).cast("float")
    return F.round(p, 1)


def round_half_even(c, scale: int) -> Column:
    """pandas ``Series.round`` (half to even)."""
    return F.bround(col_(c), scale)


def round2_even(c) -> Column:
    """Two-decimal half-even rounding as ``rint(x*100)/100``."""
    return F.rint(col_(c) * 100) / 100


def clip_lower(c, lo: float) -> Column:
    """pandas ``clip(lower=lo)``: NULL stays NULL."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(lo)))
