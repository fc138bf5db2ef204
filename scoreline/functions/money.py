"""Money text -> millions of euros, as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, strip_all


def parse_money(c) -> Column:
    """'€50M' -> 50.0, '€500k' -> 0.5, '' / '-' / NULL -> 0.0, no unit -> 0.0.

    The currency sign is dropped and ',' becomes '.'; an 'M' is looked for
    before 'k'/'K'. Text that is still not a number gives NULL for that row
    (the reference raised and lost the whole source).
    """
    raw = col_(c)
    s = strip_all(F.replace(F.replace(raw, F.lit("€"), F.lit("")), F.lit(","), F.lit(".")))
    millions = F.replace(s, F.lit("M"), F.lit("")).try_cast("double")
    thousands = F.replace(F.replace(s, F.lit("k"), F.lit("")), F.lit("K"), F.lit("")).try_cast("double") / 1000
    return (F.when(raw.isNull() | (raw == "") | (raw == "-"), F.lit(0.0))
            .when(s.contains("M"), millions)
            .when(s.rlike("[kK]"), thousands)
            .otherwise(F.lit(0.0)))


def money_label(c) -> Column:
    """'€{v:.0f}M' when v >= 1 else '—' (value rounded half to even first)."""
    v = F.coalesce(col_(c), F.lit(0.0))
    return F.when(v >= 1, F.concat(F.lit("€"), F.rint(v).cast("bigint").cast("string"), F.lit("M"))) \
            .otherwise(F.lit("—"))


def value_tier(c, gold: float = 100.0, silver: float = 50.0) -> Column:
    """Tier by market value: OURO >= 100, PRATA >= 50, else BASE (NULL -> BASE)."""
    v = F.coalesce(col_(c), F.lit(0.0))
    return F.when(v >= gold, F.lit("OURO")).when(v >= silver, F.lit("PRATA")).otherwise(F.lit("BASE"))
