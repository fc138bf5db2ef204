"""String helpers built from built-in Spark expressions (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode space separators (category Zs). SQL TRIM in the reference's engine
# strips these but not tabs or newlines; Spark's ``trim`` strips only U+0020.
UNICODE_SPACES = "\u0020\u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_trim(c) -> Column:
    """SQL-style TRIM: strip Unicode space separators at both ends (not tabs)."""
    return F.btrim(col_(c), F.lit(UNICODE_SPACES))


def strip_all(c) -> Column:
    """Python ``str.strip()``: strip every kind of whitespace at both ends."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def norm_key(c) -> Column:
    """Join key ``lower(trim(c))``."""
    return F.lower(sql_trim(c))


def ellipsis(c, n: int) -> Column:
    """First ``n`` characters, plus '…' when the text was longer."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def initials(c) -> Column:
    """First letter of the first and last word, upper-cased; a one-word name
    gives its first two characters upper-cased."""
    c = col_(c)
    parts = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != F.lit(""))
    two = F.concat(F.substring(F.element_at(parts, 1), 1, 1),
                   F.substring(F.element_at(parts, -1), 1, 1))
    return F.upper(F.when(F.size(parts) >= 2, two).otherwise(F.substring(c, 1, 2)))


def repeat_symbol(sym: str, n, empty: str = "—") -> Column:
    """``sym`` repeated ``n`` times separated by spaces; ``empty`` when n <= 0."""
    n = col_(n)
    return F.when(n > 0, F.trim(F.repeat(F.lit(sym + " "), n.cast("int")))).otherwise(F.lit(empty))


def combined_label(translated, original) -> Column:
    """'translated (original)' when the two differ, else the original."""
    t, o = col_(translated), col_(original)
    return F.when(t != o, F.concat(t, F.lit(" ("), o, F.lit(")"))).otherwise(o)


def normalize_header(name: str) -> str:
    """Header rule of the CSV loaders: strip, lower, space -> '_'."""
    return name.strip().lower().replace(" ", "_")


def normalize_header_ws(name: str) -> str:
    """Header rule of the HTML table loader: whitespace runs -> '_', lower."""
    return "_".join(str(name).strip().lower().split())
