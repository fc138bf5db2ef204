"""URL, slug and flag helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

_LOWER = "abcdefghijklmnopqrstuvwxyz"
# Regional indicator symbols U+1F1E6..U+1F1FF, one per latin letter.
_REGIONAL = "".join(chr(0x1F1E6 + i) for i in range(26))


def percent_encode(c) -> Column:
    """RFC 3986 percent-encoding that keeps only A-Z a-z 0-9 '-' '.' '_' '~'.

    Spark's ``url_encode`` is form encoding: it writes ' ' as '+', keeps '*'
    and encodes '~'; the three are fixed up afterwards.
    """
    e = F.url_encode(col_(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    return F.replace(e, F.lit("%7E"), F.lit("~"))


def wiki_slug(name, override=None) -> Column:
    """Override slug if given, else the name with spaces as '_', percent-encoded."""
    base = F.replace(col_(name), F.lit(" "), F.lit("_"))
    if override is not None:
        base = F.coalesce(col_(override), base)
    return percent_encode(base)


def upgrade_thumbnail(c, size: int = 320) -> Column:
    """Replace the thumbnail widths /50px- /80px- /100px- /150px- /200px- by /{size}px-."""
    return F.regexp_replace(col_(c), r"/(50|80|100|150|200)px-", f"/{size}px-")


def iso_base(c) -> Column:
    """Sub-national ISO codes ('gb-eng') -> base code ('gb'), lower case."""
    return F.lower(F.split_part(col_(c), F.lit("-"), F.lit(1)))


def flag_emoji(c) -> Column:
    """ISO alpha code -> regional-indicator flag emoji."""
    return F.translate(iso_base(c), _LOWER, _REGIONAL)


def flag_url(iso, width: int = 40, base: str = "https://flagcdn.com") -> Column:
    """'{base}/w{width}/{iso}.png', or '' when the code is NULL or empty."""
    i = col_(iso)
    return F.when(i.isNull() | (i == ""), F.lit("")) \
            .otherwise(F.concat(F.lit(f"{base}/w{width}/"), F.lower(i), F.lit(".png")))


def json_get(c, path: str, default: str = "") -> Column:
    """Nested JSON field as text with a default when the document, the path or
    the value is missing (``get_json_object`` returns NULL for those)."""
    return F.coalesce(F.get_json_object(col_(c), path), F.lit(default))


def flag_url_alt(iso, base: str = "https://hatscripts.github.io/circle-flags/flags") -> Column:
    """Fallback flag image: '{base}/{base iso code}.svg', or '' without a code."""
    i = col_(iso)
    return F.when(i.isNull() | (i == ""), F.lit("")) \
            .otherwise(F.concat(F.lit(base.rstrip("/") + "/"), iso_base(i), F.lit(".svg")))
