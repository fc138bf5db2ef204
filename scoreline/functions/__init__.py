"""Column-expression helpers. Everything here is a built-in Spark expression."""

from .money import money_label, parse_money, value_tier
from .numbers import (clip_lower, pct1, pct1_float32, round2_even, round_half_even, safe_int, to_int)
from .text import (UNICODE_SPACES, col_, combined_label, ellipsis, initials, norm_key,
                   normalize_header, normalize_header_ws, repeat_symbol, sql_trim, strip_all)
from .web import (flag_emoji, flag_url, flag_url_alt, iso_base, json_get, percent_encode, upgrade_thumbnail,
                  wiki_slug)

__all__ = [
    "money_label", "parse_money", "value_tier", "clip_lower", "pct1", "pct1_float32", "round2_even",
    "round_half_even", "safe_int", "to_int", "UNICODE_SPACES", "col_",
    "combined_label", "ellipsis", "initials", "norm_key", "normalize_header",
    "normalize_header_ws", "repeat_symbol", "sql_trim", "strip_all", "flag_emoji",
    "flag_url", "flag_url_alt", "iso_base", "json_get", "percent_encode", "upgrade_thumbnail", "wiki_slug",
]
