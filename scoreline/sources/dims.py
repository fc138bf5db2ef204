"""Literal dimensions and the generic lookup join.

A literal dimension is a small, fixed Python mapping turned into a DataFrame.
Its size is bounded by the literal itself (known on the driver before any job
runs), so it is always safe to broadcast; ``lookup`` does so if told that it is one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's for right results.
# ---------------------------------------------------------------------------

# Nation -> confederation; nations not listed map to "Outro".
CONFEDERATIONS: dict[str, list[str]] = {
    "CONMEBOL": ["Brazil", "Argentina", "Uruguay", "Paraguay", "Chile", "Colombia",
                 "Ecuador", "Peru", "Bolivia", "Venezuela"],
    "UEFA": ["Germany", "West Germany", "France", "Spain", "Italy", "England",
             "Netherlands", "Holland", "Belgium", "Portugal", "Croatia", "Poland",
             "Denmark", "Switzerland", "Sweden", "Norway", "Austria",
             "Czech Republic", "Czechia", "Czechoslovakia", "Hungary", "Romania",
             "Scotland", "Wales", "Turkey", "Türkiye", "Serbia", "Yugoslavia",
             "Slovakia", "Slovenia", "Bulgaria", "Russia", "Soviet Union", "Ukraine",
             "Bosnia and Herzegovina", "Montenegro", "Georgia", "North Macedonia",
             "Albania", "Kosovo", "Northern Ireland", "Finland", "Iceland", "Ireland"],
    "CONCACAF": ["United States", "USA", "Mexico", "Canada", "Costa Rica", "Honduras",
                 "Jamaica", "Panama", "El Salvador", "Haiti", "Cuba",
                 "Trinidad and Tobago", "Curaçao", "Guatemala"],
    "CAF": ["Morocco", "Senegal", "Nigeria", "Egypt", "Cameroon", "Ghana",
            "Ivory Coast", "Côte d'Ivoire", "Tunisia", "Algeria", "South Africa",
            "Mali", "DR Congo", "Cape Verde", "Burkina Faso", "Guinea",
            "Angola", "Congo", "Togo", "Gabon", "Zambia", "Zimbabwe",
            "Tanzania", "Kenya"],
    "AFC": ["Japan", "South Korea", "Korea Republic", "Iran", "Saudi Arabia",
            "Australia", "Qatar", "Iraq", "UAE", "United Arab Emirates",
            "China", "North Korea", "Indonesia", "Kuwait", "Bahrain",
            "Uzbekistan", "Jordan"],
    "OFC": ["New Zealand", "Fiji"],
}
CONFEDERATION_DEFAULT = "Outro"

# Nation name, English -> Portuguese; unmapped names stay as they are.
NATION_PT: dict[str, str] = {
    "Brazil": "Brasil", "Argentina": "Argentina", "Colombia": "Colômbia",
    "Uruguay": "Uruguai", "Ecuador": "Equador", "Venezuela": "Venezuela",
    "Chile": "Chile", "Peru": "Peru", "Paraguay": "Paraguai", "Bolivia": "Bolívia",
    "United States": "EUA", "USA": "EUA", "Mexico": "México", "Canada": "Canadá",
    "Costa Rica": "Costa Rica", "Honduras": "Honduras", "Jamaica": "Jamaica",
    "Panama": "Panamá", "El Salvador": "El Salvador", "Haiti": "Haiti",
    "Trinidad and Tobago": "Trinidad e Tobago", "Cuba": "Cuba", "Curaçao": "Curaçao",
    "Germany": "Alemanha", "West Germany": "Alemanha Ocid.", "France": "França",
    "Spain": "Espanha", "Italy": "Itália", "England": "Inglaterra",
    "Netherlands": "Holanda", "Holland": "Holanda", "Belgium": "Bélgica",
    "Portugal": "Portugal", "Croatia": "Croácia", "Poland": "Polônia",
    "Denmark": "Dinamarca", "Switzerland": "Suíça", "Sweden": "Suécia",
    "Norway": "Noruega", "Austria": "Áustria", "Czech Republic": "República Tcheca",
    "Czechia": "República Tcheca", "Hungary": "Hungria", "Romania": "Romênia",
    "Scotland": "Escócia", "Wales": "Gales", "Turkey": "Turquia", "Türkiye": "Turquia",
    "Greece": "Grécia", "Russia": "Rússia", "Soviet Union": "URSS",
    "Ukraine": "Ucrânia", "Slovakia": "Eslováquia", "Slovenia": "Eslovênia",
    "Serbia": "Sérvia", "Yugoslavia": "Iugoslávia", "Bulgaria": "Bulgária",
    "Bosnia and Herzegovina": "Bósnia e Herzegovina", "Montenegro": "Montenegro",
    "Georgia": "Geórgia", "North Macedonia": "Macedônia do Norte",
    "Albania": "Albânia", "Kosovo": "Kosovo", "Ireland": "Irlanda",
    "Finland": "Finlândia", "Iceland": "Islândia", "Luxembourg": "Luxemburgo",
    "Morocco": "Marrocos", "Senegal": "Senegal", "Nigeria": "Nigéria",
    "Egypt": "Egito", "Cameroon": "Camarões", "Ghana": "Gana",
    "Ivory Coast": "Costa do Marfim", "Côte d'Ivoire": "Costa do Marfim",
    "Tunisia": "Tunísia", "Algeria": "Argélia", "South Africa": "África do Sul",
    "Mali": "Mali", "Guinea": "Guiné", "DR Congo": "Congo RD", "Congo": "Congo",
    "Cape Verde": "Cabo Verde", "Burkina Faso": "Burkina Faso", "Zambia": "Zâmbia",
    "Angola": "Angola", "Tanzania": "Tanzânia", "Kenya": "Quênia",
    "Zimbabwe": "Zimbábue", "Libya": "Líbia", "Japan": "Japão",
    "South Korea": "Coreia do Sul", "Korea Republic": "Coreia do Sul", "Iran": "Irã",
    "Saudi Arabia": "Arábia Saudita", "Australia": "Austrália", "Qatar": "Catar",
    "Iraq": "Iraque", "UAE": "Emirados Árabes", "United Arab Emirates": "Emirados Árabes",
    "China": "China", "North Korea": "Coreia do Norte", "Indonesia": "Indonésia",
    "Uzbekistan": "Uzbequistão", "Jordan": "Jordânia", "New Zealand": "Nova Zelândia",
    "Fiji": "Fiji",
}

# Nation name -> ISO 3166-1 alpha-2 code (flag images); unmapped -> no flag.
NATION_ISO2: dict[str, str] = {
    "Brazil": "br", "Argentina": "ar", "Colombia": "co", "Uruguay": "uy",
    "Ecuador": "ec", "Venezuela": "ve", "Chile": "cl", "Peru": "pe",
    "Paraguay": "py", "Bolivia": "bo",
    "United States": "us", "USA": "us", "Mexico": "mx", "Canada": "ca",
    "Costa Rica": "cr", "Honduras": "hn", "Jamaica": "jm", "Panama": "pa",
    "El Salvador": "sv", "Haiti": "ht", "Trinidad and Tobago": "tt",
    "Cuba": "cu", "Guatemala": "gt", "Curacao": "cw", "Curaçao": "cw",
    "Germany": "de", "West Germany": "de", "East Germany": "de",
    "France": "fr", "Spain": "es", "Italy": "it", "England": "gb-eng",
    "Netherlands": "nl", "Holland": "nl", "Belgium": "be", "Portugal": "pt",
    "Croatia": "hr", "Poland": "pl", "Denmark": "dk", "Switzerland": "ch",
    "Sweden": "se", "Norway": "no", "Austria": "at", "Czech Republic": "cz",
    "Czechia": "cz", "Czechoslovakia": "cz", "Hungary": "hu", "Romania": "ro",
    "Scotland": "gb-sct", "Wales": "gb-wls", "Northern Ireland": "gb-nir",
    "Yugoslavia": "rs", "Serbia": "rs", "Turkey": "tr", "Türkiye": "tr", "Greece": "gr",
    "Russia": "ru", "Soviet Union": "ru", "Ukraine": "ua", "Slovakia": "sk",
    "Slovenia": "si", "Bulgaria": "bg", "Albania": "al", "Kosovo": "xk",
    "North Macedonia": "mk", "Finland": "fi", "Iceland": "is", "Ireland": "ie",
    "Bosnia and Herzegovina": "ba", "Montenegro": "me", "Georgia": "ge",
    "Luxembourg": "lu", "Estonia": "ee", "Latvia": "lv", "Lithuania": "lt",
    "Cyprus": "cy", "Malta": "mt", "Andorra": "ad",
    "Morocco": "ma", "Senegal": "sn", "Nigeria": "ng", "Egypt": "eg",
    "Cameroon": "cm", "Ghana": "gh", "Ivory Coast": "ci", "Côte d'Ivoire": "ci",
    "Tunisia": "tn", "Algeria": "dz", "South Africa": "za", "Mali": "ml",
    "Guinea": "gn", "Zambia": "zm", "Angola": "ao", "Ethiopia": "et",
    "DR Congo": "cd", "Congo": "cg", "Togo": "tg", "Gabon": "ga",
    "Cape Verde": "cv", "Burkina Faso": "bf", "Benin": "bj",
    "Mozambique": "mz", "Tanzania": "tz", "Uganda": "ug", "Sudan": "sd",
    "Zimbabwe": "zw", "Kenya": "ke", "Libya": "ly",
    "Japan": "jp", "South Korea": "kr", "Korea Republic": "kr",
    "Iran": "ir", "Saudi Arabia": "sa", "Australia": "au", "Qatar": "qa",
    "Iraq": "iq", "UAE": "ae", "United Arab Emirates": "ae", "China": "cn",
    "North Korea": "kp", "Indonesia": "id", "Thailand": "th", "Vietnam": "vn",
    "Uzbekistan": "uz", "Jordan": "jo", "Kuwait": "kw", "Bahrain": "bh",
    "Oman": "om", "Palestine": "ps", "Syria": "sy", "Lebanon": "lb",
    "India": "in", "Pakistan": "pk",
    "New Zealand": "nz", "Fiji": "fj", "Papua New Guinea": "pg",
    "Solomon Islands": "sb",
}

# Title years per nation.
TITLE_YEARS: dict[str, list[int]] = {
    "Brazil": [1958, 1962, 1970, 1994, 2002],
    "Germany": [1954, 1974, 1990, 2014],
    "West Germany": [1954, 1974, 1990],
    "Italy": [1934, 1938, 1982, 2006],
    "Argentina": [1978, 1986, 2022],
    "France": [1998, 2018],
    "Uruguay": [1930, 1950],
    "England": [1966],
    "Spain": [2010],
}

# Stage label, English -> Portuguese (unmapped stays).
STAGE_PT: dict[str, str] = {
    "Group Stage": "Fase de Grupos", "Round of 16": "Oitavas de Final",
    "Quarter-finals": "Quartas de Final", "Semi-finals": "Semifinal",
    "Third Place": "3º Lugar", "Final": "Final",
}
# Translated stages that are highlighted in the match table.
HIGHLIGHT_STAGES_PT = ["Final", "Semifinal", "3º Lugar"]

# Position group / code -> Portuguese label (unmapped stays).
POSITION_PT: dict[str, str] = {
    "Goalkeeper": "Goleiro", "GK": "Goleiro",
    "Defender": "Defensor", "DF": "Defensor",
    "Midfielder": "Meia", "MF": "Meia",
    "Forward": "Atacante", "FW": "Atacante",
    "Unknown": "Outro",
}
# Display order of the Portuguese position labels; others sort as 99.
POSITION_ORDER_PT = ["Goleiro", "Defensor", "Meia", "Atacante", "Outro"]

# Position code -> group (the player mart's CASE); others -> 'Unknown'.
POSITION_GROUPS: dict[str, list[str]] = {
    "Goalkeeper": ["GK"],
    "Defender": ["CB", "RB", "LB", "WB", "RWB", "LWB"],
    "Midfielder": ["DM", "CM", "AM", "MF"],
    "Forward": ["LW", "RW", "FW", "CF", "ST"],
}

# Nations listed first in the nation selector, in this order.
POPULAR_NATIONS = ["Brazil", "Germany", "Argentina", "France", "Italy",
                   "Spain", "England", "Uruguay", "Portugal", "Netherlands"]

# Players preferred as the default radar pick, in this order.
STAR_PLAYERS = ["Vinicius Junior", "Kylian Mbappé", "Lionel Messi", "Jude Bellingham",
                "Harry Kane", "Lamine Yamal", "Rodri", "Raphinha", "Pedri",
                "Phil Foden", "Bukayo Saka", "Rafael Leão", "Florian Wirtz"]

# First match date of each group ('dd/mm'); unknown groups -> 'em breve'.
GROUP_START: dict[str, str] = {
    "A": "11/06", "B": "12/06", "C": "13/06", "D": "12/06",
    "E": "14/06", "F": "14/06", "G": "15/06", "H": "15/06",
    "I": "16/06", "J": "16/06", "K": "17/06", "L": "17/06",
}
GROUP_START_DEFAULT = "em breve"

# The season that year-less dates belong to.
SEASON = 2026

# Nation -> short name on match cards; nations not listed keep their name.
SHORT_PT: dict[str, str] = {
    "Mexico": "México", "South Korea": "Coreia do Sul", "Czechia": "República Tcheca", "South Africa": "África do Sul",
    "Canada": "Canadá", "Bosnia and Herzegovina": "Bósnia-Herz.", "Qatar": "Catar", "Switzerland": "Suíça",
    "Scotland": "Escócia", "Brazil": "Brasil", "Morocco": "Marrocos", "Haiti": "Haiti",
    "United States": "EUA", "Australia": "Austrália", "Türkiye": "Turquia", "Paraguay": "Paraguai",
    "Germany": "Alemanha", "Ivory Coast": "Costa do Marfim", "Ecuador": "Equador", "Curaçao": "Curaçao",
    "Netherlands": "Holanda", "Japan": "Japão", "Sweden": "Suécia", "Tunisia": "Tunísia",
    "Belgium": "Bélgica", "Egypt": "Egito", "Iran": "Irã", "New Zealand": "Nova Zelândia",
    "Spain": "Espanha", "Uruguay": "Uruguai", "Saudi Arabia": "Arábia Saud.", "Cape Verde": "Cabo Verde",
    "France": "França", "Senegal": "Senegal", "Iraq": "Iraque", "Norway": "Noruega",
    "Argentina": "Argentina", "Algeria": "Argélia", "Austria": "Áustria", "Jordan": "Jordânia",
    "Portugal": "Portugal", "Colombia": "Colômbia", "DR Congo": "Congo RD", "Uzbekistan": "Uzbequistão",
    "England": "Inglaterra", "Croatia": "Croácia", "Ghana": "Gana", "Panama": "Panamá",
    "Jamaica": "Jamaica", "Honduras": "Honduras", "Costa Rica": "Costa Rica", "Cameroon": "Camarões",
    "Poland": "Polônia", "Denmark": "Dinamarca", "Italy": "Itália", "Serbia": "Sérvia",
    "Nigeria": "Nigéria", "Mali": "Mali", "Indonesia": "Indonésia", "Venezuela": "Venezuela",
    "Bolivia": "Bolívia", "Chile": "Chile", "Peru": "Peru", "El Salvador": "El Salvador",
    "Cuba": "Cuba", "Trinidad and Tobago": "Trinidad", "Burkina Faso": "Burkina F.", "Kenya": "Quênia",
    "Tanzania": "Tanzânia", "Zimbabwe": "Zimbábue", "Zambia": "Zâmbia",
}

# What a nation without an info record shows.
INFO_DEFAULT = {"group": "—", "confederation": "—", "titles": 0, "editions": "—", "curiosity": "", "players": []}

# Value tier -> display label.
TIER_LABELS: dict[str, str] = {"OURO": "🥇 OURO", "PRATA": "🥈 PRATA", "BASE": "🟢 TITULAR"}

# Nations with a squad on file (clickable in the nation grid).
SQUAD_NATIONS = ["Argentina", "Brazil", "England", "France", "Germany", "Portugal", "Spain"]

# Ranking metrics offered by the ranking page.
RANKING_METRICS = ["world_cup_titles", "wins", "total_goals_for", "editions_played",
                   "win_pct", "goals_per_game"]

# ---------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def confederation_map() -> dict[str, str]:
    """Nation -> confederation (one shared dict; do not mutate)."""
    return {n: conf for conf, names in CONFEDERATIONS.items() for n in names}


def dim_frame(spark: SparkSession, mapping: dict, key: str = "key", value: str = "value",
              value_type: T.DataType = T.StringType()) -> DataFrame:
    """A literal mapping as a two-column DataFrame."""
    schema = T.StructType([T.StructField(key, T.StringType(), False),
                           T.StructField(value, value_type, True)])
    return spark.createDataFrame(list(mapping.items()), schema)


def lookup(df: DataFrame, key, dim: DataFrame, out: str, default=None,
           dim_key: str = "key", dim_value: str = "value", bounded: bool = False) -> DataFrame:
    """Left-join ``dim`` on ``key`` and add column ``out`` with a default.

    ``default`` may be a literal (constant default, e.g. "Outro"), a Column
    (e.g. the key itself: identity default) or None (stays NULL). ``dim``
    must have unique keys. For a literal dimension, whose size is known up front,
    pass ``bounded=True`` to broadcast it; else the planner and AQE choose from
    run-time sizes.
    """
    k = F.col(key) if isinstance(key, str) else key
    tmp_k, tmp_v = f"__lk_{out}", f"__lv_{out}"
    d = dim.select(F.col(dim_key).alias(tmp_k), F.col(dim_value).alias(tmp_v))
    if bounded:
        d = F.broadcast(d)
    joined = df.join(d, k == F.col(tmp_k), "left")
    if default is None:
        val = F.col(tmp_v)
    elif isinstance(default, Column):
        val = F.coalesce(F.col(tmp_v), default)
    else:
        val = F.coalesce(F.col(tmp_v), F.lit(default))
    return joined.withColumn(out, val).drop(tmp_k, tmp_v)


_MAPS: dict[int, tuple[dict, Column]] = {}


def _map_literal(mapping: dict) -> Column:
    """The mapping as one map literal expression, built once per mapping
    (an unresolved expression can be reused by any number of plans)."""
    hit = _MAPS.get(id(mapping))
    if hit is None or hit[0] is not mapping:
        hit = (mapping, F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]))
        _MAPS[id(mapping)] = hit
    return hit[1]


def map_expr(mapping: dict, key, default=None) -> Column:
    """Same as ``lookup`` for a literal mapping, as a map-lookup expression with no
    join at all: ``coalesce(map[key], default)``. Best for tiny literals."""
    k = F.col(key) if isinstance(key, str) else key
    val = F.try_element_at(_map_literal(mapping), k)
    if default is None:
        return val
    return F.coalesce(val, default if isinstance(default, Column) else F.lit(default))


def values_sql(mapping: dict, key: str = "key", value: str = "value", alias: str = "t") -> str:
    """A literal mapping as SQL ``(VALUES ...) t(key, value)`` for the oracle."""
    def q(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in mapping.items())
    return f"(VALUES {rows}) AS {alias}({key}, {value})"
