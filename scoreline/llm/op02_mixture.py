"""Mixing sources to target weights by iterative proportional fitting, in DataFrame
operations only.

Documents are counted by cell (one value of each dimension). Raking scales the cells'
token weights to the target shares of each dimension in turn, again and again. A
document is then sampled with probability min(1, s * raked weight / tokens) of its
cell, where s makes the expected tokens the wanted share of all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: Cells up to which their table is broadcast to the documents; larger ones are joined.
BROADCAST_CELLS = 100_000
#: Stands for a null value of a dimension.
NULL_VALUE = "(null)"


@dataclass
class Dimension:
    """A margin: its name, the expression of its value (cast to string, null is a value
    of its own) and its targets. Values named in ``targets`` get these shares; the
    others share what remains by their token share to the power ``temper``."""

    name: str
    value: Column
    temper: float = 0.7
    targets: dict[str, float] = field(default_factory=dict)


def rake(cells: DataFrame, dimensions: list[Dimension], rounds: int) -> DataFrame:
    """``cells`` (a column for each dimension, tokens > 0) with ``weight``, raked; sums to 1."""
    for d in dimensions:
        every = Window.partitionBy(F.lit(0))
        named = F.coalesce(*[F.when(F.col(d.name) == v, F.lit(float(t))) for v, t in d.targets.items()], F.lit(None).cast("double")) if d.targets else F.lit(None).cast("double")
        left = 1.0 - sum(d.targets.values())
        values = cells.groupBy(d.name).agg(F.sum("tokens").alias("_sum")).withColumn("_named", named)
        values = values.withColumn("_free", F.when(F.col("_named").isNull(), F.pow("_sum", F.lit(d.temper))).otherwise(0.0))
        values = values.withColumn("_raw", F.coalesce("_named", F.try_divide(F.lit(left) * F.col("_free"), F.sum("_free").over(every)), F.lit(0.0)))
        values = values.select(d.name, F.coalesce(F.try_divide(F.col("_raw"), F.sum("_raw").over(every)), F.lit(0.0)).alias(f"_of_{d.name}"))
        cells = cells.join(values, d.name)
    cells = saved(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for _ in range(rounds):
        for d in dimensions:
            own = Window.partitionBy(d.name)
            cells = cells.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"_of_{d.name}"), F.sum("weight").over(own)), F.lit(0.0)))
    return saved(cells.drop(*(f"_of_{d.name}" for d in dimensions)), "raked")


def probabilities(raked: DataFrame, keep: float) -> DataFrame:
    """``raked`` with ``probability``: min(1, s * weight / tokens), with s such that the
    expected tokens are ``keep`` of all (all cells 1 if that needs every token).

    Cells come by falling weight per token; if the first k are certain, s is what is
    still wanted over the weight of the rest, and k is the least for which no further
    cell would exceed 1. One running sum over the cells finds it."""
    names = [c for c in raked.columns if c not in ("tokens", "weight")]
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.desc("_rate"), *names).rowsBetween(Window.unboundedPreceding, -1)
    x = raked.withColumn("_rate", F.col("weight") / F.col("tokens"))
    x = x.withColumn("_sure", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("_rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("_s", F.try_divide(F.lit(keep) * F.sum("tokens").over(every) - F.col("_sure"), F.col("_rest")))
    x = x.withColumn("_s", F.max(F.when((F.col("_s") > 0) & (F.col("_s") * F.col("_rate") <= 1.0), F.struct(-F.col("_sure"), "_s"))).over(every).getField("_s"))
    return x.select(*names, "tokens", "weight", F.least(F.lit(1.0), F.coalesce(F.col("_s") * F.col("_rate"), F.lit(1.0))).alias("probability"))


def mix_sources(docs: DataFrame, dimensions: list[Dimension], tokens: Column, keep: float, seed: str = "mix", rounds: int = 10, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the dimensions' values, ``n_tokens``, ``probability`` and ``sampled``.

    A document is sampled if the first 32 bits of md5(id, seed) are below its
    probability, so repeated rows share one decision and a null id has one, too.
    Documents without tokens (null or empty texts) weigh nothing: probability 0 and not
    sampled. Nulls of a dimension are a value of their own. An empty table gives an
    empty result. Columns of ``docs`` with the names of new ones are replaced."""
    names = [d.name for d in dimensions]
    keyed = docs.withColumns({**{f"_mix_{d.name}": F.coalesce(d.value.cast("string"), F.lit(NULL_VALUE)) for d in dimensions}, "_mix_tokens": F.coalesce(tokens, F.lit(0)).cast("long")})
    new = [*names, "n_tokens", "probability", "sampled"]
    cells = keyed.where("_mix_tokens > 0").groupBy(*(F.col(f"_mix_{n}").alias(n) for n in names)).agg(F.sum("_mix_tokens").alias("tokens"))
    chosen = saved(probabilities(rake(saved(cells, "counts"), dimensions, rounds), keep), "probabilities")
    chosen = chosen.select(*(F.col(n).alias(f"_mix_{n}") for n in names), F.col("probability").alias("_mix_p"))
    if chosen.count() <= BROADCAST_CELLS:
        chosen = F.broadcast(chosen)
    uniform = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = keyed.join(chosen, [f"_mix_{n}" for n in names], "left").withColumn("_mix_p", F.when(F.col("_mix_tokens") > 0, F.coalesce("_mix_p", F.lit(0.0))).otherwise(0.0))
    out = out.withColumn("_mix_s", uniform < F.col("_mix_p"))
    rest = [F.col(c) for c in docs.columns if c not in new]
    return out.select(*rest, *(F.col(f"_mix_{n}").alias(n) for n in names), F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_p").alias("probability"), F.col("_mix_s").alias("sampled"))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))


def form_topic(text: str = "text") -> Column:
    """The topic of a text without a topic column: its form, by the share of a few signs
    among its characters and by its length."""
    t = F.coalesce(F.col(text), F.lit(""))
    share = lambda signs: (F.length(t) - F.length(F.translate(t, signs, ""))) / F.greatest(F.length(t), F.lit(1))
    return (
        F.when(share("|") >= 0.02, "table").when(share("!") >= 0.02, "shout").when(share("*$%&#") >= 0.05, "markup")
        .when(F.length(t) < 600, "short").when(F.length(t) < 6000, "middle").otherwise("long")
    )


#: The mixture of the registered query: tempered sources, fixed languages, tempered topics.
#: Other languages share what is left.
LANGUAGES = {"en": 0.54, "de": 0.15, "fr": 0.15, "es": 0.14}


def document_dimensions(prefix: str = "", topic: Column | None = None) -> list[Dimension]:
    """Source, language and topic (the form, if not given) of ``documents``; ``prefix``
    keeps their columns apart from those of the table."""
    return [Dimension(f"{prefix}source", F.col("source"), 0.7), Dimension(f"{prefix}lang", F.col("lang"), 0.7, LANGUAGES), Dimension(f"{prefix}topic", form_topic() if topic is None else topic, 0.8)]


def oracle_sql(keep: float, rounds: int = 10, seed: str = "mix") -> str:
    """The query's rows in DuckDB SQL: the same fit, written as nested windows."""
    topic = """CASE WHEN (length(t) - length(replace(t, '|', ''))) / greatest(length(t), 1) >= 0.02 THEN 'table'
      WHEN (length(t) - length(replace(t, '!', ''))) / greatest(length(t), 1) >= 0.02 THEN 'shout'
      WHEN (length(t) - length(translate(t, '*$%&#', ''))) / greatest(length(t), 1) >= 0.05 THEN 'markup'
      WHEN length(t) < 600 THEN 'short' WHEN length(t) < 6000 THEN 'middle' ELSE 'long' END"""
    named = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in LANGUAGES.items())
    left = 1.0 - sum(LANGUAGES.values())
    steps = [f"""d AS (SELECT doc_id, coalesce(source, '{NULL_VALUE}') AS source, coalesce(lang, '{NULL_VALUE}') AS lang, {topic} AS topic,
      len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
             "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d WHERE n_tokens > 0 GROUP BY ALL)"]
    for dim, temper in (("source", 0.7), ("topic", 0.8)):
        steps.append(f"t_{dim} AS (SELECT {dim}, pow(sum(n), {temper}) / sum(pow(sum(n), {temper})) OVER () AS target FROM c GROUP BY {dim})")
    steps.append(f"""t_lang0 AS (SELECT lang, CASE lang {named} END AS fixed, CASE WHEN lang IN ({', '.join(f"'{k}'" for k in LANGUAGES)}) THEN 0.0 ELSE pow(sum(n), 0.7) END AS free FROM c GROUP BY lang)""")
    steps.append(f"t_lang AS (SELECT lang, x / sum(x) OVER () AS target FROM (SELECT lang, coalesce(fixed, {left!r} * free / nullif(sum(free) OVER (), 0), 0) AS x FROM t_lang0))")
    steps.append("r0 AS (SELECT source, lang, topic, n, n AS w FROM c)")
    k = 0
    for _ in range(rounds):
        for dim in ("source", "lang", "topic"):
            steps.append(f"r{k + 1} AS (SELECT r.source, r.lang, r.topic, n, coalesce(w * target / nullif(sum(w) OVER (PARTITION BY r.{dim}), 0), 0) AS w FROM r{k} r JOIN t_{dim} t ON r.{dim} = t.{dim})")
            k += 1
    steps.append(f"q AS (SELECT *, w / n AS rate, coalesce(sum(n) OVER b, 0) AS sure, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest, sum(n) OVER () AS total FROM r{k} WINDOW b AS (ORDER BY w / n DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
    steps.append(f"s AS (SELECT arg_min(s, sure) AS s FROM (SELECT *, ({keep!r} * total - sure) / nullif(rest, 0) AS s FROM q) WHERE s > 0 AND s * rate <= 1)")
    steps.append("p AS (SELECT source, lang, topic, least(1.0, coalesce((SELECT s FROM s) * rate, 1.0)) AS p FROM q)")
    return f"""WITH {', '.join(steps)}
    SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END, 6) AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{seed}'), 1, 8))::BIGINT / 4294967296.0 < CASE WHEN n_tokens > 0 THEN coalesce(p, 0) ELSE 0 END AS sampled
    FROM d LEFT JOIN p USING (source, lang, topic)"""
