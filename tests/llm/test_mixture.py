import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm.op02_mixture import Dimension, document_dimensions, mix_sources, oracle_sql, probabilities, rake, word_count

from .helpers import empty_documents, odd_documents, words


def test_raking_reaches_all_margins(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 10_000))) for a in range(6) for b in range(4) for c in range(3)]
    cells = spark.createDataFrame(rows, "s string, l string, t string, tokens long")
    named = {"l0": 0.5, "l1": 0.2, "l2": 0.2, "l3": 0.1}
    got = rake(cells, [Dimension("s", F.col("s"), 0.0), Dimension("t", F.col("t"), 0.5), Dimension("l", F.col("l"), 1.0, named)], 30).toPandas()
    assert got.groupby("l").weight.sum().to_dict() == pytest.approx(named)
    assert got.groupby("s").weight.sum().tolist() == pytest.approx([1 / 6] * 6, rel=1e-6)
    share = cells.toPandas().groupby("t").tokens.sum() ** 0.5
    assert got.groupby("t").weight.sum().tolist() == pytest.approx((share / share.sum()).tolist(), rel=1e-6)


@pytest.mark.parametrize("keep", [0.05, 0.4, 0.9, 1.0])
def test_probabilities_meet_the_budget(spark, keep):
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", int(rng.integers(1, 1000)), float(rng.random())) for i in range(50)]
    raked = spark.createDataFrame(rows, "c string, tokens long, weight double")
    got = probabilities(raked, keep).toPandas()
    assert (got.probability * got.tokens).sum() == pytest.approx(keep * got.tokens.sum())
    free = got[got.probability < 1]
    rate = free.probability / (free.weight / free.tokens)
    assert rate.empty or rate.max() == pytest.approx(rate.min())
    assert (got.probability <= 1).all() and (got.probability > 0).all()


def test_decisions_follow_the_oracle_on_odd_rows(spark):
    docs = odd_documents(spark).drop("topic")
    got = mix_sources(docs, document_dimensions(), word_count(), 0.6)
    rows = sorted((repr(r.doc_id), r.source, r.lang, r.topic, r.n_tokens, round(r.probability, 6), r.sampled) for r in got.collect())
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    con.execute("SELECT 1")
    want = con.execute(f"SELECT doc_id, source, lang, topic, n_tokens, probability, sampled FROM ({oracle_sql(0.6)})").fetchall()
    assert rows == sorted((repr(r[0]), *r[1:]) for r in want)
    assert all(r[4] > 0 or not r[6] for r in rows)
    assert mix_sources(empty_documents(spark), document_dimensions(), word_count(), 0.6).collect() == []


def test_word_count_is_that_of_the_pattern(spark):
    for r in odd_documents(spark).withColumn("c", word_count()).collect():
        assert (r.c or 0) == len(words(r.text)) == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))


def test_prefixed_dimensions_keep_the_columns(spark):
    docs = odd_documents(spark)
    got = mix_sources(docs, document_dimensions("mix_"), word_count(), 1.0)
    assert set(docs.columns) - {"probability"} <= set(got.columns)
    before = sorted(map(repr, docs.where("size(split(trim(text), ' ')) > 1 AND length(text) > 10").select("doc_id", "source", "lang").collect()))
    assert before == sorted(map(repr, got.where("sampled AND size(split(trim(text), ' ')) > 1 AND length(text) > 10").select("doc_id", "source", "lang").collect()))
