"""Toxicity, quality and language: held-out accuracy, exact parts against brute force, odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreline.llm.learning import fit_logistic, fold, labelled_sample, sigmoid
from scoreline.llm.op03_quality import BITS, dual_coordinate_descent, fit_quality, indicators, score_quality
from scoreline.llm.op07_toxicity import END, INSULT, NEGATION, REPORT, TARGET, THREAT, compose, fit_grammar, least_toxic, score_toxicity
from scoreline.llm.op08_language import codewords, fit_languages, identify_language

from . import helpers

CLEAN = "the weather report for the northern coast shows mild winds and some light rain today".split()


def toxic_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = rng.choice(CLEAN, 30).tolist()
        toxic = i % 4 == 0
        if toxic:
            w[rng.integers(30)] = rng.choice(["grumple", "snorkwit", "blatherus", "snorkwad"])
        out.append((i, " ".join(w) + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def grammar(spark):
    return fit_grammar(spark.createDataFrame([r[1:] for r in toxic_rows(1200)], "text string, label int"))


def test_toxicity_on_unseen_texts(spark, grammar):
    docs = spark.createDataFrame(toxic_rows(300, seed=9), "doc_id long, text string, label int")
    got = score_toxicity(docs, grammar).collect()
    assert all((r.toxicity >= 0.3) == (r.label == 1) and (r.toxic_clauses > 0) == (r.label == 1) for r in got)


def test_toxicity_knows_word_beginnings(spark, grammar):
    docs = spark.createDataFrame([(1, "a snorkwonder came by"), (2, "a fine day came by")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in score_toxicity(docs, grammar).collect()}
    assert got[1] > 0.3 > got[2]


def path(symbols):
    """Sum of factors that the composed machine emits over unit weights."""
    move, factor = compose()
    state = total = 0
    for s in symbols:
        total += factor[state, s]
        state = move[state, s]
    return total


def test_composed_machine_against_its_rules():
    assert path([INSULT]) == 1
    assert path([TARGET, 0, INSULT]) == 1.5
    assert path([TARGET, 0, 0, 0, 0, INSULT]) == 1
    assert path([NEGATION, INSULT]) == pytest.approx(0.6)
    assert path([NEGATION, 0, 0, 0, INSULT]) == 1
    assert path([REPORT, 0, 0, 0, 0, 0, 0, INSULT]) == pytest.approx(0.7)
    assert path([REPORT, END, INSULT]) == 1
    assert path([TARGET, NEGATION, REPORT, INSULT]) == pytest.approx(1.5 * 0.6 * 0.7)
    assert path([THREAT]) == pytest.approx(0.3) and path([TARGET, THREAT]) == 1.5
    assert path([INSULT, TARGET, INSULT]) == 2.5


def test_classifiers_take_odd_rows(spark, grammar):
    docs = helpers.odd_documents(spark)
    sample = docs.select("text", F.when(F.length("text") > 20, 1).otherwise(0).alias("label"))
    languages = fit_languages(docs)
    assert languages.languages == ["de", "en", "es", "fr"]
    runs = [
        (score_toxicity(docs, grammar), "toxicity"), (score_toxicity(docs, fit_grammar(sample)), "toxicity"), (score_toxicity(docs, fit_grammar(sample.limit(0))), "toxicity"),
        (score_quality(docs, fit_quality(sample)), "quality_score"), (score_quality(docs, fit_quality(sample.limit(0))), "quality_score"), (score_quality(docs, fit_quality(sample.where("label = 1"))), "quality_score"),
        (identify_language(docs, languages), "score"), (identify_language(docs, fit_languages(docs.limit(0))), "score"),
    ]
    for df, score in runs:
        rows = df.collect()
        assert len(rows) == docs.count() and all(0 <= r[score] <= 1 for r in rows)
        assert {c for c in docs.columns} <= set(df.columns) and len(set(df.columns)) == len(df.columns)
        empty = [r[score] for r in rows if not (r.text or "").strip() and r.text != " \t\n\x0b\x0c\r "]
        assert len(set(empty)) == 1
    for df, _ in runs[-2:]:
        for r in df.collect():
            if r.text is None or not any(c.isalpha() for c in r.text):
                assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False)
    assert all(r.lang_pred == "und" for r in runs[-1][0].collect())
    none = helpers.empty_documents(spark)
    assert score_toxicity(none, grammar).collect() == score_quality(none, fit_quality(sample)).collect() == identify_language(none, languages).collect() == []


def test_languages_on_unseen_texts(spark):
    rng = np.random.default_rng(3)
    parts = {"aa": "ba be bi bo bu", "bb": "kra kre kri kro", "cc": "ßa ßü ßö lä", "dd": "nge ngo ngi", "ee": "ill oll ull", "ff": "wse wso", "gg": "zta zto zti"}
    rows = []
    for i in range(560):
        lang = list(parts)[i % 7]
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split(), 3)) for _ in range(8)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs.where("doc_id < 350"))
    got = identify_language(docs.where("doc_id >= 350"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert model.codes.shape[0] == 7 and model.codes.shape[1] == 24


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 20):
        code = codewords(n)
        apart = min((code[i] ^ code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2) and not code.all(0).any() and code.any(0).all()


def test_margins_are_means_over_whole_texts(spark):
    model = fit_languages(spark.createDataFrame([("abc abd", "x"), ("xyz xyw", "y"), ("abc", "x"), ("zzy", "y")], "text string, lang string"))
    texts = ["abd xyz", "", "a", "ab " * 300, None]
    whole, _ = model.margins(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        alone, _ = model.margins(pa.array([t], pa.string()))
        assert np.allclose(whole[i], alone[0])


def test_quality_on_unseen_texts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        w = rng.choice(CLEAN, rng.integers(3, 60))
        bad = i % 3 == 0
        rows.append((" ".join(f"{x}{rng.choice(['$$', '!!', '*'])}" if bad and rng.random() < 0.5 else x for x in w), int(not bad)))
    df = spark.createDataFrame(rows, "text string, label int")
    model = fit_quality(df.limit(600))
    got = score_quality(spark.createDataFrame(rows[600:], "text string, label int"), model).collect()
    assert np.mean([(r.quality_score >= 0.7) == (r.label == 1) for r in got]) > 0.97


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(80)]
    y = (np.array([(r < 15).sum() - (r > 25).sum() for r in rows]) + rng.normal(0, 1, 80) > 0).astype(float)
    ratio = rng.normal(0, 1, 40)
    w, bias = dual_coordinate_descent(rows, ratio, y, epochs=3000)
    sign = 2 * y - 1
    weight = len(y) / (2 * np.where(y > 0, y.sum(), (1 - y).sum()))

    def loss(w, bias):
        margin = np.array([(w[r] * ratio[r]).sum() / np.sqrt(len(r)) + bias for r in rows])
        return 0.5 * (w @ w + bias * bias) + (weight * np.maximum(0, 1 - sign * margin)).sum()

    best = loss(w, bias)
    assert all(loss(w + rng.normal(0, s, 40), bias + rng.normal(0, s)) > best - 1e-3 for s in (0.001, 0.01, 0.1) for _ in range(30))


def test_indicators_are_distinct_and_of_the_whole_text():
    flags = np.zeros(1 << BITS, bool)
    text = np.frombuffer(b"Abc 12 !! Abc", np.uint8)
    found = indicators(text, flags)
    assert not flags.any() and len(found) == len(set(found.tolist()))
    assert set(indicators(text[:8], flags)) < set(found.tolist())


def test_labelled_sample_is_bounded_and_skips_its_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    got = {(r.text, r.label) for r in labelled_sample(docs, labels, "toxic", 4, 2, 100).collect()}
    assert got == {(f"t{i}", i % 2) for i in range(40) if helpers.fold(i, 4) != 2}
    assert labelled_sample(docs, labels, "toxic", 4, 2, 7).count() == 7
    folds = {r.doc_id: r.f for r in docs.where("doc_id IS NOT NULL").withColumn("f", fold("doc_id", 5)).collect()}
    assert folds == {i: helpers.fold(i, 5) for i in range(50)}


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    y = (rng.random(5000) < sigmoid(x @ [1.5, -1.0] + 0.3)).astype(float)
    assert fit_logistic(x, y, ridge=1e-6) == pytest.approx([1.5, -1.0, 0.3], abs=0.15)
    assert fit_logistic(np.zeros((4, 1)), np.ones(4)).tolist() == pytest.approx([0, np.log(9)])


def test_lexicon_does_not_depend_on_partitions(spark):
    sample = spark.createDataFrame([r[1:] for r in toxic_rows(600)] * 2, "text string, label int")
    one, many = fit_grammar(sample.coalesce(1)), fit_grammar(sample.repartition(32))
    assert one.entries.tolist() == many.entries.tolist() and one.weights.tolist() == many.weights.tolist() and len(one.entries)


def test_a_rare_word_needs_no_share_of_all_toxic_texts():
    # five toxic texts of five, among 100 words tried that five texts hold, whatever the corpus holds besides
    for toxic, clean in ((500, 5_000), (50_000, 500_000)):
        assert least_toxic(5, toxic / (toxic + clean), 2 / 100) <= 3
    for n, share, level in ((1, 0.1, 0.05), (7, 0.2, 0.01), (40, 0.5, 1e-6), (12, 0.01, 1e-12)):
        tail = lambda k: sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k, n + 1))  # noqa: B023, E731
        least = least_toxic(n, share, level)
        assert (least == n + 1 or tail(least) <= level) and tail(least - 1) > level
