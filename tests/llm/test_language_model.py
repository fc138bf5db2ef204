import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from scoreline.llm import op05_attention_lm as L

from .helpers import empty_documents, odd_documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(0)
    sample = [np.array([5, 9, 7, 3] * int(rng.integers(1, 30)) + rng.integers(0, 40, 5).tolist()) for _ in range(60)]
    counts = np.bincount(np.concatenate(sample), minlength=200)
    model = L.train_attention(sample, counts, len(sample))
    pairs = Counter(zip(np.concatenate([np.append(200, s) for s in sample]).tolist(), np.concatenate([np.append(s, 200) for s in sample]).tolist(), strict=True))
    keys = np.array([a * 201 + b for a, b in pairs], np.int64)
    return sample, counts, model.with_pairs(np.append(counts, len(sample)), keys, np.array(list(pairs.values())))


def score_plainly(m, ids):
    """The same model read position by position, without windows in batches."""
    end = len(m.bucket) - 1
    read = [int(m.bucket[end])] + [int(m.bucket[i]) for i in ids]
    want = list(ids) + [end]
    total = 0.0
    for p in range(len(want)):
        start = p // L.SCORED * L.SCORED - L.SCORED
        seen = [(j, read[j]) for j in range(max(0, start), p + 1)]
        a = np.array([m.query[read[p]] @ m.key[r] + m.bias[p - start - L.SCORED, j - start] for j, r in seen])
        a = np.exp(a) / np.exp(a).sum()
        c = sum(x * m.value[r][:-1] for x, (_, r) in zip(a, seen, strict=True))
        z = c @ m.out + m.direct[read[p]]
        total += (z[m.group[want[p]]] - np.log(np.exp(z).sum())) / math.log(10)
        before = ids[p - 1] if p else end
        if want[p] != end:
            i = want[p]
            total += float(m.pair[m.rank[before], m.rank[i]]) if m.rank[i] else float(m.share[i] + m.back[m.rank[before], m.group[i]])
    return total


def test_windows_score_each_id_once(trained):
    _, _, model = trained
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 200, n) for n in (0, 1, 15, 16, 17, 31, 32, 33, 100, 0)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.score(np.concatenate(texts).astype(np.int64), first)
    assert got == pytest.approx([score_plainly(model, t) for t in texts], rel=1e-3, abs=1e-3)


def test_probabilities_sum_to_one(trained):
    _, counts, model = trained
    end = len(model.bucket) - 1
    for before in ([], [5], [5, 9, 7], [180, 5] * 12):
        ids = [np.array([*before, i], np.int64) for i in range(end)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in ids])])
        whole = model.score(np.concatenate(ids), first)
        # p(before, i, end) / p(end | before, i) summed over i, plus p(before, end)
        stop = np.array([score_plainly(model, t) - stem(model, t) for t in ids])
        p = 10 ** (whole - stop)
        alone = model.score(np.array(before, np.int64), np.array([0, len(before)]))[0]
        assert p.sum() + 10**alone == pytest.approx(10 ** stem(model, np.array(before, np.int64)), rel=0.02)


def stem(m, ids):
    """log10 probability of ids without the end."""
    end = len(m.bucket) - 1
    total = score_plainly(m, ids)
    read = [int(m.bucket[end])] + [int(m.bucket[i]) for i in ids]
    p = len(ids)
    start = p // L.SCORED * L.SCORED - L.SCORED
    seen = [(j, read[j]) for j in range(max(0, start), p + 1)]
    a = np.array([m.query[read[p]] @ m.key[r] + m.bias[p - start - L.SCORED, j - start] for j, r in seen])
    a = np.exp(a) / np.exp(a).sum()
    z = sum(x * m.value[r][:-1] for x, (_, r) in zip(a, seen, strict=True)) @ m.out + m.direct[read[p]]
    return total - (z[m.group[end]] - np.log(np.exp(z).sum())) / math.log(10)


def test_training_learns_the_pattern(trained):
    sample, counts, model = trained
    pattern = np.array([5, 9, 7, 3] * 20, np.int64)
    mixed = np.random.default_rng(3).permutation(pattern)
    good, bad = model.score(np.concatenate([pattern, mixed]), np.array([0, 80, 160]))
    share = counts[pattern] / counts.sum()
    assert good > bad + 10 and good > np.log10(share).sum()


def brute(docs, train):
    counts = Counter(w for t in train for w in words(t))
    counts[None] = len(train)
    n, v = sum(counts.values()), len(+counts)
    log = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    return sorted((str(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, float(f"{sum(map(log, [*words(t), None])):.9g}")) for i, t in docs)


@pytest.mark.parametrize("frequent", [L.FREQUENT_WORDS, 3])
def test_base_scores_on_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(L, "FREQUENT_WORDS", frequent)
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = L.fit_language_model(docs.where("doc_id < 7 OR doc_id IS NULL"), PATH)
    got = L.score_texts(docs, model).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, float(f"{r.base_score:.9g}")) for r in got) == brute(rows, [t for i, t in rows if i is None or i < 7])
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("frequent,ranks", [(3, L.RANKS), (L.FREQUENT_PAIRS, 12), (0, 2)])
def test_scores_do_not_depend_on_the_size_of_the_table_of_pairs(spark, monkeypatch, frequent, ranks):
    rng = np.random.default_rng(5)
    follow = rng.permutation(60)
    texts = []
    for _ in range(80):
        at = [int(rng.integers(60))]
        while len(at) < 40:
            at.append(int(follow[at[-1]]) if rng.random() < 0.8 else int(rng.integers(60)))
        texts.append(" ".join(f"{chr(97 + i % 26)}{'xyz'[i // 26]} {i}" for i in at))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = docs.where("doc_id < 70")
    scores = lambda: {r.doc_id: r.score for r in L.score_texts(docs, L.fit_language_model(train, PATH)).collect()}
    whole = scores()
    monkeypatch.setattr(L, "FREQUENT_PAIRS", frequent)
    monkeypatch.setattr(L, "RANKS", ranks)
    assert scores() == pytest.approx(whole, rel=2e-3)


def test_empty_tables(spark):
    docs = odd_documents(spark)
    model = L.fit_language_model(empty_documents(spark), PATH)
    got = L.score_texts(docs, model).collect()
    assert len(got) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in got)
    assert L.score_texts(empty_documents(spark), model).collect() == []


def test_rounds_over_tasks_lower_the_loss_and_read_more_of_a_larger_corpus(spark, monkeypatch):
    rng = np.random.default_rng(8)
    follow = rng.permutation(60)

    def text():
        at = [int(rng.integers(60))]
        while len(at) < 60:
            at.append(int(follow[at[-3:][0]]) if rng.random() < 0.9 else int(rng.integers(60)))
        return " ".join(f"{chr(97 + i % 26)}{'xyz'[i // 26]}" for i in at)

    texts = [text() for _ in range(400)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    parts = L.part_ids(PATH)
    ids = lambda some: [L.part_ids(PATH).words.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    known = [np.array(x, np.int64) for x in ids(texts[:6])]
    counts = np.bincount(np.concatenate([np.array(x) for x in ids(texts)]), minlength=parts.vocabulary)
    start = L.train_attention(known, counts, len(texts))
    held = [np.array(x, np.int64) for x in ids([text() for _ in range(40)])]
    first = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    loss = lambda m: -m.score(np.concatenate(held), first).mean()
    some, most = L.train_on(start, train, PATH, 2, 16), L.train_on(start, train, PATH, 4, 1)
    assert loss(most) < loss(some) < loss(start)
    assert {n: x.shape for n, x in most.weights.items()} == {n: x.shape for n, x in start.weights.items()}
    # without texts the model stays as it is
    same = L.train_on(start, train.limit(0), PATH, 2, 4)
    assert all((same.weights[n] == x).all() for n, x in start.weights.items())


def test_every_text_trains_the_weights_and_the_classes(spark, monkeypatch):
    texts = [f"{'abc'[i % 3]} word{i} and {i} more " * (i % 7) for i in range(50)] + ["", None]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    encode = L.part_ids(PATH).words.tokenizer.encode
    ids = [encode(t or "", add_special_tokens=False).ids for t in texts]
    read, company, start = [], [], L.start_attention

    def rounds(attention, encoded, *rest):
        read.extend(np.frombuffer(r.ids, "<u2").tolist() for r in encoded.collect())
        held = spark.sparkContext.broadcast(attention)
        trained = [encoded.select("ids").mapInArrow(L._round(held, 0.01, 0), "name string, row long, n long, " + ", ".join(f"c{c} double" for c in range(L.CLASSES))).where("name = 'r' AND row = 0").agg({"n": "sum"}).first()[0]]
        assert trained == [sum(len(x) // L.SCORED + 1 for x in ids)]
        return attention

    monkeypatch.setattr(L, "train_rounds", rounds)
    monkeypatch.setattr(L, "start_attention", lambda counts, context, *rest: company.append(context) or start(counts, context, *rest))
    L.fit_language_model(train, PATH)
    assert sorted(read) == sorted(ids)
    # what stands before an id and what stands after it, over all texts
    end = L.part_ids(PATH).vocabulary
    follow = Counter(pair for x in ids for pair in zip([end, *x], [*x, end], strict=True))
    assert company[0].sum() == 2 * sum(follow.values())
    assert company[0][end].sum() == 2 * len(ids)


def test_gradients_are_those_of_the_loss_and_take_room_for_some_blocks_only(trained):
    rng = np.random.default_rng(6)
    _, _, model = trained
    texts = [rng.integers(0, 200, n) for n in (0, 15, 16, 40, *rng.integers(1, 200, 60))]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    read, want, _ = L._laid(model.bucket, np.concatenate(texts), first)
    read, real, group = read.astype(np.int16), want >= 0, np.where(want >= 0, model.group[want], 0)
    room = L._Room()
    got = {n: x.copy() for n, x in L._gradients(model.weights, read, group[L.SCORED :], real[L.SCORED :], room).items()}

    def loss(w):
        # of the classes, in natural logarithms, by position; the ids' shares within classes are left out
        m = L._tables(w, model.bucket, model.group, np.zeros_like(model.share))
        flat = np.concatenate(texts)
        return -(m.score(flat, first) - m.within(flat, first)).sum() * math.log(10) / real.sum()

    for n, x in model.weights.items():
        # along the gradient the loss changes by its square
        step = 0.02 / max(1e-9, float(np.sqrt((got[n] ** 2).sum())))
        up, down = (loss({**model.weights, n: x + s * step * got[n].reshape(x.shape)}) for s in (1, -1))
        assert (up - down) / (2 * step) == pytest.approx(float((got[n] ** 2).sum()), rel=0.03)
    held = {n: x.size for n, x in room.held.items()}
    many = 2 * L.PART + 2
    reps = -(-many // (len(read) // L.SCORED))
    read, group, real = (np.tile(x, reps) for x in (read, group, real))
    L._gradients(model.weights, read, group[L.SCORED :], real[L.SCORED :], room)
    most = (L.PART + 1) * L.SCORED + 1
    assert held and room.held["a"].size == L.PART * L.SCORED * 2 * L.SCORED and room.held["rows"].size == most * room.held["total"].size // L.BUCKETS
