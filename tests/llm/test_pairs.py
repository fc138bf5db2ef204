"""N-gram Jaccard join, components and benchmark decontamination against brute force."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from scoreline.llm import op10_ngram_join as J
from scoreline.llm.graph import components
from scoreline.llm.op04_decontaminate import Index, distance, find_leaks, fingerprints, window_size
from scoreline.llm.op10_ngram_join import ngram_jaccard_join, ngram_jaccard_pairs

from .helpers import empty_documents, odd_documents, shingle_set, words


def brute_components(rows, k, t):
    """component of each row index by all pairs; rows: (id, text)."""
    sets, parent = [shingle_set(text, k) for _, text in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= t * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def family(rng, n):
    """Copies with 0 to 6 changed words of one base, chains, texts that share a long passage,
    and texts around the threshold."""
    base, passage = [f"b{i}" for i in range(60)], [f"p{i}" for i in range(50)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 7), replace=False):
            w[at] = f"x{rng.integers(1_000_000)}"
        out.append(w)
    for _ in range(n // 2):
        own = [f"o{rng.integers(1_000_000)}" for _ in range(rng.integers(1, 120))]
        out.append(own + passage)
    chain = [f"c{i}" for i in range(80)]
    for i in range(12):
        out.append(chain[i : i + 60])
    out += [["a"], ["a"], ["a", "b"], ["b", "a"], ["a", "b", "a", "b", "a", "b"]]
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("k,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_join_is_exact(spark, k, t):
    rng = np.random.default_rng(k)
    texts = family(rng, 60)
    rows = list(zip((rng.permutation(len(texts)) + 10).tolist(), texts, strict=True))
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k, threshold=t).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, k, t))


def test_pairs_are_all_links_of_different_sets(spark):
    texts = family(np.random.default_rng(8), 30)
    texts += texts[:3]
    sets = [shingle_set(t, 3) for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    pairs, members = ngram_jaccard_pairs(docs.repartition(3), threshold=Fraction(4, 5))
    own = {r.doc_id: r for r in members.collect()}
    assert len(own) == len(texts) + 2 and own[900].class_id is None and own[901].class_id is None
    of = {own[i].class_id: s for i, s in enumerate(sets)}
    assert all(own[i].n_shingles == len(s) for i, s in enumerate(sets)) and len(of) == len(set(sets))
    got = pairs.collect()
    assert all((r.x_shingles, r.y_shingles, r.common) == (len(of[r.x]), len(of[r.y]), len(of[r.x] & of[r.y])) for r in got)
    want = sorted((x, y) for x in of for y in of if x < y and 5 * len(of[x] & of[y]) >= 4 * len(of[x] | of[y]))
    assert sorted((r.x, r.y) for r in got) == want and len(want) > len(of)


def test_join_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_jaccard_join(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_components(rows, 3, Fraction(9, 10)), key=key)


def test_join_empty(spark):
    assert ngram_jaccard_join(empty_documents(spark)).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert len({got[i] for i in range(41)}) == 1
    assert len({got[100], *(got[200 + i] for i in range(30))}) == 1
    assert got[500] == got[501] and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def brute_leaks(text, items, least=0.8):
    """Items whose shingles the text has, by unweighted share, anywhere in it."""
    held = shingle_set(text, 5)
    return sorted(i for i, t in items if (s := shingle_set(t, 5)) and len(s & held) >= least * len(s))


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"{'abcdefgh'[rng.integers(8)]}{rng.integers(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 9, 15, 24, 33, 59, 100, 400])]
    plain = [" ".join(word() for _ in range(200)) for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(plain)]
    docs += [(10 + i, plain[0] + " " + t.upper() + "\n" + plain[1]) for i, t in items]
    docs += [(30 + i, t) for i, t in items] + [(50, " ".join(t for _, t in items)), (51, " ".join(items[5][1].split()[:20]))]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_items=4)
    for r in found.collect():
        assert [x.item_id for x in r.leaks] == brute_leaks(r.text, items), r.doc_id
        for x in r.leaks:
            n = len(words(dict(items)[x.item_id]))
            assert x.end_word - x.start_word == n and x.similarity == pytest.approx(1.0)
            assert words(r.text)[x.start_word : x.end_word] == words(dict(items)[x.item_id])


def test_a_changed_word_still_leaks(spark):
    item = [f"v{i}" for i in range(50)]
    changed = item[:25] + ["new"] + item[26:]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 30 + changed + ["y"] * 30))], "doc_id long, text string")
    (row,) = find_leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [x.item_id for x in row.leaks] == [7] and row.leaks[0].similarity == pytest.approx(41 / 46)


def test_leaks_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (2, None), (None, "x"), (3, ""), (4, "x")], "item_id long, text string")
    got = find_leaks(docs, items)
    assert got.columns == [c for c in docs.columns if c != "leaks"] + ["leaks"]
    for r in got.collect():
        assert [x.item_id for x in r.leaks] == [i for i, t in ((1, "the quick"), (4, None)) if (t and t in (r.text or "")) or (i == 4 and "x" in words(r.text))]
    assert find_leaks(empty_documents(spark), items).collect() == []
    assert all(r.leaks == [] for r in find_leaks(docs, items.limit(0)).collect())


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 20, dtype=np.uint64)
    index = Index([], 8, {3: Index._multi_index([(int(p), i, 0) for i, p in enumerate(prints)], 8)})
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, d, replace=False))) for d in range(14) for _ in range(40)]
    windows = np.array([prints[i % 20] ^ f for i, f in enumerate(flips)], np.uint64)
    at, which, far = index.near(3, windows)
    want = {(w, p, int(distance(windows[w], prints[p]))) for w in range(len(windows)) for p in range(20) if distance(windows[w], prints[p]) <= 8}
    assert {(int(a), int(b), int(c)) for a, b, c in zip(at, which, far, strict=True)} == want


def test_fingerprints_are_bitwise_majorities():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for size in (1, 2, 9, 28, 211, 255):
        got = fingerprints(hashes, size)
        for p in range(0, len(got), 37):
            ones = sum(((int(h) >> np.arange(64, dtype=object)) & 1 for h in hashes[p : p + size]), np.zeros(64, object))
            assert int(got[p]) == sum(1 << b for b in range(64) if ones[b] > size // 2)
    assert [window_size(n) for n in (1, 5, 15, 59, 400, 10_000)] == [1, 4, 13, 42, 211, 211]
    assert Index.build([(1, "")], 8).items == []


@pytest.mark.parametrize("held", [J.HELD_SHINGLES, 5])
def test_levels_count_the_shingles_of_every_class(spark, monkeypatch, held):
    monkeypatch.setattr(J, "HELD_SHINGLES", held)
    texts = [f"common words here {i} " + " ".join(f"w{i * 7 + j}" for j in range(i % 9)) for i in range(40)] + ["common words here 3 " + "w21 w22 w23", "alone in this table", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = docs.selectExpr("doc_id", "doc_id AS key", "text")
    survey = J._surveyed(rows, 3)
    classes = {frozenset(v.tolist()) for _, v in J._sets(pa.RecordBatch.from_pydict({"text": texts}), 3)}
    often = Counter(v for c in classes for v in c)
    cells = np.zeros(J.LEVEL_CELLS, np.uint8)
    for v, n in often.items():
        if n > 1:
            at = v & (J.LEVEL_CELLS - 1)
            cells[at] = max(cells[at], 1 + int(math.log2(n)))
    assert cells.max() == 1 + int(math.log2(40))
    assert (J._levels(survey) == cells).all()
    sizes = {r.doc_id: r.n for r in survey.where("kind = 0").collect()}
    assert sizes == {i: len(shingle_set(t, 3)) for i, t in enumerate(texts)}
