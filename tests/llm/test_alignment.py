import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreline.llm.op11_alignment import Aligner, Ends, Tokens, align_tokenizers, byte_ranges, closed_groups, compose, fragment
from scoreline.llm.queries import QUERIES
from scoreline.llm.units import spaced, unit_starts

from .helpers import empty_documents, odd_documents

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in SAME} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SAME)}
odd = st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\r", "\t", "a", "the", "▁", "é", " ", "　", "漢", "<|endoftext|>", "<s>", "'s", ";\r", "😀", "...", "=", "12", "ing"]), st.text(max_size=3)), max_size=14).map("".join)


def spelt(text):
    """(ids, byte ends) of both tokenizers over the whole text at once, None if not spelt."""
    if not text:
        return None
    a = TOKENIZER.encode(" " + text, add_special_tokens=False)
    sides = [(a.ids, [bytes(BYTE[c] for c in t) for t in a.tokens])]
    b = PIECES.encode(text)
    sides.append((b, [bytes([int(PIECES.id_to_piece(i)[1:-1], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]))
    if any(b"".join(parts) != (" " + text).encode() for _, parts in sides):
        return None
    return [(ids, np.cumsum([len(p) for p in parts]).tolist()) for ids, parts in sides]


def groups_of(text):
    """Groups as pairs of id lists, by one walk over all ends."""
    sides = spelt(text)
    if sides is None:
        return []
    out, at = [], [0, 0]
    for end in sorted(set(sides[0][1]) & set(sides[1][1])):
        group = []
        for s, (ids, ends) in enumerate(sides):
            until = ends.index(end, at[s]) + 1
            group.append(ids[at[s] : until])
            at[s] = until
        out.append(tuple(group))
    return out


def brute(texts):
    """The contract's columns of each text."""
    every = [groups_of(t) for t in texts]
    links = [Counter((a, b) for left, right in groups for a in left for b in right) for groups in every]
    count = Counter(p for one in links for p in one)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for groups, one in zip(every, links, strict=True):
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(one.values()), sum(n for p, n in one.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in one.items()), hashlib.sha256(shown.encode()).hexdigest() if shown else "", shown))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups or "") for r in df.collect()), key=repr)


def wanted(rows):
    return sorted(((i, *values) for (i, _), values in zip(rows, brute([t for _, t in rows]), strict=True)), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(odd, min_size=1, max_size=5))
def test_units_give_the_tokens_of_whole_texts(texts):
    import pyarrow as pa

    own = ALIGNER
    for _, _, data, offsets in spaced(pa.array(texts)):
        units = own.units(data, offsets)
        valid = own.valid_rows(units)
        for r, text in enumerate(texts):
            expected = spelt(text)
            assert bool(valid[r]) == (expected is not None)
            if valid[r]:
                one = own.units(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))
                for got, (ids, ends) in zip(own.tokens(one), expected, strict=True):
                    assert got.ids.tolist() == ids and got.ends.tolist() == ends


ALIGNER = Aligner(A, B)


def ends_of(text, cuts):
    sides = [Tokens(np.array(ids), np.array(ends)) for ids, ends in spelt(text)]
    n = len(text.encode()) + 1
    at = sorted({0, n, *[c % n for c in cuts]})
    out = []
    for chunk, (lo, hi) in enumerate(zip(at, at[1:])):
        head, inner, tail, closed = fragment(*sides, lo, hi)
        out.append((Ends(chunk if closed else None, *[tuple(x.tolist() for x in part) for part in (head, tail)]), closed_groups(*inner)[3] if closed else ""))
    return out


@settings(max_examples=150, deadline=None)
@given(odd.filter(lambda t: spelt(t) is not None), st.lists(st.integers(0, 200), max_size=6), st.randoms(use_true_random=False))
def test_fragments_of_any_cuts_compose_in_any_order(text, cuts, rng):
    parts = ends_of(text, cuts)
    rows = [(chunk, 1, closed) for chunk, (_, closed) in enumerate(parts) if closed]
    level = [e for e, _ in parts]
    while len(level) > 1:
        i = rng.randrange(len(level) - 1)
        level[i : i + 2], joint = [compose(level[i], level[i + 1])[0]], compose(level[i], level[i + 1])[1]
        if joint:
            rows.append((joint[0], 0, ",".join(map(str, joint[1])) + "|" + ",".join(map(str, joint[2]))))
    assert level[0].closes is not None and level[0].tail == ([], [])
    rows.append((level[0].closes, 0, ",".join(map(str, level[0].head[0])) + "|" + ",".join(map(str, level[0].head[1]))))
    assert ";".join(t for _, _, t in sorted(rows)) == brute([text])[0][-1]


@settings(max_examples=100, deadline=None)
@given(odd, st.integers(1, 9))
def test_ranges_cover_the_text_and_no_half_of_a_long_unit(text, most):
    data = np.frombuffer((" " + text).encode(), np.uint8)
    starts = unit_starts(data, np.array([0, len(data)]))
    ranges = byte_ranges(data, starts, most)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    ends = [*starts[1:], len(data)]
    for lo, hi in ranges:
        assert hi - lo <= most or hi in ends
        for s, e in zip(starts, ends, strict=True):
            assert e - s <= most or not s < hi < e


TEXTS = [
    "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", "", None, " ", "\n", "a▁b", "die Straße führt nach München", "x" * 300, "naïve café, señor!  two  spaces\n\nnew lines\n",
    "<|endoftext|> is <s>plain</s> text", "漢字かな交じり文 and words", "the the the the fox fox", "🙂🙂 emoji", "tab\tand\rreturn;\r\n", " ".join(f"word{i % 7} theking{i}" for i in range(120)),
]


@pytest.mark.parametrize("options", [{}, {"frequent": 0}, {"frequent": 20, "held": 3}, {"chunk_bytes": 8, "fan_in": 2}, {"chunk_bytes": 40, "fan_in": 3, "frequent": 10}])
def test_every_way_agrees_with_brute_force(spark, options):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "an id that is missing"), (3, "the fox again"), (15, TEXTS[15])]
    got = align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B, with_groups=True, **options)
    assert rows_of(got) == wanted(rows)


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(align_tokenizers(docs, A, B, chunk_bytes=1 << 14, with_groups=True)) == wanted(rows)
    assert align_tokenizers(empty_documents(spark), A, B).count() == 0


def test_query_on_its_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_tokenizer_alignment"](spark, folder)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(w[:-1] for w in wanted(rows))
