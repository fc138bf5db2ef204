import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreline.llm.op06_token_shards import encode_texts
from scoreline.llm.pieces import PartIds
from scoreline.llm.tokens import Words, chunks, shingles, text_buffers, word_chunks

from .helpers import words

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x0c\rAZaz09.' ́İΣ|<>"), st.characters(codec="utf-8")), max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(rows):
    data, offsets = text_buffers(pa.array(rows, pa.string()))
    found = Words(data, offsets)
    for r, text in enumerate(rows):
        part = range(found.first[r], found.first[r + 1])
        assert [data[found.starts[i] : found.ends[i]].tobytes().decode() for i in part] == [w for w in words_as_written(text)]
    flat = [w for t in rows for w in words(t)]
    assert len(set(flat)) == len(set(found.hashes.tolist()))
    assert len({(w, int(h)) for w, h in zip(flat, found.hashes, strict=True)}) == len(set(flat))


def words_as_written(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_chunks_hold_whole_rows():
    _, offsets = text_buffers(pa.array(["a" * 10, "", "b" * 3, "c" * 100, ""]))
    parts = list(chunks(offsets, 12))
    assert [r for lo, hi in parts for r in range(lo, hi)] == list(range(5))
    assert all(hi - lo == 1 or offsets[hi] - offsets[lo] <= 12 for lo, hi in parts)


def test_chunking_does_not_change_words():
    column = pa.array(["one two", None, "three " * 50, "four"]).slice(1)
    whole = np.concatenate([w.hashes for *_, w in word_chunks(column)])
    assert (whole == np.concatenate([w.hashes for *_, w in word_chunks(column, 1)])).all()


def test_short_sequences_are_one_shingle():
    h = np.array([5, 6], np.uint64)
    assert len(shingles(h, 3)) == 1 and len(shingles(h[:0], 3)) == 0
    assert shingles(h, 3)[0] != shingles(h[::-1].copy(), 3)[0]


PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = PartIds(PATH)
pieces = st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAzZéÉßüÿĀſŉİ'stredmlv019.,!?<|>́ \x7f\x01"), st.characters(codec="utf-8")), max_size=14), max_size=12)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_pieces_encode_like_whole_texts(rows):
    got = encode_texts(pa.array(rows, pa.string()), ENCODER, 2)
    assert [g.tolist() for g in got] == [WHOLE.encode(t or "", add_special_tokens=False).ids + [2] for t in rows]


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_words_encode_like_texts(rows):
    assert ENCODER.words.short
    got = encode_texts(pa.array([" ".join(rows), *rows]), ENCODER, 2)
    assert [g.tolist() for g in got] == [WHOLE.encode(w, add_special_tokens=False).ids + [2] for w in [" ".join(rows), *rows]]
    assert [list(x) for x in ENCODER.words.encode(rows)] == [WHOLE.encode(w, add_special_tokens=False).ids for w in rows]


def test_every_latin_letter():
    rows = [f"{a}{chr(c)}{b}" for c in range(0x21, 0x250) for a in ("", "n") for b in ("", "x.")]
    assert [x.tolist()[:-1] for x in encode_texts(pa.array(rows), ENCODER, 2)] == [e.ids for e in WHOLE.encode_batch(rows, add_special_tokens=False)]
    assert [list(x) for x in ENCODER.words.encode(rows)] == [e.ids for e in WHOLE.encode_batch(rows, add_special_tokens=False)]


def test_special_token_strings():
    rows = ["a <|endoftext|>b", "<|startoftext|> x", " a\u0085b\x1cc"]
    got = encode_texts(pa.array(rows), PartIds(PATH, most=2), 2)
    assert [g.tolist() for g in got] == [WHOLE.encode(t, add_special_tokens=False).ids + [2] for t in rows]


def test_special_tokens_in_other_cases_keep_their_own_ids():
    rows = ["<|endoftext|>", "<|EndOfText|>", "a <|ENDOFTEXT|> <|endoftext|>"]
    for order in (rows, rows[::-1]):
        got = encode_texts(pa.array(order), PartIds(PATH), 2)
        assert [g.tolist() for g in got] == [WHOLE.encode(t, add_special_tokens=False).ids + [2] for t in order]


def test_distinct_values_are_those_of_unique():
    import numpy as np

    from scoreline.llm.tokens import distinct

    for values in (np.zeros(0, np.uint64), np.array([7, 2**64 - 1, 0, 7, 3], np.uint64), np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)):
        for got, plain in zip(distinct(values), np.unique(values, return_inverse=True), strict=True):
            assert got.tolist() == plain.tolist()
