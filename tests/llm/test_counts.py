import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreline.llm.op12_token_counts import SPACE, PieceMerges, UnitCounts, count_tokens
from scoreline.llm.queries import QUERIES

from .helpers import empty_documents, odd_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
MERGES = PieceMerges(MODEL)
COUNTS = UnitCounts(MODEL)
FEW = UnitCounts(MODEL, most=8)
odd = st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\r", "\t", "a", "the", "▁", "é", " ", "　", "漢", "<s>", "<0x41>", "<unk>", "'s", ";\r", "😀", "\x00", "...", "=", "ing", "0x"]), st.text(max_size=4)), max_size=14).map("".join)


def wanted(text):
    return len(LIBRARY.encode(text or ""))


@settings(max_examples=300, deadline=None)
@given(odd)
def test_one_heap_over_the_whole_text_counts_as_the_library_does(text):
    whole = (SPACE + text.replace(" ", SPACE)) if text else ""
    assert MERGES.count(whole) == wanted(text)
    assert sum(map(MERGES.count, MERGES.parts(whole))) == wanted(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), odd), max_size=8))
def test_units_add_up(texts):
    column = pa.array(texts, pa.string())
    assert COUNTS.of(column).tolist() == [wanted(t) for t in texts]
    assert FEW.of(column).tolist() == [wanted(t) for t in texts]  # its memory is emptied again and again


def test_long_runs():
    texts = ["a" * 30_000, " " * 5_000, "▁" * 333, "ab " * 2_000, "漢" * 2_000, "\n" * 2_000, "x" + " \n" * 999]
    assert COUNTS.of(pa.array(texts)).tolist() == [wanted(t) for t in texts]


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    got = sorted((tuple(r) for r in count_tokens(docs, MODEL, 9).collect()), key=repr)
    want = [(r.doc_id, len((r.text or "").encode()), wanted(r.text), wanted(r.text) > 9) for r in docs.collect()]
    assert got == sorted(want, key=repr) and {r[3] for r in got} == {True, False}
    assert count_tokens(empty_documents(spark), MODEL, 9).count() == 0


def test_query_on_its_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_token_counts"](spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((r.doc_id, len((r.text or "").encode()), wanted(r.text), wanted(r.text) > 4096) for r in docs)
