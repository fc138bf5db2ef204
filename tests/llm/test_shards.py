import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreline.llm.op06_token_shards import ShardReader, ShardWriter, read_token_shards, write_token_shards
from scoreline.llm.storage import fresh_path

from .helpers import empty_documents, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60_000), max_size=30), max_size=20), st.integers(1, 200), st.sampled_from([2, 4]))
def test_round_trip(docs, frame, width):
    out = io.BytesIO()
    writer = ShardWriter(out, width, frame)
    for i, ids in enumerate(docs):
        writer.add(None if i == 3 else i, np.array(ids, np.uint32))
    writer.close()
    data = out.getvalue()
    reader = ShardReader(io.BytesIO(data), len(data))
    assert [(i, x.tolist()) for i, x in reader.all()] == [(None if i == 3 else i, ids) for i, ids in enumerate(docs)]
    pick = [i for i in range(0, len(docs), 4)]
    assert {i: x.tolist() for i, x in reader.read(pick).items()} == {i: docs[i] for i in pick}


def shard(n=50, frame=100):
    out = io.BytesIO()
    writer = ShardWriter(out, 2, frame)
    for i in range(n):
        writer.add(i, np.arange(i, i + 20))
    writer.close()
    return out.getvalue()


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_reading_one_document_takes_one_frame():
    data = shard()
    file = Counting(data)
    reader = ShardReader(file, len(data))
    before = file.taken
    assert reader.read([7])[7].tolist() == list(range(7, 27))
    assert file.taken - before == int(reader.frames["size"][np.searchsorted(reader.first, 7, "right") - 1])


def test_any_zstandard_reader_streams_a_shard():
    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(shard()), read_across_frames=True).read()
    assert raw == b"".join(np.arange(i, i + 20).astype("<u2").tobytes() for i in range(50))


def test_damage_is_noticed():
    data = bytearray(shard())
    data[30] ^= 1
    reader = ShardReader(io.BytesIO(data), len(data))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(reader.all())
    for at in (-1, -30):
        data = bytearray(shard())
        data[at] ^= 1
        with pytest.raises(ValueError):
            ShardReader(io.BytesIO(data), len(data))


def test_shards_of_odd_rows(spark):
    docs = odd_documents(spark)
    folder = fresh_path(spark, "test")
    manifest = write_token_shards(docs, folder, PATH, 2, shards=3)
    got = read_token_shards(manifest, folder).collect()
    whole = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text is not None, r.text) for r in docs.collect()), key=lambda r: (r[0], r[1] or 0, r[2], (r[3] or "").encode()))
    at, want = 0, []
    for _, doc_id, _, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got), key=lambda r: r[1]) == want
    assert manifest.selectExpr("sum(docs)", "sum(tokens)").first()[:] == (len(rows), at)


def test_empty_table_writes_no_shard(spark):
    folder = fresh_path(spark, "test")
    manifest = write_token_shards(empty_documents(spark), folder, PATH, 2)
    assert manifest.collect() == [] and read_token_shards(manifest, folder).collect() == []
