import io
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm.tokenfile import TokenFileReader, TokenFileWriter, read_token_files, write_token_files
from quillspark.llm.words import encoder

PATH = P.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WHOLE.encode_special_tokens = True
ODD = ["", None, "H̱ ẖ İ", "Über É, straße. it's 1²3 a b c\x1cd", "<|endoftext|> x", "ΑΣ ς", "\u0001 \x85z 漢字 ﬁ", "a,b. c!!... d's'll", "İ K", "word " * 5000]


def brute(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_encoder_on_odd_texts():
    got = encoder(PATH).encode(ODD)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [brute(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_encoder_equals_library(texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(PATH).encode(texts)] == [brute(t) for t in texts]


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def make(docs, frame_bytes):
    out = io.BytesIO()
    w = TokenFileWriter(out, pa.int64(), 2, frame_bytes)
    for k, ids in docs:
        w.add(k, np.array(ids, "<u2").tobytes())
    w.close()
    return out.getvalue()


@pytest.mark.parametrize("frame_bytes", [1, 10, 1 << 20])
def test_file_round_trip_and_single_document(frame_bytes):
    docs = [(1, [1, 2, 3]), (2, []), (2, [9]), (5, list(range(100))), (None, [7])]
    data = make(docs, frame_bytes)
    got = [(k, ids.tolist()) for k, _, ids in TokenFileReader(Source(data)).documents()]
    assert got == docs
    reader = TokenFileReader(Source(data))
    assert [(k, s, ids.tolist()) for k, s, ids in reader.documents({5})] == [(5, 4, list(range(100)))]


def test_damaged_frame_is_found_and_others_still_read():
    data = bytearray(make([(1, [1] * 50), (2, list(range(50)))], 1))
    reader = TokenFileReader(Source(bytes(data)))
    reader.sums[0] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(reader.documents({1}))
    assert len(list(reader.documents({2}))) == 1


def test_files_against_brute_force(spark, tmp_path):
    rows = [(i * 7 % 31, t, f"x{i}") for i, t in enumerate(ODD + ["same text"] * 5)] + [(3, "again", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest = write_token_files(docs.repartition(3), str(tmp_path / "f"), PATH, end_id=2, frame_bytes=64)
    got = sorted(tuple(r) for r in read_token_files(manifest, docs.schema["doc_id"].dataType).collect())
    want, start = [], 0
    for k, ids in [(k, np.array(brute(t) + [2], "<u2").tobytes()) for k, t in sorted((k, t or "") for k, t, _ in rows)]:
        n = len(ids) // 2
        want.append((k, start, n, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())))
        start += n
    assert [(g[0], g[2]) for g in got] == sorted((w[0], w[2]) for w in want)
    assert sorted(g[1:] for g in got) == sorted(w[1:] for w in want)


def test_empty_table_and_nulls(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    manifest = write_token_files(empty, str(tmp_path / "e"), PATH)
    assert read_token_files(manifest, empty.schema["doc_id"].dataType).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    manifest = write_token_files(nulls, str(tmp_path / "n"), PATH)
    got = read_token_files(manifest, nulls.schema["doc_id"].dataType, digest_only=False).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids) for r in got] == [(None, 0, [2]), (1, 1, [2])]


def test_one_id_on_most_rows(spark, tmp_path):
    """Rows of one id, equal ones among them, are spread over files and keep their order."""
    import xxhash

    rows = [(5, f"text {i % 7} of many") for i in range(400)] + [(i, "other") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = write_token_files(docs, str(tmp_path / "h"), PATH)
    assert max(r.n_docs for r in manifest.collect()) < 400
    got = [(r.doc_id, r.start, r.ids) for r in read_token_files(manifest, docs.schema["doc_id"].dataType, digest_only=False).orderBy("start").collect()]
    want, start = [], 0
    for k, t in sorted(rows, key=lambda r: (r[0], np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64))):
        want.append((k, start, brute(t) + [2]))
        start += len(want[-1][2])
    assert got == want
