import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe
from quillspark.llm.bpe import MergeReplay, codec, decode, digests, encode, load_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [None, "", " ", "\n", "a  b", "a   b", "a\n b", "a \nb", "a\n\nb", "\n\nx ", " x\n", "it's we'll 's's ''s 'sabc", "aaaaaaaaa bbbb", "\u3000x \xa0y\tz", "Über straße 1²3 漢字 🎈", "<|endoftext|>", "x" * 3000, "\x1c \x1f y", "word " * 20000]


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_odd_texts():
    assert [ids(b) for b in codec(PATH, P.PATTERN).encode(ODD)] == [LIBRARY.encode_ordinary(t or "") for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40) | st.text("ab' \n\tsé1.", max_size=40), max_size=6))
def test_equals_library(texts):
    c = codec(PATH, P.PATTERN)
    got = c.encode(texts)
    assert [ids(b) for b in got] == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [c.decode(b).decode() for b in got] == texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=30) | st.text("abc", max_size=30).map(str.encode), max_size=6), st.lists(st.text("abc", min_size=2, max_size=5), unique=True, max_size=30))
def test_replay_with_ranks_out_of_order(words, tokens):
    """Vocabularies in which a merge may make a pair of lower rank."""
    ranks = {bytes([b]): i for i, b in enumerate(range(256))} | {t.encode(): 256 + i for i, t in enumerate(tokens)}

    def alone(text):
        if text in ranks:
            return [ranks[text]]
        parts = [text[i : i + 1] for i in range(len(text))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    replay = MergeReplay(ranks)
    for bpe.FEW in (1, 32):  # as arrays, and one by one
        assert [ids(b) for b in replay.encode(words)] == [alone(w) for w in words]


def test_every_code_point_is_split_alike():
    c = codec(PATH, P.PATTERN)
    points = [i for i in range(0x32000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{chr(p)}1 " for p in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    for t, b in zip(texts, c.encode(texts), strict=True):
        assert ids(b) == LIBRARY.encode_ordinary(t)


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD + ODD[:3])] + [(None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: tuple(r)[1:] for r in digests(docs, PATH, P.PATTERN).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(e := LIBRARY.encode_ordinary(t or "")), sha(np.array(e, "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows}
    assert got == want
    assert digests(docs.limit(0), PATH, P.PATTERN).collect() == []
    again = decode(encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).select("text", "decoded").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in again)
