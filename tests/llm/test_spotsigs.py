import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash

from quillspark.llm.spotsigs import chained, fingerprint_of, likenesses, oracle, partition_of, spots, spots_of

TEXTS = [None, "", "the", "no anchors here really", "The quick brown fox and the lazy dog of doom runs", "É é", "🎈" * 7, "the word other " * 4000, "a b c d"]


def plain(text):
    """Signatures by looking ahead from each anchor."""
    import string

    from quillspark.llm.spotsigs import ANCHORS

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = "".join(c for c in low if c not in string.punctuation or c == "|").encode().split()
    anchor = lambda w: len(w) <= 2 or w.decode() in ANCHORS.split()
    found = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if not anchor(x)][:2] if anchor(w) else []
        if len(chain) == 2:
            found.add((w, *chain))
    return found or {text}


def test_signatures_and_likeness():
    rng = random.Random(1)
    texts = [t for t in TEXTS if t is not None and len(t) < 1000] + [" ".join(rng.choice(["the", "of", "cat", "Dog,", "bird", "fish!"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts[::7]]
    sets = [(plain(a), plain(b)) for a, b in pairs]
    want = [len(x & y) / len(x | y) for x, y in sets]
    assert all(len(spots(a)) == len(plain(a)) for a in texts)
    made = [(spots(a), spots(b)) for a, b in pairs]
    assert likenesses(made, every=True)[0].tolist() == pytest.approx(want)
    for least in (0.3, 0.5, 0.8, 1.0 - 1e-9):
        value, near = likenesses(made, least)
        assert near.tolist() == [w >= least - 1e-9 for w in want]
        assert value.tolist() == pytest.approx([w if n else 0 for w, n in zip(want, near, strict=True)])
    assert likenesses([])[0].tolist() == []


def test_fingerprints_hold_their_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 500):
        found = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        text = fingerprint_of(found)
        assert len(text) == 8 * len(found) and spots_of(text).tolist() == found.tolist()
    assert partition_of(np.array([1, 10, 12, 13, 100])).tolist() == [0, 10, 11, 11, 20]


def jaccard(a, b):
    x, y = set(spots(a).tolist()), set(spots(b).tolist())
    return len(x & y) / len(x | y)


def chain_of(rows):
    """The query, by sorting all documents."""
    line = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0], np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)), reverse=True)
    out = []
    for (i, t), (_, o) in zip(line, line[1:] + line[:1], strict=True):
        h = len(t) // 2
        e = t[: len(t) - h] + o[:h]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint_of(spots(t)), fingerprint_of(spots(e)), jaccard(t, e), jaccard(t, o), len(spots(t))))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_chain_of_documents(spark, parts):
    rng = random.Random(2)
    rows = [(i * 13 % 101, t, "x") for i, t in enumerate(TEXTS + [" ".join(rng.choice(["the", "of", "cat", "dog", "bird"]) for _ in range(50)) for _ in range(30)])]
    rows += [(7000, "same id one", "y"), (7000, "same id one", "y"), (7000, None, "y"), (None, "the last of all words", "z"), (None, "another", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(parts)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in chained(docs).collect()), key=key)
    assert got == sorted(chain_of(rows), key=key)
    for r in got:
        a, b = (set(spots_of(f).tolist()) for f in r[3:5])
        assert r[5] == len(a & b) / len(a | b)  # recomputed from the columns alone


def test_one_id_on_most_rows(spark):
    rng = random.Random(9)
    rows = [(5 if i % 3 else i, " ".join(rng.choice(["the", "of", "cat", "dog", "bird", "fish"]) for _ in range(30)), "a") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string").repartition(6)
    got = chained(docs)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(chain_of(rows), key=key)
    assert max(got.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()) < 300


def test_ids_of_other_types(spark):
    rows = [(c, f"text of {c} the word after word") for c in ["b", "a", "", "é", "Z", None, "漢"]]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    assert sorted(map(str, map(tuple, chained(docs).collect()))) == sorted(map(str, chain_of(rows)))


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    r = chained(docs).collect()
    assert [(x.doc_id, x.near_next) for x in r] == [(5, 1.0)]
    assert r[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert chained(docs.limit(0)).collect() == []


def test_sql_on_odd_texts(spark, tmp_path):
    rng = random.Random(4)
    odd = TEXTS + ["a|b c.d (the) [cat] {dog} ^bird `fish` ~", "der Für FÜR für im\x0bauf\x0ceins zwei drei", "\u2028the\xa0one two\u3000three of the four five", "the\r\ncat\tdog", "E\u0301 the cafe\u0301 du coin vert"]
    rows = [(i * 17 % 211, t) for i, t in enumerate(odd + [" ".join(rng.choice(["the", "of", "cat", "Dog,", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    got = chained(docs)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/docs/*.parquet'")
        want = db.sql(oracle())
        assert want.columns == got.columns
        assert sorted(want.fetchall()) == sorted(map(tuple, got.collect()))
