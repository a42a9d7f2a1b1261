import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.langid import HALO, STRETCH, UNKNOWN, WIDTH, Network, fit, identify, keep_known, predict, stretches, training_passages

PARTS = {"en": ["the", "ing", "tion", "er", "ha", "wh"], "de": ["der", "ung", "sch", "ü", "ä", "pf"], "fr": ["le", "eau", "oi", "é", "è", "que"], "es": ["el", "ción", "ñ", "rr", "ado", "ó"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(1)
    net = Network(["a", "b", "c"], hidden=3)
    net.p = {n: w.astype(np.float64) for n, w in net.p.items()}
    x = rng.integers(0, 256, (5, 7))
    mask = np.arange(7)[None, :] < np.array([7, 4, 1, 7, 6])[:, None]
    label = np.array([0, 1, 2, 1, 0])
    _, g = net.gradients(x, mask, label)
    for name, w in net.p.items():
        flat = w.reshape(-1)
        for i in np.flatnonzero(g[name].reshape(-1))[:: max(1, flat.size // 40)]:
            kept, eps = flat[i], 1e-3
            flat[i] = kept + eps
            up = net.gradients(x, mask, label)[0]
            flat[i] = kept - eps
            down = net.gradients(x, mask, label)[0]
            flat[i] = kept
            assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[i]) < 2e-4, name


def slow(net, text):
    """Mean probabilities of a text, byte by byte: stretches are cut between characters, and both directions are read with their context."""
    data = text.encode()
    borders, at = [], 0
    for c in text:
        borders.append(at)
        at += len(c.encode())
    borders.append(len(data))
    snap = lambda place: min(b for b in borders if b >= min(place, len(data)))
    h_n, total = net.hidden, np.zeros(len(net.langs))
    starts = sorted({snap(i) for i in range(0, len(data), STRETCH)} - {len(data)})
    for start, end in zip(starts, [*starts[1:], len(data)][: len(starts)], strict=True):
        first, last = snap(max(0, start - HALO)), snap(end + HALO)
        window = data[first:last] + bytes(WIDTH - (last - first))
        states = []
        for d, order in ((0, range(WIDTH)), (1, range(WIDTH - 1, -1, -1))):
            h, out = np.zeros(h_n), {}
            for t in order:
                a, m = net.p["x"][d][window[t]], h @ net.p["u"][d]
                z, r = (np.clip(0.2 * (a[k : k + h_n] + m[k : k + h_n]) + 0.5, 0, 1) for k in (0, h_n))
                n = np.clip(a[2 * h_n :] + r * m[2 * h_n :], -1, 1)
                h = out[t] = n + z * (h - n)
            states.append(out)
        for t in range(start - first, end - first):
            score = states[0][t] @ net.p["v"][0] + states[1][t] @ net.p["v"][1] + net.p["c"]
            total += np.exp(score) / np.exp(score).sum()
    return total / max(1, len(data))


LONG = ["", "x", "abc" * 100, "é" * 100, "漢字" * 70 + "a", "🎈b" * 60, "y" * STRETCH, "z" * (STRETCH - 1) + "漢" * 30, "ab🎈" * 16 + "é", "mixed é漢🎈 text " * 40]


def test_pooled_equals_one_byte_at_a_time():
    net = Network(["a", "b", "c"], hidden=4)
    got = net.pooled([t.encode() for t in LONG], side=3)
    for t, p in zip(LONG, got, strict=True):
        assert np.allclose(p, slow(net, t), atol=1e-5), t
    x, mask, of = stretches(LONG)
    assert [int(mask[of == i].sum()) for i in range(len(LONG))] == [len(t.encode()) for t in LONG]
    for row, own in zip(x, mask, strict=True):
        bytes(row[own]).decode()  # whole code points
        bytes(row).rstrip(b"\0").decode()


def test_query_against_one_document_at_a_time(spark):
    """Labels and scores of the whole query, by the network that it trains, read byte by byte."""
    rng = random.Random(6)
    rows = [(i, text(lang, rng.randint(5, 60), rng), lang) for i, lang in enumerate(sorted(PARTS) * 12)] + [(100 + i, t, None) for i, t in enumerate(LONG)] + [(200, None, "en"), (201, "1 2 3", "de"), (None, "the thing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    net = fit(docs)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        known = bool(t) and any(map(str.isalpha, t))
        p = slow(net, t) if known else None
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert abs(got[i].score - (p.max() if known else 0)) < 1e-4
        if not known:
            assert got[i].lang_pred == UNKNOWN
        elif np.sort(p)[-1] - np.sort(p)[-2] > 1e-3:
            assert got[i].lang_pred == net.langs[int(p.argmax())]


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"words of text {i}", f"l{i % 7 if i < 70 else 9}") for i in range(75)], "doc_id long, text string, lang string")
    found = training_passages(docs, "doc_id", "text", "lang", most=5)
    assert len({lang for lang, _ in found}) == 5 and "l9" not in {lang for lang, _ in found}


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, text(lang, rng.randint(5, 200), rng), lang, "s") for i, lang in enumerate(sorted(PARTS) * 100)]
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 -- ...", None, "s"), (1003, text("de", 20, rng), None, "s"), (None, text("fr", 20, rng), "fr", "s"), (1004, text("es", 30_000, rng), "es", "s")]
    docs = spark.createDataFrame(rows + odd + odd[:2], "doc_id long, text string, lang string, score string")
    got = identify(docs).collect()
    assert len(got) == len(rows) + len(odd) + 2
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == [UNKNOWN] * 3 and by[1002].score == 0
    assert (by[1003].lang_pred, by[None].lang_pred, by[1004].lang_pred) == ("de", "fr", "es")
    assert all(0 <= r.score <= 1 for r in got)
    kept = keep_known(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not {1000, 1001, 1002} & set(ids) and {1003, 1004, None} <= set(ids)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "words here", None), (2, None, None)], "doc_id long, text string, lang string")
    assert fit(docs) is None
    assert sorted((r.lang_pred, r.score) for r in identify(docs).collect()) == [(UNKNOWN, 0.0)] * 2
    assert [r.doc_id for r in keep_known(docs).collect()] == [1]
    assert identify(docs.limit(0)).collect() == []
    assert stretches([])[0].shape == (0, WIDTH)
    assert docs.select(predict(None, docs.text)).count() == 2


def test_rate_counts_usable_texts(spark):
    n = 60_000
    text = F.when(F.col("id") < 800, F.concat(F.lit("words of number "), "id")).when(F.col("id") % 2 == 0, F.concat("id", F.lit(" 12 -- ")))
    empty = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("xx").alias("lang"))
    again = spark.range(n).select(F.when(F.col("id") < 800, F.col("id")).otherwise(0).alias("doc_id"), F.lit("repeated words").alias("text"), F.lit("yy").alias("lang"))
    found = training_passages(empty.unionByName(again), "doc_id", "text", "lang")
    assert [sum(lang == x for lang, _ in found) for x in ("xx", "yy")] == [300, 300]
    assert all(any(map(str.isalpha, p)) for _, p in found)
