import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import langid, quality
from quillspark.llm.simhash import fingerprint_of


def brute(docs, net, model):
    """The pipeline on a list of rows, document by document, with the fitted models."""
    start, weights = model
    kept = []
    for r in docs:
        f = dict(zip(quality.FEATURES, quality.features_of(r.text), strict=True))
        if f["n_words"] < 20 or 100 * f["n_repeat_words"] > 30 * f["n_words"]:
            continue
        sql = lambda e: eval(e.replace(" = ", " == ").replace("AND", "and").replace("OR", "or").replace("FALSE", "False"), {}, f)
        odds = start + sum(weights[i][0 if sql(bad) else 2 if sql(good) else 1] for i, (_, bad, good) in enumerate(quality.RULES))
        if odds >= 0:
            kept.append(r)
    kept = [r for r in kept if langid.has_letter(r.text) and net.pooled([r.text.encode()])[0].max() >= langid.LEAST]
    prints = [fingerprint_of(r.text) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, r in zip(group, kept, strict=True):
        least[g] = min(least.get(g, r), r, key=lambda r: r.doc_id)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = set()
    for r in least.values():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        out |= {(r.doc_id, p, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), 4096))}
    return out


def test_against_one_document_at_a_time(spark, tmp_path):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "tion", "er", "ha", "wh"], "de": ["der", "ung", "sch", "ü", "ä", "pf"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) + rng.choice([" the of and", " der die und", "", ""]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(30, 300)), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200 + i, rows[i][1].replace("e", "e", 1) if i % 2 else rows[i][1], rows[i][2], "s", 0) for i in range(20)]
    rows += [(300 + i, " ".join(w + "###" for w in rows[i][1].split()), "en", "s", 0) for i in range(10)]
    rows += [(400, None, "en", "s", 0), (401, "", None, "s", 0), (402, "12 34 " * 30, None, "s", 0), (403, text("en", 9000), None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = quality.fit(docs.select(quality.features(docs.text).alias("f")).select("f.*"))
    net = langid.fit(quality.keep_good(docs))
    want = brute(docs.collect(), net, model)
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    ids = {r.doc_id for r in got}
    assert 403 in ids and len(ids & set(range(120))) >= 110 and not ids & set(range(200, 311)) | {400, 401, 402} & ids
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in fill.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the generated tables are elsewhere")
def test_planted_rows_of_the_smallest_tables(spark):
    """Clean documents stay, junk and copies go, on rows as the driver makes them."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    good = [i for i, q in labels.items() if q == 1 and words[i] >= 50]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
