import random

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash
from quillspark.llm.components import components
from quillspark.llm.simhash import fingerprint_of, keep_one, links, links_within, masks, near_duplicates, signed

TEXTS = [None, "", " \t\n", "one", "ONE", "one two", "One Two Three", "a b c d", "É é x y z", "x " * 5000]


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints, near=3):
    """Least index reachable of each, all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= near:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def cloud(rng, n):
    """Fingerprints in dense and sparse groups, with chains."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64) if rng.random() < 0.7 or not out else rng.choice(out)
        for _ in range(rng.choice([1, 1, 5, 60])):
            out.append(x)
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randint(0, 63)
    return list(dict.fromkeys(out[:n]))


def test_fingerprints():
    rng = random.Random(1)
    for t in TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 50))) for _ in range(100)]:
        assert fingerprint_of(t) == brute_print(t)


@pytest.mark.parametrize("distinct", [10, 10**8, 10**12])
def test_masks_leave_no_near_pair_out(distinct):
    rng, ms = random.Random(2), masks(distinct)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for _ in range(3):
            y ^= 1 << rng.randint(0, 63)
        assert any(x & m == y & m for m in ms)


def test_links_within_span_every_group():
    rng = random.Random(3)
    for _ in range(20):
        fp = cloud(rng, 300)
        group = sorted(rng.choice([0, 1, 2, 2, 2, 3]) for _ in fp)
        i, j = links_within(np.array(group), np.array(fp, np.uint64))
        assert all(group[a] == group[b] and (fp[a] ^ fp[b]).bit_count() <= 3 for a, b in zip(i, j, strict=True))
        for g in set(group):
            own = [k for k in range(len(fp)) if group[k] == g]
            want = classes([fp[k] for k in own])
            root = {k: k for k in own}
            for _ in own:
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if group[a] == g:
                        root[a] = root[b] = min(root[a], root[b])
            assert [own.index(root[k]) for k in own] == want


@pytest.mark.parametrize(("distinct", "file"), [(500, 2048), (500, 16), (10**9, 2048), (10**9, 16)])
def test_components_against_all_pairs(spark, distinct, file):
    fp = sorted(signed(x) for x in cloud(random.Random(4), 500))
    want = classes([x % (1 << 64) for x in fp])
    found = components(links(spark.createDataFrame([(x,) for x in fp], "fp long").repartition(3), distinct, file=file))
    root = {r.node: r.root for r in found.collect()}
    assert [root.get(x, x) for x in fp] == [fp[k] for k in want]


def test_quarters_leave_no_near_pair_out():
    rng = random.Random(6)
    for _ in range(500):
        mask = rng.getrandbits(64) | rng.getrandbits(64)
        qs = simhash.quarters(mask)
        assert sum(qs) == ~mask & (1 << 64) - 1 and len(qs) == 4
        free = [b for b in range(64) if not mask >> b & 1]
        change = sum(1 << b for b in rng.sample(free, min(3, len(free))))
        assert any(not change & q for q in qs)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    root = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert root == {i: 100 for i in range(101, 201)} | {i: 500 for i in range(501, 560)} | {9: 8}


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(20)]
    near = [" ".join(w if rng.random() > 0.01 else "zz" for w in b.split()) for b in base for _ in range(3)]
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + near + base)] + [(None, base[0], "y"), (None, "alone here now", "y"), (3, "one", "x"), (3, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    prints = [brute_print(t) for _, t, _ in rows]
    of = classes(prints)
    least = {}
    for (i, _, _), c in zip(rows, of, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=key)
    assert got == sorted(((i, f"{p:016x}", least[c]) for (i, _, _), p, c in zip(rows, prints, of, strict=True)), key=key)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == sorted(least.values(), key=lambda x: (x is None, x))
    assert near_duplicates(docs.limit(0)).collect() == [] == keep_one(docs.limit(0)).collect()
    assert simhash.FILE > simhash.FEW


def test_kept_rows_do_not_depend_on_the_partitioning(spark):
    """Rows that repeat id and text but differ elsewhere, under columns with the names of what is in between."""
    rows = [(1, "one two three four five", f"v{i}", "r") for i in range(5)] + [(2, "one two three four five", "w", "r"), (3, None, "a", "r"), (3, None, "a", "r"), (None, "x y", "q", "r"), (None, "x y", "p", "r"), (9, "alone", "z", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, `row` string")
    for parts in (1, 4):
        got = sorted(map(str, keep_one(docs.repartition(parts)).collect()))
        assert got == sorted(map(str, spark.createDataFrame([rows[0], rows[6], rows[9], rows[10]], docs.schema).collect()))


def test_pivots_discard_pairs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(300)], "doc_id long, text string")
    found = simhash.pivot_figures(docs)
    assert found["offered"] > 0 and found["linked"] <= found["left"] <= found["offered"]
    assert simhash.pivot_figures(docs.limit(0)) == {"offered": 0, "left": 0, "linked": 0}
