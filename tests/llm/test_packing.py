import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quillspark.llm.packing import best_fit, pack_documents, place, reduce_and_fit, runs_of

PATH = P.path("word_bpe_49k.json")


def optimum(items, capacity):
    """Fewest bins, by trying all."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= items[i]:
                rest = list(rooms)
                rest.remove(k)
                go(i + 1, [*rest, k - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else capacity) - x)
    return sorted(rooms)


def counted(items):
    return {n: items.count(n) for n in set(items)}


def check(bins, items, capacity):
    out = sorted(itertools.chain.from_iterable(held * n for held, n in bins))
    assert out == sorted(items)
    assert all(sum(held) <= capacity for held, _ in bins)


def test_best_fit_equals_item_by_item():
    rng = random.Random(1)
    for _ in range(300):
        cap = rng.choice([10, 30, 100])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))]
        bins = best_fit(counted(items), cap)
        check(bins, items, cap)
        assert sorted(cap - sum(h) for h, n in bins for _ in range(n)) == plain_best_fit(items, cap)


def test_reduction_keeps_the_optimum():
    """The reduced part is optimal: with the rest packed by trying all, no bin is lost."""
    from quillspark.llm import packing

    rng = random.Random(2)
    for _ in range(250):
        cap = rng.choice([10, 20, 50])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        rest = {}
        saved, packing.best_fit = packing.best_fit, lambda counts, c: rest.update(counts) or []
        try:
            fixed = reduce_and_fit(counted(items), cap)
        finally:
            packing.best_fit = saved
        left = [n for n, c in rest.items() for _ in range(c)]
        check([*fixed, *[((n,), c) for n, c in rest.items()]], items, cap)
        assert sum(n for _, n in fixed) + optimum(left, cap) == optimum(items, cap)


def test_large_counts_stay_small():
    rng = random.Random(3)
    counts = {rng.randint(1, 4096): rng.randint(1, 10**9) for _ in range(3000)}
    bins = reduce_and_fit(counts)
    total = {}
    for held, n in bins:
        assert sum(held) <= 4096
        for x in held:
            total[x] = total.get(x, 0) + n
    assert total == counts
    assert len(bins) < 30_000
    used, needed = sum(n for _, n in bins), -(-sum(n * c for n, c in counts.items()) // 4096)
    assert used <= 1.01 * max(needed, sum(c for n, c in counts.items() if n > 2048))
    assert len(runs_of(bins)["rank"]) < 200_000


def test_places_have_no_gaps(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([1, 7, 7, 7, 40, 60, 100]), 5) for i in range(500)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = place(pieces, capacity=100, ranked=20).collect()
    assert len(got) == 500
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 100
    assert len(by) == sum(n for _, n in reduce_and_fit(counted([r[3] for r in rows]), 100))


def test_documents(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(1, None, "a"), (2, "", "b"), (3, "The end. " * 3000, "c"), (3, "The end. " * 3000, "c"), (4, "short", "d"), (None, "no id", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack_documents(docs, PATH).collect()
    want = []
    for k, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for p, lo in enumerate(range(0, len(ids), 4096)):
            part = ids[lo : lo + 4096]
            want.append((k, p, lo, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert pack_documents(docs.limit(0), PATH).collect() == []
