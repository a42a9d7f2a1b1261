"""Near-duplicates by SimHash, searched with pivot distance tables.

Fingerprints that differ in few bits agree on some of the blocks that 64 bits are cut into, so each distinct
fingerprint is filed under its blocks. Within a file, a table of Hamming distances to many reference fingerprints
(pivots) is computed once; by the triangle inequality a pair whose distances to any pivot differ by more than the limit
cannot link, and only the pairs that no pivot discards are verified bit by bit. Of the links of a file those of a
spanning forest are kept, so that dense groups of copies never become all pairs. A file of more than FILE fingerprints
is filed again by quarters of the bits that its members do not share: near ones agree on one quarter, and as a file
with b bits left holds at most 2**b distinct fingerprints, every file ends up small, however dense its group.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, row_of, shuffle_width, slices
from quillspark.llm.components import components

BITS, NEAR, SHINGLE, SEED = 64, 3, 3, 42
#: Reference fingerprints: a rule gives them.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(24)], np.uint64)
FILE = 2048
#: Up to this size the pairs of a file are taken by their offset, for many files at once.
FEW = 32
_LOW = np.arange(BITS, dtype=np.uint64)


def shingle_hashes(text: str | None, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included; A-Z is lower-cased first, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint_of(text: str | None) -> int:
    """64 bits, each set if it is set in over half the shingle hashes; 0 without words."""
    h = shingle_hashes(text)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << _LOW)[2 * count > len(h)].sum(dtype=np.uint64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a long (the same bits, signed)."""

    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t) for _, texts in slices(column) for t in texts], np.uint64).view(np.int64))

    return prints(text.cast("string"))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def masks(distinct: int, near: int = NEAR, crowd: int = 64) -> list[int]:
    """Masks of which two fingerprints within `near` bits agree on one: of the fewest equal blocks for which a file holds about `crowd` by chance."""
    for blocks in range(near + 1, BITS + 1):
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
        if distinct <= crowd << sum(sorted(b - a for a, b in zip(edges, edges[1:], strict=False))[: blocks - near]):
            break
    return [sum(c) for c in combinations(parts, blocks - near)]


def quarters(mask: int, near: int = NEAR) -> list[int]:
    """Parts of the bits outside the mask, one more than the bits in which near fingerprints differ."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    edges = [round(i * len(free) / (near + 1)) for i in range(near + 2)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links_within(group: np.ndarray, fp: np.ndarray, near: int = NEAR, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that span the links within each group; group is sorted, fp is unsigned. tally: pairs offered, left by the pivots, linked."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs link: coordinates discard, the survivors are verified."""
        left = np.arange(len(i))
        for p in range(table.shape[1]):
            left = left[np.abs(table[i[left], p] - table[j[left], p]) <= near]
        hit = left[np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= near]
        if tally is not None:
            tally[:] = tally[0] + len(i), tally[1] + len(left), tally[2] + len(hit)
        return hit

    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.array([], np.int64)
    size = np.diff(np.concatenate([first, [n]]))
    after = np.repeat(first + size, size) - np.arange(n) - 1
    few = np.repeat(size <= FEW, size)
    a, b = [], []
    at = np.flatnonzero(few)
    for off in range(1, FEW):
        at = at[after[at] >= off]
        if not len(at):
            break
        hit = at[linked(at, at + off)]
        a.append(hit)
        b.append(hit + off)
    for f, s in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        unseen = np.arange(f, f + s)
        front: list[int] = []
        while len(unseen):
            if not front:
                front, unseen = [int(unseen[0])], unseen[1:]
            one = front.pop()
            hit = linked(np.full(len(unseen), one), unseen)
            if len(hit):
                met = unseen[hit]
                a.append(np.full(len(met), one))
                b.append(met)
                front += met.tolist()
                unseen = np.delete(unseen, hit)
    none = np.array([], np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, distinct: int, near: int = NEAR, file: int = FILE, figures: dict | None = None) -> DataFrame:
    """Links (a, b) that span all pairs of the distinct values fp within near bits.

    figures: accumulators `offered`, `left` and `linked` that the search adds its pairs to; a repeated task adds again.
    """
    if file < 1 << near + 1:
        raise ValueError(f"a file has to hold at least {1 << near + 1} fingerprints")
    spark, cells = prints.sparkSession, None
    filed = prints.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks(distinct, near)])).alias("mask"))
    while True:
        keyed = filed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        small = keyed.join(sizes.where(F.col("n") <= file), ["mask", "key"], "left_semi").select("mask", "key", "fp")
        cells = small if cells is None else cells.unionByName(small)
        large = materialize(sizes.where(F.col("n") > file).select("mask", "key"), "large")
        split = [r["mask"] for r in large.select("mask").distinct().collect()]  # masks of this level with a large file: a few longs
        if not split:
            break
        again = materialize(keyed.join(large, ["mask", "key"], "left_semi").select("fp", "mask"), "refiled")
        finer = spark.createDataFrame([(m, [signed(m % (1 << BITS) | q) for q in quarters(m % (1 << BITS), near)]) for m in split], "mask long, finer array<long>")
        filed = again.join(finer, "mask").select("fp", F.explode("finer").alias("mask")).distinct()  # two masks may meet in one
    keys = ["mask", "key"]
    ordered = cells.repartition(shuffle_width(spark), *keys).sortWithinPartitions(*keys)

    def search(batches):
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = columns if held is None else [np.concatenate(c) for c in zip(held, columns, strict=True)]
            same = np.ones(len(held[0]), bool)
            for c in held[:2]:
                same &= c == c[-1:]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if len(same) and not same.all() else 0
            if cut:  # the last group may go on in the next batch
                yield found([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield found(held)

    def found(columns):
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:2]:
            new[1:] |= c[1:] != c[:-1]
        tally = [0, 0, 0]
        i, j = links_within(np.cumsum(new), columns[2].astype(np.int64).view(np.uint64), near, tally)
        for name, n in zip(("offered", "left", "linked") if figures else (), tally, strict=False):
            figures[name].add(n)
        return pa.RecordBatch.from_arrays([pa.array(columns[2][i], pa.int64()), pa.array(columns[2][j], pa.int64())], ["a", "b"])

    return ordered.mapInArrow(search, "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, figures: dict | None = None) -> DataFrame:
    """doc_id, text_hash, fp, component_id, first and n of every document.

    component_id is the smallest id of the component (null if it has none), first the document (no_id, doc_id, text_hash)
    that stands for it and n its rows. Null and empty texts have fingerprint 0; repeated rows are returned each; other
    columns are ignored. Exact copies are one fingerprint before any search, and what is said of a component is
    gathered from fingerprints, so that no join brings the documents of a component together.
    """
    own = materialize(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), fingerprint(F.col(f"`{text_col}`")).alias("fp")), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")  # nulls last
    distinct = materialize(own.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct, distinct.count(), near, figures=figures)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = named.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    whole = materialize(named.select("fp", "root").join(of_root, "root").select("fp", "first", "n"), "classes")
    return own.join(whole, "fp").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), "first", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    return grouped(docs, id_col, text_col, near).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def pivot_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> dict[str, int]:
    """How many pairs the files offer, how many of them the pivots leave, and how many of those link."""
    context = docs.sparkSession.sparkContext
    figures = {n: context.accumulator(0) for n in ("offered", "left", "linked")}
    grouped(docs, id_col, text_col, near, figures).count()
    return {n: a.value for n, a in figures.items()}


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """One document of each component, with its columns: that with the smallest id, nulls last, then the smallest text hash.

    Of rows that repeat id and text, the one whose columns come first as JSON. The documents that go are the smaller
    side of a join with all rows; an empty table stays empty; columns may have any names.
    """
    several = grouped(docs, id_col, text_col, near).where("n > 1").select("doc_id", "text_hash", "first")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    marked = several.groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(F.bool_or(chosen).alias("stays"), F.count(F.lit(1)).alias("n"))
    marked = materialize(marked.where("NOT stays OR n > 1"), "marked")
    hashed = docs.select(row_of(docs).alias("row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(f"`{text_col}`").alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    kept = hashed.join(marked, same, "left_anti").select("row.*")
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return kept
    one = hashed.join(repeated, same, "left_semi").groupBy("_id", "_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(one.select("row.*"))
