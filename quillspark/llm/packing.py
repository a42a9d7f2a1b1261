"""Packing token sequences: dominance reduction, then best fit, on counts by length.

The instance is the histogram of piece lengths, which has at most `capacity` rows however many documents there are.
The reduction takes the longest open length j and looks for a set of other lengths that some optimal packing must be
able to use with it: nothing fits beside j; a partner fills the rest exactly; at most one more piece fits, and the
longest such is taken; or every feasible pair (and larger set) beside j could be put inside what is taken. Such bins
are fixed for as many pieces as there are. Lengths without such a set stay for best fit, longest first.
"""

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, shuffle_width, slices
from quillspark.llm.words import encoder

CAPACITY = 4096
#: A length held by more than this share of a task's usual pieces is ranked in several groups; few pieces are never split.
SHARE, LEAST = 0.25, 64


class _Open:
    """Counts of the lengths that are still to be placed, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def left(self, length: int, used: dict[int, int]) -> int:
        return self.counts.get(length, 0) - used.get(length, 0)

    def longest(self, most: int, used: dict[int, int]) -> int:
        """The longest length up to most of which a piece is left besides those used; 0 for none."""
        at = bisect.bisect_right(self.lengths, most) - 1
        while at >= 0 and self.left(self.lengths[at], used) <= 0:
            at -= 1
        return self.lengths[at] if at >= 0 else 0

    def smallest(self, k: int, used: dict[int, int]) -> list[int]:
        found: list[int] = []
        for length in self.lengths:
            found += [length] * min(k - len(found), max(0, self.left(length, used)))
            if len(found) == k:
                break
        return found


def dominating(open_: _Open, j: int, capacity: int) -> tuple[int, ...] | None:
    """The lengths that some optimal packing puts beside a piece of length j, the longest open one, or None if none is proved."""
    rest, used = capacity - j, {j: 1}
    k = open_.longest(rest, used)
    if not k or k == rest:
        return (k,) if k else ()
    small = open_.smallest(3, used)
    if len(small) < 2 or small[0] + small[1] > rest:
        return (k,)
    if len(small) == 3 and sum(small) <= rest:
        return None  # sets of three and more: not proved
    # Pairs at most. b is what fits beside k; {k, b} dominates a pair x >= y if y <= b, or if x + y <= k.
    b = open_.longest(rest - k, {j: 1, k: 1 + (k == j)})
    for y in open_.lengths[bisect.bisect_right(open_.lengths, b) :]:
        if 2 * y > rest:
            break
        if open_.left(y, used) <= 0:
            continue
        x = open_.longest(rest - y, {j: 1, y: 1 + (y == j)})
        if x >= y and x + y > k:
            return None
    return (k, b) if b else (k,)


def reduce_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in order, how many such bins); their number depends on the lengths there are, not on the counts."""
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    open_, bins, stay = _Open(counts), [], 0
    while open_.lengths:
        j = open_.longest(capacity if not stay else stay - 1, {})
        if not j:
            break
        while open_.counts.get(j):
            beside = dominating(open_, j, capacity)
            if beside is None:
                break
            need: dict[int, int] = {}
            for n in (j, *beside):
                need[n] = need.get(n, 0) + 1
            # What was proved holds while the lengths open are the same; a length that runs out changes them.
            times = max(1, min((open_.counts[n] - (1 if len(beside) > 1 else 0)) // c for n, c in need.items()))
            for n, c in need.items():
                open_.take(n, c * times)
            bins.append(((j, *beside), times))
        stay = j
    return bins + best_fit(open_.counts, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each piece into the fullest bin that takes it; bins with the same contents are kept as one with a count."""
    groups: dict[int, list] = {}  # room -> [(lengths, bins)]
    rooms: list[int] = []

    def put(room: int, held: tuple, n: int) -> None:
        if n:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((held, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                held, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, held, n = capacity, (), -(-left // (capacity // length))
            each = room // length  # the fullest bin that takes one takes the next as well
            full = min(n, left // each)
            put(room - each * length, (*held, *[length] * each), full)
            left -= full * each
            if full < n:
                some = min(left, each - 1) if left < each else 0
                put(room - some * length, (*held, *[length] * some), 1 if some else 0)
                left -= some
                put(room, held, n - full - (1 if some else 0) if held else 0)
    return [(held, n) for found in groups.values() for held, n in found]


def runs_of(bins: list) -> dict[str, np.ndarray]:
    """For each length, in the order of its pieces' ranks: from which rank on, the first bin, pieces a bin, the place in it."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for held, n in bins:
        at = 0
        for length in dict.fromkeys(held):
            each = held.count(length)
            rows.append((length, seen.get(length, 0), base, each, at))
            seen[length] = seen.get(length, 0) + n * each
            at += length * each
        base += n
    rows.sort()
    names = ("length", "rank", "base", "each", "at")
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 5
    return dict(zip(names, columns, strict=True))


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most capacity ids; a text without ids has no piece unless there is an end id."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                rows, at = [], []
                for i, ids in enumerate(enc.encode(texts)):
                    ids += end
                    for p, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        rows.append((p, lo // 4, len(part) // 4, zlib.crc32(part)))
                        at.append(first + i)
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [f.name for f in fields])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, T.StructType(fields))


def place(pieces: DataFrame, capacity: int = CAPACITY, ranked: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length; offsets have no gaps. Read more than once: materialise it first.

    Pieces of one length are ranked in salted groups of about `ranked` (SHARE of what a task has of all pieces), so that
    a length held by most of the rows is no single task; the order among equal lengths has no effect on the number of
    sequences.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    bins = reduce_and_fit(counts, capacity)
    runs = spark.sparkContext.broadcast(runs_of(bins))  # bounded by the lengths there are
    ranked = ranked or max(LEAST, int(SHARE * sum(counts.values()) / shuffle_width(spark)))
    columns = [c for c in pieces.columns]
    # Few lengths have several groups: at most the number of tasks divided by SHARE.
    groups = spark.createDataFrame([(n, -(-c // ranked)) for n, c in counts.items() if c > ranked], "_of long, _salts long")
    salted = pieces.join(F.broadcast(groups), F.col("length") == F.col("_of"), "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.coalesce("_salts", F.lit(1)))).drop("_of", "_salts")
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[F.col(c) for c in columns if c != "length"]))
    ranks = salted.withColumn("_own", own).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def where(length: pa.Array, rank: pa.Array) -> pa.Array:
        r = runs.value
        n, k = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        lo, hi = np.searchsorted(r["length"], n, "left"), np.searchsorted(r["length"], n, "right")
        while (todo := hi - lo > 1).any():  # the last run of the length that begins at the rank or before
            mid = (lo + hi) // 2
            up = r["rank"][np.minimum(mid, len(r["rank"]) - 1)] <= k
            lo, hi = np.where(todo & up, mid, lo), np.where(todo & ~up, mid, hi)
        t = k - r["rank"][lo]
        each = r["each"][lo]
        return pa.StructArray.from_arrays([pa.array(r["base"][lo] + t // each), pa.array(r["at"][lo] + t % each * n)], ["sequence_id", "offset"])

    placed = ranks.withColumn("_p", where("length", "_rank"))
    return placed.select(*columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts hold the end id alone; repeated rows are packed each; null ids are kept; other columns are
    ignored; an empty table gives no rows.
    """
    return place(materialize(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)
