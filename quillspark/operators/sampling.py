"""Seeded shuffles, caps, splits and prefixes, each by an explicit total order."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.rng import order_key
from quillspark.shared import row_of, shuffle_width

#: Copies of one row that are made at once.
BLOCK = 1 << 16


def shuffled_cap(rows: DataFrame, key: str, cap: int, seed: int = 42) -> DataFrame:
    """The first `cap` rows of a seeded shuffle by key; a top-k, never a whole sort."""
    return rows.orderBy(order_key(seed, F.col(key)), F.col(key)).limit(cap)


def head(rows: DataFrame, position: str, n: int) -> DataFrame:
    return rows.orderBy(position).limit(n)


def _border(values: DataFrame, want: int) -> tuple[str, int, int]:
    """For hexadecimal values(v) and 0 < want <= their number: the want-th smallest, how many equal ones are among the first `want`, how many there are.

    Values are counted by their first 4 digits, by 8, and whole; each count is of what shares the prefix found before, at
    most 65,536 groups, and whole values only among the few with one prefix.
    """
    found = ""
    for digits in (4, 8, 64):
        counts = values.where(F.startswith("v", F.lit(found))).groupBy(F.substring("v", 1, digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        for r in counts:
            if r["n"] >= want:
                found, n = r["p"], r["n"]
                break
            want -= r["n"]
    return found, want, n


def train_val_split(rows: DataFrame, key: str, ratio: float = 0.9, seed: int = 42, group_by: str | None = None) -> DataFrame:
    """Adds `split`, in place of a column of that name: the first floor(n * ratio) units of the seeded shuffle are train, the others val.

    Units are rows, or with group_by the groups of that column, so that rows of a group stay together (null is one
    group). Keys may repeat or be null: rows with the key at the border are ordered by a digest of all their columns,
    and of wholly equal ones the right number is train. No rank is taken in one task: the border is found by counting
    prefixes of the order keys.
    """
    unit = F.col(f"`{group_by or key}`")
    held = rows.select(row_of(rows, but=("split",)).alias("row"), order_key(seed, unit).alias("v"))
    units = held.select("v").distinct() if group_by else held.select("v")
    want = math.floor(units.count() * ratio)
    below = lambda side: side.select("row.*", "split")
    if want == 0:
        return below(held.withColumn("split", F.lit("val")))
    last, taken, n = _border(units, want)
    side = F.when(F.col("v") <= last, "train").otherwise("val")
    if taken == n:
        return below(held.withColumn("split", side))
    apart = held.where(F.col("v") != last).withColumn("split", side)
    tied = held.where(F.col("v") == last).select("row", F.md5(F.to_json("row").cast("binary")).alias("v"))
    last_row, taken, n = _border(tied, taken)
    equal = tied.where(F.col("v") == last_row).groupBy("v").agg(F.first("row").alias("row"))  # one row, n times in the table
    block = equal.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // BLOCK)))).repartition(min(shuffle_width(rows.sparkSession), (n - 1) // BLOCK + 1), "b")
    equal = block.withColumn("i", F.explode(F.sequence(F.col("b") * BLOCK + 1, F.least(F.lit(n), (F.col("b") + 1) * BLOCK)))).withColumn("split", F.when(F.col("i") <= taken, "train").otherwise("val"))
    others = tied.where(F.col("v") != last_row).withColumn("split", F.when(F.col("v") < last_row, "train").otherwise("val"))
    return below(apart).unionByName(below(others)).unionByName(below(equal))
