"""Random numbers as a function of what they are for: the same on any partitioning, and in SQL.

A draw is the first 32 bits of the MD5 of "seed:key:attempt:tag".
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int, key: Column, attempt: Column, tag: str) -> Column:
    name = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), attempt.cast("string"), F.lit(tag))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform_int(seed: int, key: Column, attempt: Column, tag: str, low: Column, high: Column) -> Column:
    """An integer from low to high, both included; the bias is below one in a million for ranges up to 4,000."""
    return (low + draw(seed, key, attempt, tag) % (high - low + 1)).cast("int")


def order_key(seed: int, key: Column) -> Column:
    """Ordering by this, then by key, is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
