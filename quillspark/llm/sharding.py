"""Shards of bounded size by extendible hashing.

A document's bucket is a prefix of the bits of its hash. The directory starts with one bucket; only a bucket above the
byte limit splits on its next bit. Sizes are summed by hash prefix, so the directory is found from a table of a few
cells for each shard, and only the cells that are still too large are looked at with more bits. A bucket whose hashes
are all equal cannot split: its rows fill overflow pages in order, and a row above the limit is a page of its own.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, row_of, shuffle_width

HASH_BITS = 60
LIMIT = 64 << 20
#: Limits of bytes of one repeated id that a running total may go over.
DEAL = 8


def drawn() -> Column:
    """A number from 0 to 1 for each row, by its place in the scan, so that a task that is run again draws the same."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)


def hash_of(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; null hashes as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """For sizes(h, bytes): tables (cell, depth) by number of bits of the cell; a row belongs to the first that holds its cell."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    found, low, rest = [], 0, sizes
    width = min(20, max(2, math.ceil(math.log2(max(1, total / limit))) + 3))
    while True:
        high = min(HASH_BITS, low + width)
        cells = materialize(rest.groupBy(F.shiftright("h", HASH_BITS - high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("least"), F.max("h").alias("most")), "cells")
        each = cells.withColumn("d", F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(high)))).withColumn("p", F.expr(f"shiftright(cell, {high} - d)"))
        fits = each.groupBy("d", "p").agg(((F.sum("bytes") <= limit) | (F.min("least") == F.max("most"))).alias("fits"))
        depth = materialize(each.join(fits, ["d", "p"]).groupBy("cell").agg(F.min(F.when(F.col("fits"), F.col("d"))).alias("depth")), "directory")
        found.append((high, depth.where("depth IS NOT NULL")))
        large = depth.where("depth IS NULL")
        if high == HASH_BITS or large.isEmpty():
            return found
        rest = rest.join(large, F.shiftright("h", HASH_BITS - high) == F.col("cell"), "left_semi")
        low, width = high, 10


def place(rows: DataFrame, sizes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """rows(h, bytes, draw, ...) with depth and shard; apart, those of equal hashes above the limit, if any. sizes: (h, bytes) of all rows, stored.

    Every row gets its shard by itself, so that repeated ids neither multiply nor need telling apart.
    """
    placed = rows.withColumn("depth", F.lit(None).cast("int"))
    for high, cells in directory(sizes.select("h", "bytes"), limit):
        cells = cells.select(F.col("cell").alias("_cell"), F.col("depth").alias("_depth"))
        placed = placed.join(cells, F.shiftright("h", HASH_BITS - high) == F.col("_cell"), "left").withColumn("depth", F.coalesce("depth", "_depth")).drop("_cell", "_depth")
    prefix = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"right(lpad(bin(shiftright(h, {HASH_BITS} - depth)), {HASH_BITS}, '0'), depth)"))
    placed = placed.withColumn("shard", prefix)
    # Equal hashes above the limit: few, or one id repeated. Their rows are drawn into deals of about DEAL limits; in each a running total deals out pages.
    full = sizes.groupBy("h").agg(F.sum("bytes").alias("all"), F.count(F.lit(1)).alias("n")).where((F.col("all") > limit) & (F.col("n") > 1))
    full = materialize(full.select("h", F.ceil(F.col("all") / (DEAL * limit)).alias("_deals")), "overflow")
    if full.isEmpty():
        return placed, None
    placed = placed.join(full, "h", "left")
    own = Window.partitionBy("h", "_deal").orderBy("bytes")
    # Smallest first: two pages of half the limit never share one, so a page of running total // half holds at most the limit.
    half = max(1, limit // 2)
    over = placed.where("_deals IS NOT NULL").withColumn("_deal", F.floor(F.col("draw") * F.col("_deals")))
    over = over.withColumn("_sum", F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.row_number().over(own))
    page = F.when(F.col("bytes") > half, F.concat(F.lit("r"), "_n")).otherwise(F.floor((F.col("_sum") - F.col("bytes")) / half).cast("string"))
    over = over.withColumn("shard", F.concat("shard", F.lit("+"), "_deal", F.lit("."), page))
    return placed.where("_deals IS NULL").drop("_deals"), over.drop("_deals", "_deal", "_sum", "_n")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long")


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bytes (UTF-8, null: 0), depth, shard (the prefix as bits, then the overflow page if any) of every document.

    Every shard holds at most `limit` bytes, unless it is a single row. Repeated ids share a hash, null ids that of the
    empty one; null and empty texts have no bytes; an empty table gives no rows; other columns are ignored. Texts are
    measured where they lie and never shuffled.
    """
    key = F.col(f"`{id_col}`")
    base = materialize(docs.select(key.alias("doc_id"), hash_of(key).alias("h"), size_of(F.col(f"`{text_col}`")).alias("bytes"), drawn().alias("draw")), "sizes")
    plain, over = place(base, base, limit)
    return (plain.unionByName(over) if over else plain).select("doc_id", "bytes", "depth", "shard")


def folder_column(schema: T.StructType) -> str:
    """The name of the folders' column: `shard`, with underscores before it if the documents have such a column."""
    name = "shard"
    while name in {f.name.lower() for f in schema.fields}:
        name = "_" + name
    return name


def write_shards(docs: DataFrame, out_dir: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as Parquet, one folder for each shard; returns what assign() does, from the files read back.

    Every row is written once, with all its columns, whatever its id and whatever they are called; shards are as bounded
    as those of assign(). Texts travel once, by ranges of hashes (where the directory is too large to be sent to all
    tasks, once more to meet it), and a shard is a run of hashes: a folder has a few files, and no task is larger than
    its range. An empty table writes nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(row_of(docs).alias("row"), hash_of(F.col(f"`{id_col}`")).alias("h"), size_of(F.col(f"`{text_col}`")).alias("bytes"), drawn().alias("draw"))
    sizes = materialize(rows.select("h", "bytes"), "sizes")
    plain, over = place(rows, sizes, limit)
    total, n = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(shuffle_width(spark), min(n, math.ceil(total / limit)))
    dealt = plain.repartitionById(width, F.shiftright(F.shiftright("h", HASH_BITS - 24) * F.lit(width).cast("long"), 24).cast("int"))
    dealt = dealt.unionByName(over) if over else dealt
    name = folder_column(docs.schema)
    # A letter before the bits: an empty name would be the folder of nulls, and one of digits a number.
    dealt.select("row.*", F.concat(F.lit("s"), "shard").alias(name)).write.partitionBy(name).parquet(out_dir)
    again, shard = read_shards(spark, out_dir, docs.schema), F.col(f"`{name}`")
    return again.select(F.col(f"`{id_col}`").alias("doc_id"), size_of(F.col(f"`{text_col}`")).alias("bytes"), F.length(F.substring_index(shard, "+", 1)).alias("depth"), shard.alias("shard"))


def read_shards(spark: SparkSession, out_dir: str, schema: T.StructType) -> DataFrame:
    """The rows of write_shards() and their shard, in folder_column(schema); schema is that of the documents."""
    name = folder_column(schema)
    again = spark.read.schema(T.StructType([*schema.fields, T.StructField(name, T.StringType())])).parquet(out_dir)
    return again.withColumn(name, F.substr(F.col(f"`{name}`"), F.lit(2)))


def oracle(limit: int = LIMIT) -> str:
    return f"""
    WITH b AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
    e AS (SELECT doc_id, bytes, h, d::INTEGER AS d, h >> ({HASH_BITS} - d) AS p FROM b, range(0, {HASH_BITS + 1}) AS r(d)),
    f AS (SELECT d, p, sum(bytes) <= {limit} OR min(h) = max(h) AS fits FROM e GROUP BY d, p),
    g AS (SELECT doc_id, bytes, h, min(d) AS depth FROM e JOIN f USING (d, p) WHERE fits GROUP BY doc_id, bytes, h)
    SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h >> ({HASH_BITS} - depth)), {HASH_BITS}, '0'), depth) END AS shard FROM g"""
