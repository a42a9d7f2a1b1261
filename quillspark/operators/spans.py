"""Infill spans: up to n line spans of a text, drawn by the hash contract.

All 3n attempts are an array inside the row: blank ones are filtered out, the first n survivors kept, and only those
are turned into prefix, middle and suffix. No row is exploded before it is needed, and nothing is shuffled.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.rng import uniform_int
from quillspark.functions.text import fim_text, has_sentinel, is_blank, join_lines, split_lines
from quillspark.shared import row_of

MIN_LINES = 10


def spans(sources: DataFrame, key: str, text: str, samples: int = 5, seed: int = 42, shortest: int = 1, longest: int = 15, carry: tuple[str, ...] = ()) -> DataFrame:
    """file_id, attempt, start, span_len, n_lines, prefix, suffix, middle, text, has_sentinel.

    Texts under ten lines give nothing. An attempt whose middle is blank is used up. Boundary line ends belong to
    neither side, and a span leaves at least one line before and after it. Null texts give nothing. `carry` names
    further columns of the source to keep, which spares a join later.
    """
    if not 1 <= shortest <= min(longest, MIN_LINES - 2) or samples < 1:
        raise ValueError("spans need 1 <= shortest <= longest, shortest <= 8 and at least one sample")
    base = sources.select(F.col(key).alias("file_id"), *carry, split_lines(F.col(text).cast("string")).alias("lines")).withColumn("n_lines", F.size("lines"))

    def attempt(i):
        size = uniform_int(seed, F.col("file_id"), i, "len", F.lit(shortest), F.least(F.lit(longest), F.col("n_lines") - 2))
        return F.struct(i.cast("int").alias("attempt"), size.alias("span_len"))

    def placed(a):
        start = uniform_int(seed, F.col("file_id"), a["attempt"], "start", F.lit(1), F.col("n_lines") - a["span_len"] - 1)
        return F.struct(a["attempt"].alias("attempt"), a["span_len"].alias("span_len"), start.alias("start"))

    tries = F.transform(F.transform(F.sequence(F.lit(0), F.lit(3 * samples - 1)), attempt), placed)
    filled = lambda a: F.exists(F.slice(F.col("lines"), a["start"] + 1, a["span_len"]), lambda line: ~is_blank(line))
    kept = F.when(F.col("n_lines") >= MIN_LINES, F.slice(F.filter(tries, filled), 1, samples))
    # An outer explode: from a plain one the optimizer infers a filter that would draw everything twice.
    drawn = base.withColumn("a", F.explode_outer(kept)).where(F.col("a").isNotNull()).select("file_id", *carry, "n_lines", "lines", "a.*")
    end = F.col("start") + F.col("span_len")
    cut = drawn.withColumns({"prefix": join_lines(F.slice("lines", 1, F.col("start"))), "middle": join_lines(F.slice("lines", F.col("start") + 1, F.col("span_len"))), "suffix": join_lines(F.slice("lines", end + 1, F.col("n_lines") - end))})
    whole = cut.withColumn("text", fim_text(F.col("prefix"), F.col("suffix"), F.col("middle")))
    return whole.withColumn("has_sentinel", has_sentinel(F.concat("prefix", "suffix", "middle"))).select("file_id", *carry, "attempt", "start", "span_len", "n_lines", "prefix", "suffix", "middle", "text", "has_sentinel")


def keep_first(rows: DataFrame, text: str, *order: str) -> DataFrame:
    """Exact dedup on a text column: the first row in the given order stays, with all its columns, whatever they are called.

    Rows are grouped by digest, and each task drops its own repeats before the shuffle. Null texts are equal to each other.
    """
    held = rows.select(row_of(rows).alias("row"), F.sha2(F.col(f"`{text}`").cast("binary"), 256).alias("digest"))
    by = Window.partitionBy("digest").orderBy(*[F.col(f"row.`{c}`") for c in order])
    return held.withColumn("n", F.row_number().over(by)).where("n = 1").select("row.*")
