"""Scoring predictions against records, with per-model aggregates and running means.

Predictions are a table (record_id, model, completion); what makes them is a callable for mapInPandas or a column.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scoring import edit_similarity, exact_match
from quillspark.operators.sampling import head
from quillspark.schemas import PREDICTION
from quillspark.shared import scratch_path, shuffle_width


def predict(records: DataFrame, model: str, completion: Column) -> DataFrame:
    """Predictions of a stand-in model that is a column expression."""
    return records.select(F.col("record_id").cast("string").alias("record_id"), F.lit(model).alias("model"), completion.alias("completion"))


def predict_with(records: DataFrame, model: str, load: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """Predictions of a real model: `load` runs once in each worker and gives a function of (prefix, suffix)."""

    def run(frames):
        complete = load()
        for f in frames:
            yield f.assign(model=model, completion=[complete(p, s) for p, s in zip(f.prefix, f.suffix, strict=True)])[["record_id", "model", "completion"]]

    return records.select(F.col("record_id").cast("string").alias("record_id"), "prefix", "suffix").mapInPandas(run, PREDICTION)


def score_text(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """record_id, model, exact_match, edit_similarity of records(record_id, middle) and their predictions."""
    keyed = records.select(F.col("record_id").cast("string").alias("record_id"), "middle")
    return keyed.join(predictions, "record_id").select("record_id", "model", exact_match(F.col("completion"), F.col("middle")).alias("exact_match"), edit_similarity(F.col("completion"), F.col("middle")).alias("edit_similarity"))


def summarise(scores: DataFrame, *metrics: str) -> DataFrame:
    """Mean of each metric by model, in order of model; NaN and null values and null models do not count, no rows give none."""
    means = [F.avg(F.when(~F.isnan(f"`{m}`"), F.col(f"`{m}`"))).alias(m) for m in metrics]
    return scores.where(F.col("model").isNotNull()).groupBy("model").agg(*means).orderBy("model")


def long_form(summary: DataFrame, *metrics: str) -> DataFrame:
    return summary.unpivot("model", list(metrics), "metric", "value")


def running_mean(scores: DataFrame, order: Sequence[str], every: int, *metrics: str) -> DataFrame:
    """model, position, and the mean of all rows so far of each metric, for every `every`-th row of a model and its last.

    Rows of a model are in the order of `order`, which should tell them apart, and position counts them from 1. No task
    holds a model: rows are dealt into blocks by ranges of the order and written to the shared folder, so that a block
    stays what it is; the sums of a block, a row for each, give what goes before the next. Null scores do not count.
    """
    spark, keys = scores.sparkSession, [f"_o{i}" for i in range(len(order))]
    values = [f"_v{i}" for i in range(len(metrics))]
    held = scores.select("model", *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)], *[F.col(f"`{m}`").cast("double").alias(v) for m, v in zip(metrics, values, strict=True)])
    dealt = held.repartitionByRange(shuffle_width(spark), "model", *keys).withColumn("_block", F.spark_partition_id())
    path = scratch_path(spark, "scores")
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)

    sums = [F.struct(F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.count(v).alias("n")).alias(v) for v in values]
    blocks = rows.groupBy("model", "_block").agg(F.count(F.lit(1)).alias("_n"), *sums)
    model, before = Window.partitionBy("model"), Window.partitionBy("model").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = blocks.select(
        F.col("model").alias("_model"), F.col("_block").alias("_of"), earlier("_n").alias("_rows"), F.sum("_n").over(model).alias("_last"),
        *[F.struct(earlier(f"{v}.sum").alias("sum"), earlier(f"{v}.n").alias("n")).alias(f"{v}_before") for v in values],
    )
    place = Window.partitionBy("model", "_block").orderBy(*keys)
    so_far = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("model", "_block", F.row_number().over(place).alias("_nth"), *[F.struct(F.sum(v).over(so_far).alias("sum"), F.count(v).over(so_far).alias("n")).alias(v) for v in values])
    joined = within.join(offsets, F.col("model").eqNullSafe(F.col("_model")) & (F.col("_block") == F.col("_of")))
    mean = lambda v: (F.coalesce(F.col(f"{v}.sum"), F.lit(0.0)) + F.col(f"{v}_before.sum")) / F.nullif(F.col(f"{v}.n") + F.col(f"{v}_before.n"), F.lit(0))
    seen = joined.select("model", (F.col("_rows") + F.col("_nth")).alias("position"), "_last", *[mean(v).alias(m) for v, m in zip(values, metrics, strict=True)])
    return seen.where((F.col("position") % every == 0) | (F.col("position") == F.col("_last"))).drop("_last")


def evaluate(records: DataFrame, predictions: DataFrame, position: str = "position", max_samples: int = 200) -> tuple[DataFrame, DataFrame]:
    """Scores of the first max_samples records, and their summary."""
    scores = score_text(head(records, position, max_samples), predictions)
    return scores, summarise(scores, "exact_match", "edit_similarity")
