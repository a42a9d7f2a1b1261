"""Report tables: loss series, run ids, flat configurations, metric names, benchmark pivots."""

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def loss_series(log: DataFrame) -> DataFrame:
    """(series, step, value) of train and eval losses; an entry may feed both, and without train losses there is nothing."""
    entries = log.select(F.explode("log_history").alias("e")).select("e.*")
    train = entries.where("loss IS NOT NULL").select(F.lit("train").alias("series"), "step", F.col("loss").alias("value"))
    evals = entries.where("eval_loss IS NOT NULL").select(F.lit("eval").alias("series"), "step", F.col("eval_loss").alias("value"))
    any_train = train.limit(1).select(F.lit("eval").alias("series")).alias("t")
    return train.unionByName(evals.join(any_train, "series", "left_semi"))


#: What is replaced in a model's name to get its slug, its length, and the form of a run's id.
SLUG = (("qwen2.5-coder-", "qwen"), (".", ""), ("-", ""))
SLUG_LENGTH = 8
RUN_ID = "%s-lora-r%s-e%s-ds%s-%s-a%s"


def model_slug(name: Column) -> Column:
    stem = F.lower(F.substring_index(name, "/", -1))
    return F.substring(reduce(lambda s, r: F.replace(s, F.lit(r[0]), F.lit(r[1])), SLUG, stem), 1, SLUG_LENGTH)


def run_id(name: Column, rank: Column, epochs: Column, version: Column, day: Column, attempt: Column) -> Column:
    return F.format_string(RUN_ID, model_slug(name), rank.cast("string"), epochs.cast("string"), F.coalesce(version, F.lit("v1")), F.date_format(day, "yyyyMMdd"), F.coalesce(attempt, F.lit(1)).cast("string"))


#: The keys of a run's flat record, by section.
FLAT = {
    "model": ("name", "max_seq_length"),
    "lora": ("r", "alpha", "dropout", "target_modules"),
    "training": ("num_epochs", "per_device_train_batch_size", "gradient_accumulation_steps", "learning_rate", "warmup_steps", "lr_scheduler_type", "fp16", "seed"),
    "data": ("path", "train_split"),
}


def flatten_config(config: dict, fingerprint: str = "unknown", revision: str = "unknown", device: str = "unknown", day: datetime.date | None = None) -> dict:
    """One level of section/key names, with the derived batch size and the run's id; a missing key of FLAT raises KeyError."""
    flat = {f"{s}/{k}": config[s][k] for s, keys in FLAT.items() for k in keys}
    training, run = config["training"], config.get("wandb", {})
    attempt, version = run.get("attempt", 1), str(run.get("dataset_version", "v1"))
    slug = reduce(lambda s, r: s.replace(*r), SLUG, config["model"]["name"].rsplit("/", 1)[-1].lower())[:SLUG_LENGTH]
    stamp = f"{day or datetime.datetime.now(datetime.UTC).date():%Y%m%d}"
    return flat | {
        "training/effective_batch_size": training["per_device_train_batch_size"] * training["gradient_accumulation_steps"],
        "training/optim": training.get("optim", "adamw_torch"),
        "data/sha256": fingerprint,
        "model/revision": revision,
        "compute/gpu_type": device,
        "run/attempt": attempt,
        "run/dataset_version": version,
        "run/id": RUN_ID % (slug, config["lora"]["r"], training["num_epochs"], version, stamp, attempt),
    }


def config_table(spark: SparkSession, flat: dict) -> DataFrame:
    return spark.createDataFrame([({k: None if v is None else str(v) for k, v in flat.items()},)], "config map<string,string>")


def split_project(full: Column) -> tuple[Column, Column]:
    """Entity (null without a slash) and project, at the first slash."""
    at = F.instr(full, "/")
    return F.when(at > 0, F.substr(full, F.lit(1), at - 1)), F.when(at > 0, F.substr(full, at + F.lit(1))).otherwise(full)


def metric_name(label: Column, metric: Column, scope: str = "eval") -> Column:
    return F.concat(F.lit(f"{scope}/"), F.when(label == "Base", "base").otherwise("lora_ft"), F.lit("/"), F.replace(metric, F.lit("@"), F.lit("_at_")))


def tracker_scalars(summary: DataFrame, *metrics: str, scope: str = "eval") -> DataFrame:
    """(name, value) for every model and metric of a summary, as a tracker takes them."""
    long = summary.select("model", *[F.col(f"`{m}`").cast("double") for m in metrics]).unpivot("model", [f"`{m}`" for m in metrics], "metric", "value")
    return long.select(metric_name(F.col("model"), F.replace("metric", F.lit("`"), F.lit("")), scope).alias("name"), "value")


def results_table(scores: DataFrame, scope: str = "eval") -> DataFrame:
    """The per-example scores, each row with the name of the tracker's table that it belongs to."""
    return scores.select(F.lit(f"{scope}/results_table").alias("table"), *[F.col(f"`{c}`") for c in scores.columns if c != "table"])


def accuracy_cost(results: DataFrame, metric: str) -> DataFrame:
    """Points for accuracy against deployment cost: model, benchmark, size, quantisation and the metric, where both are known."""
    points = results.select("model_name", "benchmark", "params", F.coalesce("quantization", F.lit("none")).alias("quantization"), F.col(f"`{metric}`").alias("value"))
    return points.where("params IS NOT NULL AND value IS NOT NULL")


def fingerprint16(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256; `unknown` for null."""
    return F.coalesce(F.substring(F.sha2(content.cast("binary"), 256), 1, 16), F.lit("unknown"))


def file_fingerprint(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return "unknown"
    return spark.read.format("binaryFile").load(path).select(fingerprint16(F.col("content"))).first()[0]


def modelfile(path: Column) -> Column:
    """The deployment template for a model file."""
    # The template's lines.
    body = '''# Modelfile for Qwen2.5-Coder-0.5B Python FIM
FROM %s

# Qwen2.5-Coder FIM template
TEMPLATE """<|fim_prefix|>{{ .Prompt }}<|fim_suffix|><|fim_middle|>"""

PARAMETER stop "<|endoftext|>"
PARAMETER stop "<|fim_middle|>"
PARAMETER stop "<|fim_prefix|>"
PARAMETER stop "<|fim_suffix|>"
'''
    return F.format_string(body, path)


def benchmark_pivot(results: DataFrame, metric: str, benchmarks: list[str]) -> DataFrame:
    """model_name by benchmark; naming the benchmarks spares a pass over the data."""
    return results.groupBy("model_name").pivot("benchmark", benchmarks).agg(F.first(f"`{metric}`"))


def retention(results: DataFrame, metric: str, base: str = "none") -> DataFrame:
    """Each quantised result as a share of the unquantised one of the same model and benchmark."""
    value = F.col(f"`{metric}`")
    before = F.max(F.when(F.col("quantization") == base, value)).alias("before")
    full = results.groupBy("model_name", "benchmark").agg(before)
    after = results.where(F.col("quantization") != base).select("model_name", "benchmark", "quantization", value.alias("after"))
    return after.join(full, ["model_name", "benchmark"]).withColumn("retained", F.when(F.col("before") != 0, F.col("after") / F.col("before")))


def source_mix(rows: DataFrame, source: str, text: str) -> DataFrame:
    """Rows, share, mean and median length by source."""
    size = F.length(text)
    by = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_length"), F.median(size).alias("median_length"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a source by now
