"""Infill records from a stream of source tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.spans import spans


def stream_spans(spark: SparkSession, folder: str, schema: T.StructType, key: str, text: str, samples: int = 5, seed: int = 42, within: str | None = None) -> DataFrame:
    """Spans of every new Parquet file in a folder, each distinct record once; state holds a digest of each.

    With `within`, a duration such as "7 days", digests are forgotten that long after their file was written (by the
    files' times), so that the state is bounded; a record that comes again later than that is then kept again.
    """
    source = spark.readStream.schema(schema).parquet(folder)
    if within is None:
        made = spans(source, key, text, samples, seed)
    else:
        timed = source.withColumn("arrived", F.col("_metadata.file_modification_time")).withWatermark("arrived", within)
        made = spans(timed, key, text, samples, seed, carry=("arrived",))
    digested = made.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    return digested.dropDuplicates(["digest"]) if within is None else digested.dropDuplicatesWithinWatermark(["digest"])


def ingest(made: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what there is as Parquet and stop."""
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
