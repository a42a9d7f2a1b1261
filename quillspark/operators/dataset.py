"""From source folders to a deduplicated infill corpus."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.sampling import shuffled_cap, train_val_split
from quillspark.operators.spans import keep_first, spans
from quillspark.operators.validity import decoded
from quillspark.schemas import FIM_RECORD
from quillspark.session import ship
from quillspark.sources.readers import below, read_files, scan_jsonl, scan_sources
from quillspark.sources.writers import write_jsonl


def corpus(files: DataFrame, samples: int = 5, seed: int = 42) -> tuple[DataFrame, Observation, Observation]:
    """Records of files(path, content), with what is observed of files and of records while they are made."""
    of_files, of_records = Observation("files"), Observation("records")
    read = files.select("path", decoded(F.col("content")).alias("d")).select("path", "d.*")
    read = read.observe(of_files, F.count(F.lit(1)).alias("read"), F.count_if(~F.col("valid")).alias("invalid"))
    made = spans(read.where("valid"), "path", "source", samples, seed).observe(of_records, F.count(F.lit(1)).alias("raw"))
    return keep_first(made, "text", "file_id", "attempt"), of_files, of_records


def build_dataset(spark: SparkSession, source_dirs: list[str], output_path: str, max_files: int = 5000, samples_per_file: int = 5, seed: int = 42) -> dict:
    """Write the corpus as JSON lines and return its counters.

    The cap is taken on paths, before any content is read, and before validation, so invalid files use it up. Files are
    known by their path below the source folder, so the same tree gives the same corpus wherever it lies. The other counters are taken while writing; a file that is listed but cannot be read counts as unreadable.
    """
    ship(spark)
    listed = scan_sources(spark, source_dirs).select("path", below(spark, F.col("path"), source_dirs).alias("name"))
    listed = shuffled_cap(listed, "name", max_files, seed)
    paths = [r["path"] for r in listed.collect()]  # at most max_files
    if not paths:  # an empty plan would be optimised away, and its observations with it
        write_jsonl(spark.createDataFrame([], FIM_RECORD), output_path)
        return dict.fromkeys(("files", "unreadable", "invalid", "processed", "raw", "kept"), 0)
    rows, of_files, of_records = corpus(read_files(spark, paths).withColumn("path", below(spark, F.col("path"), source_dirs)), samples_per_file, seed)
    after = Observation("kept")
    write_jsonl(rows.select("prefix", "suffix", "middle", "text").observe(after, F.count(F.lit(1)).alias("kept")), output_path)
    files, records = of_files.get, of_records.get
    return {"files": len(paths), "unreadable": len(paths) - files["read"], "invalid": files["invalid"], "processed": files["read"] - files["invalid"], "raw": records["raw"], "kept": after.get["kept"]}


def files_by_directory(files: DataFrame) -> DataFrame:
    return files.groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"))


def build_counters(checked: DataFrame) -> DataFrame:
    """One row of counters from checked(readable, valid, n_raw, n_kept)."""
    return checked.agg(
        F.count_if(F.col("readable") & F.col("valid")).alias("processed"),
        F.count_if(F.col("readable") & ~F.col("valid")).alias("invalid"),
        F.count_if(~F.col("readable")).alias("unreadable"),
        F.coalesce(F.sum("n_raw"), F.lit(0)).alias("raw"),
        F.coalesce(F.sum("n_kept"), F.lit(0)).alias("kept"),
    )


def directory_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder; contents are not read."""
    total = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0]
    return total or 0


def load_train_val(spark: SparkSession, path: str, train_split: float = 0.9, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The texts of a JSON-lines corpus, shuffled by seed and split: (train, val), each with the column text alone."""
    split = train_val_split(scan_jsonl(spark, path, allow_empty=False).select("text"), "text", train_split, seed)
    return tuple(split.where(F.col("split") == side).select("text") for side in ("train", "val"))
