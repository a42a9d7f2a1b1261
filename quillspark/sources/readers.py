"""Scans."""

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import is_blank
from quillspark.schemas import FIM_RECORD, TRAINER_LOG


def scan_sources(spark: SparkSession, dirs: list[str], pattern: str = "*.py") -> DataFrame:
    """directory, path, length, content of every matching file below each folder; a file below two of them comes twice."""
    one = lambda d: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(d).select(F.lit(d).alias("directory"), "path", "length", "content")
    return reduce(DataFrame.unionByName, map(one, dirs))


def below(spark: SparkSession, path: Column, dirs: list[str]) -> Column:
    """A path without the source folder that it is in, the innermost if there are several."""
    known = []
    for d in dirs:
        where = spark._jvm.org.apache.hadoop.fs.Path(d)
        known.append(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/") + "/")
    cut = [F.when(F.startswith(path, F.lit(k)), F.substr(path, F.lit(len(k) + 1))) for k in sorted(known, key=len, reverse=True)]
    return F.coalesce(*cut, path)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content of the given files, as often as each is listed; files that cannot be read are left out. The list is a capped one."""
    times = Counter(paths)
    if not times:
        return spark.createDataFrame([], "path string, content binary")
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in sorted(times)]
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(escaped).select("path", "content")
    again = {p: n for p, n in times.items() if n > 1}
    if not again:
        return read
    more = spark.createDataFrame([(p, n) for p, n in again.items()], "path string, n int")
    return read.join(more, "path", "left").select("path", "content", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1))))).drop("col")


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType = FIM_RECORD, allow_empty: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one raises, and so does an empty file unless it is allowed."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not allow_empty and rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def scan_trainer_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log as one row, or None where the file is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(TRAINER_LOG).option("multiLine", "true").json(path)


def scan_tasks(spark: SparkSession, path: str, config: str | None = None, split: str | None = None) -> DataFrame:
    """Raw infill tasks from Parquet or JSON lines, with unit_tests as JSON text or nested.

    With a configuration, the files of the folder of that name below path; with a split, those whose names begin with
    it. The kind of file follows from the names found.
    """
    if config is None and split is None:
        return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path)
    pattern = f"{path.rstrip('/')}/{config + '/' if config else ''}{split or ''}*"
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = [f.getPath().toString() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []]
    parquet, lines = ([f for f in found if f.endswith(ends)] for ends in ((".parquet",), (".json", ".jsonl")))
    if not parquet and not lines:
        raise ValueError(f"no tasks in {pattern}")
    return spark.read.parquet(*parquet) if parquet else spark.read.json(lines)


def non_blank_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(~is_blank(F.col("value"))).count()
