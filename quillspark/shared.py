"""Fresh paths in the folder that driver and executors share."""

import os
import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a folder of our own only where all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{checkpoint_root(spark)}/quillspark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for a path with or without scheme."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def row_of(rows: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """All columns of a row as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in but])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
