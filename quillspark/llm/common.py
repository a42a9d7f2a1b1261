"""What the operators of this subpackage share: scratch tables, shared files, input tables."""

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from quillspark.session import ship
from quillspark.shared import open_fs, row_of, scratch_path, shuffle_width

__all__ = ["discard", "materialize", "open_fs", "row_of", "scratch_path", "shuffle_width", "slices", "table"]

#: Texts are handed to Python code in slices of about this many characters, which bounds the Python objects alive at once.
SLICE_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._scratch = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def slices(column: pa.Array, limit: int = SLICE_CHARS):
    """(first row, texts) for runs of rows whose texts together hold about limit bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield first, column.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += size
    yield first, column.slice(first, n - first).to_pylist()
