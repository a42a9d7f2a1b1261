"""Sinks; each overwrites."""

from pyspark.sql import DataFrame


def write_jsonl(rows: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines, non-ASCII characters as they are; `files` for a fixed number of parts."""
    (rows.coalesce(files) if files else rows).write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str, key: str = "model") -> None:
    """One CSV with a header, the key first, in its order."""
    summary.select(key, *[f"`{c}`" for c in summary.columns if c != key]).orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
