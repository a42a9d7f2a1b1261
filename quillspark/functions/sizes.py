"""Bytes in larger units."""

from pyspark.sql import Column


def kilobytes(n: Column) -> Column:
    return n / 1024


def megabytes(n: Column) -> Column:
    return n / (1024 * 1024)
