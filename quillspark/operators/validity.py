"""Decoding of source bytes and the syntax check, the one place where Python has to see every file."""

import ast
import warnings

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(content: bytes) -> str:
    """UTF-8 without its undecodable bytes, with every line end a line feed."""
    return content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def parses(source: str) -> bool:
    """Whether Python's grammar, of the worker's version, accepts it; what exhausts the parser is not accepted either."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(source)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False
    return True


def decoded(content: Column) -> Column:
    """struct(source, valid) of binary content."""

    @F.arrow_udf("struct<source:string,valid:boolean>")
    def check(column: pa.Array) -> pa.Array:
        texts = [None if b is None else decode(b) for b in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([t is not None and parses(t) for t in texts], pa.bool_())], ["source", "valid"])

    return check.asNondeterministic()(content)


def is_valid(source: Column) -> Column:
    @F.arrow_udf("boolean")
    def check(column: pa.Array) -> pa.Array:
        return pa.array([t is not None and parses(t) for t in column.to_pylist()], pa.bool_())

    return check.asNondeterministic()(source)
