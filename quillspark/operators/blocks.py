"""Block and function spans of Python sources, from their syntax trees."""

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def blocks_of(source: str | None) -> list[dict]:
    """(kind, start, end) by 0-based line, end excluded, of functions and of compound statements' bodies; none for what does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    found = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found.add(("function", node.lineno - 1, node.end_lineno))
        elif isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.AsyncWith | ast.Try | ast.ClassDef):
            found.add(("block", node.body[0].lineno - 1, node.body[-1].end_lineno))
    return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(found, key=lambda x: (x[1], x[2], x[0]))]


def block_spans(source: Column) -> Column:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def find(column: pa.Array) -> pa.Array:
        return pa.array([blocks_of(t) for t in column.to_pylist()], kind)

    return find.asNondeterministic()(source)
