"""Scores of a completion against its reference."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip


def exact_match(predicted: Column, reference: Column) -> Column:
    return (strip(predicted) == strip(reference)).cast("double")


def edit_similarity(predicted: Column, reference: Column) -> Column:
    """1 - distance / longer length, on stripped text by code points; 1 if both are empty, 0 if one is."""
    a, b = strip(predicted), strip(reference)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def passes(outputs: Column, unit_tests: Column) -> Column:
    """Whether the output of every test, stripped, is among its accepted ones, stripped; null outputs fail, no tests fail."""
    one = lambda pair: F.coalesce(F.array_contains(F.transform(pair["t"]["output"], strip), strip(pair["o"])), F.lit(False))
    pairs = F.zip_with(unit_tests, outputs, lambda t, o: F.struct(t.alias("t"), o.alias("o")))
    return F.coalesce((F.size(unit_tests) > 0) & (F.size(unit_tests) == F.size(outputs)) & F.forall(pairs, one), F.lit(False))
