import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import rng, scoring, text
from quillspark.schemas import MASK

PIECES = st.text(st.sampled_from(list("ab \t\n\r\x0b\x0c\x1c\x1e\x1f\x85\xa0\u2028\u3000é🎈")), max_size=12)


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, a string, b string" if isinstance(values[0], tuple) else "i int, a string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


@settings(max_examples=15, deadline=None)
@given(st.lists(PIECES, min_size=20, max_size=60))
def test_lines_and_strip_as_in_python(spark, texts):
    assert column(spark, texts, text.split_lines(F.col("a"))) == [t.splitlines() for t in texts]
    assert column(spark, texts, text.strip(F.col("a"))) == [t.strip() for t in texts]
    assert column(spark, texts, text.is_blank(F.col("a"))) == [not t.strip() for t in texts]


def test_every_white_space_code_point(spark):
    points = [chr(i) for i in range(0x3100)]
    assert column(spark, points, text.is_blank(F.col("a"))) == [not c.strip() for c in points]


def plain_similarity(a, b):
    a, b = a.strip(), b.strip()
    if not a and not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b)) if a and b else 0.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=20, max_size=40))
def test_scores(spark, pairs):
    assert column(spark, pairs, scoring.exact_match(F.col("a"), F.col("b"))) == [float(a.strip() == b.strip()) for a, b in pairs]
    assert column(spark, pairs, scoring.edit_similarity(F.col("a"), F.col("b"))) == pytest.approx([plain_similarity(a, b) for a, b in pairs])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["a", "$1", "\\", "\n", MASK]), max_size=6).map("".join), st.sampled_from(["", "x$0", "\\1", MASK])), min_size=10, max_size=30))
def test_first_mask_only(spark, pairs):
    assert column(spark, pairs, text.replace_first(F.col("a"), F.col("b"))) == [a.replace(MASK, b, 1) for a, b in pairs]
    assert column(spark, pairs, text.before_mask(F.col("a"))) == [a.split(MASK, 1)[0] for a, _ in pairs]
    assert column(spark, pairs, text.after_mask(F.col("a"))) == [a.split(MASK, 1)[1] if MASK in a else "" for a, _ in pairs]


def test_prompt_and_sentinels(spark):
    got = spark.createDataFrame([("p", "s", "m")], "a string, b string, c string").select(text.fim_text(F.col("a"), F.col("b"), F.col("c")), text.has_sentinel(F.col("a"))).first()
    assert tuple(got) == ("<|fim_prefix|>p<|fim_suffix|>s<|fim_middle|>m", False)


def test_draws(spark):
    got = spark.range(200).select(rng.uniform_int(9, F.col("id"), F.lit(3), "t", F.lit(2), F.lit(5))).collect()
    assert [r[0] for r in got] == [2 + int(hashlib.md5(f"9:{i}:3:t".encode()).hexdigest()[:8], 16) % 4 for i in range(200)]


def test_passes(spark):
    tests = [{"input": "", "output": ["1 ", "one"]}, {"input": "", "output": ["2"]}]
    kind = "t array<struct<input:string,output:array<string>>>, o array<string>"
    cases = [(tests, ["1\n", " 2"], True), (tests, ["one", "3"], False), (tests, ["1", None], False), (tests, ["1"], False), ([], [], False), (None, None, False), (tests, None, False)]
    got = spark.createDataFrame([c[:2] for c in cases], kind).select(scoring.passes(F.col("o"), F.col("t"))).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]
