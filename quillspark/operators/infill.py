"""Infill tasks scored by execution: loading, program assembly, judging; execution itself is opt-in."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.scoring import passes
from quillspark.functions.text import after_mask, before_mask, replace_first
from quillspark.operators import sandbox
from quillspark.operators.evaluate import summarise
from quillspark.operators.sampling import shuffled_cap
from quillspark.schemas import MASK, UNIT_TESTS


def nested_tests(raw: DataFrame, column: str = "unit_tests") -> DataFrame:
    """Unit tests as an array of (input, accepted outputs), from JSON text or as they are; anything but an array of outputs is refused."""
    kind = raw.schema[column].dataType
    if isinstance(kind, T.StringType):
        return raw.withColumn(column, F.from_json(column, UNIT_TESTS, {"mode": "FAILFAST"}))
    if kind.simpleString() != UNIT_TESTS.simpleString():
        raise ValueError(f"unit tests are {kind.simpleString()}, not {UNIT_TESTS.simpleString()}")
    return raw


def masked(tasks: DataFrame, column: str = "eval_prompt") -> DataFrame:
    """Tasks with a mask, with the text before and after the first one."""
    return tasks.where(F.contains(column, F.lit(MASK))).withColumns({"prefix": before_mask(F.col(column)), "suffix": after_mask(F.col(column))})


def load_tasks(raw: DataFrame, language: str = "python", max_samples: int = 100, seed: int = 42) -> DataFrame:
    """Language filter, seeded cap, and only then the mask filter, so that fewer than max_samples may come out."""
    capped = shuffled_cap(raw.where(F.col("lang") == language), "task_id", max_samples, seed)
    return nested_tests(masked(capped)).select("task_id", "prefix", "suffix", "eval_prompt", "unit_tests")


def assemble(prompt: Column, completion: Column) -> Column:
    """The program: the first mask replaced, later ones kept."""
    return replace_first(prompt, completion)


def judge(runs: DataFrame) -> DataFrame:
    """model, task_id, pass@1 from runs(model, task_id, unit_tests, outputs)."""
    return runs.select("model", "task_id", passes(F.col("outputs"), F.col("unit_tests")).cast("double").alias("pass@1"))


def score_tasks(tasks: DataFrame, predictions: DataFrame, allow_execution: bool = False, timeout: float = sandbox.WALL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Scores (model, task_id, pass@1) of predictions(record_id, model, completion) for loaded tasks, and their summary; programs are run."""
    keyed = predictions.select(F.col("record_id").alias("task_id"), "model", "completion")
    runs = tasks.join(keyed, "task_id").withColumn("program", assemble(F.col("eval_prompt"), F.col("completion")))
    scores = judge(runs.withColumn("outputs", sandbox.outputs(F.col("program"), F.col("unit_tests"), allow_execution, timeout)))
    return scores, summarise(scores, "pass@1")
