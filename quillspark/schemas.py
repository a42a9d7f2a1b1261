"""Table schemas and string constants of the infill engine."""

from pyspark.sql import types as T

# Sentinels of the training text, and the mask of infill tasks.
FIM_PREFIX = "<|fim_prefix|>"
FIM_SUFFIX = "<|fim_suffix|>"
FIM_MIDDLE = "<|fim_middle|>"
MASK = "{{completion}}"

FIM_RECORD = T.StructType([T.StructField(n, T.StringType(), False) for n in ("prefix", "suffix", "middle", "text")])
PREDICTION = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("model", T.StringType()), T.StructField("completion", T.StringType())])
UNIT_TESTS = T.ArrayType(T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.ArrayType(T.StringType()))]))
INFILL_TASK = T.StructType([*[T.StructField(n, T.StringType()) for n in ("task_id", "lang", "eval_prompt")], T.StructField("unit_tests", UNIT_TESTS)])
TRAINER_LOG = T.StructType([T.StructField("log_history", T.ArrayType(T.StructType([T.StructField("step", T.LongType()), T.StructField("loss", T.DoubleType()), T.StructField("eval_loss", T.DoubleType())])))])
