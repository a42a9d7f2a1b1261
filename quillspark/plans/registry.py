"""Registered queries of the core engine and their SQL counterparts, over the generated tables."""

import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import scoring, sizes, text
from quillspark.operators import blocks, dataset, evaluate, infill, reporting, sampling, sandbox, spans, validity
from quillspark.plans import oracles
from quillspark.schemas import MASK
from quillspark.session import ship
from quillspark.shared import open_fs, scratch_path, shuffle_width
from quillspark.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _spans(t) -> DataFrame:
    return spans.spans(t("documents").select("doc_id", "text"), "doc_id", "text")


def _digest(c: str):
    """A text by its digest, so that no text is shuffled to be compared."""
    return F.sha2(F.col(c).cast("binary"), 256).alias(c)


@query(oracles.FLAGSHIP)
def fim_flagship(t, spark):
    """Distinct infill records by language."""
    made = spans.spans(t("documents").select("doc_id", "lang", "text"), "doc_id", "text", carry=("lang",))
    made = made.select("lang", "file_id", "attempt", "span_len", _digest("text"))
    by = spans.keep_first(made, "text", "file_id", "attempt").groupBy("lang")
    return by.agg(F.count(F.lit(1)).alias("n_records"), F.sum("span_len").cast("long").alias("n_lines"))


@query(oracles.SPANS)
def fim_spans(t, spark):
    return _spans(t).select("file_id", "attempt", "start", "span_len", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(oracles.DEDUP)
def fim_dedup(t, spark):
    made = _spans(t).select("file_id", "attempt", F.md5(F.col("text").cast("binary")).alias("text_md5"), _digest("text"))
    return spans.keep_first(made, "text", "file_id", "attempt").select("file_id", "attempt", "text_md5")


@query(oracles.BUILD_STATS)
def fim_build_stats(t, spark):
    """The builder's counters, with one invalid text in every ten documents by construction."""
    nth = F.row_number().over(Window.partitionBy("text").orderBy("file_id", "attempt"))
    raw = _spans(t).select("file_id", "attempt", _digest("text")).withColumn("n", nth)
    each = raw.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("n") == 1).alias("n_kept"))
    docs = t("documents").select("doc_id", F.lit(True).alias("readable"), (F.col("doc_id") % 10 != 0).alias("valid"))
    return dataset.build_counters(docs.join(each, docs["doc_id"] == each["file_id"], "left"))


@query(oracles.LINE_STATS)
def line_stats(t, spark):
    lines = text.split_lines(F.col("text"))
    return t("documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: ~text.is_blank(x))).cast("long").alias("n_filled"))


@query(oracles.STRIPPED)
def strip_lengths(t, spark):
    """Unicode strip of texts with white space of several kinds put around them."""
    around = F.concat(F.lit("\u3000\t\xa0"), F.col("text"), F.lit("\x1c \u2028\n"))
    return t("documents").select("doc_id", F.length(text.strip(around)).cast("long").alias("n_chars"))


@query(oracles.EXACT_DEDUP)
def exact_dedup_docs(t, spark):
    return spans.keep_first(t("documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


def _part_sources(t) -> DataFrame:
    """Sources of 4 + p_size lines; every odd one has a syntax error at its end."""
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") + 3), lambda i: F.concat(F.lit("line_"), i.cast("string"), F.lit(" = "), i.cast("string"))), "\n")
    return t("part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 2 == 1, F.concat(body, F.lit("\ndef foo(:"))).otherwise(body).alias("source"))


@query(oracles.SYNTAX)
def syntax_valid_counts(t, spark):
    return _part_sources(t).select("p_size", validity.is_valid(F.col("source")).alias("ok")).groupBy("p_size").agg(F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_invalid"))


@query(oracles.VALID_SPANS)
def valid_source_spans(t, spark):
    """Spans of the sources that parse."""
    valid = _part_sources(t).where(validity.is_valid(F.col("source")))
    return spans.spans(valid, "p_partkey", "source").select("file_id", "attempt", "start", "span_len", F.md5("text").alias("text_md5"))


@query(oracles.SPLIT)
def train_val_split(t, spark):
    return sampling.train_val_split(t("documents").select("doc_id"), "doc_id")


@query(oracles.GROUP_SPLIT)
def grouped_split(t, spark):
    return sampling.train_val_split(t("documents").select("doc_id", "source"), "doc_id", group_by="source")


@query(oracles.CAP)
def shuffle_cap(t, spark):
    return sampling.shuffled_cap(t("documents").select("doc_id"), "doc_id", 500)


@query(oracles.LANG_SAMPLE)
def lang_sample(t, spark):
    """Language filter, seeded cap, then the mask filter: every third document has a mask."""
    prompt = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 20), F.lit(MASK), F.substr("text", F.lit(21)))).otherwise(F.col("text"))
    raw = t("documents").select(F.col("doc_id").alias("task_id"), "lang", prompt.alias("eval_prompt"), F.lit('[{"input": "", "output": []}]').alias("unit_tests"))
    return infill.load_tasks(raw, language="en", max_samples=100).select("task_id", "prefix", "suffix")


@query(oracles.HEAD)
def head_n(t, spark):
    return sampling.head(t("documents").select("doc_id", "lang"), "doc_id", 200)


def _turns(t) -> DataFrame:
    """Records from conversations: each turn is a prompt, the next turn its reference."""
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = t("conversations").select("conv_id", "turn", "text", nxt.alias("middle")).where("text IS NOT NULL AND middle IS NOT NULL")
    return both.withColumn("record_id", F.concat_ws("-", "conv_id", "turn"))


def _half(c: str):
    return F.substr(c, F.lit(1), F.floor(F.length(c) / 2).cast("int"))


def _text_scores(t) -> DataFrame:
    # Spread before the quadratic distance: a scan of few files would leave it to few tasks.
    turns = _turns(t)
    turns = turns.repartition(shuffle_width(turns.sparkSession), "record_id")
    echo = evaluate.predict(turns, "Base", F.col("text"))
    half = evaluate.predict(turns, "LoRA-FT", _half("middle"))
    return evaluate.score_text(turns, echo.unionByName(half))


@query(oracles.EXACT_MATCH)
def exact_match_by_model(t, spark):
    turns = _turns(t)
    labels = F.explode(F.array(F.struct(F.lit("Base").alias("model"), F.col("text").alias("completion")), F.struct(F.lit("LoRA-FT").alias("model"), _half("middle").alias("completion"))))
    both = turns.select("middle", labels.alias("p")).select("middle", "p.*")
    scored = both.select("model", scoring.exact_match(F.col("completion"), F.col("middle")).alias("exact_match"))
    return evaluate.summarise(scored, "exact_match").withColumn("exact_match", F.round("exact_match", 6))


@query(oracles.EDIT_SIMILARITY)
def edit_similarity_by_model(t, spark):
    summary = evaluate.summarise(_text_scores(t), "exact_match", "edit_similarity")
    return summary.select("model", F.round("exact_match", 6).alias("exact_match"), F.round("edit_similarity", 6).alias("edit_similarity"))


@query(oracles.COMPARISON)
def comparison_long(t, spark):
    summary = evaluate.summarise(_text_scores(t), "exact_match", "edit_similarity")
    return evaluate.long_form(summary, "exact_match", "edit_similarity").withColumn("value", F.round("value", 6))


@query(oracles.RUNNING)
def running_mean(t, spark):
    """Every twentieth record of each model, and its last, by conversation and turn."""
    place = F.split("record_id", "-")
    scored = _text_scores(t).withColumns({"conv_id": place[0].cast("long"), "turn": place[1].cast("int")})
    means = evaluate.running_mean(scored, ("conv_id", "turn"), 20, "exact_match", "edit_similarity")
    return means.select("model", "position", F.round("exact_match", 6).alias("exact_match"), F.round("edit_similarity", 6).alias("edit_similarity"))


def _prompts(t) -> DataFrame:
    """Documents with one or, for even ids, two masks."""
    prompt = F.concat(F.substring("text", 1, 30), F.lit(MASK), F.substring("text", 31, 30), F.when(F.col("doc_id") % 2 == 0, F.lit(MASK)).otherwise(""), F.substr("text", F.lit(61)))
    return t("documents").select(F.col("doc_id").alias("task_id"), prompt.alias("eval_prompt"))


@query(oracles.MASK_SPLIT)
def mask_split(t, spark):
    return infill.masked(_prompts(t)).select("task_id", "prefix", "suffix")


@query(oracles.ASSEMBLY)
def program_assembly(t, spark):
    return _prompts(t).select("task_id", infill.assemble(F.col("eval_prompt"), F.concat(F.lit("pass $1 \\ "), F.col("task_id").cast("string"))).alias("program"))


def _runs(t) -> DataFrame:
    """Stored runs: a test for each line of an order; the second model prints other values for large quantities, and nothing for some flags."""
    line = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q"), (F.col("l_quantity") > 45).alias("big"), (F.col("l_returnflag") == "A").alias("lost"))
    accepted = F.array(F.concat(F.lit(" "), F.col("q"), F.lit("\n")), F.concat(F.col("q"), F.lit(".0")))
    test = F.struct(F.col("l_linenumber").alias("i"), F.struct(F.lit("").alias("input"), accepted.alias("output")).alias("t"), F.concat("q", F.lit("\t")).alias("base"), F.when(F.col("big"), "x").when(~F.col("lost"), F.concat(F.col("q"), F.lit(".0"))).alias("tuned"))
    tests = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(test)).alias("a"))
    models = F.explode(F.array(F.struct(F.lit("Base").alias("model"), F.col("a.base").alias("outputs")), F.struct(F.lit("LoRA-FT").alias("model"), F.col("a.tuned").alias("outputs"))))
    return tests.select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("a.t").alias("unit_tests"), models.alias("m")).select("task_id", "unit_tests", "m.*")


@query(oracles.JUDGE)
def judge_outputs(t, spark):
    return infill.judge(_runs(t)).select("task_id", "model", F.col("`pass@1`").alias("passed"))


@query(oracles.PASS_AT_1)
def pass_at_1(t, spark):
    return evaluate.summarise(infill.judge(_runs(t)), "pass@1").select("model", F.round("`pass@1`", 6).alias("pass_at_1"))


@query(oracles.JSON_TESTS)
def json_props(t, spark):
    """Unit tests as JSON text, parsed and exploded."""
    js = F.concat(F.lit('[{"input": "'), F.col("event_type"), F.lit('", "output": ["'), F.get_json_object("props", "$.k"), F.lit('", "-"]}]'))
    raw = t("events").select("event_id", js.alias("unit_tests"))
    return infill.nested_tests(raw).select("event_id", F.explode("unit_tests").alias("u")).select("event_id", F.col("u.input").alias("input"), F.col("u.output")[0].alias("first_output"), F.size("u.output").cast("long").alias("n_outputs"))


def _log(t) -> DataFrame:
    """Trainer logs of at most a thousand entries each."""
    entry = F.struct(F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 5 == 0, F.col("value") / 2).alias("eval_loss"))
    return t("events").where("event_type IS NOT NULL").select(F.floor(F.col("event_id") / 1000).alias("run"), entry.alias("e")).groupBy("run").agg(F.collect_list("e").alias("log_history"))


@query(oracles.LOSS)
def loss_series(t, spark):
    return reporting.loss_series(_log(t)).select("series", "step", F.round("value", 6).alias("value"))


@query(oracles.FINGERPRINT)
def fingerprint16(t, spark):
    return t("documents").select("doc_id", reporting.fingerprint16(F.when(F.col("doc_id") % 7 != 0, F.col("text"))).alias("fingerprint"))


@query(oracles.PROMPT)
def fim_prompt(t, spark):
    return t("part").select("p_partkey", text.fim_prompt(F.col("p_name"), F.col("p_type")).alias("prompt"), text.fim_text(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("text"))


@query(oracles.SENTINEL)
def sentinel_flag(t, spark):
    return t("part").select("p_partkey", text.has_sentinel(F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit("<|fim_suffix|>"), "p_type")).otherwise(F.col("p_name"))).alias("has_sentinel"))


@query(oracles.RUN_ID)
def run_id(t, spark):
    name = F.concat(F.lit("Org/Qwen2.5-Coder-"), (F.col("p_size") / 10).cast("decimal(4,1)").cast("string"), F.lit("B"))
    return t("part").select("p_partkey", reporting.run_id(name, F.lit(16), F.col("p_size"), F.when(F.col("p_size") % 2 == 0, "v2"), F.lit("2026-01-05").cast("date"), F.when(F.col("p_size") % 3 == 0, F.col("p_size"))).alias("run_id"))


@query(oracles.CONFIG)
def config_flatten(t, spark):
    """A configuration as rows, its learning rate and epochs from the data."""
    row = t("part").agg(F.max("p_size").alias("e"), F.min("p_size").alias("b")).first()
    config = {
        "model": {"name": "Org/Model-1", "max_seq_length": 2048}, "lora": {"r": 16, "alpha": 32, "dropout": 0.5, "target_modules": "q,v"},
        "training": {"num_epochs": row["e"], "per_device_train_batch_size": row["b"], "gradient_accumulation_steps": 4, "learning_rate": 0.25, "warmup_steps": 10, "lr_scheduler_type": "cosine", "fp16": "true", "seed": 42},
        "data": {"path": "d.jsonl", "train_split": 0.5},
    }
    flat = reporting.flatten_config(config, day=datetime.date(2026, 1, 5))
    return reporting.config_table(spark, flat).select(F.explode("config").alias("key", "value"))


@query(oracles.NAMES)
def metric_names(t, spark):
    entity, project = reporting.split_project(F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("/"), "p_type", F.lit("/x"))).otherwise(F.col("p_brand")))
    label = F.when(F.col("p_size") % 3 == 0, "Base").otherwise("Other")
    return t("part").select("p_partkey", entity.alias("entity"), project.alias("project"), reporting.metric_name(label, F.lit("exact_match")).alias("metric"), F.round(sizes.kilobytes(F.col("p_retailprice")), 6).alias("kb"), F.round(sizes.megabytes(F.col("p_retailprice") * 1000), 6).alias("mb"))


@query(oracles.MODELFILE)
def modelfile(t, spark):
    return t("region").select("r_regionkey", F.md5(reporting.modelfile(F.concat("r_name", F.lit(".gguf")))).alias("md5"))


@query(oracles.SOURCES)
def files_per_source(t, spark):
    """Counts by folder, here by source."""
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query(oracles.MIX)
def source_mix(t, spark):
    mix = reporting.source_mix(t("documents"), "lang", "text")
    return mix.select("lang", "n", F.round("mean_length", 6).alias("mean_length"), F.round("median_length", 6).alias("median_length"), F.round("share", 6).alias("share"))


def _results(t) -> DataFrame:
    """Benchmark results from orders: model by priority, benchmark by status."""
    o = t("orders").select(F.col("o_orderpriority").alias("model_name"), F.col("o_orderstatus").alias("benchmark"), F.when(F.col("o_orderkey") % 2 == 0, "none").otherwise("q4").alias("quantization"), (F.col("o_totalprice") / 1000).alias("v"))
    return o.groupBy("model_name", "benchmark", "quantization").agg(F.avg("v").alias("pass@1"))


@query(oracles.PIVOT)
def benchmark_pivot(t, spark):
    """Every result, quantised ones as variants of their model."""
    variant = _results(t).withColumn("model_name", F.concat_ws("/", "model_name", "quantization"))
    pivot = reporting.benchmark_pivot(variant, "pass@1", ["F", "O", "P"])
    return pivot.select("model_name", *[F.round(c, 4).alias(f"bench_{c.lower()}") for c in ("F", "O", "P")])


@query(oracles.RETENTION)
def accuracy_retention(t, spark):
    return reporting.retention(_results(t), "pass@1").select("model_name", "benchmark", "quantization", F.round("retained", 6).alias("retained"))


@query(oracles.SCATTER)
def accuracy_cost(t, spark):
    """Accuracy against model size, sizes by the length of the model's name and unknown for some."""
    sized = _results(t).withColumn("params", F.when(F.col("benchmark") != "P", F.length("model_name")))
    return reporting.accuracy_cost(sized, "pass@1").withColumn("value", F.round("value", 4))


@query(oracles.SCALARS)
def tracker_scalars(t, spark):
    passed = evaluate.summarise(infill.judge(_runs(t)), "pass@1")
    return reporting.tracker_scalars(passed, "pass@1", scope="eval/safim").withColumn("value", F.round("value", 6))


@query(oracles.RESULTS_ROWS)
def results_table(t, spark):
    """Per-example rows of the tracker's table."""
    scores = infill.judge(_runs(t)).withColumnRenamed("pass@1", "passed")
    return reporting.results_table(scores, scope="eval/safim").withColumnRenamed("table", "name")


@query(oracles.SOURCE_SPLIT)
def split_on_repeated_keys(t, spark):
    """A split by a key that many rows share: floor(n * 0.9) rows are train."""
    split = sampling.train_val_split(t("documents").select("source", "doc_id"), "source")
    return split.groupBy("source").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "val").alias("n_val"))


def _write_sources(t, spark) -> str:
    """A tree of Python files in the shared folder, one for each size and kind of generated source; returns its root."""
    root = scratch_path(spark, "tree")
    files = _part_sources(t).select(F.format_string("d%d/s%d_%d.py", F.col("p_size") % 3, "p_size", F.col("p_partkey") % 2).alias("name"), "source").distinct()

    def write(batches):
        for batch in batches:
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = open_fs(f"{root}/{name}")
                fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(where, compression=None) as f:
                    f.write(source.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return root


@query(oracles.CORPUS)
def corpus_build(t, spark):
    """The whole build over real files: scan, decode, validity, spans, dedup, JSON lines, and back."""
    root, out = _write_sources(t, spark), scratch_path(spark, "corpus")
    dataset.build_dataset(spark, [root], out)
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return readers.scan_jsonl(spark, out).select(digest("text"), digest("prefix"), digest("middle"), digest("suffix"))


@query(oracles.CORPUS_COUNTERS)
def corpus_counters(t, spark):
    """The build's counters, lines written, files by folder and bytes, over real files."""
    root, out = _write_sources(t, spark), scratch_path(spark, "corpus")
    made = dataset.build_dataset(spark, [f"{root}/d{i}" for i in range(3)], out)
    made |= {"lines": readers.non_blank_lines(spark, out), "bytes": dataset.directory_bytes(spark, root)}
    folders = dataset.files_by_directory(readers.scan_sources(spark, [f"{root}/d{i}" for i in range(3)])).collect()  # three rows
    rows = list(made.items()) + [(r["directory"].rsplit("/", 1)[1], r["n_files"]) for r in folders]
    return spark.createDataFrame(rows, "name string, n long")


@query(oracles.TRAIN_TEXTS)
def train_val_texts(t, spark):
    """The trainer's loader on JSON lines with repeated texts: how often each text is in train and in val."""
    path = scratch_path(spark, "jsonl")
    rows = t("documents").select(*[F.lit("").alias(c) for c in ("prefix", "suffix", "middle")], F.coalesce("source", F.lit("none")).alias("text"))
    writers.write_jsonl(rows.unionByName(t("documents").select("text").where("text IS NOT NULL"), allowMissingColumns=True), path)
    sides = [side.select("text", F.lit(name).alias("split")) for name, side in zip(("train", "val"), dataset.load_train_val(spark, path), strict=True)]
    return sides[0].unionByName(sides[1]).groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5"), "split").agg(F.count(F.lit(1)).alias("n"))


@query(oracles.JSONL)
def jsonl_round_trip(t, spark):
    """Records through the JSON-lines sink and scan, with every character that the tables hold."""
    path = scratch_path(spark, "jsonl")
    made = t("conversations").where("text IS NOT NULL").select(F.col("role").alias("prefix"), F.concat(F.lit('"\\\t\u2028'), "text").alias("suffix"), F.col("turn").cast("string").alias("middle"), "text")
    writers.write_jsonl(made, path)
    return readers.scan_jsonl(spark, path).select("prefix", "middle", F.md5(F.col("suffix").cast("binary")).alias("suffix_md5"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(oracles.EXACT_MATCH)
def summary_csv(t, spark):
    """The summary as its CSV gives it back."""
    path = scratch_path(spark, "csv")
    writers.write_summary(exact_match_by_model(t, spark), path)
    return spark.read.option("header", True).schema("model string, exact_match double").csv(path)


@query(oracles.TASK_FILES)
def task_files(t, spark):
    """Tasks from stored files, by configuration and split."""
    root = scratch_path(spark, "tasks")
    raw = t("documents").where("lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("task_id"), "lang")
    for config, split, rest in (("block", "test", 0), ("block", "train", 1), ("api", "test", 2)):
        raw.where(F.col("doc_id") % 3 == rest).withColumn("config", F.lit(config)).coalesce(2).write.parquet(f"{root}/{config}/{split}.parquet")
    return readers.scan_tasks(spark, root, "block", "test").select("task_id", "lang", "config")


@query(oracles.EXEC_SCORES)
def exec_scores(t, spark):
    """Loaded tasks, completed by two stored models, assembled, run and judged; a task without tests passes for nobody."""
    body = "a = int(input())\nprint({{completion}})\n"
    tests = '[{"input": "1", "output": ["2", "2.0"]}, {"input": "4", "output": ["5"]}]'
    rows = [("add", "python", body, tests), ("none", "python", body, "[]"), ("other", "java", body, tests), ("whole", "python", "print(1)", tests), ("late", "python", body, tests.replace("[\"5\"]", "[\"8\", \" 5 \\n\"]"))]
    tasks = infill.load_tasks(spark.createDataFrame(rows, "task_id string, lang string, eval_prompt string, unit_tests string"))
    done = [(k, m, c) for k in ("add", "none", "late") for m, c in (("Base", "a + 1"), ("LoRA-FT", "a * 2"))]
    scores, _ = infill.score_tasks(tasks, spark.createDataFrame(done, "record_id string, model string, completion string"), allow_execution=True)
    return scores.select("task_id", "model", F.col("`pass@1`").alias("passed"))


@query(oracles.SANDBOX)
def exec_sandbox(t, spark):
    """Four trusted programs under limits: right, wrong, failing and endless."""
    rows = [("right", "print(int(input()) + 1)", "1"), ("wrong", "print(3)", "1"), ("fails", "raise SystemExit(3)", "1"), ("endless", "while True: pass", "1")]
    tests = F.array(F.struct(F.col("stdin").alias("input"), F.array(F.lit("2")).alias("output")))
    runs = spark.createDataFrame(rows, "task_id string, program string, stdin string").withColumn("unit_tests", tests)
    done = runs.withColumns({"outputs": sandbox.outputs(F.col("program"), F.col("unit_tests"), allow_execution=True, timeout=2.0), "model": F.lit("Base")})
    return infill.judge(done).select("task_id", F.col("`pass@1`").alias("passed"))


@query(oracles.BLOCKS)
def block_spans(t, spark):
    """Function and block spans of generated sources."""
    source = F.concat(F.lit("def f(x):\n    if x:\n        y = "), F.col("p_size").cast("string"), F.lit("\n        return y\n    return 0\n"))
    return t("part").select("p_partkey", F.explode(blocks.block_spans(source)).alias("b")).select("p_partkey", "b.*")
