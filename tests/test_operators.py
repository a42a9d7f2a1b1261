import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.operators import blocks, dataset, evaluate, infill, reporting, sampling, sandbox, validity
from quillspark.operators.spans import keep_first, spans
from quillspark.schemas import MASK
from quillspark.sources import config, readers, writers
from quillspark.streaming.ingest import ingest, stream_spans


def source(n):
    return "\n".join(f"line_{i} = {i}" for i in range(n))


def test_spans_properties(spark):
    rows = [(i, source(n)) for i, n in enumerate([0, 5, 9, 10, 11, 30, 200])] + [(50, "\n" * 40), (51, "\r\n".join(map(str, range(12))) + "\r\n"), (52, None)]
    table = spark.createDataFrame(rows, "k long, t string")
    got = spans(table, "k", "t", samples=5, seed=1).collect()
    by = {}
    for r in got:
        by.setdefault(r.file_id, []).append(r)
        lines = dict(rows)[r.file_id].splitlines()
        assert 1 <= r.span_len <= min(15, len(lines) - 2) and r.start >= 1 and r.start + r.span_len <= len(lines) - 1
        assert "\n".join([r.prefix, r.middle, r.suffix]) == "\n".join(lines)
        assert r.text == f"<|fim_prefix|>{r.prefix}<|fim_suffix|>{r.suffix}<|fim_middle|>{r.middle}" and r.middle.strip() and not r.has_sentinel
    assert sorted(by) == [3, 4, 5, 6, 51]
    assert all(len(v) <= 5 for v in by.values()) and len(by[6]) == 5
    again = spans(table.repartition(7), "k", "t", samples=5, seed=1).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    with pytest.raises(ValueError):
        spans(table, "k", "t", shortest=9)


def test_keep_first(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "A"), (5, None), (4, None)], "k int, t string")
    assert sorted(r.k for r in keep_first(rows, "t", "k").collect()) == [1, 2, 4]
    clash = rows.selectExpr("k", "t", "'a' AS _n", "'b' AS n", "'c' AS digest", "'d' AS `row`")
    got = keep_first(clash, "t", "k")
    assert got.columns == clash.columns and {tuple(r)[2:] for r in got.collect()} == {("a", "b", "c", "d")}


def test_decoding_and_validity(spark):
    assert validity.decode(b"a\xff\r\nb\rc") == "a\nb\nc"
    texts = ["x = 1 + 2", "def f():\n    return 1", "def foo(:\n  pass", "", "# \u00e9\nx = 1", "\ufeffx = 1", "a\x00b", "(" * 5000, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", validity.is_valid(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got][:5] == [True, True, False, True, True] and not any(r.v for r in got[6:])


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src" / "deep"
    src.mkdir(parents=True)
    for i in range(3):
        (src / f"dup_{i}.py").write_text(source(30))
    (src / "valid.py").write_text(source(12) + "\n# é\n")
    (src / "invalid.py").write_text("def foo(:\n" * 12)
    (src / "odd [name] {x}.py").write_text(source(3))
    (src / "other.txt").write_text(source(30))
    return tmp_path


def test_build(spark, tree):
    out = str(tree / "out.jsonl")
    counters = dataset.build_dataset(spark, [str(tree / "src")], out, samples_per_file=2, seed=0)
    assert counters == {"files": 6, "unreadable": 0, "invalid": 1, "processed": 5, "raw": counters["raw"], "kept": counters["kept"]}
    records = [json.loads(line) for p in sorted((tree / "out.jsonl").glob("part-*")) for line in p.read_text().splitlines()]
    assert len(records) == counters["kept"] == len({r["text"] for r in records}) and all(list(r) == ["prefix", "suffix", "middle", "text"] for r in records)
    capped = dataset.build_dataset(spark, [str(tree / "src")], out, max_files=2)
    assert capped["files"] == 2
    assert main(["--source-dirs", str(tree / "src"), str(tree / "src"), "--output", out, "--max-files", "100"])["processed"] == 10
    assert readers.scan_jsonl(spark, out).count() > 0
    (tree / "none").mkdir()
    assert set(dataset.build_dataset(spark, [str(tree / "none")], out).values()) == {0}
    counts = dataset.files_by_directory(readers.scan_sources(spark, [str(tree / "src"), str(tree)])).collect()
    assert sorted(r.n_files for r in counts) == [6, 6]
    assert dataset.directory_bytes(spark, str(tree / "src")) == sum(p.stat().st_size for p in (tree / "src").rglob("*") if p.is_file())


def test_scans(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"prefix":"p","suffix":"s","middle":"m","text":"t"}\n\n   \n')
    assert readers.scan_jsonl(spark, str(good)).count() == 1 and readers.non_blank_lines(spark, str(good)) == 1
    bad = tmp_path / "b.jsonl"
    bad.write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.scan_jsonl(spark, str(bad)).collect()
    empty = tmp_path / "c.jsonl"
    empty.write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        readers.scan_jsonl(spark, str(empty), allow_empty=False)
    log = tmp_path / "log.json"
    log.write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 2, "eval_loss": 1.0}, {"step": 3, "loss": 1.5, "eval_loss": 0.5}, {"step": 4}]}, indent=1))
    series = reporting.loss_series(readers.scan_trainer_log(spark, str(log))).collect()
    assert sorted(map(tuple, series)) == [("eval", 2, 1.0), ("eval", 3, 0.5), ("train", 1, 2.0), ("train", 3, 1.5)]
    log.write_text(json.dumps({"log_history": [{"step": 2, "eval_loss": 1.0}]}))
    assert reporting.loss_series(readers.scan_trainer_log(spark, str(log))).collect() == []
    log.write_text("{}")
    assert reporting.loss_series(readers.scan_trainer_log(spark, str(log))).collect() == []
    assert readers.scan_trainer_log(spark, str(tmp_path / "none.json")) is None


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_split(spark, n):
    rows = spark.range(n).select((F.col("id") * 3).alias("k"), (F.col("id") % 11).alias("g"))
    got = sampling.train_val_split(rows, "k", 0.9, 5).collect()
    assert sum(r.split == "train" for r in got) == math.floor(n * 0.9) and len(got) == n
    again = {r.k: r.split for r in sampling.train_val_split(rows.repartition(5), "k", 0.9, 5).collect()}
    assert again == {r.k: r.split for r in got}
    grouped = sampling.train_val_split(rows, "k", 0.5, group_by="g").collect()
    assert len({(r.g, r.split) for r in grouped}) == len({r.g for r in grouped}) == min(n, 11)
    assert sampling.shuffled_cap(rows, "k", 5).count() == min(n, 5)


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_split_takes_whole_records_at_any_key(spark, ratio):
    """Repeated and null keys, wholly equal rows, and columns with the names of what is in between."""
    for keys in ([7] * 25, [None] * 25, [None] * 5 + [1] * 12 + [2, 3] * 4, list(range(25))):
        rows = [(k, "same" if i % 2 else f"row {i}", i % 3, "s", "x") for i, k in enumerate(keys)]
        table = spark.createDataFrame(rows, "k long, t string, v int, _k string, `row` string").repartition(3)
        got = sampling.train_val_split(table, "k", ratio, 5)
        assert got.columns == [*table.columns, "split"]
        found = got.collect()
        assert sum(r.split == "train" for r in found) == math.floor(len(keys) * ratio) and len(found) == len(keys)
        assert sorted(map(str, (tuple(r)[:-1] for r in found))) == sorted(map(str, rows))
        again = sampling.train_val_split(got.repartition(2), "k", ratio, 5).collect()
        assert sorted(map(str, again)) == sorted(map(str, found))
    grouped = sampling.train_val_split(table.withColumn("g", F.when(F.col("k") > 5, F.col("k") % 4)), "k", 0.5, group_by="g").collect()
    assert len({(r.g, r.split) for r in grouped}) == 5 and len(grouped) == 25


def test_many_equal_rows_are_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK", 7)
    table = spark.createDataFrame([("a",)] * 50, "k string")
    got = sampling.train_val_split(table, "k", 0.9).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 45, "val": 5}


def test_loader_and_task_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(json.dumps({"prefix": "", "suffix": "", "middle": "", "text": f"t{i % 4}"}) + "\n" for i in range(20)))
    train, val = dataset.load_train_val(spark, str(path))
    assert (train.columns, train.count(), val.count()) == (["text"], 18, 2)
    assert sorted(r.text for r in train.unionByName(val).collect()) == sorted(f"t{i % 4}" for i in range(20))
    path.write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        dataset.load_train_val(spark, str(path))
    for config, name in (("block", "test-0.jsonl"), ("block", "train.jsonl"), ("api", "test.jsonl")):
        (tmp_path / config).mkdir(exist_ok=True)
        (tmp_path / config / name).write_text(json.dumps({"task_id": f"{config}/{name}"}) + "\n")
    assert [r.task_id for r in readers.scan_tasks(spark, str(tmp_path), "block", "test").collect()] == ["block/test-0.jsonl"]
    assert readers.scan_tasks(spark, str(tmp_path), "block").count() == 2
    assert [r.task_id for r in readers.scan_tasks(spark, str(tmp_path / "api"), split="test").collect()] == ["api/test.jsonl"]
    assert readers.scan_tasks(spark, str(tmp_path / "api" / "test.jsonl")).count() == 1
    with pytest.raises(ValueError, match="no tasks"):
        readers.scan_tasks(spark, str(tmp_path), "block", "validation")


def test_a_tree_gives_the_same_corpus_wherever_it_lies(spark, tmp_path):
    texts = []
    for place in ("here", "there/deep"):
        src = tmp_path / place / "src"
        (src / "sub").mkdir(parents=True)
        for i in range(3):
            (src / "sub" / f"f{i}.py").write_text(source(20 + i))
        out = str(tmp_path / place / "out")
        dataset.build_dataset(spark, [str(src)], out, max_files=2)
        texts.append(sorted(r.text for r in readers.scan_jsonl(spark, out).collect()))
    assert texts[0] == texts[1] and texts[0]


def test_tracker_rows_and_points(spark):
    scores = spark.createDataFrame([("Base", "a", 1.0), ("Base", "b", 0.0), ("tuned", "a", 1.0)], "model string, task_id string, `pass@1` double")
    found = reporting.tracker_scalars(evaluate.summarise(scores, "pass@1"), "pass@1", scope="eval/safim").collect()
    assert sorted(map(tuple, found)) == [("eval/safim/base/pass_at_1", 0.5), ("eval/safim/lora_ft/pass_at_1", 1.0)]
    assert reporting.results_table(scores).columns == ["table", "model", "task_id", "pass@1"]
    results = spark.createDataFrame([("m", "b", 5, None, 0.5), ("m", "b", None, "q4", 0.4), ("n", "b", 7, "q4", None)], "model_name string, benchmark string, params int, quantization string, `pass@1` double")
    assert [tuple(r) for r in reporting.accuracy_cost(results, "pass@1").collect()] == [("m", "b", 5, "none", 0.5)]


def test_running_means_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "b", "b", None]), i * 37 % 1009, i, rng.choice([0.0, 1.0, 0.25, None]), None if i % 2 else 2.0) for i in range(1009)] + [("late", 1, 1, None, None), ("late", 2, 1, 1.0, None)]
    scores = spark.createDataFrame(rows, "model string, position int, `a.b` int, m double, `x.y` double").repartition(7)
    want = []
    for model in ("a", "b", None, "late"):
        own = sorted((r for r in rows if r[0] == model), key=lambda r: r[1:3])
        for n in range(1, len(own) + 1):
            if n % 10 == 0 or n == len(own):
                known = [[r[c] for r in own[:n] if r[c] is not None] for c in (3, 4)]
                want.append((model, n, *[pytest.approx(sum(k) / len(k)) if k else None for k in known]))
    got = sorted(map(tuple, evaluate.running_mean(scores, ["position", "a.b"], 10, "m", "x.y").collect()), key=lambda r: (r[0] is None, r[:2]))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[:2]))
    assert evaluate.running_mean(scores.limit(0), ["position"], 10, "m").collect() == []


def test_evaluation(spark, tmp_path):
    records = spark.createDataFrame([(i, i, f"middle {i}", "p", "s") for i in range(45)], "record_id int, position int, middle string, prefix string, suffix string")
    right = evaluate.predict(records, "Base", F.concat(F.lit(" "), "middle"))
    wrong = evaluate.predict_with(records, "LoRA-FT", lambda: lambda prefix, suffix: prefix + suffix)
    scores, summary = evaluate.evaluate(records, right.unionByName(wrong), max_samples=30)
    assert scores.count() == 60
    rows = summary.collect()
    assert [r.model for r in rows] == ["Base", "LoRA-FT"] and rows[0].exact_match == 1 and rows[1].exact_match == 0
    writers.write_summary(summary, str(tmp_path / "m.csv"))
    lines = next((tmp_path / "m.csv").glob("part-*")).read_text().splitlines()
    assert lines[0] == "model,exact_match,edit_similarity" and lines[1].startswith("Base,1.0")
    assert evaluate.long_form(summary, "exact_match", "edit_similarity").count() == 4
    means = spark.createDataFrame([("Base", i, float(i % 2)) for i in range(1, 46)], "model string, position int, exact_match double")
    assert [(r.position, r.exact_match) for r in evaluate.running_mean(means, ["position"], 20, "exact_match").orderBy("position").collect()] == [(20, 0.5), (40, 0.5), (45, pytest.approx(23 / 45))]
    none = spark.createDataFrame([("Base", float("nan")), ("Base", 1.0), (None, 5.0)], "model string, exact_match double")
    assert [tuple(r) for r in evaluate.summarise(none, "exact_match").collect()] == [("Base", 1.0)]
    assert evaluate.summarise(none.limit(0), "exact_match").collect() == []


def test_infill(spark):
    tests = json.dumps([{"input": "4", "output": ["5"]}])
    raw = spark.createDataFrame([("a", "python", f"print(int(input()) + {MASK})", tests), ("b", "python", "no mask", tests), ("c", "Python", MASK, tests)], "task_id string, lang string, eval_prompt string, unit_tests string")
    tasks = infill.load_tasks(raw)
    assert [(r.task_id, r.prefix, r.suffix) for r in tasks.collect()] == [("a", "print(int(input()) + ", ")")]
    models = F.explode(F.array(F.struct(F.lit("Base").alias("model"), F.lit("1").alias("completion")), F.struct(F.lit("LoRA-FT").alias("model"), F.lit("2").alias("completion"))))
    runs = tasks.select("*", models.alias("m")).select("*", "m.*").withColumn("program", infill.assemble(F.col("eval_prompt"), F.col("completion")))
    runs = runs.withColumn("outputs", sandbox.outputs(F.col("program"), F.col("unit_tests"), allow_execution=True))
    assert {(r.model, r["pass@1"]) for r in infill.judge(runs).collect()} == {("Base", 1.0), ("LoRA-FT", 0.0)}
    with pytest.raises(PermissionError):
        sandbox.outputs(F.col("program"), F.col("unit_tests"))
    bad = spark.createDataFrame([("a", "x")], "task_id string, o string").select("task_id", F.array(F.struct(F.lit("").alias("input"), F.col("o").alias("output"))).alias("unit_tests"))
    with pytest.raises(ValueError, match="unit tests are"):
        infill.nested_tests(bad)


def test_sandbox():
    assert sandbox.run_program("print(' hi ')", None) == "hi"
    assert sandbox.run_program("raise SystemExit(2)", "") is None
    assert sandbox.run_program("while True: pass", "", timeout=0.5) is None
    assert sandbox.run_program("x = bytearray(3 << 30)", "") is None


def test_config(spark, tmp_path):
    path = str(tmp_path / "c.yaml")
    with open(path, "w") as f:
        f.write("model: {name: Org/Qwen2.5-Coder-0.5B, max_seq_length: 2048}\nlora: {r: 16, alpha: 32, dropout: 0.05, target_modules: [q]}\ndata: {path: d, train_split: 0.9}\n"
                "training: {num_epochs: 3, per_device_train_batch_size: 4, gradient_accumulation_steps: 4, learning_rate: 0.0002, warmup_steps: 1, lr_scheduler_type: cosine, fp16: true, seed: 42}\n")  # fmt: skip
    flat = reporting.flatten_config(config.override(path, "wandb", attempt=2), day=datetime.date(2026, 8, 10))
    assert config.load_config(path)["wandb"] == {"attempt": 2}
    assert flat["run/id"] == "qwen05b-lora-r16-e3-dsv1-20260810-a2" and flat["training/effective_batch_size"] == 16 and flat["training/optim"] == "adamw_torch"
    assert reporting.config_table(spark, flat).select(F.map_keys("config")).first()[0]
    one = spark.createDataFrame([("Org/Qwen2.5-Coder-0.5B", "2026-08-10")], "n string, d string")
    got = one.select(reporting.run_id(F.col("n"), F.lit(16), F.lit(3), F.lit(None).cast("string"), F.to_date("d"), F.lit(2))).first()[0]
    assert got == flat["run/id"]
    assert reporting.file_fingerprint(spark, path + ".none") == "unknown" and len(reporting.file_fingerprint(spark, path)) == 16


def test_blocks():
    found = blocks.blocks_of("def f(x):\n    if x:\n        y = 1\n    return y\n")
    assert found == [{"kind": "function", "start": 0, "end": 4}, {"kind": "block", "start": 2, "end": 3}]
    assert blocks.blocks_of("def (") == [] == blocks.blocks_of(None)


def test_streaming_ingest(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(i, source(20 + i % 3)) for i in range(6)], "k long, t string")
    docs.write.parquet(folder)
    made = stream_spans(spark, folder, docs.schema, "k", "t")
    for _ in range(2):
        ingest(made, out, str(tmp_path / "state")).awaitTermination()
        docs.write.mode("append").parquet(folder)
    want = {r.text for r in spans(docs, "k", "t").collect()}
    got = [r.text for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_streaming_with_bounded_state(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(i, source(20 + i % 3)) for i in range(6)], "k long, t string")
    docs.write.parquet(folder)
    made = stream_spans(spark, folder, docs.schema, "k", "t", within="1 day")
    for _ in range(2):
        ingest(made, out, str(tmp_path / "state")).awaitTermination()
        docs.write.mode("append").parquet(folder)
    got = [r.text for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == {r.text for r in spans(docs, "k", "t").collect()}
