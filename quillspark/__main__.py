"""python -m quillspark: build an infill corpus from source folders."""

import argparse
import json

from pyspark.sql import SparkSession

from quillspark.operators.dataset import build_dataset


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    # The flags and their defaults.
    p.add_argument("--source-dirs", nargs="+", default=["src"])
    p.add_argument("--output", default="data/fim_dataset.jsonl")
    p.add_argument("--max-files", type=int, default=5000)
    p.add_argument("--samples-per-file", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(args)
    counters = build_dataset(SparkSession.builder.getOrCreate(), a.source_dirs, a.output, a.max_files, a.samples_per_file, a.seed)
    print(json.dumps(counters))
    return counters


if __name__ == "__main__":
    main()
