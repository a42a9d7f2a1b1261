"""The corpus pipeline: quality rules, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as
Parquet to the shared folder and gives it to the next. In every stage but the last, columns stay as they are, whatever
their names, and an empty table stays empty. Repeated rows are judged each by the first two stages; the third keeps one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import langid, packing, quality, simhash
from quillspark.llm.common import discard, materialize, table
from quillspark.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of being good is at least one half; null, empty and short texts go, null ids stay."""
    ship(spark)
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; the network learns from what this stage is given.

    Null and empty texts and those without a letter go; without any labelled text, all others stay.
    """
    ship(spark)
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null ids last.

    Fingerprints link at three bits, as in the registered query. Null and empty texts are copies of each other.
    """
    ship(spark)
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences; null and empty texts hold the end id alone."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality rules", quality_rules), ("language ID", language), ("SimHash near-dedup", near_dedup), ("best-fit packing", pack)]

#: No SQL: a trained network and a tokenizer have none. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
