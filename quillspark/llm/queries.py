"""The registered queries of this subpackage and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, langid, packing, quality, sharding, simhash, spotsigs, tokenfile, urlfilter, warc
from quillspark.llm.common import scratch_path, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards; every value comes from the files read back."""
    return sharding.write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))


def shards_64k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment alone, with a limit that splits even the smallest tables."""
    return sharding.assign(table(spark, sf_dir, "documents"), 64 << 10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.chained(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    directory = warc.write_archives(pages, scratch_path(spark, "archives"))
    return warc.read_archives(directory, pages.schema["page_id"].dataType)


def warc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index at work: the URLs of every page whose id is divisible by 20, searched in archives of all pages."""
    pages = table(spark, sf_dir, "pages")
    directory = warc.write_archives(pages, scratch_path(spark, "archives"))
    found = warc.lookup(directory, pages.where("page_id % 20 = 0"), pages.schema["page_id"].dataType)
    return found.select("page_id", "payload_bytes", "record_type", "refers_to")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scratch_path(spark, "token-files")
    manifest = tokenfile.write_token_files(docs, out, public_tokenizers.path(WORD_BPE), end_id=2)
    return tokenfile.read_token_files(manifest, docs.schema["doc_id"].dataType)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_quality": op2_quality,
        "op3_language": op3_language,
        "op4_simhash": op4_simhash,
        "op5_sharding": op5_sharding,
        "op6_packing": op6_packing,
        "op7_spotsigs": op7_spotsigs,
        "op8_warc": op8_warc,
        "op9_token_files": op9_token_files,
        "op10_url_filter": op10_url_filter,
        "shards_64k": shards_64k,
        "warc_lookup": warc_lookup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality": quality.oracle(),
        "op5_sharding": sharding.oracle(),
        "op7_spotsigs": spotsigs.oracle(),
        "op8_warc": warc.oracle(),
        "op10_url_filter": urlfilter.oracle(),
        "shards_64k": sharding.oracle(64 << 10),
        "warc_lookup": warc.lookup_oracle(),
    }
