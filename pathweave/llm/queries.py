"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracles import HOST_RULES, NEAR_DUPLICATES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_count

    return token_count.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ogg

    return ogg.stored_features(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(_table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("row_hash")


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_html_text, op3_token_count, op4_kd_shards, op5_ogg, op6_line_dedup, op7_byte_bpe, op8_host_rules, op9_langid, op10_near_duplicates)
}

#: The others have no SQL (hashes, models, containers, parsers) and are tested against slow versions in tests/llm.
ORACLES: dict[str, str] = {"op8_host_rules": " ".join(HOST_RULES.split()), "op10_near_duplicates": " ".join(NEAR_DUPLICATES.split())}
