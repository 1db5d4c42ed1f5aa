"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _rank_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_digest

    return shard_digest(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host is the source and path the language: documents have no address."""
    from .quality import OUT, judge

    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge(documents, labels, columns=["doc_id"]).select("doc_id", *OUT)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    return format_conversations(table(spark, sf_dir, "conversations"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), *_rank_file(), cache=2.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .mixing import MIX_SQL
    from .topk import TOP_K_SQL

    return {"op2_exact_topk": TOP_K_SQL, "op7_mixing": MIX_SQL}
