"""From raw documents to an encoded training mix: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a table. All but the last keep the columns of
``docs``, whatever their names; what they decide takes effect: rejected documents and near copies go, and
documents that the mix takes twice are there twice. Texts are taken whole; an empty table stays empty in
every stage. Only ``doc_id``, ``text``, ``source`` and ``lang`` are read, each of which may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, mixing, near_copies, quality, toxicity
from plumbline.llm.common import aside, stored, table

READ = ["doc_id", "text", "source", "lang"]

#: The last stage's digests and the fitted classifiers have no SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    A null, empty or blank text is rejected; null sources and languages are sites of their own; rows that
    repeat are judged one by one, alike; without labels every document with words is kept.
    """
    inner, back = aside(docs, READ)
    return back(quality.judge(inner, table(spark, sf_dir, "labels")).filter("keep"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier keeps.

    A null or empty text is scored from the bias alone; rows that repeat are scored alike; a document
    without an id is scored like any other; without labels every document is kept.
    """
    inner, back = aside(docs, READ)
    return back(toxicity.classify(inner, table(spark, sf_dir, "labels")).filter("predicted = 0"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): that of the least id.

    Null texts and texts without words are copies of each other; a null id stays only where its group has
    no other; of rows that repeat the least id one stays.
    """
    return near_copies.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; documents are repeated as often as they are taken.

    A null or blank text is never taken; null sources are one source, last in order; of equal rows as many are
    taken as fit.
    """
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of the mix; a null text counts as empty."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, cache=0.5)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("simhash_dedup", one_of_each),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between two stages the rows are stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs)
    return docs
