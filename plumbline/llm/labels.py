"""A bounded sample of labelled documents to fit classifiers on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text of each class that a sample may bring to the driver.
SAMPLE_BYTES = 64 << 20


def labelled_sample(
    df: DataFrame,
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    each: int = 2500,
    most_bytes: int = SAMPLE_BYTES,
    where: Column | None = None,
) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of a bounded sample of labelled documents, and the share of label 1.

    Drawn are the labelled documents of least id hash, of each class up to ``each`` and as many as
    ``most_bytes`` bytes of text hold (one at least); texts are taken whole. Labels whose
    document is missing or has no text are not drawn. The share is that of all labelled ids (1 if there
    is none). ``where``: condition on the column ``doc_id`` of the labels.
    """
    marks = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("mark"))
        .filter(F.col("doc_id").isNotNull() & F.col("mark").isNotNull())
    )
    if where is not None:
        marks = marks.filter(where)
    marks = marks.groupBy("doc_id").agg(F.max(F.col("mark").cast("int")).alias("mark"))
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    total = sum(counts.values())
    if not total:
        return [], np.zeros(0), 1.0
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
    sizes = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("size"))
    known = marks.join(sizes, "doc_id")
    drawn: dict[int, int] = {}
    for mark in (0, 1):
        rows = known.filter(F.col("mark") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each)
        held = 0
        for place, r in enumerate(rows.collect()):
            held += r["size"]
            if place and held > most_bytes:
                break
            drawn[r.doc_id] = mark
    # from Arrow, so that no Python worker is started to make the rows
    ids = df.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(list(drawn), pa.int64())}))
    found = (
        texts.join(F.broadcast(ids), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    found.sort(key=lambda r: r.doc_id)
    marked = np.array([drawn[r.doc_id] for r in found], dtype=np.int64)
    return [r.text for r in found], marked, counts.get(1, 0) / total
