"""Toxicity by a linear classifier over character n-grams with naive Bayes log-count ratios.

The classifier (see :mod:`ngrams`) is fitted on a bounded sample of labelled rows
(``SAMPLE`` of each class) whose id hash is not held out, and scores every whole text. Nothing but
the text enters a score.

Defined results: a null or empty text is scored like any other, from the bias alone; texts are
taken whole; repeated rows are scored row by row; a null id is not held out; a null label
is no label, and of repeated labels the highest holds; without labels no text is toxic (score near 0);
with labels of one class all scores are near that class; an empty table gives an empty result; input
columns named like an output column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams
from .common import give_back, in_arrow, slices, text_bytes, without
from .labels import labelled_sample

SAMPLE = 2500
FOLDS = 5
OUT = ["held_out", "score", "predicted"]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % FOLDS == 0, F.lit(False))


def fit_toxicity(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> ngrams.Model:
    texts, marks, share = labelled_sample(
        df, labels, label_col, id_col, text_col, sample, where=~held_out("doc_id")
    )
    if not len(marks):
        return ngrams.constant(0.0)
    model = ngrams.fit([t.encode("utf-8") for t in texts], marks, share)
    del texts
    give_back()
    return model


def score_texts(
    df: DataFrame, model: ngrams.Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows with ``held_out, score, predicted``."""
    kept = without(df, OUT)
    inner = kept.withColumn("held_out", held_out(id_col))
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*inner.schema.fields, *fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 128):
                data, offsets = text_bytes(part.column(text_col))
                score = ngrams.sigmoid(model.log_odds(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=[*part.schema.names, "score", "predicted"],
                )

    return in_arrow(inner, run, schema)


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Fits on the labels and scores all rows."""
    model = fit_toxicity(df, labels, id_col=id_col, text_col=text_col, **options)
    return score_texts(df, model, id_col, text_col)


def toxicity_digest(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return classify(narrow, labels).select("doc_id", "held_out", "score", "predicted")
