"""Vectors of a table as numpy blocks, and the query side in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries that are held on the driver and sent to the executors at once.
QUERY_CHUNK = 8192


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, without a Python worker."""
    columns = [f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in schema.split(", "))]
    return spark.range(0).selectExpr(*columns)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the rows with an id and a vector without null or non-finite components."""
    limit = float("inf")
    return df.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(limit)))
    )


def blocks(batch, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vector in an Arrow batch of ``vec_id, v``."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    lists = batch.column("v")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        mine = np.flatnonzero(lengths == length)
        for i in range(0, len(mine), rows):
            some = mine[i : i + rows]
            yield ids[some], flat[starts[some][:, None] + np.arange(length)].reshape(len(some), length)


def query_chunks(queries: DataFrame, chunk: int = QUERY_CHUNK) -> Iterator[list[tuple]]:
    """The queries ``vec_id, v`` by chunks of ids, each grouped as (ids, matrix) by length.

    Rows that repeat an id count as one query, by the least vector.
    """
    n = queries.count()
    pieces = max(1, -(-n // chunk))
    for piece in range(pieces):
        rows = (
            queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == piece)
            .groupBy("vec_id")
            .agg(F.min("v").alias("v"))
            .orderBy("vec_id")
            .collect()
        )
        by_length: dict[int, list] = {}
        for r in rows:
            by_length.setdefault(len(r.v), []).append(r)
        if rows:
            yield [
                (
                    np.array([r.vec_id for r in group], dtype=np.int64),
                    np.array([r.v for r in group], dtype=np.float64).reshape(len(group), length),
                )
                for length, group in sorted(by_length.items())
            ]


def distinct(q: np.ndarray, ids: np.ndarray, scores: np.ndarray):
    """One entry of each (q, id): that of the highest score."""
    order = np.lexsort((-scores, ids, q))
    q, ids, scores = q[order], ids[order], scores[order]
    keep = np.ones(len(q), dtype=bool)
    keep[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    return q[keep], ids[keep], scores[keep]


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k entries of highest score of each q, ties to smaller ids."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
    keep = rank < k
    return q[keep], ids[keep], scores[keep]
