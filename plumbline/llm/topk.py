"""Exact top-k inner products by a three-phase uniform threshold.

The score of a candidate is the sum of its partial scores over ``parts`` blocks of columns.

1. Every task gathers, for each query, a local list: it forms the partial scores of the leading block only
   (the one in which the queries are longest), and scores the rows that lead there in full. The k-th best
   score over all lists is a cutoff that the true k-th best can't be below.
2. The cutoffs are broadcast (one number for each query of a chunk). Their share cutoff / parts is the uniform
   threshold: only rows that, by the lengths of the blocks alone, can reach it in some block are looked at.
   Block by block, in single precision, entries are collected: a pair is dropped as soon as its partial
   scores, the lengths of the blocks that are left and the rounding can't reach the cutoff.
3. Only for the pairs that are left the integer scores are formed exactly; of those at the cutoff or
   over it the k best are the result.

Queries go through in chunks of bounded size against all rows, so what is broadcast doesn't
grow with the table, and a task sends at most k entries for each query: of those beyond none
can be among the k best. Components become floor(scale * x); sums are exact in double precision
below 2^53 and are otherwise done in Python integers.

Defined results: rows with a null id, and vectors that are null or hold null or non-finite
components, take no part; a query meets only vectors of its own length; an id that
repeats is one query (its least vector) and never its own candidate, but as a candidate each of its rows
counts; ties go to smaller ids; a component that scaled leaves the range of doubles is scaled as an
integer, and scores beyond a long are held at its ends; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_arrow
from .vectors import QUERY_CHUNK, best, blocks, empty, query_chunks, usable

ROWS, QUERIES, PARTS = 2048, 512, 4
#: Rows of a block that are looked at for a query's local list.
LEADERS = 32
#: Pairs whose exact scores are formed at once.
PAIRS = 1 << 18
SCHEMA = "query_id long, vec_id long, score long"


def quantised(matrix: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); infinite where that leaves the range of doubles."""
    with np.errstate(over="ignore"):
        return np.floor(matrix * scale)


def _integers(row: np.ndarray, raw: np.ndarray, scale: float) -> list[int]:
    return [int(y) if np.isfinite(y) else int(x) * int(scale) for y, x in zip(row.tolist(), raw.tolist(), strict=True)]


def exact_scores(x, raw_x, q, raw_q, r: np.ndarray, c: np.ndarray, scale: float) -> np.ndarray:
    """Integer inner products of rows ``r`` of x with rows ``c`` of q, held at the ends of a long."""
    if not len(r):
        return np.zeros(0, dtype=np.int64)
    bound = np.abs(x[r]).max(axis=1, initial=0.0) * np.abs(q[c]).max(axis=1, initial=0.0) * x.shape[1]
    out = np.zeros(len(r), dtype=np.int64)
    small = bound < 2**53
    for i in range(0, len(r), PAIRS):
        some = np.flatnonzero(small[i : i + PAIRS]) + i
        out[some] = np.einsum("ij,ij->i", x[r[some]], q[c[some]]).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    for i in np.flatnonzero(~small).tolist():
        one, other = _integers(x[r[i]], raw_x[r[i]], scale), _integers(q[c[i]], raw_q[c[i]], scale)
        out[i] = min(max(sum(a * b for a, b in zip(one, other, strict=True)), low), high)
    return out


class Side:
    """Rows of one side: quantised, and in single precision with the lengths of their blocks of columns."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, scale: float, columns: list[slice]):
        self.ids, self.raw, self.columns = ids, raw, columns
        self.whole = quantised(raw, scale)
        self.huge = ~np.isfinite(self.whole).all(axis=1)
        top = np.abs(self.whole).max(axis=1, initial=0.0)
        top = np.where(self.huge | (top == 0), 1.0, top)
        shape = np.where(self.huge[:, None], 0.0, self.whole) / top[:, None]
        size = np.sqrt((shape**2).sum(axis=1))
        self.size = top * np.where(size > 0, size, 1.0)
        unit = shape / np.where(size > 0, size, 1.0)[:, None]
        self.unit = unit.astype(np.float32)
        self.lengths = np.stack([np.sqrt((unit[:, c] ** 2).sum(axis=1)) for c in columns], axis=1)

    def slice(self, a: int, b: int) -> Side:
        out = object.__new__(Side)
        out.columns = self.columns
        for name in ("ids", "raw", "whole", "huge", "size", "unit", "lengths"):
            setattr(out, name, getattr(self, name)[a:b])
        return out


def _columns(length: int, parts: int) -> list[slice]:
    edges = np.linspace(0, length, parts + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def leaders(x: Side, q: Side, k: int, scale: float):
    """(query, id, score) of the k best of the rows that lead in the queries' longest block of columns."""
    block = x.columns[int(q.lengths.sum(axis=0).argmax())]
    size = np.minimum(x.size, 1e30).astype(np.float32)
    partial = (x.unit[:, block] @ q.unit[:, block].T) * size[:, None]
    n = min(LEADERS, len(x.ids))
    r = np.argpartition(-partial, n - 1, axis=0)[:n]
    total = np.einsum("nqd,qd->nq", x.unit[r], q.unit) * size[r]
    n = min(k + 1, n)  # one more, for the query's own row
    best_of = np.argpartition(-total, n - 1, axis=0)[:n]
    r, c = np.take_along_axis(r, best_of, axis=0).ravel(), np.tile(np.arange(len(q.ids)), n)
    other = x.ids[r] != q.ids[c]
    r, c = r[other], c[other]
    return q.ids[c], x.ids[r], exact_scores(x.whole, x.raw, q.whole, q.raw, r, c, scale)


def reaching(x: Side, q: Side, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, query) whose score may reach the query's cutoff."""
    parts, dim = len(x.columns), x.unit.shape[1]
    cut = np.where(cut > -(2.0**63), cut, -np.inf)  # all lower scores are held there too
    with np.errstate(over="ignore", invalid="ignore"):
        wanted = cut[None, :] / (x.size[:, None] * q.size[None, :])  # of vectors of length one
    wanted = np.where(np.isnan(wanted), -np.inf, wanted)
    slack = (dim + 8) * 2.0**-23
    always = x.huge[:, None] | q.huge[None, :]
    lengths = [x.lengths[:, [p]] * q.lengths[None, :, p] for p in range(parts)]
    alive = np.maximum.reduce(lengths) >= wanted / parts - slack  # the uniform threshold
    if not (alive | always).any():
        return np.nonzero(always)
    order = np.argsort(-q.lengths.sum(axis=0), kind="stable").tolist()
    left = sum(lengths)
    total = np.zeros(alive.shape, dtype=np.float32)
    r = c = None
    for p in order:
        block = x.columns[p]
        if r is None:
            total += x.unit[:, block] @ q.unit[:, block].T
            left = left - lengths[p]
            alive &= total + left >= wanted - slack
            if alive.sum() * 8 < alive.size:  # few are left: pair by pair from here on
                r, c = np.nonzero(alive)
                total, left = total[r, c], left[r, c]
        else:
            total = total + np.einsum("ij,ij->i", x.unit[r, block], q.unit[c, block])
            left = left - lengths[p][r, c]
            stays = total + left >= wanted[r, c] - slack
            r, c, total, left = r[stays], c[stays], total[stays], left[stays]
    if r is None:
        return np.nonzero(alive | always)
    if always.any():
        more = always.copy()
        more[r, c] = True
        return np.nonzero(more)
    return r, c


def _sides(batch, chunk, scale, parts):
    """Blocks of rows with the blocks of queries of the same length."""
    for ids, matrix in blocks(batch, ROWS):
        x = None
        for query_ids, queries in chunk:
            if queries.shape[1] == matrix.shape[1]:
                columns = _columns(matrix.shape[1], parts)
                x = x or Side(ids, matrix, scale, columns)
                for i in range(0, len(query_ids), QUERIES):
                    yield x, Side(query_ids[i : i + QUERIES], queries[i : i + QUERIES], scale, columns)


def _emit(parts, k):
    if not parts:
        return None
    q, ids, scores = (np.concatenate(c) for c in zip(*parts, strict=True))
    q, ids, scores = best(q, ids, scores, k)
    return [(q, ids, scores)]


def _batch(parts):
    q, ids, scores = parts[0] if parts else (np.zeros(0, dtype=np.int64),) * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(q), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"]
    )


def _local_lists(chunk, k: int, scale: float, parts: int):
    def run(batches):
        kept = None
        for batch in batches:
            found = list(kept or [])
            found += [leaders(x, q, k, scale) for x, q in _sides(batch, chunk, scale, parts)]
            kept = _emit(found, k)
        yield _batch(kept)

    return run


def _above_cutoff(chunk, cutoffs: dict[int, int], k: int, scale: float, parts: int):
    def run(batches):
        kept, own = None, dict(cutoffs)
        for batch in batches:
            found = list(kept or [])
            for x, q in _sides(batch, chunk, scale, parts):
                cut = np.array([own.get(i, -(1 << 63)) for i in q.ids.tolist()])
                r, c = reaching(x, q, cut.astype(np.float64))
                other = x.ids[r] != q.ids[c]
                r, c = r[other], c[other]
                scores = exact_scores(x.whole, x.raw, q.whole, q.raw, r, c, scale)
                enough = scores >= cut[c]
                found.append((q.ids[c[enough]], x.ids[r[enough]], scores[enough]))
                if len(found) > 16:
                    found = _emit(found, k)
                    _raise(own, found, k)
            kept = _emit(found, k)
            _raise(own, kept, k)
        yield _batch(kept)

    return run


def _raise(cutoffs: dict[int, int], kept, k: int) -> None:
    """A task that has k entries for a query needs no lower ones of it."""
    if kept:
        q, _, scores = kept[0]
        last = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.zeros(0, dtype=np.int64)
        full = last[np.diff(np.r_[-1, last]) == k]
        for i, score in zip(q[full].tolist(), scores[full].tolist(), strict=True):
            cutoffs[i] = max(score, cutoffs.get(i, score))


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    parts: int = PARTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    chunk: int = QUERY_CHUNK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of highest score for each query."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    out = empty(spark, "query_id long, rank int, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for piece in query_chunks(usable(queries, id_col, vector_col), chunk):
        lists = in_arrow(rows, _local_lists(piece, k, scale, parts), SCHEMA)
        ranked = lists.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k)
        cutoffs = {r.query_id: r.score for r in ranked.select("query_id", "score").collect()}
        entries = in_arrow(rows, _above_cutoff(piece, cutoffs, k, scale, parts), SCHEMA)
        ranked = entries.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        out = out.unionByName(ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
    return out


TOP_K_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
