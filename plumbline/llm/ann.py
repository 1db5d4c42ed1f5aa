"""Approximate nearest neighbours by cosine: inverted lists with an adaptive scan of dimensions.

Index. Lists are the cells of centroids that are fitted on a bounded sample (``SAMPLE`` rows,
those of least hash); every row is put into its list, and lists are dealt out in blocks of
about ``BLOCK`` rows, so a list that holds much of the table is spread over many tasks. How many
lists a query probes is set by brute force on a quarter of the sample that no centroid is fitted on, so that the share of true neighbours
in probed lists reaches ``recall``.

Search. Vectors are scaled to length one and turned by a random rotation, after which any few
columns tell about the whole distance. Within each probed list a task adds up partial squared
distances block of columns by block of columns. After d of D columns, a hypothesis test
abandons every candidate whose partial distance times D / d is over the query's k-th best distance so far
times (1 + ``epsilon`` / sqrt(d))^2. Those that are left get their cosine from the original vectors
in double precision. First bounds come from a part of the sample, whose nearest rows are candidates in
any case, so that no query is left with fewer than k while the table has them.

Queries go through in chunks of bounded size; a task sends k entries for each query at most.

Defined results: rows with a null id, vectors that are null, all zero, or hold null or
non-finite components take no part; a query meets only vectors of its own length; an id that repeats is
one query (its least vector), never its own candidate, and a candidate once, by its best score; ties go to smaller ids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, in_arrow
from .vectors import QUERY_CHUNK, best, blocks, distinct, empty, query_chunks, usable

SAMPLE = 8192
LISTS = 2048
BLOCK = 1024
COLUMNS = 16
QUERIES = 512
SCHEMA = "query_id long, vec_id long, score double"


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so nothing overflows."""
    top = np.abs(matrix).max(axis=1, keepdims=True)
    scaled = matrix / top
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def lists_to_probe(
    sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 256
) -> int:
    """The least number of lists that hold ``recall`` of the sample's true neighbours."""
    some = sample[:queries]
    near = some @ sample.T
    near[np.arange(len(some)), np.arange(len(some))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(-(some @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[top], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            for ids, matrix in blocks(batch, 4096):
                nearest = (unit(matrix) @ centroids.T).argmax(axis=1)
                flat = pa.array(matrix.ravel())
                offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nearest.astype(np.int32)),
                        pa.array(ids),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    names=["list", "vec_id", "v"],
                )

    return run


def _scan(index: dict, k: int, epsilon: float):
    """Searches the queries in the blocks of a partition, list after list."""

    def run(batches):
        query_ids, original, turned = index["ids"], index["queries"], index["turned"]
        norms = np.linalg.norm(original, axis=1)
        bound = index["bound"].copy()
        dim = turned.shape[1]
        parts = [slice(i, min(i + COLUMNS, dim)) for i in range(0, dim, COLUMNS)]
        kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for batch in batches:
            lists = batch.column("list").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(lists[1:] != lists[:-1]) + 1
            found = [kept]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lists)], strict=True):
                probing = index["by_list"].get(int(lists[a])) if b > a else None
                if probing is None:
                    continue
                for ids, matrix in blocks(batch.slice(a, b - a), BLOCK):
                    x = unit(matrix) @ index["rotation"]
                    for i in range(0, len(probing), QUERIES):
                        mine = probing[i : i + QUERIES]
                        r, c = _survivors(x, turned[mine], bound[mine], parts, epsilon)
                        c = mine[c]
                        other = ids[r] != query_ids[c]
                        r, c = r[other], c[other]
                        dots = np.einsum("ij,ij->i", matrix[r], original[c])
                        scores = dots / (np.linalg.norm(matrix[r], axis=1) * norms[c])
                        found.append((c, ids[r], scores))
            kept = best(*distinct(*(np.concatenate(p) for p in zip(*found, strict=True))), k)
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(bound)) == k)
            worst = np.full(len(bound), np.inf)
            np.minimum.at(worst, kept[0], kept[2])
            bound[full] = np.minimum(bound[full], 2 - 2 * worst[full])
        yield pa.RecordBatch.from_arrays(
            [pa.array(query_ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])],
            names=["query_id", "vec_id", "score"],
        )

    return run


def _survivors(x, q, bound, parts, epsilon):
    """Pairs (row, query) that no test abandons."""
    dim = x.shape[1]
    r = c = total = None
    done = 0
    for part in parts:
        if r is None:
            xs, qs = x[:, part], q[:, part]
            near = (xs**2).sum(1)[:, None] + (qs**2).sum(1)[None, :] - 2 * (xs @ qs.T)
        else:
            near = total + ((x[r, part] - q[c, part]) ** 2).sum(1)
        done += part.stop - part.start
        slack = (1 + epsilon / np.sqrt(done)) ** 2 if done < dim else 1 + 1e-9
        allowed = bound * (slack * done / dim) + 1e-12
        if r is None:
            r, c = np.nonzero(near <= allowed[None, :])
            total = near[r, c]
        else:
            stays = near <= allowed[c]
            r, c, total = r[stays], c[stays], near[stays]
    return r, c


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    recall: float = 0.98,
    epsilon: float = 2.1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    lists: int = LISTS,
    chunk: int = QUERY_CHUNK,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query."""
    spark = df.sparkSession
    nonzero = F.exists("v", lambda x: x != 0)
    rows = usable(df, id_col, vector_col).filter(nonzero)
    asked = usable(queries, id_col, vector_col).filter(nonzero)
    out = empty(spark, "query_id long, rank int, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for length, n in rows.groupBy(F.size("v").alias("n")).count().collect():
        own = rows.filter(F.size("v") == length)
        drawn = own.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).collect()
        ids = np.array([r.vec_id for r in drawn], dtype=np.int64)
        raw = np.array([r.v for r in drawn], dtype=np.float64)
        base = unit(raw)
        once = base[np.r_[True, ids[1:] != ids[:-1]]]  # rows that repeat an id are neighbours
        fitted = len(once) - len(once) // 4
        centroids = fit_centroids(once[:fitted], max(1, min(int(n**0.5), lists, fitted)), seed)
        probes = lists_to_probe(once[fitted:], centroids, k, recall)
        listed = in_arrow(own, _assign(centroids), "list int, vec_id long, v array<double>")
        listed = checkpointed(listed)
        sizes = dict(listed.groupBy("list").count().collect())
        split = F.create_map(*[F.lit(x) for i, m in sizes.items() for x in (i, -(-m // BLOCK))])
        salt = F.pmod(F.xxhash64("vec_id"), F.element_at(split, F.col("list")))
        dealt = checkpointed(
            listed.withColumn("part", salt)
            .repartition("list", "part")
            .sortWithinPartitions("list", "part", "vec_id")
            .select("list", "vec_id", "v")
        )
        turn = rotation(length, seed)
        for piece in query_chunks(asked.filter(F.size("v") == length), chunk):
            for query_ids, matrix in piece:
                q = unit(matrix)
                order = np.argsort(-(q @ centroids.T), axis=1)[:, :probes]
                by_list: dict[int, list[int]] = {}
                for i, row in enumerate(order.tolist()):
                    for cell in row:
                        by_list.setdefault(cell, []).append(i)
                bound, first = _first_bound(q, matrix, query_ids, base, raw, ids, k)
                index = {
                    "ids": query_ids,
                    "queries": matrix,
                    "turned": q @ turn,
                    "rotation": turn,
                    "bound": bound,
                    "by_list": {cell: np.array(rows_) for cell, rows_ in by_list.items()},
                }
                entries = in_arrow(dealt, _scan(index, k, epsilon), SCHEMA)
                entries = entries.unionByName(spark.createDataFrame(first))
                entries = entries.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                ranked = entries.withColumn("rank", F.row_number().over(by_score))
                ranked = ranked.filter(F.col("rank") <= k)
                out = out.unionByName(
                    ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
                )
    return out


def _best_copies(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of the rows (columns of ``near``) that repeat an id, neighbours of each other, only the nearest
    one is left to each query; the others are at minus infinity."""
    new = np.r_[True, ids[1:] != ids[:-1]]
    if new.all():
        return near
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    top = near == np.maximum.reduceat(near, starts, axis=1)[:, group]
    seen = np.cumsum(top, axis=1)
    before = seen[:, starts] - top[:, starts]
    return np.where(top & (seen - before[:, group] == 1), near, -np.inf)


def _first_bound(q, matrix, query_ids, base, raw, ids, k: int, most: int = 2048):
    """The squared distance of each query's k-th nearest in a part of the sample, which the k-th
    nearest of all rows can't exceed; and these neighbours with their scores."""
    bound = np.full(len(q), 4.0)
    base, raw, ids = base[:most], raw[:most], ids[:most]
    entries = []
    for i in range(0, len(q), QUERIES):
        near = q[i : i + QUERIES] @ base.T
        near[query_ids[i : i + QUERIES, None] == ids[None, :]] = -np.inf
        near = _best_copies(near, ids)
        top = np.argsort(-near, axis=1, kind="stable")[:, :k]
        if len(ids) >= k:
            kth = np.take_along_axis(near, top[:, k - 1 :], axis=1)[:, 0]
            bound[i : i + QUERIES] = np.where(np.isfinite(kth), 2 - 2 * kth, 4.0)
        c, place = np.nonzero(np.isfinite(np.take_along_axis(near, top, axis=1)))
        r = top[c, place]
        x, y = raw[r], matrix[i + c]
        scores = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        entries.append((query_ids[i + c], ids[r], scores))
    columns = [np.concatenate(x) for x in zip(*entries, strict=True)]
    return bound, pa.table(columns, names=["query_id", "vec_id", "score"])
