"""Registration: matched targets, similarity from moments, iterative closest points, RANSAC."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError
from . import nn
from .transforms import Similarity


def match_by_id(source: DataFrame, target: DataFrame, least: int = 3) -> DataFrame:
    """Common ids with ``sx..sz`` and ``tx..tz``; three at least."""
    a = source.select("id", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    b = target.select("id", *[F.col(c).alias(f"t{c}") for c in "xyz"])
    both = a.join(b, "id")
    if both.limit(least).count() < least:
        raise ContractError(f"fewer than {least} common ids")
    return both


def moments(pairs: DataFrame, keys: Sequence[str] = (), weight: str | None = None, pivot=None) -> DataFrame:
    """Weighted sums from which a similarity follows, about pivots so that large offsets lose no digits."""
    ps, pt = pivot or ((0.0,) * 3, (0.0,) * 3)
    w = F.col(weight) if weight else F.lit(1.0)
    s = {c: F.col(f"s{c}") - float(p) for c, p in zip("xyz", ps, strict=True)}
    t = {c: F.col(f"t{c}") - float(p) for c, p in zip("xyz", pt, strict=True)}
    return pairs.groupBy(*keys).agg(
        F.sum(w).alias("w"),
        *[F.sum(w * s[c]).alias(f"s{c}") for c in "xyz"],
        *[F.sum(w * t[c]).alias(f"t{c}") for c in "xyz"],
        *[F.sum(w * t[a] * s[b]).alias(f"t{a}s{b}") for a in "xyz" for b in "xyz"],
        F.sum(w * sum(s[c] * s[c] for c in "xyz")).alias("ss"),
    )


def similarity_from(row, pivot=None, with_scale: bool = True) -> Similarity:
    """Least-squares similarity of a row of :func:`moments`; reflections are turned into rotations."""
    ps, pt = (np.array(p, dtype=float) for p in (pivot or ((0.0,) * 3, (0.0,) * 3)))
    w = row["w"]
    ms = np.array([row[f"s{c}"] for c in "xyz"]) / w
    mt = np.array([row[f"t{c}"] for c in "xyz"]) / w
    cov = np.array([[row[f"t{a}s{b}"] for b in "xyz"] for a in "xyz"]) / w - np.outer(mt, ms)
    spread = row["ss"] / w - ms @ ms
    if spread <= 0:
        raise ContractError("all points are one")
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[2] = -1
    r = u @ np.diag(sign) @ vt
    scale = float((d * sign).sum() / spread) if with_scale else 1.0
    return Similarity(r, (mt + pt) - scale * r @ (ms + ps), scale)


def fit_similarity(pairs: DataFrame, weight: str | None = None, with_scale: bool = True) -> Similarity:
    first = pairs.first()
    if first is None:
        raise ContractError("no pairs")
    pivot = tuple(tuple(first[f"{k}{c}"] for c in "xyz") for k in "st")
    return similarity_from(moments(pairs, weight=weight, pivot=pivot).first(), pivot, with_scale)


def ransac(pairs: DataFrame, threshold: float = 0.1, trials: int = 200, seed: int = 0, most: int = 10_000) -> tuple[Similarity, list, bool]:
    """(similarity, inlier ids, fell back): the sample of three with most inliers, refitted on them.

    Targets are few (counted); trials run on the driver. Four pairs or fewer are fitted as they are.
    """
    rows = pairs.orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"over {most} targets")
    s = np.array([[r[f"s{c}"] for c in "xyz"] for r in rows])
    t = np.array([[r[f"t{c}"] for c in "xyz"] for r in rows])

    def fitted(pick) -> Similarity:
        a, b = s[pick], t[pick]
        ma, mb = a.mean(0), b.mean(0)
        u, d, vt = np.linalg.svd((b - mb).T @ (a - ma) / len(a))
        sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
        r = u @ np.diag(sign) @ vt
        scale = (d * sign).sum() / max(((a - ma) ** 2).sum(1).mean(), 1e-300)
        return Similarity(r, mb - scale * r @ ma, scale)

    def errors(m: Similarity) -> np.ndarray:
        return np.linalg.norm(m.scale * s @ m.r.T + m.t - t, axis=1)

    everything = np.arange(len(rows))
    if len(rows) <= 4:
        return fitted(everything), [r["id"] for r in rows], False
    rng, best = np.random.default_rng(seed), None
    for _ in range(trials):
        pick = rng.choice(len(rows), 3, replace=False)
        try:
            good = errors(fitted(pick)) < threshold
        except (np.linalg.LinAlgError, ValueError):
            continue
        if best is None or good.sum() > best.sum():
            best = good
    if best is None or best.sum() < 3:
        return fitted(everything), [r["id"] for r in rows], True
    return fitted(np.flatnonzero(best)), [r["id"] for r, ok in zip(rows, best, strict=True) if ok], False


def icp(
    source: DataFrame,
    target: DataFrame,
    bound: float,
    rounds: int = 30,
    trim: float = 1.0,
    tolerance: float = 1e-6,
) -> tuple[Similarity, list[tuple[int, int, float]]]:
    """(rigid transform, history of (round, pairs, rmse)): point-to-point ICP over a bounded join.

    One join and two aggregations each round; the points keep their lineage short because only the transform,
    literals in the plan, changes between rounds.
    """
    current, history, last = Similarity(), [], None
    columns = source.select("id", "x", "y", "z")
    reference = target.select("id", "x", "y", "z")
    for k in range(rounds):
        moved = columns.select("id", *[c.alias(n) for c, n in zip(current.apply(tuple(F.col(c) for c in "xyz")), "xyz", strict=True)])
        found = nn.nearest(moved, reference, bound).filter(F.col("ref_id").isNotNull())
        pairs = (
            found.join(moved, "id")
            .select("distance", *[F.col(c).alias(f"s{c}") for c in "xyz"], "ref_id")
            .join(reference.select(F.col("id").alias("ref_id"), *[F.col(c).alias(f"t{c}") for c in "xyz"]), "ref_id")
        )
        if trim < 1.0:
            n = pairs.count()
            keep = max(3, int(n * trim))
            pairs = pairs.orderBy("distance", "ref_id").limit(keep)
        state = pairs.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("distance") ** 2)).alias("rmse")).first()
        if not state.n or state.n < 3:
            raise ContractError("fewer than three pairs within the bound")
        history.append((k, state.n, state.rmse))
        if last is not None and abs(last - state.rmse) < tolerance:
            break
        last = state.rmse
        current = fit_similarity(pairs, with_scale=False) @ current
    return current, history
