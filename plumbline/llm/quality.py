"""Quality by hierarchical empirical Bayes over hosts and paths.

Document evidence is the probability of a logistic regression over shape statistics of the whole text
(letter case, symbols, repeated words and lines, word lengths), fitted on a bounded sample of
labelled rows. Sites add what their other documents say: grouped aggregation gives the sum and number of
probabilities for each host and each path of a host; a path's mean is shrunk to its host's, a host's to
the mean of all, by the ratio of the variance within to the variance between that the data show. A
site with few documents therefore says little, and a document never counts as evidence for
itself. The log-odds of the site over the global log-odds are added to the document's.

Sites meet in grouped sums that are combined before the shuffle, so a host with a third of all rows
is one row for each task.

Defined results: a text without words (null, blank) gets the lowest probability, whatever its site; texts are taken whole; null hosts and paths are sites
of their own; repeated rows are scored row by row; a null label is no label, and of repeated labels
the highest holds; without labels of both classes all documents with words get the share of label 1
(1 without labels); an empty table gives an empty result; input columns named like an output column
are replaced by it, and all others are kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, give_back, in_arrow, joined, slices, stored, without
from .labels import labelled_sample

#: Labelled documents of each class that the classifier is fitted on at most.
SAMPLE = 2500
THRESHOLD = 0.5
LOWEST = 1e-4
OUT = ["evidence", "host_mean", "site_mean", "quality_score", "keep"]

_PLAIN = frozenset(b" \t\n\r\x0b\x0c.,'-:;?\"()")
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _PLAIN and not chr(b).isalnum())
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def shape(text: str) -> list[float] | None:
    """Statistics of a text; None if it has no words."""
    words = text.split()
    if not words:
        return None
    data = text.encode("utf-8")
    n, size = len(words), len(data)
    again = sum([a == b for a, b in zip(words, words[1:], strict=False)])
    lines = [line for line in text.split("\n") if line]
    letters = sum(map(str.isalpha, text)) / len(text)
    capital = sum(map(str.isupper, words))
    symbols = size - len(data.translate(None, _SYMBOLS))
    return [
        capital / n,
        (size - len(data.translate(None, _UPPER))) / size,
        min(symbols / size, 0.3),
        min(symbols / n, 3.0),
        np.sqrt(again / n),
        again / n,
        len(set(words)) / n**0.75,
        (size - len(data.translate(None, _DIGITS))) / size,
        min(size / n, 40.0),
        min(data.count(b"|") / n, 1.0),
        min(data.count(b".") / n, 1.0),
        min(data.count(b"!") / n, 3.0),
        1 - len(set(lines)) / max(len(lines), 1),
        min(n / max(len(lines), 1), 200.0),
        letters,
        np.log1p(n),
        float(n < 8),
    ]


class ShapeModel:
    def __init__(self, mean, scale, weights, bias):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def probability(self, texts: list[str | None]) -> np.ndarray:
        rows = [shape(t or "") for t in texts]
        known = [i for i, r in enumerate(rows) if r is not None]
        out = np.full(len(rows), LOWEST)
        if known:
            x = (np.array([rows[i] for i in known]) - self.mean) / self.scale
            z = np.clip(x, -6, 6) @ self.weights + self.bias
            out[known] = np.clip(1 / (1 + np.exp(-np.clip(z, -50, 50))), LOWEST, 1 - LOWEST)
        return out


def fit_shape(texts: list[str], labels: np.ndarray, share: float, penalty: float = 1.0) -> ShapeModel:
    """Logistic regression by Newton steps; ``share`` is that of label 1 outside the sample."""
    rows = [(s, y) for s, y in zip(map(shape, texts), labels, strict=True) if s is not None]
    width = len(shape("a"))
    y = np.array([r[1] for r in rows], dtype=np.float64)
    share = min(max(share, 1e-6), 1 - 1e-6)
    if not len(y) or y.min() == y.max():
        return ShapeModel(np.zeros(width), np.ones(width), np.zeros(width), np.log(share / (1 - share)))
    x = np.array([r[0] for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    x = np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(width, penalty), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w
        )
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    shift = np.log(share / (1 - share)) - np.log(y.sum() / (len(y) - y.sum()))
    return ShapeModel(mean, scale, w[:-1], w[-1] + shift)


def with_evidence(
    df: DataFrame, model: ShapeModel, text_col: str = "text", drop_text: bool = False
) -> DataFrame:
    """Every row with ``evidence``; without the text if ``drop_text``."""
    kept = without(df, ["evidence"])
    names = [c for c in kept.columns if not (drop_text and c == text_col)]
    fields = [kept.schema[c] for c in names]
    schema = T.StructType([*fields, T.StructField("evidence", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = model.probability(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(found, pa.float64())],
                    names=[*names, "evidence"],
                )

    return in_arrow(kept, run, schema)


def site_table(scored: DataFrame) -> tuple[DataFrame, float]:
    """Sums and shrinkage of each ``host, path`` of rows with ``evidence``; the mean of all."""
    paths = checkpointed(
        scored.groupBy("host", "path").agg(
            F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("ss"), F.count("*").alias("n")
        )
    )
    hosts = paths.groupBy(F.col("host").alias("of")).agg(
        F.sum("s").alias("host_s"),
        F.sum("ss").alias("host_ss"),
        F.sum("n").alias("host_n"),
        F.sum(F.col("s") ** 2 / F.col("n")).alias("in_paths"),
        F.sum(F.col("n") ** 2).alias("path_nn"),
        F.count("*").alias("paths"),
    )
    t = hosts.agg(
        *[F.sum(c).alias(c) for c in ("host_s", "host_ss", "host_n", "in_paths", "paths")],
        F.sum(F.col("host_s") ** 2 / F.col("host_n")).alias("in_hosts"),
        F.sum(F.col("host_n") ** 2).alias("host_nn"),
        F.sum(F.col("path_nn") / F.col("host_n")).alias("path_nn"),
        F.count("*").alias("hosts"),
    ).first()
    n = t.host_n or 0
    mean = t.host_s / n if n else 0.5
    within = max((t.host_ss - t.in_paths) / max(n - t.paths, 1), 1e-9) if n else 1.0

    def ratio(between: float, sites: int, spread: float) -> float:
        """Documents that the prior of a site is worth."""
        variance = max(between - sites * within, 0.0) / max(spread, 1e-9)
        return min(within / max(variance, 1e-12), 1e9)

    to_all = to_host = 1e9
    if n:
        to_all = ratio(t.in_hosts - n * mean**2, t.hosts - 1, n - t.host_nn / n)
        to_host = ratio(t.in_paths - t.in_hosts, t.paths - t.hosts, n - t.path_nn)
    table = paths.join(hosts, paths.host.eqNullSafe(hosts.of)).select(
        F.col("host").alias("site_host"),
        F.col("path").alias("site_path"),
        "s",
        "n",
        "host_s",
        "host_n",
        F.lit(float(to_all)).alias("to_all"),
        F.lit(float(to_host)).alias("to_host"),
    )
    return checkpointed(table), float(min(max(mean, LOWEST), 1 - LOWEST))


def judge(
    df: DataFrame,
    labels: DataFrame,
    host_col: str = "source",
    path_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
    columns: list[str] | None = None,
) -> DataFrame:
    """All rows with ``evidence, host_mean, site_mean, quality_score, keep``.

    ``columns``: the input columns of the result (all if not given). The evidence of a row is computed once
    and stored with these columns.
    """
    texts, marks, share = labelled_sample(df, labels, label_col, id_col, text_col, sample)
    model = fit_shape(texts, marks, share)
    del texts
    give_back()
    kept = without(df.select(*[F.col(f"`{c}`") for c in columns or df.columns]), OUT)
    sites = {"site_host_of": host_col, "site_path_of": path_col}
    inner = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(kept.columns)]
    inner += [F.col(f"`{c}`").cast("string").alias(n) for n, c in sites.items()]
    scored = with_evidence(df.select(*inner, F.col(f"`{text_col}`").alias("text")), model, drop_text=True)
    rows = stored(scored)
    table, mean = site_table(
        rows.select(F.col("site_host_of").alias("host"), F.col("site_path_of").alias("path"), "evidence")
    )
    same = F.col("site_host_of").eqNullSafe(F.col("site_host"))
    both = joined(rows, table, same & F.col("site_path_of").eqNullSafe(F.col("site_path")))
    own = F.col("evidence")
    host = (F.col("host_s") - own + F.col("to_all") * mean) / (F.col("host_n") - 1 + F.col("to_all"))
    site = (F.col("s") - own + F.col("to_host") * host) / (F.col("n") - 1 + F.col("to_host"))
    held = lambda x: F.least(F.greatest(x, F.lit(LOWEST)), F.lit(1 - LOWEST))
    odds = lambda x: F.log(x / (1 - x))
    score = 1 / (1 + F.exp(-(odds(held(own)) + odds(held(site)) - odds(F.lit(mean)))))
    score = F.when(own > LOWEST, score).otherwise(F.least(score, F.lit(LOWEST)))  # no site saves it
    return both.select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept.columns)],
        "evidence",
        held(host).alias("host_mean"),
        held(site).alias("site_mean"),
        score.alias("quality_score"),
        (score >= threshold).alias("keep"),
    )
