"""Lineage: tree digests, verification of outputs, fingerprints and their chains, recounts, migrations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def file_table(df: DataFrame, path: str, content: str) -> DataFrame:
    """``path, size, sha256`` of rows that hold a file's content."""
    data = F.col(content).cast("binary")
    return df.select(F.col(path).cast("string").alias("path"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("sha256"))


def tree_digest(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``files, digest``: SHA-256 over path and digest of every file, in order of path components."""
    entry = F.struct(F.split("path", "/").alias("parts"), F.concat("path", "sha256").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.text), "")
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sha2(joined, 256).alias("digest"))


def verify_tree(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, problem`` of files that are missing, extra or differ in size or digest."""
    e = expected.select("path", F.col("size").alias("es"), F.col("sha256").alias("eh"))
    a = actual.select("path", F.col("size").alias("as_"), F.col("sha256").alias("ah"))
    problem = (
        F.when(F.col("ah").isNull(), "missing")
        .when(F.col("eh").isNull(), "extra")
        .when(~F.col("es").eqNullSafe(F.col("as_")), "size")
        .when(~F.col("eh").eqNullSafe(F.col("ah")), "sha256")
    )
    return e.join(a, "path", "full_outer").select("path", problem.alias("problem")).filter(F.col("problem").isNotNull())


def fingerprint(*parts: Column) -> Column:
    """Digest of named inputs; NULL is told from the empty string."""
    shown = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *shown), 256)


def fingerprint_chain(stages: DataFrame, keys: Sequence[str], order_by: str, own: str) -> DataFrame:
    """``fingerprint`` of each stage: digest of the earlier fingerprint and its own inputs, folded in order."""
    entries = F.array_sort(F.collect_list(F.struct(order_by, own)))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(acc, e):
        now = F.sha2(F.concat(acc.last, F.lit("|"), e[own]), 256)
        return F.struct(now.alias("last"), F.concat(acc.out, F.array(now)).alias("out"))

    folded = stages.groupBy(*keys).agg(entries.alias("_e")).select(*keys, "_e", F.aggregate("_e", start, step).alias("_s"))
    return folded.select(*keys, F.explode(F.arrays_zip("_e", F.col("_s.out").alias("out"))).alias("x")).select(
        *keys, F.col(f"x._e.{order_by}").alias(order_by), F.col("x.out").alias("fingerprint")
    )


def fingerprint_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``key, left, right`` where two executions differ; a value unknown on a side is a difference."""
    left = a.select(key, F.col(value).alias("left"))
    right = b.select(key, F.col(value).alias("right"))
    both = left.join(right, key, "full_outer")
    return both.filter(F.col("left").isNull() | F.col("right").isNull() | (F.col("left") != F.col("right")))


def resume(recorded: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """``key, decision``: reuse equal fingerprints, refuse usable ones that changed, else run."""
    r = recorded.select(key, F.col("fingerprint").alias("old"), "usable")
    c = current.select(key, F.col("fingerprint").alias("new"))
    decision = F.when(F.coalesce(F.col("usable"), F.lit(False)), F.when(F.col("old").eqNullSafe(F.col("new")), "reuse").otherwise("stale")).otherwise("run")
    return c.join(r, key, "left").select(key, decision.alias("decision"))


def recount(declared: DataFrame, rows: DataFrame, key: str, count: str) -> DataFrame:
    """``key, declared, found`` where a record's count isn't what the data hold (0 counts)."""
    found = rows.groupBy(key).agg(F.count("*").alias("found"))
    both = declared.select(key, F.col(count).alias("declared")).join(found, key, "left")
    found = F.coalesce("found", F.lit(0))
    return both.select(key, "declared", found.alias("found")).filter(~F.col("declared").eqNullSafe(F.col("found")))


def rollup(stages: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Sum of measured seconds; NULL if none was measured."""
    return stages.groupBy(*keys).agg(F.sum(seconds).alias("seconds"), F.count(seconds).alias("measured"))


def latest_state(events: DataFrame, keys: Sequence[str], state: str, at: str, tie: str) -> DataFrame:
    """The last state of each key."""
    return events.groupBy(*keys).agg(F.max_by(state, F.struct(at, tie)).alias("state"), F.max(at).alias("at"))


def version_tuple(version: Column) -> Column:
    """Array of numbers, which compares part by part."""
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))


class Migrations:
    """Forward-only steps between versions of a table; a version without a path is refused."""

    def __init__(self, current: str):
        self.current = current
        self.steps: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}

    def step(self, old: str, new: str):
        def add(f: Callable[[DataFrame], DataFrame]):
            if old in self.steps:
                raise ValueError(f"a second step from {old}")
            self.steps[old] = (new, f)
            return f

        return add

    def migrate(self, df: DataFrame, version: str) -> DataFrame:
        while version != self.current:
            if version not in self.steps:
                raise ValueError(f"no way from version {version} to {self.current}")
            version, f = self.steps[version]
            df = f(df)
        return df


def monotonic_issues(df: DataFrame, keys: Sequence[str], s: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys with the number of steps that do not grow."""
    order = Window.partitionBy(*keys).orderBy("_place")
    step = F.col(s) - F.lag(s).over(order)
    return df.withColumn("_step", step).groupBy(*keys).agg(F.count_if(F.col("_step") <= tolerance).alias("issues"))
