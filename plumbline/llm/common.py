"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rules: space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A session on one machine (master ``local``) that names none gets a temporary folder; on a cluster
    that would be one node's disk, so there the setting must be given.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return spark.conf.get("spark.checkpoint.dir", None) or found


#: Bytes of an Arrow batch that goes to a Python worker, where the session leaves Spark's default.
BATCH_BYTES = "8m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size: rows hold whole texts, and Spark's default of 64 MB is
    held several times by a task. The setting belongs to the session and stays."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH_SETTING, str(_BATCH_DEFAULT)))
    if now.lower().rstrip("b") in (str(_BATCH_DEFAULT), "64m"):
        conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory of this process goes back to the system, where the C library can do that."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions on DataFrames made within leave no shuffle files behind.

    Spark keeps them until the driver happens to collect its garbage, so that a loop of small steps
    fills the disk with files that nothing reads again. A shuffle that is asked for again is computed again.
    """
    conf = spark.conf
    before = conf.get(_CLEANUP_SETTING, None)
    conf.set(_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        conf.unset(_CLEANUP_SETTING) if before is None else conf.set(_CLEANUP_SETTING, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a replicated copy in the shared folder."""
    shared_dir(df.sparkSession)
    with short_lived_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`checkpointed`, but as compressed Parquet; for rows with texts.

    Columns without a type (only nulls) can't be stored and are made anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    empty = {c for c, kind in df.dtypes if kind == "void"}
    held = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in empty]) if empty else df
    with short_lived_shuffles(spark):
        held.write.parquet(path)
    found = spark.read.schema(held.schema).parquet(path)
    if not empty:
        return found
    return found.select(*[F.lit(None).alias(c) if c in empty else F.col(f"`{c}`") for c in df.columns])


def joined(rows: DataFrame, small: DataFrame, on, how: str = "left", most: int = 100_000) -> DataFrame:
    """Join with a table of few rows, one for each source or site: counted, and broadcast only up to
    ``most`` rows; beyond, Spark joins by key and splits hot keys at run time."""
    with short_lived_shuffles(small.sparkSession):
        few = small.count() <= most
    return rows.join(F.broadcast(small) if few else small, on, how)


def occurrences(rows: DataFrame, which: list[str], name: str = "nth") -> DataFrame:
    """The rows with ``name``: 1, 2, ... among those that are equal in the columns ``which``.

    They are numbered within the task that read them, and from task to task by the counts of each, so that
    many equal rows never meet in one task.
    """
    rows = stored(rows.withColumn("task_of", F.spark_partition_id()))
    key = [F.col(c).alias(f"same_{i}") for i, c in enumerate(which)]
    before = Window.partitionBy(*[f"same_{i}" for i in range(len(which))]).orderBy("task_at")
    counts = (
        rows.groupBy(*key, F.col("task_of").alias("task_at"))
        .agg(F.count("*").alias("in_task"))
        .withColumn("earlier", F.sum("in_task").over(before) - F.col("in_task"))
    )
    own = Window.partitionBy(*which, "task_of").orderBy(F.lit(1))
    same = F.col("task_of") == F.col("task_at")
    for i, c in enumerate(which):
        same &= F.col(c).eqNullSafe(F.col(f"same_{i}"))
    numbered = rows.withColumn("in_own", F.row_number().over(own))
    return joined(numbered, counts, same, "inner").select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "task_of"],
        (F.col("in_own") + F.col("earlier")).alias(name),
    )


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops input columns whose names an operator's own output columns take (case ignored)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def aside(
    df: DataFrame, needed: list[str]
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with neutral names for all columns but ``needed``, so that none can clash with those of an
    operator, and a function that selects the columns of ``df``, names restored, from a result."""
    names = {c: c if c in needed else f"kept_{i}" for i, c in enumerate(df.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])

    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), back


def slices(batch, rows: int = 256, most: int = 8 << 20) -> Iterator:
    """A batch in slices of at most ``rows`` rows and ``most`` bytes of text, but of one row at least.

    An empty batch is one empty slice.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    size = np.zeros(n, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    start = 0
    while start < n or start == 0:
        before = upto[start - 1] if start else 0
        end = min(start + rows, int(np.searchsorted(upto, before + most, side="right")), n)
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


def text_bytes(batch_column) -> tuple[bytes, list[int]]:
    """The UTF-8 bytes of an Arrow string column, null as empty, and its offsets."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch_column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    offsets = [0]
    total = 0
    for n in lengths.tolist():
        total += n
        offsets.append(total)
    buf = column.buffers()[2]
    if buf is None or total == 0:
        return b"", offsets
    import numpy as np

    start = int(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset])
    return buf.slice(start, total).to_pybytes(), offsets
