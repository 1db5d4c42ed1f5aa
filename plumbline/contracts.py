"""Checks that fail closed, and the way in for values that stand for "not observed"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack of interval and station comparisons, in metres.
EPS = 1e-9


class ContractError(ValueError):
    """Data or parameters break a rule that an operator relies on."""


def require(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """Counts the rows that break a rule and refuses if there are any."""
    n = df.filter(broken).count()
    if n:
        raise ContractError(f"{message}: {n} row(s)")
    return df


def checked(value: Column, ok: Column, message: str) -> Column:
    """The value, or an error while the query runs if the condition doesn't hold."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def observed(value: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def require_metric_frame(df: DataFrame, frame_col: str = "frame") -> DataFrame:
    """Refuses coordinates of a frame without a metric scale."""
    return require(
        df, ~F.coalesce(F.col(frame_col).isin("TLS_GLOBAL", "LOCAL_METRIC"), F.lit(False)), "no metric frame"
    )


def float32_safe(*columns: Column, limit: float = 5000.0) -> Column:
    """Whether coordinates can be stored as float without losing millimetres."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.abs(c) <= limit)
    return ok


def shared_folder(spark) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; on one machine (master
    ``local``) a temporary one if none is set, on a cluster none is guessed."""
    import re
    import tempfile

    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ContractError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="plumbline-")).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
