"""Video frames: perceptual hashes, greedy selection, consecutive groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dhash(values: Column, bits: int) -> Column:
    """Bit i is set if value i+1 is over value i (0-based), as a long."""
    steps = F.sequence(F.lit(0), F.lit(bits - 1))
    return F.aggregate(
        steps,
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(
            F.when(F.get(values, i + 1) > F.get(values, i), F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")
        ),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def select_frames(frames: DataFrame, keys: Sequence[str], order_by: Sequence[str], blur: str, hash_col: str, least_blur: float, most_distance: int, most: int | None = None) -> DataFrame:
    """Every frame with ``keep, reason``: blurred, then duplicate of the last kept one, then over the cap.

    The decision depends on the last kept frame, so the frames of a source are walked in order by one task,
    which keeps no more than that frame and a count; only frames that are not blurred enter it.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    sharp = F.col(blur) >= least_blur
    names = [*keys, *order_by]
    fields = [T.StructField(f"_{i}", frames.schema[c].dataType) for i, c in enumerate(names)]

    def walk(group: pa.Table) -> pa.Table:
        group = group.sort_by([(f"_{i}", "ascending") for i in range(len(keys), len(names))])
        last, kept, reasons = None, 0, []
        for h in group.column("_h").to_pylist():
            if last is not None and h is not None and ((h ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() <= most_distance:
                reasons.append("duplicate")
            elif most is not None and kept >= most:
                reasons.append("max_frames")
            else:
                reasons.append("keep")
                last, kept = h, kept + 1
        return group.drop_columns("_h").append_column("_r", pa.array(reasons, pa.string()))

    own = [F.col(c).alias(f"_{i}") for i, c in enumerate(names)]
    rows = frames.filter(sharp).select(*own, F.col(hash_col).cast("long").alias("_h"))
    decided = rows.groupBy(*[f"_{i}" for i in range(len(keys))]).applyInArrow(
        walk, T.StructType([*fields, T.StructField("_r", T.StringType())])
    )
    decided = decided.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "_r")
    joined = frames.join(decided, [*keys, *order_by], "left")
    reason = F.when(sharp, F.col("_r")).otherwise("blurred")
    return joined.select(*frames.columns, (reason == "keep").alias("keep"), reason.alias("reason"))


def consecutive_groups(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], size: int) -> DataFrame:
    """Rows with ``group_id`` seg_0000, seg_0001, ... of ``size`` rows each."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)) - 1
    return df.withColumn("group_id", F.format_string("seg_%04d", F.floor(place / size).cast("int")))
