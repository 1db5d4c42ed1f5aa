"""Streaming forms of the batch operators: windows, gaps, first point of a voxel, frame selection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..contracts import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``start, event_type, n, value`` of tumbling or sliding windows; later rows are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "value")
    )


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of observations of a user without a step over ``gap``."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), "n")
    )


def first_of_voxel(points: DataFrame, size: float, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first point of each voxel within the watermark."""
    cell = {f"k{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"}
    return points.withColumns(cell).withWatermark(at, late).dropDuplicatesWithinWatermark(list(cell))


def frame_dedup(events: DataFrame, least_blur: float, most_distance: int) -> DataFrame:
    """``source, event_id, reason``: each frame against the last kept one of its source.

    State is the last kept hash. Frames of one micro-batch are put in order; the source must deliver
    batches in order, as a replayed log does.
    """
    rows = events.select(
        F.col("user_id").alias("source"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "event_id",
        F.col("value").alias("blur"),
        F.pmod(F.col("event_id") * F.lit(2654435761), F.lit(2147483648)).alias("hash"),
    )

    def decide(key, batches: Iterator, state: GroupState):
        import pandas as pd

        last = state.get[0] if state.exists else None
        frames = pd.concat(list(batches)).sort_values(["at", "event_id"])
        reasons = []
        for blur, value in zip(frames["blur"], frames["hash"], strict=True):
            if blur < least_blur:
                reasons.append("blurred")
            elif last is not None and (int(value) ^ last).bit_count() <= most_distance:
                reasons.append("duplicate")
            else:
                reasons.append("keep")
                last = int(value)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"source": key[0], "event_id": frames["event_id"].to_numpy(), "reason": reasons})

    return rows.groupBy("source").applyInPandasWithState(
        decide, "source long, event_id long, reason string", "last long", "append", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a query over all that its source has now and returns its result table.

    Each micro-batch is written to the shared folder by the executors, so the driver holds no rows. Mode
    ``complete`` leaves the last batch, which is the whole result; otherwise all batches together are.
    """
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    written = {}

    def write(batch: DataFrame, number: int) -> None:
        path = f"{place}/result/{number}"
        batch.write.mode("overwrite").parquet(path)
        if mode == "complete":
            written.clear()
        written[number] = path

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{place}/progress")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*written.values())
