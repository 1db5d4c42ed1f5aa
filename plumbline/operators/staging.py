"""A subset of a reconstruction to train on, and reports that copy figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import even_pick


def staged_images(images: DataFrame, cameras: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train images, evenly picked by name down to ``most``; the cameras that took them).

    ``images``: image_id, name, camera_id, role.
    """
    chosen = images.filter(F.col("role") == "train")
    if most is not None:
        chosen = even_pick(chosen.withColumn("_all", F.lit(0)), ["_all"], ["name"], most).drop("_all")
    return chosen, cameras.join(chosen.select("camera_id").distinct(), "camera_id", "left_semi")


def staged_points(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """The points with their tracks cut to the chosen images (maybe to nothing) and colours held to 1..254.

    ``points``: point_id, r, g, b, track array<struct<image_id, ...>>. Observations meet the images by
    key and are put together again by point.
    """
    seen = points.select("point_id", F.posexplode("track").alias("_at", "_o"))
    kept = seen.join(chosen.select(F.col("image_id").alias("_image")), F.col("_o.image_id") == F.col("_image"), "left_semi")
    tracks = kept.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("_at", "_o"))).alias("_kept"))
    kind = points.schema["track"].dataType
    track = F.coalesce(F.transform("_kept", lambda e: e["_o"]), F.array()).cast(kind)
    held = {c: F.least(F.greatest(F.col(c), F.lit(1)), F.lit(254)) for c in "rgb"}
    return points.drop("track").join(tracks, "point_id", "left").withColumns({**held, "track": track}).drop("_kept")


def report(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row of each key with a column for each metric, copied as it is, and ``absent``: why others have no
    figure. ``metrics``: keys, metric, value, reason; a metric without a row is "not recorded", one that
    two rows give different values is "contradictory" and NULL."""
    own = lambda n: F.col("metric") == n
    parts = []
    for n in names:
        value, reason = F.when(own(n), F.col("value")), F.when(own(n), F.col("reason"))
        parts += [F.min(value).alias(f"_lo_{n}"), F.max(value).alias(f"_hi_{n}"), F.min(reason).alias(f"_why_{n}"), F.count_if(own(n)).alias(f"_n_{n}")]
    rows = metrics.groupBy(*keys).agg(*parts)
    agreed = lambda n: F.col(f"_lo_{n}") == F.col(f"_hi_{n}")
    why = lambda n: (
        F.when(F.col(f"_n_{n}") == 0, "not recorded")
        .when(F.col(f"_lo_{n}").isNull(), F.coalesce(f"_why_{n}", F.lit("no reason given")))
        .when(~agreed(n), "contradictory")
    )
    absent = F.array_compact(F.array(*[F.when(why(n).isNotNull(), F.concat(F.lit(f"{n}: "), why(n))) for n in names]))
    return rows.select(
        *keys, *[F.when(agreed(n), F.col(f"_lo_{n}")).alias(n) for n in names], F.array_join(absent, "; ").alias("absent")
    )
