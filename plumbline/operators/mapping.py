"""Evidence joins: images to scans by GUID and by mapping rows, with one status for every image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_mapping(images: DataFrame, scans: DataFrame, rows: DataFrame) -> DataFrame:
    """``image_id, status, scan_ids``: one row for each image.

    ``images``: image_id, guid (nullable). ``scans``: scan_id, guid. ``rows``: image_id, target, vendor;
    a target that is no scan_id resolves to nothing.

    Precedence: rows that disagree, or that contradict a declared GUID, are a conflict; rows that resolve
    to nothing are orphans, to several scans ambiguous, else confirmed if a vendor manifest says so
    or the GUID agrees, otherwise manual. Without rows the GUID decides: none is unmapped, no match orphan, one
    confirmed, several ambiguous.
    """
    by_guid = scans.select(F.trim("guid").alias("guid"), F.col("scan_id").alias("_scan"))
    embedded = (
        images.select("image_id", F.trim("guid").alias("guid"))
        .join(by_guid, "guid", "left")
        .groupBy("image_id")
        .agg(F.max("guid").alias("guid"), F.array_sort(F.collect_set("_scan")).alias("embedded"))
    )
    resolved = rows.join(
        scans.select(F.col("scan_id").alias("target"), F.col("scan_id").alias("_scan")).distinct(), "target", "left"
    )
    by_row = resolved.groupBy("image_id").agg(
        F.count("*").alias("n_rows"),
        F.array_sort(F.collect_set("_scan")).alias("by_rows"),
        F.count_distinct("target").alias("targets"),
        F.bool_or("vendor").alias("vendor"),
    )
    both = images.select("image_id").join(embedded, "image_id", "left").join(by_row, "image_id", "left")
    told, own = F.size("by_rows"), F.size("embedded")
    has_rows = F.col("n_rows").isNotNull()
    # one row resolves to one scan at most, so different targets that resolve are different sets
    disagree = has_rows & (F.col("targets") > 1)
    against = has_rows & F.col("guid").isNotNull() & ((told > 0) | (own > 0)) & ~F.arrays_overlap("by_rows", "embedded")
    status = (
        F.when(disagree | against, "conflict")
        .when(has_rows & (told == 0), "orphan")
        .when(has_rows & (told > 1), "ambiguous")
        .when(has_rows & (F.col("vendor") | ((own == 1) & F.arrays_overlap("by_rows", "embedded"))), "confirmed")
        .when(has_rows, "manual")
        .when(F.col("guid").isNull(), "unmapped")
        .when(own == 0, "orphan")
        .when(own == 1, "confirmed")
        .otherwise("ambiguous")
    )
    return both.select("image_id", status.alias("status"), F.when(has_rows, F.col("by_rows")).otherwise(F.col("embedded")).alias("scan_ids"))


def status_counts(mapping: DataFrame, column: str = "status") -> DataFrame:
    return mapping.groupBy(column).agg(F.count("*").alias("n"))


def keyed_diff(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, kind, fields`` of keys that are missing on a side, repeated, or differ (null-safe)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias(f"n_{name}"), *[F.min(f).alias(f"{name}_{f}") for f in fields])

    both = side(a, "a").join(side(b, "b"), key, "full_outer")
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])
    )
    kind = (
        F.when(F.col("n_a").isNull(), "extra")
        .when(F.col("n_b").isNull(), "missing")
        .when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate")
        .when(F.size(differing) > 0, "differs")
    )
    shown = F.when(kind == "differs", F.array_join(differing, ",")).otherwise("")
    return both.select(key, kind.alias("kind"), shown.alias("fields")).filter(F.col("kind").isNotNull())


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of the child whose key is not in the parent; a NULL key is no reference."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def issues(*checks: tuple[str, DataFrame, Column]) -> DataFrame:
    """``issue, item`` of all checks: (name, rows that break it, what names a row)."""
    out = None
    for name, rows, item in checks:
        part = rows.select(F.lit(name).alias("issue"), item.cast("string").alias("item"))
        out = part if out is None else out.unionByName(part)
    return out
