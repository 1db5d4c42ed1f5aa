"""Sharding by a two-pass external shuffle, with DataFrame operations only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash of id and text,
so no source or group of copies gathers anywhere. Pass two holds one bucket in a
task, puts it into a fixed order, and applies Spark's ``shuffle``, a seeded Fisher-Yates
permutation. Buckets follow one another; the place of a record in that sequence gives its shard
and slot, so shards are equal runs of a random permutation and a bucket lies in few shards.

The number of buckets follows the bytes, so a task's memory doesn't grow with the table. Rows that are
equal in id and text have one hash; where they would overfill their bucket they are numbered and
scattered by number. Reruns over the same rows agree, but rows equal in id and text may change places.

Defined results: a null text has no bytes (its CRC-32 is 0); texts stay whole, and a text larger than a
bucket has one almost to itself; null ids scatter by their text; rows that are equal in id and text are kept
as often as they occur; an empty table gives an empty result; input columns named like an output
column are replaced by it, all others are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, joined, occurrences, without

#: Bytes of records that a bucket is meant to have, bucket counts that may be broadcast, and buckets that are
#: summed up together before all are put in order.
BUCKET_BYTES = 32 << 20
BROADCAST_BUCKETS = 200_000
TOGETHER = 4096
ROW_BYTES = 16


def record_size(text_col: str = "text") -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _scattered(df: DataFrame, buckets: int, seed: int, id_col: str, text_col: str, bucket_bytes: int) -> DataFrame:
    """``_bucket`` and ``_entry`` (a hash that orders the bucket, and the record) of every row."""
    tagged = df.select(
        F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(buckets)).cast("int").alias("_bucket"),
        F.xxhash64(F.lit(seed + 1), id_col, text_col).alias("_at"),
        record_size(text_col).alias("_bytes"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_record"),
    )
    full = checkpointed(
        tagged.groupBy("_bucket").agg(F.sum("_bytes").alias("b")).filter(F.col("b") > 2 * bucket_bytes).select("_bucket")
    )
    if not full.isEmpty():
        kinds = joined(tagged, full, "_bucket", "left_semi").groupBy("_bucket", "_at")
        many = checkpointed(
            kinds.agg(F.count("*").alias("n"), F.sum("_bytes").alias("b"))
            .filter((F.col("n") > 1) & (F.col("b") > bucket_bytes // 2))
            .select("_bucket", "_at")
        )
        if not many.isEmpty():
            equal = occurrences(joined(tagged, many, ["_bucket", "_at"], "left_semi"), ["_bucket", "_at"], "_nth")
            again = F.pmod(F.xxhash64(F.lit(seed + 2), "_at", "_nth"), F.lit(buckets)).cast("int")
            spread = equal.withColumn("_bucket", again).drop("_nth")
            tagged = joined(tagged, many, ["_bucket", "_at"], "left_anti").unionByName(spread)
    return tagged.select("_bucket", F.struct(F.col("_at").alias("at"), F.col("_record").alias("record")).alias("_entry"))


def shard_records(
    df: DataFrame,
    shards: int = 40,
    seed: int = 20_240_601,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All records with ``size``, ``shard`` and ``slot``; shard counts differ by one at most."""
    df = without(df, ["size", "shard", "slot"])
    total, n = df.agg(F.sum(record_size(text_col)), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    tagged = _scattered(df, buckets, seed, id_col, text_col, bucket_bytes)
    counts = checkpointed(
        tagged.groupBy("_bucket").agg(F.count("*").alias("n")).withColumn("_set", F.floor(F.col("_bucket") / TOGETHER))
    )
    in_set = Window.partitionBy("_set").orderBy("_bucket")
    sets = counts.groupBy("_set").agg(F.sum("n").alias("in_set"))
    sets = sets.select("_set", (F.sum("in_set").over(Window.orderBy("_set")) - F.col("in_set")).alias("_before"))
    offsets = joined(counts, sets, "_set", "inner").select(
        "_bucket", (F.col("_before") + F.sum("n").over(in_set) - F.col("n")).alias("_offset")
    )
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    gathered = F.collect_list("_entry")
    if _has_map(df.schema):  # maps have no order
        at = lambda x, y: F.when(x.at < y.at, -1).when(x.at > y.at, 1).otherwise(0)
        gathered = F.array_sort(gathered, at)
    else:
        gathered = F.sort_array(gathered)
    permuted = (
        tagged.repartitionById(buckets, F.col("_bucket"))
        .groupBy("_bucket")
        .agg(gathered.alias("_entries"))
        .select("_bucket", F.shuffle("_entries", F.lit(seed)).alias("_entries"))
    )
    placed = permuted.join(offsets, "_bucket").select(
        "_offset", F.posexplode("_entries").alias("_pos", "_entry")
    )
    place = F.col("_offset") + F.col("_pos")
    low, longer = divmod(n, shards)
    start = longer * (low + 1)  # the first shards have one more
    short = F.lit(max(low, 1)).cast("long")
    early = place < start
    return placed.select(
        "_entry.record.*",
        record_size(f"_entry.record.{text_col}").alias("size"),
        F.when(early, F.floor(place / (low + 1)))
        .otherwise(longer + F.floor((place - start) / short))
        .cast("int")
        .alias("shard"),
        F.when(early, F.pmod(place, F.lit(low + 1).cast("long")))
        .otherwise(F.pmod(place - start, short))
        .cast("long")
        .alias("slot"),
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes the shards as one folder each, with the slot of every record."""
    shard_records(df, **options).write.partitionBy("shard").parquet(path)


def shard_digest(df: DataFrame, shards: int = 40, **options) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``rows``."""
    return shard_records(df, shards, **options).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
