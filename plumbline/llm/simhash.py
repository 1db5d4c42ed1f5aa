"""SimHash near-duplicates: fingerprints, links by covering locality-sensitive hashing, components.

Every structured mask of :func:`covering_masks` defines a table; two fingerprints that
differ in at most ``radius`` bits are equal under some mask, so they meet in a bucket of that table
and no link is lost. Links are looked for between distinct fingerprints only: copies share a
fingerprint and never meet each other. A bucket above ``bucket_limit`` is dealt out again by
masks over the bits that its own mask left open, which again loses no pair and leaves
at most 2^16 fingerprints that can still share a bucket. A bucket gives the star of each group
of linked members, not its pairs; stars are joined to components by alternating large and small
star steps on tables.

Defined results: a text that is null, empty or white space has fingerprint zero and is linked like
any other; texts are taken whole; fewer words than a shingle are one shingle; a null id
never names a component unless it has no other id; repeated rows share a component; an empty
table gives an empty result; other columns are carried or ignored. The rows that :func:`deduplicated`
leaves keep all their columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, checkpointed, in_arrow, joined, short_lived_shuffles, slices, stored, text_bytes, without

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 50_000


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; fewer words than ``width`` are one shingle."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > width:
        starts, ends = starts[: 1 - width or None], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends.tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, len(starts))


def print_of(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; of none: 0."""
    totals = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        some = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * totals > len(hashes)).tolist())


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's shingles; without words: 0."""
    return print_of(shingle_hashes(text, width, seed))


def parity(a: int, b: int) -> int:
    return (a & b).bit_count() & 1


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """2^(radius+1) - 1 masks over the positions such that any ``radius`` positions are left
    out together by some mask.

    Every position gets a nonzero vector of radius + 1 bits; the mask of a nonzero vector v keeps the
    positions whose vector has an odd product with v. Any ``radius`` vectors have a common
    orthogonal v, whose mask keeps none of them.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(len(positions))]
    return [
        sum(1 << p for p, m in zip(positions, vectors, strict=True) if parity(m, v))
        for v in range(1, size)
    ]


def with_fingerprint(
    df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", width: int = 3, seed: int = 42
) -> DataFrame:
    """Every row with the fingerprint of its whole text as a (signed) long."""
    kept = without(df, [out_col])
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(text_col))
                found = [
                    fingerprint(data[a:b], width, seed)
                    for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                ]
                column = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, column], names=[*part.schema.names, out_col]
                )

    return in_arrow(kept, run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stars(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member of its linked group) for all members that are not the smallest."""
    rest = np.sort(members)
    found = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            # counted without sign: numpy counts the bits of the absolute value
            near = np.bitwise_count((rest ^ todo.pop()).view(np.uint64)) <= radius
            if near.any():
                linked = rest[near]
                rest = rest[~near]
                todo.extend(linked)
                found.extend((int(x), int(root)) for x in linked)
    return found


def _bucket_links(radius: int):
    def run(batches):
        """Each row is a whole bucket."""
        for batch in batches:
            out = []
            for members in batch.column("members"):
                out += stars(members.values.to_numpy(zero_copy_only=False), radius)
            yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]):
    table = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])


def _tables(masks: list[int], fp: str, first: int = 0) -> Column:
    """One (t, key) for each mask."""
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(first + i).alias("t"),
                    F.col(fp).bitwiseAND(F.lit(signed(m))).alias("key"),
                )
                for i, m in enumerate(masks)
            ]
        )
    )


def links(prints: DataFrame, radius: int = 3, bucket_limit: int = 4096) -> DataFrame:
    """Edges (a, b), a > b, that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    masks = covering_masks(radius, list(range(64)))
    keyed = prints.select("fp", _tables(masks, "fp").alias("at")).select("at.t", "at.key", "fp")
    shared = checkpointed(
        keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    )
    cold = keyed.join(shared.filter(F.col("n") <= bucket_limit).drop("n"), ["t", "key"])
    hot = shared.filter(F.col("n") > bucket_limit).drop("n")
    if not hot.isEmpty():
        fuller = F.lit(None).cast("array<struct<t:int,key:bigint>>")
        for i, mask in enumerate(masks):
            open_bits = [b for b in range(64) if not mask >> b & 1]
            wider = [mask | m for m in covering_masks(radius, open_bits)]
            first = len(masks) + i * len(masks)
            choices = F.array(
                *[
                    F.struct(
                        F.lit(first + j).alias("t"),
                        F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"),
                    )
                    for j, m in enumerate(wider)
                ]
            )
            fuller = F.when(F.col("t") == i, choices).otherwise(fuller)
        again = keyed.join(hot, ["t", "key"]).select("fp", F.explode(fuller).alias("at"))
        cold = cold.unionByName(again.select("at.t", "at.key", "fp"))
    # grouped, so that no plan may take a bucket apart
    buckets = cold.groupBy("t", "key").agg(F.collect_list("fp").alias("members")).select("members")
    return in_arrow(buckets, _bucket_links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the least node of its component."""
    edges = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = checkpointed(
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        with short_lived_shuffles(edges.sparkSession):
            now = edges.agg(
                F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
            ).first()
        if now == before:
            return edges.select(
                F.col("a").alias("node"), F.col("b").alias("root")
            )
        before = now


def component_of(
    rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fingerprint", radius: int = 3
) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of the rows; the root is the least
    fingerprint of the component."""
    prints = checkpointed(
        rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least_id"))
    )
    roots = components(links(prints, radius))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    members = roots.select("node", "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )
    least = (
        members.join(prints, members.node == prints.fp)
        .groupBy("root")
        .agg(F.min("least_id").alias("component_id"))
    )
    return rooted.join(least, "root", "left").select(
        "fp", "root", F.coalesce("component_id", "least_id").alias("component_id")
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    seed: int = 42,
    radius: int = 3,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = checkpointed(
        with_fingerprint(source, "text", "fp", width, seed).select("doc_id", "fp")
    )
    found = component_of(rows, "doc_id", "fp", radius)
    return rows.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    seed: int = 42,
    radius: int = 3,
    most: int = 500_000,
) -> DataFrame:
    """The rows of ``df`` with one row of each component left: that of the least id.

    The rows are stored once with their fingerprints; what is to go is decided on ids and
    fingerprints alone and taken out by place in the stored files, broadcast only if it
    is no more than ``most`` places. All columns are kept whatever their names.
    """
    inner, back = aside(df, [id_col, text_col])
    rows = stored(with_fingerprint(inner, text_col, "own_print", width, seed))
    found = component_of(rows, id_col, "own_print", radius).select(F.col("fp").alias("node"), "root")
    return back(first_of_each(rows, found, "own_print", id_col, most))


def first_of_each(rows: DataFrame, found: DataFrame, own_col: str, id_col: str, most: int) -> DataFrame:
    """The stored rows with one of each group left: that of the least id, a null id only if there is no
    other. ``found`` has ``node`` (a value of ``own_col``) and ``root``; a node without is its own root.

    Copies are combined before the shuffle, so a node of many rows is one row for each task.
    """
    located = {"at_file": F.col("_metadata.file_name"), "at_row": F.col("_metadata.row_index")}
    placed = rows.select(
        F.col(id_col).alias("id"), F.col(own_col).alias("own"), *[c.alias(n) for n, c in located.items()]
    )
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "at_file", "at_row")
    first = placed.groupBy("own").agg(F.min(order).alias("first"))
    rooted = first.join(found, first.own == found.node, "left")
    stays = (
        rooted.groupBy(F.coalesce("root", "own").alias("root"))
        .agg(F.min("first").alias("first"))
        .select("first.at_file", "first.at_row")
    )
    gone = checkpointed(
        placed.select("at_file", "at_row").join(stays, ["at_file", "at_row"], "left_anti")
    )
    return joined(rows.withColumns(located), gone, ["at_file", "at_row"], "left_anti", most).select(
        *[F.col(f"`{c}`") for c in rows.columns]
    )
