"""Near copies by similarity of word shingles: operator 8 where texts, not fingerprints, must be similar.

Texts are sets of ``width``-word shingles; two texts are linked if the sets' Jaccard similarity is
``similarity`` or more. Candidates come from SimHash fingerprints of the shingles by covering
locality-sensitive hashing (:func:`.simhash.links`), and every candidate is checked on the sets. A
pair at 0.8 differs in some 10 of 64 bits, which no number of covering masks that can be held reaches, so
the links that fingerprints can't show are looked for in MinHash bands: with ``BANDS`` bands
of ``DEPTH`` hashes a pair at 0.8 meets in none with probability (1 - 0.8^5)^40 = 1.2e-7, and rarer above.
Groups are the components of the links.

Equal sets are one node and never meet. In each bucket a star is tested, twice: every member against
one centre. Of each bucket that then still lies in several components, common shingles of the members are
counted by an inverted index within a task, so pairs are never rows. Buckets of more than
``LIMIT`` members are dealt out again by bands of further hashes, up to ``LEVELS`` times.

Defined results: texts are taken whole, words and their case as in :mod:`.simhash`; fewer words than
a shingle are one shingle; null texts and texts without words are copies of each other; of a group the row
of the least id stays, a null id only if there is no other, and of rows that repeat the least id one; an empty
table stays empty; all columns are kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, checkpointed, in_arrow, joined, slices, stored, text_bytes
from .simhash import components, first_of_each, links, print_of, shingle_hashes

BANDS, DEPTH = 40, 5
CHUNK = 4096
STAR_ROUNDS, LEVELS, LIMIT = 2, 3, 4096
#: Rows of 16 bytes that may be broadcast.
MOST = 500_000
_SKETCH = {
    "own_set": T.LongType(),
    "own_size": T.LongType(),
    "own_print": T.LongType(),
    "own_bands": T.ArrayType(T.LongType()),
}


def _mixers(level: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17 + level)
    times = rng.integers(0, 1 << 32, BANDS * DEPTH, dtype=np.uint32) | np.uint32(1)
    return times, rng.integers(0, 1 << 32, BANDS * DEPTH, dtype=np.uint32)


def bands(found: np.ndarray, level: int = 0, mixers=None) -> list[int]:
    """A key for each band of the MinHash signature of a set."""
    import xxhash

    times, plus = mixers or _mixers(level)
    least = np.full(BANDS * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    low = found.astype(np.uint32)
    for i in range(0, len(low), CHUNK):
        mixed = times[:, None] * low[None, i : i + CHUNK] + plus[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    data = least.tobytes()
    step = 4 * DEPTH
    return [xxhash.xxh64_intdigest(data[b * step : (b + 1) * step], b) for b in range(BANDS)]


def _longs(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def with_sketch(df: DataFrame, text_col: str, width: int, seed: int = 42) -> DataFrame:
    """Every row with the digest and size of its set, its SimHash fingerprint and its bands."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(*f) for f in _SKETCH.items()]])

    def run(batches):
        import xxhash

        mixers = _mixers(0)
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(text_col))
                sets, prints = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    hashes = shingle_hashes(data[a:b], width, seed)
                    prints.append(print_of(hashes))
                    sets.append(np.unique(hashes))
                keys = _longs([k for s in sets for k in bands(s, 0, mixers)])
                places = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(_longs([xxhash.xxh64_intdigest(s.tobytes()) for s in sets])),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(_longs(prints)),
                        pa.ListArray.from_arrays(places, pa.array(keys)),
                    ],
                    names=[*part.schema.names, *_SKETCH],
                )

    return in_arrow(df, run, schema)


def _sets(width: int, seed: int = 42):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column("text"))
                found = [
                    np.unique(shingle_hashes(data[a:b], width, seed)).tobytes()
                    for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(found, pa.binary())], names=["node", "grams"]
                )

    return run


def _dealt_again(level: int):
    """Members of a bucket with the keys of finer buckets within it."""

    def run(batches):
        import xxhash

        mixers = _mixers(level)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                keys = []
                for key, grams in zip(part.column("key").to_pylist(), part.column("grams").to_pylist(), strict=True):
                    own = key.to_bytes(8, "little", signed=True)
                    found = bands(np.frombuffer(grams, dtype=np.uint64), level, mixers)
                    keys += [xxhash.xxh64_intdigest(own + k.to_bytes(8, "little")) for k in found]
                of = np.repeat(np.arange(part.num_rows), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_longs(keys)), part.column("node").take(pa.array(of)), part.column("size").take(pa.array(of))],
                    names=["key", "node", "size"],
                )

    return run


def _buckets(batches):
    """Nodes, sets and roots of each bucket; rows come sorted by key, and a bucket may go on in the next batch."""
    held_key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, *rest = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "grams", "root")]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if key[a] != held_key and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held_key = key[a]
            held.append([c[a:b] for c in rest])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def joins(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets that connect all roots that any pair of similar sets connects."""
    size = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(len(sets)), size)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(column, np.cumsum(size)[:-1])
    order = np.argsort(column, kind="stable")
    holders = np.split(member[order], np.flatnonzero(np.diff(column[order])) + 1)
    _, label, count = np.unique(roots, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(label != count.argmax())  # one end of every pair of two roots is in these
    found = []
    for i in rest.tolist():
        if (label == label[0]).all():
            break
        held = [holders[c] for c in own[i].tolist()]
        both = np.bincount(np.concatenate(held), minlength=len(sets)) if held else np.zeros(len(sets))
        near = both >= similarity * (size + size[i] - both) - 1e-9
        for j in np.flatnonzero(near & (label != label[i])).tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _joined_in_buckets(similarity: float):
    def run(batches):
        out = []
        for node, grams, root in _buckets(batches):
            found = joins([np.frombuffer(g, dtype=np.uint64) for g in grams], root, similarity)
            out.append(np.array([(node[i], node[j]) for i, j in found], dtype=np.int64).reshape(-1, 2))
            if len(out) == 1000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _pairs(found: list[np.ndarray]):
    table = np.concatenate([np.zeros((0, 2), dtype=np.int64), *found])
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])


def _checked(similarity: float):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                stays = []
                for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    stays.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield part.select(["a", "b"]).filter(pa.array(stays, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b"
    )
    return in_arrow(both, _checked(similarity), "a long, b long")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows ``key, node, size`` of the buckets of two members or more."""
    full = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    return stored(joined(keyed, full, "key", "inner", MOST))


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    of = roots.select(F.col("node").alias("of"), "root")
    return joined(members, of, members.node == of.of, "left", MOST).select(
        "key", "node", "size", F.coalesce("root", "node").alias("root")
    )


def _stars(placed: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs of different roots: each bucket's members with its centre of this turn."""
    centre = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("by"), "node", "size", "root")).alias("c")
    centres = checkpointed(
        placed.groupBy("key")
        .agg(centre, F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low <> high")
        .select("key", "c")
    )
    near = F.least("size", "c.size") >= similarity * F.greatest("size", "c.size") - 1e-9
    return (
        joined(placed, centres, "key", "inner", MOST // 4)
        .filter(near & (F.col("root") != F.col("c.root")))
        .select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
        .distinct()
    )


def _near_prints(sketches: DataFrame, radius: int) -> DataFrame:
    """Pairs of nodes whose fingerprints are linked by covering masks, or equal."""
    prints = checkpointed(sketches.groupBy(F.col("own_print").alias("fp")).agg(F.min("node").alias("node")))
    edges = links(prints.select("fp"), radius)
    a, b = (prints.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")) for c in "ab")
    linked = edges.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    same = sketches.join(prints.withColumnRenamed("node", "least"), F.col("own_print") == F.col("fp"))
    return linked.unionByName(
        same.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    )


def _all_roots(found: DataFrame) -> DataFrame:
    """With the roots themselves, which :func:`.simhash.components` leaves out."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _several(placed: DataFrame) -> DataFrame:
    """Of the buckets that lie in several components one of each with the same members, with ``n``."""
    return (
        placed.groupBy("key")
        .agg(
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"),
            F.min("node").alias("first"),
            F.max("node").alias("last"),
            F.count("*").alias("n"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
        )
        .filter("low <> high")
        .groupBy("s", "first", "last", "n")
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )


def groups(
    rows: DataFrame, text_col: str, width: int, similarity: float, radius: int = 3, limit: int = LIMIT
) -> DataFrame:
    """(node, root) of the sets of the rows of :func:`with_sketch` that are linked to others."""
    sketches = stored(
        rows.groupBy(F.col("own_set").alias("node")).agg(*[F.first(c).alias(c) for c in list(_SKETCH)[1:]])
    )
    size = F.col("own_size").alias("size")
    members = _shared(sketches.select("node", size, F.explode("own_bands").alias("key")))
    prints = checkpointed(_near_prints(sketches, radius))
    asked = checkpointed(
        members.select("node")
        .unionByName(prints.select(F.col("a").alias("node")))
        .unionByName(prints.select(F.col("b").alias("node")))
        .distinct()
    )
    texts = rows.select(F.col("own_set").alias("node"), F.col(text_col).alias("text"))
    found = in_arrow(joined(texts, asked, "node", "left_semi", MOST), _sets(width), "node long, grams binary")
    sets = stored(found.groupBy("node").agg(F.first("grams").alias("grams")))
    linked, roots = checkpointed(_verified(prints, sets, similarity)), None
    for level in range(1, LEVELS + 1):
        for turn in range(STAR_ROUNDS):
            pairs = _stars(_rooted(members, roots), similarity, turn)
            linked = checkpointed(linked.unionByName(_verified(pairs, sets, similarity)))
            roots = checkpointed(_all_roots(components(linked)))
        placed = checkpointed(_rooted(members, roots))
        several = checkpointed(_several(placed))
        last = level == LEVELS
        whole = several if last else several.filter(F.col("n") <= limit)
        dealt = (
            joined(placed, whole.select("key"), "key", "inner", MOST)
            .join(sets, "node")
            .select("key", "node", "grams", "root")
            .repartition("key")
            .sortWithinPartitions("key")
        )
        found = in_arrow(dealt, _joined_in_buckets(similarity), "a long, b long")
        linked = checkpointed(linked.unionByName(found))
        hot = several.filter(F.col("n") > limit).select("key")
        if last or hot.isEmpty():
            return _all_roots(components(linked))
        again = joined(placed, hot, "key", "inner", MOST).join(sets, "node").select("key", "node", "size", "grams")
        members = _shared(in_arrow(again, _dealt_again(level), "key long, node long, size long"))
        roots = checkpointed(_all_roots(components(linked)))


def deduplicated(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 3,
    limit: int = LIMIT,
    most: int = MOST,
) -> DataFrame:
    """The rows of ``df`` with one row of each group left: that of the least id."""
    inner, back = aside(df, [id_col, text_col])
    rows = stored(with_sketch(inner, text_col, width))
    found = checkpointed(groups(rows, text_col, width, similarity, radius, limit))
    return back(first_of_each(rows, found, "own_set", id_col, most))
