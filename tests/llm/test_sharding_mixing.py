from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from plumbline.llm import mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(n=500):
    words = "lorem ipsum dolor sit amet".split()
    rows = [(i, " ".join(words[(i + k) % 5] for k in range(i % 37)), "en", f"s{i % 3 if i % 2 else 0}", i) for i in range(n)]
    rows += [(n, None, None, None, None), (None, "no id", "en", None, 1), (n + 1, "", "en", "s0", 0), (n + 2, "w " * 50_000, "en", "s1", 1)]
    rows += [(n + 3, "twice", "en", "s1", 1)] * 2 + [(n + 10 + i, "copy of one text", "en", "s0", 1) for i in range(n // 2)]
    return rows


def test_shards_hold_all_rows_evenly(spark):
    rows = plain()
    got = sharding.shard_digest(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) == set(range(40))
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    text = {r[0]: r[1] for r in rows}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert r.law == "rows" and r.grown_shard is None
    copies = Counter(r.shard for r in got if r.doc_id is not None and text[r.doc_id] == "copy of one text")
    assert len(copies) > 30  # copies spread


def test_shuffles_and_reruns_agree(spark):
    df = docs(spark, plain())
    place = lambda seed: {(r.doc_id, r.size): (r.shard, r.slot) for r in sharding.shard_records(df, 4, seed=seed, bucket_bytes=20_000).collect()}
    first = place(1)
    assert first == place(1)
    assert first != place(2)
    order = [k[0] for k, _ in sorted(first.items(), key=lambda kv: kv[1]) if k[0] is not None]
    assert order != sorted(order)


def test_shard_edges(spark):
    df = docs(spark, plain(3)[:5])
    few = sharding.shard_records(df, 40).collect()
    assert sorted(r.shard for r in few) == list(range(5)) and all(r.slot == 0 for r in few)
    assert sharding.shard_digest(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"lang": "shard", "n_chars": "slot"})
    assert sharding.shard_records(clash).columns.count("shard") == 1


class Twister:
    """The generator behind Spark's ``shuffle``: Mersenne twister seeded with the two halves of a long."""

    def __init__(self, seed: int):
        low, high = seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF
        self.rng = random.Random(high | low << 32)

    def below(self, n: int) -> int:
        while True:
            bits = self.rng.getrandbits(32) >> 1
            if n & (n - 1) == 0:
                return n * bits >> 31
            if bits - bits % n + (n - 1) < 1 << 31:
                return bits % n


def test_buckets_are_permuted_like_a_replay(spark):
    rows = [(i, f"text {i} " * (i % 9), "en", f"s{i % 3}", i) for i in range(400)]
    seed, shards, size = 77, 7, 1500
    df = docs(spark, rows)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_records(df, shards, seed=seed, bucket_bytes=size).collect()}
    buckets = -(-sum(len(r[1].encode()) + 16 for r in rows) // size)
    hashed = df.selectExpr("doc_id", f"pmod(xxhash64({seed}, doc_id, text), {buckets}) AS b", f"xxhash64({seed + 1}, doc_id, text) AS at")
    members = defaultdict(list)
    for r in hashed.collect():
        members[r.b].append((r.at, r.doc_id))
    order = []
    for b in sorted(members):
        entries, twister = sorted(members[b]), Twister(seed + b)  # a bucket is a partition, whose number is added
        index = [0] * len(entries)
        for i in range(len(entries)):  # Fisher-Yates, inside out
            j = twister.below(i + 1)
            index[i] = index[j]
            index[j] = i
        order += [entries[i][1] for i in index]
    low, longer = divmod(len(rows), shards)
    want, place = {}, 0
    for shard in range(shards):
        for slot in range(low + (shard < longer)):
            want[order[place]] = (shard, slot)
            place += 1
    assert got == want


def test_equal_rows_and_maps_do_not_fill_one_bucket(spark):
    rows = [(None, "the same text again", "en", "s", 1)] * 3000 + [(i, f"other {i}", "en", "s", i) for i in range(300)]
    df = docs(spark, rows).repartition(6).selectExpr("*", "map('a', doc_id) AS m", "'b' AS _bucket", "'c' AS _entry", "'d' AS _nth", "'e' AS _at")
    tagged = sharding._scattered(df, 100, 1, "doc_id", "text", 1100)
    assert max(r["count"] for r in tagged.groupBy("_bucket").count().collect()) < 100
    got = sharding.shard_records(df, 10, bucket_bytes=1100).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r._bucket == "b" and r._entry == "c" and r._nth == "d" and r.m == {"a": r.doc_id} for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(330)) for s in slots.values()) and len(slots) == 10


def test_no_python_in_the_plan(spark, sf_dir):
    for df in (sharding.shard_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")), mixing.mix_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def water_fill(sizes: dict, share=1.5, cap=2) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        free -= set(over)
    return out


def test_mix_meets_targets(spark):
    rows = plain()
    got = mixing.mix_digest(docs(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_id = {r[0]: r for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    want = water_fill(sizes)
    taken = Counter()
    for r in got:
        row = by_id[r.doc_id]
        assert r.size == count(row[1]) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[row[3]] and r.target == pytest.approx(want[row[3]])
        taken[row[3]] += r.taken
    for s, t in want.items():
        largest = max(count(r[1]) for r in rows if r[3] == s)
        assert abs(taken[s] - t) <= largest / 2 + 1
    again = mixing.mix_digest(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_one_source_takes_half_again(spark):
    rows = [(i, "a b c d", "en", "only", 7) for i in range(200)]
    got = mixing.mix_digest(docs(spark, rows)).collect()
    assert sum(r.taken for r in got) == 1200
    assert {r.taken for r in got} == {4, 8}


def test_mix_edges(spark):
    assert mixing.mix_digest(docs(spark, []).limit(0)).count() == 0
    empty = mixing.mix_digest(docs(spark, [(1, None, "en", None, 0), (2, "", "en", "a", 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    df = docs(spark, plain(60))
    mix = mixing.mixed_documents(df)
    assert mix.columns == df.columns
    whole = mixing.mix(df)
    assert mix.count() == sum(r.copies for r in whole.collect())


def test_mix_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(mixing.MIX_SQL).fetchall())
    got = sorted(map(tuple, mixing.mix_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()))
    assert got == want


def test_equal_rows_are_taken_in_part(spark):
    rows = [(None, "five words are in here", "en", "s0", 1)] * 900 + [(i, "a b c", "en", "s1", 1) for i in range(100)]
    df = docs(spark, rows).repartition(5)
    got = mixing.mix_digest(df).collect()
    taken = Counter()
    for r in got:
        taken["s0" if r.size == 5 else "s1"] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = water_fill({"s0": 4500, "s1": 300})
    assert {s: abs(taken[s] - want[s]) <= 5 for s in want} == {"s0": True, "s1": True}
    assert mixing.mixed_documents(df).count() == sum(r.taken // r.size for r in got)


def test_few_rows_are_ranked_at_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = sorted(map(tuple, mixing.mix_digest(df).collect()))
    assert sorted(map(tuple, mixing.mix_digest(df, edge_rows=1).collect())) == wide


def test_inclusion_follows_the_length_class(spark):
    """Every source is a draw of its own from the same sizes; frequencies come near p."""
    sizes, draws = [3, 5, 6, 12, 20, 33, 60, 90, 130, 250] * 30, 30
    rows = [(d * 1000 + i, " ".join(["w"] * n), "en", f"s{d:04}", n) for d in range(draws) for i, n in enumerate(sizes)]
    got = mixing.mix(docs(spark, rows), weights=(1,), share=0.8).collect()
    copies, target = defaultdict(int), got[0].target
    for r in got:
        copies[r.n_chars] += r.copies
    total = Counter(sizes)
    low, high = 0.0, 10.0
    for _ in range(100):  # the level, by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(n * min(2, level * n.bit_length()) for n in sizes) < target else (low, level)
    for n, c in copies.items():
        assert c / (draws * total[n]) == pytest.approx(min(2, level * n.bit_length()), abs=0.06)
    assert copies[250] > 1.5 * copies[3]


def test_mix_keeps_columns_whatever_their_names(spark):
    names = ["size", "taken", "copies", "place", "q", "key", "cut", "edge_key", "single", "nth", "class", "_record", "whole", "p"]
    df = docs(spark, plain(40)).selectExpr("*", *[f"concat('{n}', coalesce(doc_id, 0)) AS `{n}`" for n in names], "NULL AS nothing")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        assert all(r[n] == f"{n}{r.doc_id or 0}" for n in names) and r.nothing is None
    out = mixing.mix(df)
    assert sorted(out.columns) == sorted({*df.columns, *mixing.OUT}) and dict(out.dtypes)["size"] == "bigint"
