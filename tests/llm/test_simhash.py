from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")

from plumbline.llm import simhash  # noqa: E402


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: dict) -> dict:
    ids = list(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(ids, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_every_triple_is_left_out_by_a_mask():
    masks = simhash.covering_masks(3, list(range(64)))
    assert len(masks) == 15
    for triple in itertools.combinations(range(64), 3):
        assert any(all(not m >> b & 1 for b in triple) for m in masks)


def make_texts():
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choices(words, k=random.choice([0, 1, 2, 3, 5, 40, 300]))) for _ in range(60)]
    near = []
    for text in base[:40]:
        parts = text.split()
        for _ in range(3):
            changed = list(parts)
            if changed:
                changed[random.randrange(len(changed))] = random.choice(words)
            near.append(" ".join(changed))
    return [*base, *near, *base[:10], None, "", " \t\n", "ÀB c", "one" * 30_000, "A b C d", "a  b\tc\nd"]


def test_components_are_those_of_all_pairs(spark):
    texts = make_texts()
    df = spark.createDataFrame([(i + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {i + 1: slow_print(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == slow_components(prints)


@pytest.mark.parametrize("limit", [4096, 4])
def test_no_link_is_lost_in_hot_buckets(spark, limit):
    random.seed(9)
    centre = random.getrandbits(64)
    values = {centre}
    while len(values) < 300:  # a dense cloud of fingerprints
        x = random.choice(list(values)) if random.random() < 0.5 else centre
        for _ in range(random.randint(1, 5)):
            x ^= 1 << random.randrange(64)
        values.add(x)
    prints = {simhash.signed(v): v for v in values}
    df = spark.createDataFrame([(k,) for k in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket_limit=limit)).collect()}
    want = slow_components(prints)
    got = {k: roots.get(k, k) for k in prints}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in m.values()}
    assert groups(got) == groups(want)


def test_no_bucket_is_taken_apart_by_skew_splits(spark):
    random.seed(9)
    centres = [random.getrandbits(64) for _ in range(40)]
    values = {c ^ 1 << a ^ 1 << b for c in centres for a in range(6) for b in range(6)}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.01",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long").repartition(8)
        found = {(r.a, r.b) for r in simhash.links(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    keys = {}
    for m in simhash.covering_masks(3, list(range(64))):
        for v in values:
            keys.setdefault((m, v & m), []).append(simhash.signed(v))
    assert found == {e for x in keys.values() for e in simhash.stars(np.array(x), 3)}


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_stars_find_all_links():
    x = np.array([0, 1, 3, 7, 3 << 40, (3 << 40) | 1, 0xFFFF], dtype=np.int64)
    linked = dict(simhash.stars(x, 1))
    assert linked == {1: 0, 3: 0, 7: 0, (3 << 40) | 1: 3 << 40}
    signs = np.array([simhash.signed(1 << 63 | 0xF0), 0xF0], dtype=np.int64)
    assert simhash.stars(signs, 1) == [(0xF0, simhash.signed(1 << 63 | 0xF0))]


def test_edges_of_the_table(spark):
    schema = "doc_id long, text string, source string"
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0
    rows = [(None, "a b c d", "s"), (None, "a b c d", "s"), (5, "a b c d", "s"), (2, "q r s t", None), (2, "q r s t", None), (None, "only null id", "s")]
    df = spark.createDataFrame(rows, schema)
    ids = sorted((str(r.component_id) for r in simhash.near_duplicates(df).collect()))
    assert ids == ["2", "2", "5", "5", "5", "None"]
    left = simhash.deduplicated(df)
    assert left.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(5, "a b c d"), (2, "q r s t"), (None, "only null id")]))


def test_components_of_near_copies_under_skew_splits(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(8):
        parts = random.choices(words, k=500)
        for _ in range(30):
            parts[random.randrange(len(parts))] = random.choice(words)
            texts.append(" ".join(parts))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.01",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == slow_components({i: slow_print(t) for i, t in enumerate(texts)})
