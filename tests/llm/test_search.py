from __future__ import annotations

import numpy as np
import pytest

from plumbline.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a hot vector
    rows = [(i, x[i].tolist(), 0) for i in range(n)]
    nothing = [(n, None, 0), (n + 1, [None] * dim, 0), (n + 2, [float("nan")] * dim, 0), (n + 3, [float("inf")] * dim, 0), (None, x[1].tolist(), 0)]
    return rows, nothing, x.astype(np.float64)


def test_top_k_is_brute_force(spark):
    rows, nothing, x = random_rows()
    df = table(spark, rows + nothing)
    got = topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    q = np.floor(256 * x)
    want = []
    for i in range(0, len(x), 50):
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -scores)) if j != i][:5]
        want += [(i, k + 1, int(j), int(scores[j])) for k, j in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_in_small_chunks_and_few_rows(spark):
    rows, _, _ = random_rows(120)
    df = table(spark, rows)
    query = df.filter("vec_id % 10 = 0")
    assert sorted(topk.top_k(df, query, chunk=3).collect()) == sorted(topk.top_k(df, query).collect())
    few = table(spark, rows[:3])
    assert len(topk.top_k(few, few.filter("vec_id = 0")).collect()) == 2
    assert topk.top_k(few.limit(0), few.limit(0)).count() == 0
    assert topk.top_k(few, few.limit(0)).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    rows = [(0, [1e9, 1.0], 0), (1, [1e9, 2.0], 0), (2, [1e9, 3.0], 0), (3, [-1e30, 0.0], 0), (4, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, df.filter("vec_id = 0")).collect()}
    a = int(256e9)
    assert got[(0, 2)] == min(a * a + 256 * 768, 2**63 - 1)
    assert got[(0, 3)] == -(2**63)
    assert (0, 4) not in got


def test_top_k_of_components_beyond_doubles(spark):
    rows = [(0, [1e308, 1.0], 0), (1, [1e308, -5.0], 0), (2, [-1e308, 2.0], 0), (3, [1e-300, 0.25], 0), (4, [0.0, 0.0], 0), (5, [-1e307, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in topk.top_k(df, df).collect()}
    high, low = 2**63 - 1, -(2**63)
    assert [got[(0, i)] for i in (1, 3, 4, 2, 5)] == [(1, high), (2, 64 * 256), (3, 0), (4, low), (5, low)]
    assert got[(3, 0)] == (1, 64 * 256) and got[(3, 2)][1] == 64 * 512 or got[(3, 2)] == (1, 64 * 512)


def test_the_threshold_saves_exact_products():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8192, 64)).astype(np.float32).astype(np.float64)
    columns = topk._columns(64, topk.PARTS)
    side = topk.Side(np.arange(len(x)), x, 256.0, columns)
    q = topk.Side(np.arange(50), x[:50], 256.0, columns)
    lists = [topk.leaders(side.slice(i, i + 2048), q, 5, 256.0) for i in range(0, len(x), 2048)]
    ids, _, scores = (np.concatenate(part) for part in zip(*lists, strict=True))
    cut = np.array([np.sort(scores[ids == i])[-5] for i in range(50)], dtype=np.float64)
    r, c = topk.reaching(side, q, cut)
    assert len(ids) + len(r) < 0.02 * len(x) * 50
    exact = np.floor(256 * x) @ np.floor(256 * x[:50]).T
    need = exact >= cut[None, :]
    assert need[r, c].sum() == need.sum()


def test_searches_ignore_columns_whatever_their_names(spark):
    rows, _, _ = random_rows(80)
    df = table(spark, rows)
    names = ["v", "query_id", "rank", "score", "list", "part", "n", "vec"]
    more = df.selectExpr("*", *[f"'x' AS `{n}`" for n in names])
    for search in (topk.top_k, ann.nearest):
        assert sorted(search(more, more.filter("vec_id % 50 = 0")).collect()) == sorted(search(df, df.filter("vec_id % 50 = 0")).collect())


def test_top_k_against_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(topk.TOP_K_SQL).fetchall())


def brute(x, i, k=5):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y[i]
    return [j for j in np.lexsort((np.arange(len(x)), -np.round(s, 12))) if j != i][:k], s


def test_nearest_recall_and_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=np.float64)
    got = ann.nearest(df, df.filter("vec_id % 5 = 0")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, len(x), 5))
    hit = 0
    for i, entries in found.items():
        entries.sort()
        assert [e[0] for e in entries] == [1, 2, 3, 4, 5]
        want, s = brute(x, i)
        hit += len({e[1] for e in entries} & set(want))
        assert all(abs(s[e[1]] - e[2]) < 1e-12 for e in entries)
    assert hit >= 0.9 * 5 * len(found)


def test_nearest_with_a_hot_vector_and_useless_rows(spark):
    rows, nothing, x = random_rows(600)
    rows.append((600, [0.0] * 16, 0))
    df = table(spark, rows + [(i + 700, v, l) for i, v, l in nothing if i is not None])
    got = ann.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    by = {}
    for r in sorted(got):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0] == list(range(300, 305))  # ties to smaller ids
    assert 600 not in by and all(len(v) == 5 and 600 not in v for v in by.values())


def test_nearest_edges(spark):
    rows, _, _ = random_rows(30)
    few = table(spark, rows[:3])
    assert len(ann.nearest(few, few.filter("vec_id = 0")).collect()) == 2
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0
    one = table(spark, rows[:1])
    assert ann.nearest(one, one).count() == 0


def test_abandoned_rows_are_far():
    rng = np.random.default_rng(0)
    x = ann.unit(rng.normal(size=(2000, 64)))
    q = ann.unit(rng.normal(size=(20, 64)))
    d2 = ((x[:, None] - q[None]) ** 2).sum(2)
    bound = np.sort(d2, axis=0)[4]
    r, c = ann._survivors(x, q, bound, [slice(i, i + 16) for i in range(0, 64, 16)], 2.1)
    near = {(a, b) for a, b in zip(*np.nonzero(d2 <= bound), strict=True)}
    assert len(near & set(zip(r.tolist(), c.tolist(), strict=True))) >= 0.9 * len(near)
    assert len(r) < 3 * len(near)


def test_rows_that_repeat_an_id_are_one_candidate(spark):
    import numpy as np

    from plumbline.llm import ann

    vectors = np.random.default_rng(5).normal(size=(300, 16))
    once = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(once * 6, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(once[:20], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, asked, recall=1.0, epsilon=50.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit[:20] @ unit.T
    near[np.arange(20), np.arange(20)] = -np.inf
    assert [got[i] for i in range(20)] == np.argsort(-near, axis=1)[:, :5].tolist()


def test_probes_are_set_on_rows_held_out_from_the_fit(spark, monkeypatch):
    import numpy as np

    from plumbline.llm import ann

    seen = {}
    fit, probe = ann.fit_centroids, ann.lists_to_probe
    monkeypatch.setattr(ann, "fit_centroids", lambda x, *a: seen.update(fit=x) or fit(x, *a))
    monkeypatch.setattr(ann, "lists_to_probe", lambda x, *a: seen.update(probe=x) or probe(x, *a))
    vectors = np.random.default_rng(6).normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ann.nearest(df, df.limit(3)).count()
    rows = lambda x: {r.tobytes() for r in x}
    assert len(seen["fit"]) == 300 and len(seen["probe"]) == 100
    assert not rows(seen["fit"]) & rows(seen["probe"])


def test_recall_on_the_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        best, _ = brute(x, i)
        hits += len({int(ids[j]) for j in best} & got[int(ids[i])])
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()
