from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import mixing, ngrams, quality, queries, toxicity  # noqa: E402

from slow_versions import slow_survivors  # noqa: E402


def test_stages_keep_their_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if place < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    assert counts[0] > counts[1] >= counts[2] > counts[3] and counts[5] == counts[4]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in docs.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_keep_columns_whatever_their_names(spark, sf_dir):
    """Names of the operators' own and helper columns, and nulls, ties and repeated rows, in every stage."""
    names = ["keep", "score", "predicted", "held_out", "size", "n", "s", "host_n", "host_s", "to_all", "to_host", "host", "path"]
    names += ["evidence", "_host", "_row", "_file", "_fingerprint", "_record", "taken", "copies", "p", "u", "own_set", "kept_0"]
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = some.unionByName(some.filter("doc_id % 3 = 0")).unionByName(
        some.limit(8).selectExpr("CAST(NULL AS bigint) AS doc_id", "IF(doc_id % 2 = 0, text, NULL) AS text", "lang", "CAST(NULL AS string) AS source", "n_chars")
    )
    marked = [f"concat('{n}/', coalesce(doc_id, -1)) AS `{n}`" for n in names]
    docs = docs.selectExpr("*", *marked, "NULL AS nothing").cache()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got, name
        for r in got:
            assert all(r[n] == f"{n}/{-1 if r.doc_id is None else r.doc_id}" for n in names), name


def slow_pipeline(spark, sf_dir) -> Counter:
    """The ids that every stage leaves, with scores from the operators and all decisions made in Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.judge(docs, labels).collect() if r.quality_score >= 0.5}
    left = docs.filter(docs.doc_id.isin(sorted(good)))
    fitted = toxicity.fit_toxicity(left, labels)
    clean = set()
    for i in good:
        data = (texts[i].text or "").encode()
        if ngrams.sigmoid(fitted.log_odds(data, [0, len(data)]))[0] < 0.5:
            clean.add(i)
    stays = slow_survivors({i: texts[i].text for i in sorted(clean)})
    con = duckdb.connect()
    rows = [(i, texts[i].text, texts[i].source) for i in sorted(stays)]  # noqa: F841
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows, strict=True)), strict=True))))
    return Counter({r[0]: r[4] // r[1] for r in con.sql(mixing.MIX_SQL).fetchall() if r[4]})


def test_run_is_that_of_a_slow_pipeline(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == slow_pipeline(spark, sf_dir)


def test_run_and_registered_queries(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    for name, query in found.items():
        rows = query(spark, sf_dir)
        assert rows.count() > 0, name
    assert set(queries.oracle_sql()) <= set(found)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).count() == 0
