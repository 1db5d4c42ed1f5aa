from __future__ import annotations

import random
import time

import pytest

pytest.importorskip("xxhash")

import corpus_pipeline  # noqa: E402

from plumbline.llm import near_copies, simhash  # noqa: E402

from slow_versions import slow_survivors  # noqa: E402


def chained_texts():
    random.seed(8)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(random.choices(words, k=k)) for k in (0, 3, 5, 40, 120, 300, 90, 200)]
    for text in texts[3:]:
        chain = text.split()
        for _ in range(12):  # each within reach of the one before, the last far from the first
            for _ in range(len(chain) // 80 + 1):
                chain[random.randrange(len(chain))] = random.choice(words)
            texts.append(" ".join(chain))
    return [*texts, None, " \n", texts[4].upper(), texts[1], "a b c d e f", "a b c d e f g"]


@pytest.mark.parametrize("limit", [4096, 3])
def test_stage_leaves_one_of_each_group_of_jaccard(spark, limit):
    texts = chained_texts()
    order = random.sample(range(len(texts)), len(texts))
    docs = dict(zip(order, texts, strict=True))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = [r.doc_id for r in near_copies.deduplicated(df, limit=limit).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_survivors(docs)
    if limit == 4096:
        got = [r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()]
        assert len(got) == len(set(got)) and set(got) == slow_survivors(docs)


def test_many_copies_nulls_and_clashing_columns(spark):
    rows = [(i % 7 or None, "one text that comes many times", f"v{i}") for i in range(300)]
    rows += [(50, None, "n"), (None, "", "n"), (None, "only here and without any id at all", "k")]
    names = ["own_set", "own_print", "at_file", "at_row", "node", "root", "key", "keep", "score", "_file", "_row"]
    df = spark.createDataFrame(rows, "doc_id long, text string, v string").selectExpr("*", *[f"v AS {n}" for n in names], "NULL AS nothing")
    for out in (corpus_pipeline.one_of_each(spark, df, ""), simhash.deduplicated(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, rows[-1][1]), (1, rows[0][1]), (50, "")]
        assert all(r[n] == r.v for r in got for n in names)


def test_stage_leaves_no_near_copies_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()}
    assert got == slow_survivors(texts)


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark):
    rows = [(i, f"{chr(97 + i % 20)} b c d e f g h {i % 60}") for i in range(200)]
    rows = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = shuffle_files(spark)
    found = near_copies.groups(near_copies.with_sketch(rows, "text", 5), "text", 5, 0.5)
    for _ in range(50):  # removed in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert found.columns == ["node", "root"] and not left
