from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import ngrams, quality, toxicity

DOCS = "doc_id long, text string, source string, lang string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = [a + b for a in ("ther", "ing", "ation", "wor", "lan") for b in ("ed", "es", "or", "an", "ion", "st")]


def corpus(n=600, seed=0):
    random.seed(seed)
    docs, labels = [], []
    for i in range(n):
        words = random.choices(WORDS, k=random.randint(5, 120))
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for _ in range(3):
                words[random.randrange(len(words))] = random.choice(["dirtbag", "dirtbags", "scumbag"])
        text = " ".join(words) + "."
        if not good:
            text = " ".join(w.upper() + "!!" for w in words) if i % 8 else " ".join([words[0]] * len(words))
        docs.append((i, text, f"s{i % 7}", "en"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = corpus()
    got = toxicity.toxicity_digest(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 0}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert right >= 0.95 * len(held)


def test_toxicity_does_not_learn_from_held_out_labels(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, DOCS)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a = toxicity.toxicity_digest(d, spark.createDataFrame(labels, LABELS)).collect()
    b = toxicity.toxicity_digest(d, spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("marks", [[], [(1, 1, 1), (2, 1, 1)], [(1, 1, 0)], [(1, None, None), (None, 1, 1)]])
def test_few_labels(spark, marks):
    rows = [(1, "one two three", "s", "en"), (2, None, None, None), (None, "", "s", None), (2, None, None, None), (3, "x" * 300_000, "s", "en")]
    d, l = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, LABELS)
    tox = toxicity.toxicity_digest(d, l).collect()
    assert len(tox) == 5 and all(0 <= r.score <= 1 for r in tox)
    assert {r.predicted for r in tox} == ({1} if len(marks) == 2 and marks[0][2] == 1 else {0})
    judged = quality.judge(d, l).collect()
    assert len(judged) == 5
    assert all(r.keep == bool(r.text) for r in judged)
    assert toxicity.toxicity_digest(d.limit(0), l).count() == 0
    assert quality.judge(d.limit(0), l).count() == 0


def test_clashing_columns_are_replaced(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS score", "'y' AS keep", "'z' AS evidence")
    out = toxicity.classify(d, spark.createDataFrame(labels, LABELS))
    assert dict(out.dtypes)["score"] == "double" and out.columns.count("score") == 1
    judged = quality.judge(d, spark.createDataFrame(labels, LABELS))
    assert dict(judged.dtypes)["keep"] == "boolean" and judged.columns.count("evidence") == 1


def test_quality_keeps_clean_documents(spark):
    docs, labels = corpus()
    half = [r for r in labels if r[0] % 3]
    got = quality.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(half, LABELS)).collect()
    unseen = [r for r in got if r.doc_id % 3 == 0]
    assert sum(r.keep == (r.doc_id % 4 != 0) for r in unseen) >= 0.97 * len(unseen)
    clean = [r for r in unseen if r.doc_id % 4]
    assert sum(r.keep for r in clean) >= 0.98 * len(clean)


def test_site_means_are_shrunk_without_the_document_itself(spark):
    """Against the formulas written out in numpy."""
    rng = np.random.default_rng(3)
    rows = []
    for host, level in (("a", 0.9), ("b", 0.3), ("c", 0.6)):
        for path in ("x", "y"):
            n = 1 if (host, path) == ("c", "y") else 40
            rows += [(host, path, float(np.clip(level + rng.normal() * 0.1, 0.01, 0.99))) for _ in range(n)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    table, mean = quality.site_table(scored)
    p = np.array([r[2] for r in rows])
    assert mean == pytest.approx(p.mean())
    sums = {(r.site_host, r.site_path): r for r in table.collect()}
    assert sums[("a", "x")].s == pytest.approx(sum(r[2] for r in rows if r[:2] == ("a", "x")))
    groups = {}
    for h, q, v in rows:
        groups.setdefault(h, {}).setdefault(q, []).append(v)
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for g in groups.values() for v in g.values()) / (len(p) - 6)
    hosts = {h: np.concatenate([*g.values()]) for h, g in groups.items()}
    between = (sum(len(v) * (v.mean() - p.mean()) ** 2 for v in hosts.values()) - 2 * within) / (len(p) - sum(len(v) ** 2 for v in hosts.values()) / len(p))
    assert sums[("a", "x")].to_all == pytest.approx(within / between, rel=1e-6)


def test_ngram_pairs_stay_within_their_text():
    texts = [b"abc", b"", b"cab abc", b"x" * 500]
    offsets = np.cumsum([0, *map(len, texts)]).tolist()
    together = ngrams.grams(b"".join(texts), offsets)
    for i, t in enumerate(texts):
        alone = ngrams.grams(t, [0, len(t)])[1]
        assert sorted(together[1][together[0] == i]) == sorted(alone)


def test_share_moves_the_bias():
    texts = [b"good words here", b"bad words here"] * 20
    labels = np.array([0, 1] * 20)
    low, high = ngrams.fit(texts, labels, 0.01), ngrams.fit(texts, labels, 0.5)
    assert high.bias - low.bias == pytest.approx(np.log(99))


def test_letters_are_counted_over_the_whole_text():
    from plumbline.llm import quality

    head, tail = "plain words " * 400, "#1 |2 " * 2000
    for text in (head + tail, tail + head):
        share = sum(c.isalpha() for c in text) / len(text)
        assert abs(quality.shape(text)[14] - share) < 1e-12


def test_toxicity_scores_are_those_of_a_slow_version(spark):
    """Document frequencies, ratios, and scores from Python sets of n-grams; the fitted weights are the operator's."""
    docs, labels = corpus(300, seed=4)
    docs += [(900, None, "s", "en"), (901, "", "s", "en"), (902, "Scumbag " * 40_000, "s", "en"), (903, "dirtbag" * 9, None, None), (903, "dirtbag" * 9, None, None)]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit_toxicity(d, l)

    def features(text):
        data = (" " + (text or "") + " ").encode().translate(ngrams._FOLD)
        found = set()
        for size in ngrams.SIZES:
            for i in range(len(data) - size + 1):
                value = size
                for byte in data[i : i + size]:
                    value = value * 0x01000193 % 2**32 ^ byte
                value = value * 0x9E3779B1 % 2**32
                value = (value ^ value >> 15) * 0x85EBCA77 % 2**32
                found.add(value >> 32 - ngrams.BITS)
        return found

    fitted = [(text, toxic) for (i, text, _, _), (_, _, toxic) in zip(docs, labels, strict=False) if zlib.crc32(str(i).encode()) % 5]
    has = [(features(t), y) for t, y in fitted]
    size = [sum(y == k for _, y in has) for k in (0, 1)]
    weight = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    assert len(weight) > 20
    counts = {}
    for f, y in has:
        for place in f:
            counts.setdefault(place, [0, 0])[y] += 1
    strong = {}
    for place, n in counts.items():
        mean = sum(n) / len(has)
        spread = np.sqrt(mean * (1 - mean) * (1 / size[0] + 1 / size[1]))
        if sum(n) >= 3 and (z := abs(n[1] / size[1] - n[0] / size[0]) / max(spread, 1e-12)) > 2:
            strong[place] = z
    assert len(strong) <= ngrams.FEATURES and set(strong) == set(weight)
    ratio = {k: np.log((counts[k][1] + 0.5) / (size[1] + 1) / ((counts[k][0] + 0.5) / (size[0] + 1))) for k in strong}
    alike = [weight[k] * ratio[k] >= 0 for k in strong if strong[k] > 6]
    assert len(alike) > 10 and np.mean(alike) > 0.95  # weights are scaled by the ratios
    want = {}
    for i, text, _, _ in docs:
        if i != 902:
            want[i] = 1 / (1 + np.exp(-(model.bias + sum(weight.get(f, 0.0) for f in features(text)))))
    want[902] = 1 / (1 + np.exp(-(model.bias + sum(weight.get(f, 0.0) for f in features("Scumbag Scumbag ")))))
    got = toxicity.toxicity_digest(d, l).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == int(want[r.doc_id] >= 0.5)


def test_windows_of_ngrams_change_nothing(monkeypatch):
    texts = [b"abc" * 70, b"", b"x y z" * 41, b"q"]
    offsets = np.cumsum([0, *map(len, texts)]).tolist()
    whole = ngrams.grams(b"".join(texts), offsets)
    monkeypatch.setattr(ngrams, "WINDOW", 7)
    cut = ngrams.grams(b"".join(texts), offsets)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_quality_columns_are_those_of_the_formulas(spark):
    docs, labels = corpus(200, seed=2)
    docs += [(500, None, None, None), (501, "a few words of a text", None, "en"), (501, "a few words of a text", None, "en"), (502, "word " * 60_000, "s1", None), (None, "no id at all here", "s1", "de")]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = quality.judge(d, l).collect()
    assert len(got) == len(docs)
    groups = {}
    for r in got:
        groups.setdefault(r.source, {}).setdefault(r.lang, []).append(r.evidence)
    p = np.array([r.evidence for r in got])
    hosts = {h: np.concatenate(list(g.values())) for h, g in groups.items()}
    paths = [np.array(v) for g in groups.values() for v in g.values()]
    n, mean = len(p), p.mean()
    within = max(sum(((v - v.mean()) ** 2).sum() for v in paths) / (n - len(paths)), 1e-9)
    of_hosts = sum(len(v) * v.mean() ** 2 for v in hosts.values())
    of_paths = sum(len(v) * v.mean() ** 2 for v in paths)

    def worth(between, sites, spread):
        return min(within / max(max(between - sites * within, 0) / max(spread, 1e-9), 1e-12), 1e9)

    to_all = worth(of_hosts - n * mean**2, len(hosts) - 1, n - sum(len(v) ** 2 for v in hosts.values()) / n)
    nested = sum(len(np.array(v)) ** 2 / len(hosts[h]) for h, g in groups.items() for v in g.values())
    to_host = worth(of_paths - of_hosts, len(paths) - len(hosts), n - nested)
    odds = lambda x: np.log(x / (1 - x))
    held = lambda x: min(max(x, quality.LOWEST), 1 - quality.LOWEST)
    for r in got:
        own, all_host, path = r.evidence, hosts[r.source], groups[r.source][r.lang]
        host = (all_host.sum() - own + to_all * mean) / (len(all_host) - 1 + to_all)
        site = (sum(path) - own + to_host * host) / (len(path) - 1 + to_host)
        score = 1 / (1 + np.exp(-(odds(held(own)) + odds(held(site)) - odds(held(mean)))))
        if own <= quality.LOWEST:
            score = min(score, quality.LOWEST)
        assert (r.host_mean, r.site_mean, r.quality_score) == pytest.approx((held(host), held(site), score), rel=1e-6)
        assert r.keep == (r.quality_score >= 0.5)


def test_quality_keeps_columns_whatever_their_names(spark):
    docs, labels = corpus(60)
    names = ["n", "s", "host_n", "host_s", "to_all", "to_host", "_host", "_path", "host", "path", "site_host", "of", "kept_0"]
    d = spark.createDataFrame(docs, DOCS).selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names], "NULL AS nothing")
    out = quality.judge(d, spark.createDataFrame(labels, LABELS))
    assert out.columns == [*d.columns, *quality.OUT]
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)


def test_samples_take_whole_long_texts_and_are_bounded(spark):
    from plumbline.llm.labels import labelled_sample

    rows = [(i, "word " * (20_000 if i % 2 else 3), "s", "en") for i in range(40)]
    d = spark.createDataFrame(rows, DOCS)
    l = spark.createDataFrame([(i, i % 4 // 2, 0) for i in range(60)], LABELS)  # ids from 40 on have no text
    texts, marks, share = labelled_sample(d, l, "quality", each=15)
    assert len(texts) == 30 and sum(marks) == 15 and share == 0.5
    assert {len(t) for t in texts} == {15, 100_000}
    few, _, _ = labelled_sample(d, l, "quality", each=15, most_bytes=250_000)
    assert 2 <= len(few) < 30 and sum(map(len, few)) <= 500_000
