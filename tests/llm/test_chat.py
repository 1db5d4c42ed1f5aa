from __future__ import annotations

import itertools

import numpy as np

from plumbline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(n=30):
    rows = []
    for c in range(n):
        turn = 0
        if c % 3 == 0:
            rows.append((c, turn, "system", "Be brief.\nBe kind."))
            turn += 1
        for k in range(1 + c % 4):
            rows.append((c, turn, "user", f"What is {k}?"))
            rows.append((c, turn + 1, "assistant", "It is a number.\nA whole one, and a long line about it to tell it apart from questions.\nNothing else."))
            turn += 2
    return rows


def test_roles_are_recovered(spark):
    df = spark.createDataFrame(conversations(), SCHEMA)
    got = chat.format_conversations(df).collect()
    assert len(got) == 30
    assert sum(r.roles_agree for r in got) >= 28
    one = next(r for r in got if r.conv_id == 1)
    assert one.rendered.startswith("<|user|>\nWhat is 0?\n<|end|>\n<|assistant|>\nIt is a number.")


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    n = len(chat.STATES)
    model = chat.Hmm(rng.normal(size=n), rng.normal(size=(n, n)), [rng.normal(size=(n, k)) for k in (4, 2, 6, 4)])
    seen = [tuple(int(rng.integers(k)) for k in (4, 2, 6, 4)) for _ in range(5)]
    emitted = lambda t, s: sum(e[s, seen[t][i]] for i, e in enumerate(model.emit))

    def score(path):
        total = model.start[path[0]] + emitted(0, path[0])
        return total + sum(model.move[a, b] + emitted(t + 1, b) for t, (a, b) in enumerate(itertools.pairwise(path)))

    best = max(itertools.product(range(n), repeat=5), key=score)
    assert model.viterbi(seen) == list(best)


def test_markers_decide_without_training():
    start, move, emit = chat.prior_counts()
    normal = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    model = chat.Hmm(normal(start), normal(move), [normal(e) for e in emit])
    text = "System: rules\n\nUser: hi there\nmore of it\n\nAssistant: hello\n\nHuman: bye\n### Response\n"
    turns = chat.parse(text, model)
    assert [r for r, _ in turns][:4] == ["system", "user", "assistant", "user"]
    assert turns[1][1] == "hi there\nmore of it"
    assert chat.marker("AI: yes") == ("assistant", "yes") and chat.marker("again, no") == ("none", "again, no")


def test_edges(spark):
    rows = [(None, None, None, None), (1, 0, "user", ""), (2, 0, "user", "x" * 100_000), (2, 0, "user", "x" * 100_000), (3, 5, "robot", "a\nb"), (4, None, "user", "q"), (4, 2500, "assistant", "late")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rendered")
    got = {(r.conv_id, r.segment): r for r in chat.format_conversations(df).collect()}
    assert set(got) == {(None, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 2)}
    assert got[(None, 0)].rendered == "" and got[(1, 0)].found_turns == 0
    assert got[(2, 0)].n_turns == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_segments_are_decoded_as_one_conversation(spark):
    rng = np.random.default_rng(3)
    n = len(chat.STATES)
    model = chat.Hmm(rng.normal(size=n), rng.normal(size=(n, n)), [rng.normal(size=(n, k)) * 0.3 for k in (4, 2, 6, 4)])
    lines = ["Yes.", "Why?", "User: go on", "a long line " * 9, "so", "Bot: ok"]
    rows = [(7, i * 400, "user", lines[int(rng.integers(6))]) for i in range(60)] + [(8, 0, "user", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA)
    parts = sorted((r.segment, r.transcript) for r in chat.transcripts(df).collect() if r.conv_id == 7)
    assert len(parts) > 20
    seen = [chat.observed(t)[1] for _, t in parts]
    ends = chat.borders([model.passage(s) for s in seen])
    joined = [x for s, e in zip(seen, ends, strict=True) for x in model.viterbi(s, *e)]
    whole = [x for s in seen for x in s]
    emitted = model.emitted(whole)

    def score(path):  # orders of equal lines tie, so scores are compared
        moves = sum(model.move[a, b] for a, b in itertools.pairwise(path))
        return model.start[path[0]] + moves + sum(emitted[t, x] for t, x in enumerate(path))

    best = score(model.viterbi(whole))
    assert abs(score(joined) - best) < 1e-9
    assert score([x for s in seen for x in model.viterbi(s)]) < best - 1e-3
    got = {r.segment: r.rendered for r in chat.format_conversations(df, model).collect() if r.conv_id == 7}
    for (segment, text), e in zip(parts, ends, strict=True):
        assert got[segment] == chat.render(chat.parse(text, model, *e))


def test_many_rows_of_one_turn_number_are_cut_into_parts(spark, monkeypatch):
    """3,000 turns that share a null or equal turn number are parts of bounded size, decoded as one."""
    rng = np.random.default_rng(5)
    n = len(chat.STATES)
    model = chat.Hmm(rng.normal(size=n), rng.normal(size=(n, n)), [rng.normal(size=(n, k)) * 0.3 for k in (4, 2, 6, 4)])
    rows = [(1, None, ("user", "assistant", None)[i % 3], f"line {i % 700}." if i % 5 else "Why?") for i in range(3000)]
    rows += [(2, 7, "user", "same")] * 2500 + [(3, i, "user", f"turn {i}") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    parts = chat.transcripts(df, 300).collect()
    assert max(len(r.roles) for r in parts) <= 300
    assert sum(len(r.roles) for r in parts) == len(rows)
    one = sorted((r.part, r.transcript) for r in parts if r.conv_id == 1)
    assert [p for p, _ in one] == list(range(10))
    roles = [x for r in sorted(parts, key=lambda r: r.part) if r.conv_id == 1 for x in r.roles]
    assert roles == sorted(roles, key=lambda x: ["unknown", "assistant", "user"].index(x))
    got = chat.with_borders(chat.transcripts(df, 300), model).collect()
    seen = [chat.observed(t)[1] for _, t in one]
    ends = {r.part: (r._before, r._last) for r in got if r.conv_id == 1}
    joined = [x for i, s in enumerate(seen) for x in model.viterbi(s, *ends[i])]
    whole = [x for s in seen for x in s]
    emitted = model.emitted(whole)

    def score(path):
        moves = sum(model.move[a, b] for a, b in itertools.pairwise(path))
        return model.start[path[0]] + moves + sum(emitted[t, x] for t, x in enumerate(path))

    assert abs(score(joined) - score(model.viterbi(whole))) < 1e-6
    out = chat.format_conversations(df)
    assert out.select("n_turns").groupBy().max().first()[0] <= chat.SEGMENT
    assert out.selectExpr("sum(n_turns)").first()[0] == len(rows)


def slow_model(rows):
    """Counts of :func:`chat.fit` one by one."""
    start, move, emit = chat.prior_counts()
    of = {}
    for c, t, role, text in rows:
        of.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text or ""))
    for turns in of.values():
        before = None
        for place, (_, _, _, role, text) in enumerate(sorted(turns)):
            if role in chat.ROLES:
                lines, seen = chat.observed(text)
                states = [chat.STATES.index((role, i == 0)) for i in range(max(len(lines), 1))]
                if place == 0:
                    start[states[0]] += 1
                elif before in chat.ROLES:
                    for opens in (True, False):
                        move[chat.STATES.index((before, opens)), states[0]] += 0.5
                for a, b in itertools.pairwise(states):
                    move[a, b] += 1
                for state, codes in zip(states, seen, strict=False):
                    for i, code in enumerate(codes):
                        emit[i][state, code] += 1
            before = role
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return log(start), log(move), [log(e) for e in emit]


def test_fit_counts_like_a_slow_version(spark):
    rows = [*conversations(), (50, None, "user", "Hm?"), (50, None, None, "x\n\ny"), (50, 3, "assistant", None), (51, 1200, "user", "a\nb"), (51, 10, "system", "c")]
    model = chat.fit(spark.createDataFrame(rows, SCHEMA))
    start, move, emit = slow_model(rows)
    assert np.allclose(model.start, start) and np.allclose(model.move, move)
    assert all(np.allclose(a, b) for a, b in zip(model.emit, emit, strict=True))


def test_render_is_plain():
    assert chat.render([("user", "a\nb"), ("assistant", "")]) == "<|user|>\na\nb\n<|end|>\n<|assistant|>\n\n<|end|>\n"
    assert chat.render([]) == ""


def test_roles_of_conversations_that_the_model_has_not_seen(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.fit(turns.filter("conv_id % 2 = 0"))
    got = chat.format_conversations(turns.filter("conv_id % 2 = 1"), model).collect()
    assert len(got) > 20 and sum(r.roles_agree for r in got) >= 0.9 * len(got)
