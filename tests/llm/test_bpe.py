from __future__ import annotations

import base64
import hashlib
import random
import struct

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from plumbline.llm import bpe, token_counts  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(5)
    alphabet = list("abeht hién\n  \t!$漢😀ZQ0 '\x1c\x85") + ["<|endoftext|>", "the ", "ing"]
    made = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 80))) for _ in range(400)]
    return ["", " ", "\n\n\n", "a" * 5000, "xyzq" * 3000, "é" * 999, *made]


def test_encodes_like_the_library_and_back(library):
    own = bpe.codec(RANKS, P.PATTERN)
    for text in texts():
        ids = own.ids(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids, step=1) == own.decode(ids) == text


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    own = bpe.Codec(RANKS, P.PATTERN)
    own.machine.max_moves = 20
    for text in texts()[:80]:
        assert own.ids(text) == library.encode_ordinary(text)


def test_compatible_is_what_merging_gives():
    machine = bpe.codec(RANKS, P.PATTERN).machine
    random.seed(2)
    for _ in range(3000):
        a, b = random.randrange(2000), random.randrange(2000)
        left, right = machine.tokens[a], machine.tokens[b]
        assert machine.compatible(a, b) == (bpe.merge_by_rank(left + right, machine.ranks) == [left, right])


def test_output_lags_by_a_bounded_number_of_bytes():
    machine = bpe.Transducer(bpe.load_ranks(RANKS))
    longest = max(map(len, machine.ranks))
    state, emitted, piece = 0, 0, b"abcabcinternationalisation" * 40
    for read, byte in enumerate(piece, 1):
        move = machine.moves.get(state << 8 | byte) or machine._advance(state, byte)
        out, state = divmod(move, bpe.TOKEN)
        ids = [] if not out else [out - 1] if out < bpe.SEVERAL else machine.several[out - bpe.SEVERAL]
        emitted += sum(len(machine.tokens[i]) for i in ids)
        assert read - emitted <= 2 * longest


def test_streaming_decoder_replaces_what_is_no_utf8():
    random.seed(3)
    parts = [0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0xA0, 0x9F, 0x90, 0x8F, 0xFF, 0xC0]
    for _ in range(5000):
        data = bytes(random.choice(parts) for _ in range(random.randint(0, 10)))
        machine, out, i = bpe.Utf8Decoder(), "", 0
        while i < len(data):
            step = random.randint(1, 4)
            out += machine.feed(data[i : i + step])
            i += step
        assert out + machine.finish() == data.decode("utf-8", "replace")


def test_query_rows(spark, library):
    rows = [(1, "the cat", "x"), (2, None, "y"), (None, "", None), (1, "the cat", "x"), (3, "a" * 200_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, RANKS, P.PATTERN).collect()
    assert len(got) == 5
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want = (
            doc_id,
            len(ids),
            hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )
        assert want in [tuple(r) for r in got]
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_ids_column_and_back(spark, library):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    coded = bpe.encode_texts(df, RANKS, P.PATTERN)
    assert {r.doc_id: r.ids for r in coded.collect()} == {1: library.encode_ordinary("one two"), 2: []}
    back = bpe.decode_ids(coded, RANKS, P.PATTERN)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: "one two", 2: ""}
    again = bpe.encode_texts(coded, RANKS, P.PATTERN)  # the column that clashes is replaced
    assert again.columns == coded.columns


def test_counts_like_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    some = [*texts(), "<|endoftext|>" * 3, "x<|endoftext|>y"]
    want = [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert token_counts.counter(path, P.PATTERN).count(some) == want
    df = spark.createDataFrame([*enumerate(some), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.count_tokens(df, path, P.PATTERN).collect()}
    assert [got[i].n_tokens for i in range(len(some))] == want
    assert [got[i].n_bytes for i in range(len(some))] == [len(t.encode()) for t in some]
    assert all(got[i].over_limit == (want[i] > 512) for i in range(len(some)))
    assert (got[-1].n_bytes, got[-1].n_tokens, got[-1].over_limit) == (0, 0, False)
    assert token_counts.count_tokens(df.limit(0), path, P.PATTERN).count() == 0


def test_long_pre_tokens_are_counted_in_time(library):
    import time

    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("byte_bpe_50k.json")
    own, other = token_counts.Counter(path, P.PATTERN), tokenizers.Tokenizer.from_file(path)
    random.seed(11)
    some = ["".join(random.choices(letters, k=n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aeno", "a", "aA", "éu漢") for n in (257, 3000, 20_000)]
    some += ["ab" * 5000, "the" * 4000 + " ", "=" * 9999, "\n" * 3001, "a" * 301 + " " + "b" * 777]
    assert own.count(some) == [len(other.encode(t, add_special_tokens=False).ids) for t in some]
    pieces = [p.encode() for p in some]
    assert (own.table._count_long(pieces) == own.table._count_short(pieces)).all()
    megabyte = "".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=1 << 20))
    began = time.process_time()
    (n,) = own.count([megabyte])
    assert time.process_time() - began < 10
    assert n == len(library.encode_ordinary(megabyte))
