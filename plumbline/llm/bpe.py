"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

Encoding. The merges of a rank file define, for every byte string, one valid
token sequence: the one whose neighbouring tokens are all *compatible*, i.e.
merging the bytes of the two tokens gives these two tokens back. That makes
encoding a transduction: a nondeterministic machine guesses token ends while it
walks a trie of the vocabulary and drops guesses whose token is not compatible
with the one before. :class:`Transducer` determinises it lazily. A state is a set
of hypotheses (trie node, last token, output not yet emitted); its successors are
built when a byte first asks for them and kept. As soon as all hypotheses agree on
a token it is emitted, so output lags input by no more than the longest token.

Decoding. :class:`Utf8Decoder` is an incremental UTF-8 state machine: it takes
the bytes of tokens piece by piece, keeps the state of a character that tokens
split, and puts U+FFFD for what is no UTF-8.

Defined results: a null text is an empty one (no ids, empty decoded text); texts
are taken whole whatever their length; repeated rows and null ids are encoded row by
row; an empty table gives an empty result; other columns are carried or ignored, and
an input column named like an output column is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import threading
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, in_arrow, slices, without

#: Seconds after which a worker without a task empties its caches.
IDLE_SECONDS = 2.0
#: Most cached pre-tokens (in each of two generations) and transducer moves of a Python
#: worker; caches that are full are emptied, so memory is bounded and results are the same.
CACHED_PIECES = 150_000
CACHED_MOVES = 400_000
CACHED_PAIRS = 100_000
CACHED_EDGES = 8192
NEVER = 1 << 60
#: How a move packs the next state and what it emits.
TOKEN, SEVERAL = 1 << 28, 1 << 30


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: join the neighbours of lowest rank, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min(
            ((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)),
        )
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Maps the bytes of one pre-token to its token ids."""

    def __init__(self, ranks: dict[bytes, int], max_moves: int = CACHED_MOVES):
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.max_moves = max_moves
        leaf: dict[int, int] = {}
        self.children: list[dict[int, int]] = [{}]
        self.accepts: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                step = self.children[node].get(byte)
                if step is None:
                    step = len(self.children)
                    if self.children[node] is leaf:
                        self.children[node] = {}
                    self.children[node][byte] = step
                    self.children.append(leaf)
                    self.accepts.append(-1)
                node = step
            self.accepts[node] = i
        self._edges: dict[int, tuple] = {}
        self._compatible: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.sets: list[bytes] = []
        self.states: dict[bytes, int] = {}
        self.moves: dict[int, int] = {}
        self.several: list[tuple[int, ...]] = []
        self._state([(0, -1, [])])  # state 0: nothing read yet

    def release(self) -> None:
        self._compatible.clear()
        self._edges.clear()
        self._reset()

    def _state(self, alive: list[tuple]) -> int:
        """Number of a set of hypotheses (trie node, last token, tokens not yet emitted)."""
        flat = []
        for node, last, pending in alive:
            flat += (node, last, len(pending))
            flat += pending
        key = struct.pack(f"{len(flat)}i", *flat)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.sets)
            self.sets.append(key)
        return found

    def _hypotheses(self, state: int):
        flat = memoryview(self.sets[state]).cast("i").tolist()
        i = 0
        while i < len(flat):
            end = i + 3 + flat[i + 2]
            yield flat[i], flat[i + 1], tuple(flat[i + 3 : end])
            i = end

    def _spines(self, token: int):
        """The parts of a token at its left and right edge while it is merged from bytes,
        smallest first, each with the rank of the merge that ends it."""
        found = self._edges.get(token)
        if found is None:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            left, right = [], []
            while len(parts) > 1:
                rank, at = min(
                    (self.ranks.get(parts[i] + parts[i + 1], NEVER), i)
                    for i in range(len(parts) - 1)
                )
                if rank == NEVER:
                    break
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            left.append((parts[0], NEVER))
            right.append((parts[-1], NEVER))
            if len(self._edges) >= CACHED_EDGES:
                self._edges.clear()
            found = self._edges[token] = (left, right, len(parts) == 1)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side; -1 is the start of the pre-token.

        They can if no merge across their border comes before the merges that build them:
        the edge parts of both are walked in the order in which merges end them, and at
        equal ranks the one further left comes first.
        """
        key = left << 32 | right
        known = self._compatible.get(key)
        if known is not None:
            return known
        known = self._spines(right)[2]
        if left >= 0 and known:
            xs, ys = self._spines(left)[1], self._spines(right)[0]
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = xs[i], ys[j]
                rank = self.ranks.get(x + y, NEVER)
                if rank < x_ends and rank <= y_ends:
                    known = False
                    break
                if x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
        if len(self._compatible) >= CACHED_PAIRS:
            self._compatible.clear()
        self._compatible[key] = known
        return known

    def _advance(self, state: int, byte: int) -> int:
        """Determinises one move: the next state and, above ``TOKEN``, what is emitted.

        Emitted are the tokens that all surviving guesses agree on: one plus the token, or, from
        ``SEVERAL`` on, a place in the list of longer outputs.
        """
        alive, children, accepts = [], self.children, self.accepts
        flat = memoryview(self.sets[state]).cast("i").tolist()
        i, size, shortest = 0, len(flat), NEVER
        while i < size:
            held = flat[i + 2]
            step = children[flat[i]].get(byte)
            if step is not None:
                last, pending = flat[i + 1], flat[i + 3 : i + 3 + held]
                if children[step]:
                    alive.append((step, last, pending))
                    if held < shortest:
                        shortest = held
                token = accepts[step]
                if token >= 0 and self.compatible(last, token):
                    alive.append((0, token, [*pending, token]))
                    if held < shortest:
                        shortest = held + 1
            i += 3 + held
        if not alive:
            raise ValueError(f"byte {byte} has no token in the vocabulary")
        agreed = 0
        first = alive[0][2]
        while agreed < shortest and all([h[2][agreed] == first[agreed] for h in alive]):
            agreed += 1
        move = self._state([(n, t, p[agreed:]) for n, t, p in alive] if agreed else alive)
        if agreed == 1:
            move += (first[0] + 1) * TOKEN
        elif agreed:
            self.several.append(tuple(first[:agreed]))
            move += (SEVERAL + len(self.several) - 1) * TOKEN
        self.moves[state << 8 | byte] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # the library gives a pre-token that is a token as it is
            return [whole]
        if len(self.moves) > self.max_moves:
            self._reset()
        moves, state, out = self.moves, 0, []
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._advance(state, byte)
            if move < TOKEN:
                state = move
                continue
            emitted, state = divmod(move, TOKEN)
            if emitted < SEVERAL:
                out.append(emitted - 1)
            else:
                out.extend(self.several[emitted - SEVERAL])
        for node, _, pending in self._hypotheses(state):
            if node == 0:
                out.extend(pending)
                return out
        raise ValueError("the vocabulary has no encoding of this pre-token")


class Utf8Decoder:
    """Incremental UTF-8 state machine; each maximal ill-formed part becomes one U+FFFD."""

    def __init__(self):
        self.held = b""
        self.wanted = 0
        self.low, self.high = 0x80, 0xBF

    def _step(self, byte: int) -> bool:
        """Moves on a byte; False if it can't continue the character that is held."""
        if not self.wanted:
            if 0xC2 <= byte <= 0xDF:
                self.wanted = 1
            elif 0xE0 <= byte <= 0xEF:
                self.wanted = 2
                self.low = 0xA0 if byte == 0xE0 else 0x80
                self.high = 0x9F if byte == 0xED else 0xBF
            elif 0xF0 <= byte <= 0xF4:
                self.wanted = 3
                self.low = 0x90 if byte == 0xF0 else 0x80
                self.high = 0x8F if byte == 0xF4 else 0xBF
            else:
                return byte < 0x80
            return True
        ok = self.low <= byte <= self.high
        self.low, self.high = 0x80, 0xBF
        self.wanted = self.wanted - 1 if ok else 0
        return ok

    def feed(self, data: bytes) -> str:
        out = []
        i, n = 0, len(data)
        while i < n:
            if not self.wanted:
                # the fast path: everything up to a character that may go on in the next piece
                end = n
                back = 1
                while back <= 3 and back <= n - i and 0x80 <= data[n - back] <= 0xBF:
                    back += 1
                if back <= min(3, n - i) and data[n - back] >= 0xC2:
                    end = n - back
                if end > i:
                    out.append(data[i:end].decode("utf-8", "replace"))
                    i = end
                    continue
            byte = data[i]
            was_open = bool(self.wanted)
            if self._step(byte):
                self.held += data[i : i + 1]
                i += 1
                if not self.wanted:
                    out.append(self.held.decode("utf-8"))
                    self.held = b""
            else:
                out.append("�")
                self.held = b""
                if not was_open:
                    i += 1
        return "".join(out)

    def finish(self) -> str:
        left, self.held, self.wanted = self.held, b"", 0
        self.low, self.high = 0x80, 0xBF
        return "�" if left else ""


class _Pieces(dict):
    """Ids of pre-tokens met before, in two generations: the older goes when the newer is full."""

    def __init__(self, machine: Transducer, most: int):
        super().__init__()
        self.machine, self.older, self.most = machine, {}, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.machine.encode(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes texts with one vocabulary; keeps its caches for a Python worker."""

    def __init__(self, path: str, pattern: str, cache: float = 1.0):
        import regex

        self.machine = Transducer(load_ranks(path), int(CACHED_MOVES * cache))
        self.split = regex.compile(pattern).findall
        self.bytes_of = self.machine.tokens
        self.most = int(CACHED_PIECES * cache)
        self.pieces = _Pieces(self.machine, self.most)
        self.in_use = InUse(self.release)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.pieces
        return b"".join([known[p] for p in self.split(text)])

    def release(self) -> None:
        """Empties the caches and forgets the codec; the next task of the worker builds it anew."""
        self.pieces = _Pieces(self.machine, self.most)
        self.machine.release()
        for key in [k for k, c in _CODECS.items() if c is self]:
            del _CODECS[key]
        load_ranks.cache_clear()

    def ids(self, text: str) -> list[int]:
        return memoryview(self.encode(text)).cast("I").tolist()

    def parts(self, batches):
        """Slices of the batches of a task."""
        with self.in_use:
            for batch in batches:
                yield from slices(batch)

    def decode_bytes(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def decode(self, ids, step: int = 4096) -> str:
        machine = Utf8Decoder()
        out = [
            machine.feed(self.decode_bytes(ids[i : i + step])) for i in range(0, len(ids), step)
        ]
        return "".join(out) + machine.finish()


class InUse:
    """While a task runs, its caches stay; a while after the last task of a worker they go, so that
    idle workers leave their memory to other stages."""

    def __init__(self, release, seconds: float | None = None):
        self.release = release
        self.seconds = IDLE_SECONDS if seconds is None else seconds
        self.lock = threading.RLock()
        self.tasks = self.turn = 0

    def __enter__(self):
        with self.lock:
            self.tasks += 1
            self.turn += 1
        return self

    def __exit__(self, *_):
        with self.lock:
            self.tasks -= 1
            timer = threading.Timer(self.seconds, self._idle, [self.turn])
        timer.daemon = True
        timer.start()

    def _idle(self, turn: int) -> None:
        with self.lock:
            if not self.tasks and self.turn == turn:
                self.release()
                pa.default_memory_pool().release_unused()
                give_back()


_CODECS: dict[tuple[str, str, float], Codec] = {}


def codec(path: str, pattern: str, cache: float = 1.0) -> Codec:
    """The worker's codec; ``cache`` scales its caches, about 150 MB at 1."""
    key = (path, pattern, cache)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern, cache)
    return _CODECS[key]


def encode_texts(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids"
) -> DataFrame:
    """Every row with the token ids of its whole text in ``ids_col`` (array<int>)."""
    kept = without(df, [ids_col])
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np

        own = codec(path, pattern)
        for part in own.parts(batches):
            encoded = [own.encode(t or "") for t in part.column(text_col).to_pylist()]
            offsets = np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32)
            values = np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, ids], names=[*part.schema.names, ids_col]
            )

    return in_arrow(kept, run, schema)


def decode_ids(
    df: DataFrame, path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """Every row with the text that ``ids_col`` stands for (null: empty)."""
    kept = without(df, [decoded_col])
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded_col, T.StringType())])

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                texts = [own.decode(i or []) for i in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())],
                    names=[*part.schema.names, decoded_col],
                )

    return in_arrow(kept, run, schema)


def round_trip(
    df: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache: float = 1.0,
) -> DataFrame:
    """Encodes each whole text, decodes its ids with the streaming decoder and digests both.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row. Ids and decoded
    text live only within a slice of a batch, so nothing but digests leaves the worker.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        own = codec(path, pattern, cache)
        for part in own.parts(batches):
            counts, of_ids, of_text = [], [], []
            for text in part.column("text").to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                decoded = own.decode(memoryview(ids).cast("I"))
                of_text.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(of_ids, pa.string()),
                    pa.array(of_text, pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_arrow(source, run, schema)
