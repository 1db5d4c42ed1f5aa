"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that no cache knows are held as one flat array of symbols with
the pre-token that each belongs to. A round looks up the merge rank of every pair of
neighbours, finds each pre-token's lowest rank, and applies that pair everywhere in
it at once; pre-tokens without a known pair leave. What survives are the tokens. A merge
only makes pairs of higher rank than its own, so a round gives what one-by-one merging gives.

Such rounds look at every symbol that is left, and a long pre-token needs many. Those above ``LONG``
bytes are therefore merged rank by rank, still synchronously: the places of each rank are kept in a list, a
round takes the list of the lowest rank and applies it in all pre-tokens at once, and only places next
to a merge are looked up anew. Each place enters few lists, so the time grows with the bytes.

Defined results: a null text counts as empty (no bytes, no tokens); texts are taken
whole; repeated rows and null ids are counted row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import InUse
from .common import in_arrow, slices

#: Most cached pre-tokens, in each of two generations; merged pre-tokens of one call.
CACHED_PIECES = 200_000
BATCH_SYMBOLS = 2_000_000
#: Bytes above which a pre-token is merged rank by rank.
LONG = 256


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves,
    the others, in order, from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merges as sorted pair keys with their ranks and results."""

    def __init__(self, merges: list[tuple[int, int, int]], size: int, bytes_to_symbol: np.ndarray):
        table = np.array(merges, dtype=np.int64).reshape(-1, 3)
        keys = table[:, 0] * size + table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.size = size
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int64), table[order, 2]
        self.bytes_to_symbol = bytes_to_symbol
        self.none = len(keys)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs (``none`` where there is no merge) and their places in the table."""
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        if not len(self.keys):
            return np.full(len(keys), self.none), at
        return np.where(self.keys[at] == keys, self.ranks[at], self.none), at

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        is_long = np.array([len(p) > LONG for p in pieces], dtype=bool)
        counts = np.zeros(len(pieces), dtype=np.int64)
        for some, counted in ((np.flatnonzero(~is_long), self._count_short), (np.flatnonzero(is_long), self._count_long)):
            if len(some):
                counts[some] = counted([pieces[i] for i in some.tolist()])
        return counts

    def _count_long(self, pieces: list[bytes]) -> np.ndarray:
        """Rank by rank, over all pieces at once; the places of a rank are touched only then."""
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        n = int(lengths.sum())
        symbols = self.bytes_to_symbol[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        alive = np.ones(n, dtype=bool)
        ranks, results = np.full(n, self.none), np.zeros(n, dtype=np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(places: np.ndarray) -> None:
            """Ranks of the pairs that start at the places, each put on the list of its rank."""
            ranks[places] = self.none
            places = places[after[places] >= 0]
            if not len(places):
                return
            found, at = self.rank(symbols[places], symbols[after[places]])
            known = found != self.none
            places, found = places[known], found[known]
            if not len(places):
                return
            ranks[places], results[places] = found, self.results[at[known]]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for some, rank in zip(np.split(places, cuts), found[np.r_[0, cuts]].tolist(), strict=True):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(heap, rank)
                waiting[rank].append(some)

        look_up(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            lists = waiting.pop(rank)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            places = places[(ranks[places] == rank) & alive[places]]
            if not len(places):
                continue
            if len(places) > 1:  # in a run of one symbol every other pair is taken, from the left
                follows = np.r_[False, after[places[:-1]] == places[1:]]
                if follows.any():
                    index = np.arange(len(places))
                    head = np.maximum.accumulate(np.where(follows, 0, index))
                    places = places[(index - head) % 2 == 0]
            gone = after[places]
            symbols[places] = results[places]
            alive[gone] = False
            ranks[gone] = self.none
            right = after[gone]
            after[places] = right
            inner = right >= 0
            before[right[inner]] = places[inner]
            left = before[places]
            look_up(np.unique(np.concatenate([places, left[left >= 0]])))
        return np.add.reduceat(alive.astype(np.int64), ends - lengths)

    def _count_short(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        counts = lengths.copy()
        symbols = self.bytes_to_symbol[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            ranks, at = self.rank(symbols[:-1], symbols[1:])
            ranks[owner[:-1] != owner[1:]] = self.none
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[heads, len(symbols)])
            lowest = np.minimum.reduceat(np.r_[ranks, self.none], heads)
            here = ranks == np.repeat(lowest, sizes)[:-1]
            here &= ranks != self.none
            # in a run of one symbol every other pair is taken, from the left
            starts = np.flatnonzero(here & ~np.r_[False, here[:-1]])
            run = np.zeros(len(here), dtype=np.int64)
            run[starts] = starts
            place = np.arange(len(here)) - np.maximum.accumulate(run)
            taken = np.flatnonzero(here & (place % 2 == 0))
            if not len(taken):
                break
            symbols[taken] = self.results[at[taken]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[taken + 1] = False
            counts -= np.bincount(owner[taken], minlength=len(counts))
            stays &= np.repeat(lowest != self.none, sizes)  # others are done
            symbols, owner = symbols[stays], owner[stays]
        return counts


class _Counts(dict):
    """Counts of pre-tokens met before, in two generations."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, int] = {}

    def add(self, pieces: list[str], counts: list[int]) -> None:
        if len(self) + len(pieces) > CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        self.update(zip(pieces, counts, strict=True))


class Counter:
    """Counts the tokens of texts as the tokenizer of a byte-level BPE file does."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((vocab[left], vocab[right], vocab[left + right]))
        symbols = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        self.table = MergeTable(merges, max(vocab.values()) + 1, symbols)
        self.split = regex.compile(pattern).findall
        added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        added.sort(key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known = _Counts()
        self.in_use = InUse(self.release)

    def release(self) -> None:
        self.known = _Counts()

    def parts(self, batches):
        with self.in_use:
            for batch in batches:
                yield from slices(batch, 512)

    def _parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special strings, each of which is a token by itself."""
        if self.added is None or not self.added.search(text):
            return self.split(text), 0
        pieces, special, start = [], 0, 0
        for m in self.added.finditer(text):
            pieces += self.split(text[start : m.start()])
            special, start = special + 1, m.end()
        return pieces + self.split(text[start:]), special

    def count(self, texts: list[str]) -> list[int]:
        parts = [self._parts(t) for t in texts]
        known, older = self.known, self.known.older
        fresh = {p for pieces, _ in parts for p in pieces if p not in known}
        recalled = {p: older[p] for p in fresh if p in older}
        new = [p for p in fresh if p not in recalled]
        here: dict[str, int] = dict(recalled)
        start, held = 0, 0
        for i, p in enumerate(new):
            held += len(p)
            if held >= BATCH_SYMBOLS or i == len(new) - 1:
                group = new[start : i + 1]
                counts = self.table.count([g.encode("utf-8") for g in group]).tolist()
                here.update(zip(group, counts, strict=True))
                start, held = i + 1, 0
        out = []
        for pieces, special in parts:
            try:
                n = sum([known[p] if p in known else here[p] for p in pieces])
            except KeyError as missing:
                raise ValueError(f"pre-token without a count: {missing}") from missing
            out.append(n + special)
        short = [p for p in here if len(p) <= 64]
        known.add(short, [here[p] for p in short])
        return out


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    key = (path, pattern)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, pattern)
    return _COUNTERS[key]


def count_tokens(
    df: DataFrame,
    path: str,
    pattern: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, from its whole text."""
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        own = counter(path, pattern)
        for part in own.parts(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            counts = np.array(own.count(texts), dtype=np.int64)
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts),
                    pa.array(counts > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_arrow(source, run, schema)
