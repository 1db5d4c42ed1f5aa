"""Chat formatting: transcripts are parsed by a hidden Markov model, then rendered as turns.

A transcript is a text whose lines belong to speakers; some lines open with a marker
("User:", "### Assistant", ...), most do not. The states of the model are role and whether a line opens
a turn or goes on with one; what it sees of a line is its marker, whether a blank line is before it, its
length class and how it ends. Start, transition and emission frequencies are grouped counts over
conversations whose roles are known, smoothed; Viterbi finds the likeliest states, and with
them roles and turns. Turns are rendered as ``<|role|>\\n`` text ``\\n<|end|>\\n``.

A transcript is one row, so no conversation is gathered from the whole table in one task
except by its own id: the turns of a conversation are put together by a grouped list, whose partial
lists are combined before the shuffle. Turn numbers from ``SEGMENT`` on make further transcripts of a
conversation (segment 1, 2, ...), and where more than ``SEGMENT`` rows have their turn numbers in one segment
(null, repeated or dense ones), it is cut into parts of that many rows; both bound the row that a hot
conversation id makes. Decoding goes across segments and parts: each is one max-plus matrix from the state
before it to its last state; the matrices of a conversation (some 340 bytes for ``SEGMENT`` turns) give
the states at the borders, and each is decoded between its own, so the path is a best one of the whole
conversation. A turn that goes on over a border is rendered on both sides.

Defined results: null texts are empty turns; null turns come first and ties are ordered by role and text,
between parts by role, the first characters of the text and its hash;
rows that repeat are turns of their own; a null conversation id is a conversation; roles that are
null or unknown are not learned from; an empty transcript has no turns and is rendered as the empty
string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, in_arrow, joined, slices, stored, without

ROLES = ("system", "user", "assistant")
SEGMENT = 1000
#: Words that mark a speaker, by role (fixed values).
MARKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "customer", "you", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "model", "a"),
}
_WORDS = {w: r for r, words in MARKERS.items() for w in words}
_MARKER = re.compile(
    r"^\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?\s*(" + "|".join(sorted(_WORDS, key=len, reverse=True)) + r")\s*(?:\*\*)?"
    r"\s*(?:[:>\]]|\|>|$)\s*(?:\*\*)?\s*",
    re.IGNORECASE,
)
MARKS = (*ROLES, "none")
LENGTHS, ENDS = 6, 4
STATES = [(role, opens) for role in ROLES for opens in (True, False)]


def marker(line: str) -> tuple[str, str]:
    """The role that a line's marker names ("none"), and the line without it."""
    m = _MARKER.match(line)
    return (_WORDS[m[1].lower()], line[m.end() :]) if m else ("none", line)


def observation(line: str, after_blank: bool) -> tuple[int, int, int, int]:
    mark, rest = marker(line)
    rest = rest.rstrip()
    length = min(int(np.log2(1 + len(rest)) / 1.7), LENGTHS - 1)
    end = {"?": 1, ".": 2, "": 3}.get(rest[-1:], 0)
    return MARKS.index(mark), int(after_blank), length, end


def observed(text: str) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """Lines that are not blank and what the model sees of each; the first counts as after a blank."""
    lines, seen, blank = [], [], True
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = True
            continue
        lines.append(line)
        seen.append(observation(line, blank))
        blank = False
    return lines, seen


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray] = field(default_factory=list)

    def emitted(self, seen: list[tuple[int, int, int, int]]) -> np.ndarray:
        codes = np.array(seen)
        return sum(e[:, codes[:, i]] for i, e in enumerate(self.emit)).T

    def passage(self, seen: list[tuple[int, int, int, int]]) -> np.ndarray | None:
        """Best scores of the last state (columns): from the start of a conversation (row 0) and from
        each state before the lines (rows 1 to 6); None without lines."""
        if not seen:
            return None
        emitted = self.emitted(seen)
        score = np.vstack([self.start, self.move]) + emitted[0]
        for t in range(1, len(seen)):
            score = (score[:, :, None] + self.move).max(axis=1) + emitted[t]
        return score

    def viterbi(
        self, seen: list[tuple[int, int, int, int]], before: int | None = None, last: int | None = None
    ) -> list[int]:
        """The likeliest states, after the state ``before`` and up to the state ``last`` if given; of
        equal ones the first."""
        if not seen:
            return []
        emitted = self.emitted(seen)
        score = (self.start if before is None else self.move[before]) + emitted[0]
        back = np.zeros((len(seen), len(STATES)), dtype=np.int64)
        for t in range(1, len(seen)):
            paths = score[:, None] + self.move
            back[t] = paths.argmax(axis=0)
            score = paths[back[t], np.arange(len(STATES))] + emitted[t]
        states = [int(score.argmax()) if last is None else last]
        for t in range(len(seen) - 1, 0, -1):
            states.append(int(back[t, states[-1]]))
        return states[::-1]


def borders(passages: list[np.ndarray | None]) -> list[tuple[int | None, int | None]]:
    """(state before, last state) of each segment on a best path through all, from :meth:`Hmm.passage`."""
    scores, score = [], None
    for m in passages:
        scores.append(score)
        if m is not None:
            score = m[0] if score is None else (score[:, None] + m[1:]).max(axis=0)
    state = None if score is None else int(score.argmax())
    found = []
    for m, score in zip(passages[::-1], scores[::-1], strict=True):
        if m is None:
            found.append((None, None))
        elif score is None:
            found.append((None, state))
        else:
            before = int((score + m[1:, state]).argmax())
            found.append((before, state))
            state = before
    return found[::-1]


def prior_counts() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pseudo-counts: a marker speaks for its role, turns open after blank lines, roles take turns."""
    n = len(STATES)
    start = np.array([1.0 if opens else 1e-6 for _, opens in STATES])
    move = np.full((n, n), 1e-6)
    marks = np.full((n, len(MARKS)), 0.02)
    blanks = np.full((n, 2), 0.5)
    for i, (role, opens) in enumerate(STATES):
        for j, (other, opens_next) in enumerate(STATES):
            if opens_next:
                move[i, j] = 0.05 if other == role or other == "system" else 1.0
            elif other == role:
                move[i, j] = 1.0
        marks[i, MARKS.index("none")] = 1.0
        if opens:
            marks[i, MARKS.index(role)] = 3.0
        blanks[i] = (0.05, 1.0) if opens else (1.0, 0.3)
    return start, move, [marks, blanks, np.full((n, LENGTHS), 0.5), np.full((n, ENDS), 0.5)]


def _turn_events(role: str, text: str, first: bool, before: str | None) -> list[tuple[str, int, int]]:
    """(kind, state or earlier state, state or code) of each line of one labelled turn."""
    lines, seen = observed(text)
    events = []
    states = [STATES.index((role, i == 0)) for i in range(max(len(lines), 1))]
    if first:
        events.append(("start", 0, states[0]))
    elif before in ROLES:
        events.append(("next", ROLES.index(before), states[0]))
    for a, b in zip(states, states[1:], strict=False):
        events.append(("move", a, b))
    if len(states) > 1:
        events.append(("last", states[-1], 0))
    for state, codes in zip(states, seen, strict=False):
        events += [(f"emit{i}", state, c) for i, c in enumerate(codes)]
    return events


def ordered_turns() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def fit(turns: DataFrame) -> Hmm:
    """Counts over all labelled turns ``conv_id, turn, role, text``, summed before the shuffle."""
    return fit_segments(segments(turns))


def fit_segments(cut: DataFrame) -> Hmm:
    """:func:`fit` on the rows of :func:`segments`."""
    import pyarrow as pa

    by_place = Window.partitionBy("conv_id", "segment", "part").orderBy(*ordered_turns())
    ends = cut.groupBy("conv_id", "segment", "part").agg(F.max(F.struct("turn", "role"))["role"].alias("end"))
    by_segment = Window.partitionBy("conv_id").orderBy("segment", "part")
    ends = ends.select(
        F.col("conv_id").alias("of"),
        F.col("segment").alias("at"),
        F.col("part").alias("at_part"),
        F.lag("end").over(by_segment).alias("end_before"),
        F.row_number().over(by_segment).alias("nth"),
    ).filter("nth > 1")
    placed = cut.select(
        "conv_id",
        "segment",
        "part",
        "role",
        "text",
        F.lag("role").over(by_place).alias("before"),
        (F.row_number().over(by_place) == 1).alias("heads"),
    )
    same = placed.conv_id.eqNullSafe(ends.of) & (placed.segment == ends["at"]) & (placed.part == ends.at_part)
    rows = placed.join(ends, placed.heads & same, "left").select(
        "role",
        "text",
        F.coalesce("before", "end_before").alias("before"),
        (F.col("heads") & F.col("nth").isNull()).alias("first"),
    )
    rows = rows.filter(F.col("role").isin(*ROLES))

    def count(batches):
        found: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("role", "text", "first", "before")]
            for role, text, first, before in zip(*columns, strict=True):
                for e in _turn_events(role, text or "", first, before):
                    found[e] = found.get(e, 0) + 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array([found[k] for k in keys], pa.int64()),
            ],
            names=["kind", "a", "b", "n"],
        )

    counted = in_arrow(rows, count, "kind string, a int, b int, n long")
    start, move, emit = prior_counts()
    for r in counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        if r.kind == "start":
            start[r.b] += r.n
        elif r.kind == "move":
            move[r.a, r.b] += r.n
        elif r.kind == "next":  # from either state of the earlier role
            for i, (role, _) in enumerate(STATES):
                if role == ROLES[r.a]:
                    move[i, r.b] += r.n / 2
        elif r.kind.startswith("emit"):
            emit[int(r.kind[4:])][r.a, r.b] += r.n
    normal = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Hmm(normal(start), normal(move), [normal(e) for e in emit])


def parse(
    text: str, model: Hmm, before: int | None = None, last: int | None = None
) -> list[tuple[str, str]]:
    """The turns (role, text) of a transcript, or of a segment between two states."""
    lines, seen = observed(text)
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, model.viterbi(seen, before, last), strict=True):
        role, opens = STATES[state]
        clean = marker(line)[1] if opens else line
        if opens or not turns or turns[-1][0] != role:
            turns.append((role, [clean]))
        else:
            turns[-1][1].append(clean)
    return [(role, "\n".join(part).strip()) for role, part in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def segments(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, part, turn, role, text``; the segment is the turn number over ``size``, the part
    the row's place in it over ``size``."""
    cut = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / size), F.lit(0)).cast("long").alias("segment"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    none = F.lit(0).cast("long")
    counts = cut.groupBy("conv_id", "segment").count().filter(F.col("count") > size)
    hot = checkpointed(counts.select(F.col("conv_id").alias("of"), F.col("segment").alias("at"), "count"))
    rows = hot.agg(F.sum("count")).first()[0]
    if not rows:
        return cut.withColumn("part", none)
    same = cut.conv_id.eqNullSafe(F.col("of")) & (cut.segment == F.col("at"))
    others = joined(cut, hot, same, "left_anti").withColumn("part", none)
    # sorted in pieces of some 64 parts; rows are numbered within a piece and pieces by their counts
    long = stored(joined(cut, hot.drop("count"), same, "left_semi").withColumn("nth", F.monotonically_increasing_id()))
    order = [F.col("turn"), F.col("role"), F.substring("text", 1, 32), F.xxhash64("text"), F.col("nth")]
    sorted_out = long.repartitionByRange(-(-rows // (64 * size)), "conv_id", "segment", *order)
    long = stored(sorted_out.withColumn("piece", F.spark_partition_id()))
    in_piece = Window.partitionBy("conv_id", "segment", "piece").orderBy(*[c.asc_nulls_first() for c in order])
    earlier = Window.partitionBy("of", "at").orderBy("of_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        long.groupBy(F.col("conv_id").alias("of"), F.col("segment").alias("at"), F.col("piece").alias("of_piece"))
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    numbered = long.withColumn("place", F.row_number().over(in_piece) - 1)
    same = numbered.conv_id.eqNullSafe(before.of) & (numbered.segment == before["at"]) & (numbered.piece == before.of_piece)
    parts = joined(numbered, before, same, "inner").withColumn(
        "part", F.floor((F.col("place") + F.col("before")) / size).cast("long")
    )
    return others.unionByName(parts.select(*others.columns))


def transcripts(turns: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``conv_id, segment, part, roles, transcript``: turns in order, a blank line between them."""
    return transcripts_of(segments(turns, size))


def transcripts_of(cut: DataFrame) -> DataFrame:
    gathered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return (
        cut.groupBy("conv_id", "segment", "part")
        .agg(gathered.alias("t"))
        .select(
            "conv_id",
            "segment",
            "part",
            F.transform("t", lambda x: F.coalesce(x.role, F.lit("unknown"))).alias("roles"),
            F.array_join(F.col("t.text"), "\n\n").alias("transcript"),
        )
    )


def format_transcripts(df: DataFrame, model: Hmm, text_col: str = "transcript") -> DataFrame:
    """All rows with ``found_roles`` (array), ``n_lines`` and ``rendered``."""
    import pyarrow as pa
    from pyspark.sql import types as T

    kept = without(df, ["found_roles", "n_lines", "rendered"])
    bordered = {"_before", "_last"} <= set(df.columns)
    schema = T.StructType(
        [
            *kept.schema.fields,
            T.StructField("found_roles", T.ArrayType(T.StringType())),
            T.StructField("n_lines", T.LongType()),
            T.StructField("rendered", T.StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ends = [(None, None)] * len(texts)
                if bordered:
                    ends = zip(*[part.column(c).to_pylist() for c in ("_before", "_last")], strict=True)
                found = [parse(t, model, *e) for t, e in zip(texts, ends, strict=True)]
                lines = [sum(1 for x in t.split("\n") if x.strip()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([[r for r, _ in f] for f in found], pa.list_(pa.string())),
                        pa.array(lines, pa.int64()),
                        pa.array([render(f) for f in found], pa.string()),
                    ],
                    names=[*part.schema.names, "found_roles", "n_lines", "rendered"],
                )

    return in_arrow(kept, run, schema)


def with_borders(cut: DataFrame, model: Hmm) -> DataFrame:
    """The transcripts with ``_before`` and ``_last``: the states at the borders of conversations of
    several segments, null elsewhere."""
    import pyarrow as pa

    key = ["conv_id", "segment", "part"]

    def pass_through(batches):
        for batch in batches:
            for part in slices(batch):
                found = [model.passage(observed(t)[1]) for t in part.column("transcript").to_pylist()]
                flat = [None if m is None else m.ravel().tolist() for m in found]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in key], pa.array(flat, pa.list_(pa.float64()))],
                    names=[*key, "m"],
                )

    def decide(group: pa.Table) -> pa.Table:
        group = group.sort_by([("segment", "ascending"), ("part", "ascending")])
        flat = group.column("m").to_pylist()
        ends = borders([None if m is None else np.array(m).reshape(-1, len(STATES)) for m in flat])
        columns = [group.column(c) for c in key]
        columns += [pa.array([e[i] for e in ends], pa.int32()) for i in (0, 1)]
        return pa.table(columns, names=["of", "at", "at_part", "_before", "_last"])

    several = cut.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("several"))
    parts = cut.join(several, cut.conv_id.eqNullSafe(several.several), "left_semi")
    passed = in_arrow(
        parts.select(*key, "transcript"), pass_through, "conv_id long, segment long, part long, m array<double>"
    )
    schema = "of long, at long, at_part long, _before int, _last int"
    ends = passed.groupBy("conv_id").applyInArrow(decide, schema)
    on = cut.conv_id.eqNullSafe(ends.of) & (cut.segment == ends["at"]) & (cut.part == ends.at_part)
    return cut.join(ends, on, "left").drop("of", "at", "at_part")


def format_conversations(turns: DataFrame, model: Hmm | None = None) -> DataFrame:
    """``conv_id, segment, part, n_turns, n_lines, found_turns, roles_agree, rendered`` of all conversations.

    The roles of the table train the model and are not shown to Viterbi; ``roles_agree``
    says whether the roles found are the ones given.
    """
    cut = segments(turns)
    model = model or fit_segments(cut)
    return format_transcripts(with_borders(stored(transcripts_of(cut)), model), model).select(
        "conv_id",
        "segment",
        "part",
        F.size("roles").cast("long").alias("n_turns"),
        "n_lines",
        F.size("found_roles").cast("long").alias("found_turns"),
        (F.col("roles") == F.col("found_roles")).alias("roles_agree"),
        "rendered",
    )
