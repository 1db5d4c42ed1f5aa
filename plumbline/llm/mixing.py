"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Sources share the mix by weight; a target stops at ``cap`` times its source's size and the excess
goes to the others by weight. Within a source long documents are likelier to be taken: the expected
number of copies of a document is proportional to its length class (the binary digits of its size), up
to ``cap``, so that the expected words of the source are its target. The whole part is allocated to every
document, the rest is its inclusion probability p. Documents are ranked by Pareto's
``(u / (1 - u)) / (p / (1 - p))``, u being a seeded hash, and are taken in that order while their
words fit what the target still lacks, so the sample's size in words is fixed. The gap that is left, less
than a document, is closed by up to ``FITS`` further documents, each time the largest that fits,
and by one more of nearest size if that brings the words nearer to the target.

No source's documents are ordered in one task: histograms of the key, of ``1 << STEP`` bins each,
narrow down where the target is reached until what is left of a source is at most ``EDGE_ROWS`` rows (or
rows of one key), and only these are ranked.

Defined results: a null or blank text has size 0 and is never taken; null sources are one
source, last in order; repeated rows and null ids are ranked by their text as well, and of rows
equal in all of it as many are taken as fit, which of them being open; an empty table gives an empty
result; input columns named like an output column are replaced by it, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, joined, occurrences, without

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
FITS = 2
#: Bits of the key, bits of it that a histogram tells apart, and rows that are ranked at once.
KEY_BITS, STEP = 48, 8
EDGE_ROWS = 4096
OUT = ["size", "source_size", "target", "copies", "taken"]


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def draw_key(id_col: str, text_col: str, seed: int) -> Column:
    """Hexadecimal digest that decides a document's place; the same in any SQL engine with MD5."""
    return F.md5(
        F.concat_ws(
            ":",
            F.lit(str(seed)),
            F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            F.md5(F.coalesce(F.col(text_col), F.lit(""))),
        )
    )


def uniform(key: Column) -> Column:
    """Over 0 and under 1, from the first 48 bits."""
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source_key, source_size`` with ``target``. One row for each source is ordered."""
    in_order = Window.orderBy(F.col("source_key").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_need = Window.orderBy("need", F.col("source_key").asc_nulls_last())
    ranked = (
        sizes.withColumn("w", weight)
        .withColumn("need", F.col("source_size") * cap / F.col("w"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("size_before", F.sum("source_size").over(by_need) - F.col("source_size"))
        .withColumn("w_before", F.sum("w").over(by_need) - F.col("w"))
        .withColumn("rank", F.row_number().over(by_need))
        # the level if this source and those that need more are not at their cap
        .withColumn(
            "level",
            (F.col("all_size") * share - F.col("size_before") * cap)
            / (F.col("all_w") - F.col("w_before")),
        )
    )
    # the first in order of need that stays under its cap sets the level for all after it
    first = F.when(F.col("need") >= F.col("level"), F.struct("rank", "level"))
    level = F.min(first).over(everything).getField("level")
    return ranked.withColumn("shared", level).select(
        "source_key",
        "source_size",
        F.least(
            (F.col("source_size") * cap).cast("double"),
            F.coalesce(F.col("w") * F.col("shared"), (F.col("source_size") * cap).cast("double")),
        ).alias("target"),
    )


def expected_copies(words: DataFrame, aimed: DataFrame, cap: int = CAP) -> DataFrame:
    """``source_key, class_key, source_size, target, whole, p, lacking`` of each length class of a source.

    ``words`` has ``source, class, words``. Copies are ``level * class`` up to ``cap``; few rows a source.
    """
    by_need = Window.partitionBy("source_key").orderBy(F.col("class_key").desc())
    whole_source = Window.partitionBy("source_key")
    mass = F.col("words") * F.col("class_key")
    need = F.try_divide(F.lit(float(cap)), F.col("class_key").cast("double"))
    first = F.when(need >= F.col("level"), F.struct(-F.col("class_key"), F.col("level")))
    expected = F.when(F.col("class_key") == 0, 0.0).otherwise(
        F.least(F.lit(float(cap)), F.coalesce(F.col("class_key") * F.col("shared"), F.lit(float(cap))))
    )
    return (
        joined(words, aimed, words.source.eqNullSafe(aimed.source_key), "inner")
        .withColumnRenamed("class", "class_key")
        .withColumn("words_before", F.sum("words").over(by_need) - F.col("words"))
        .withColumn("mass_left", F.sum(mass).over(whole_source) - F.sum(mass).over(by_need) + mass)
        # the level if this class and the shorter ones are not at their cap
        .withColumn(
            "level",
            F.try_divide(F.col("target") - F.col("words_before") * cap, F.col("mass_left").cast("double")),
        )
        .withColumn("shared", F.min(F.when(F.col("class_key") > 0, first)).over(whole_source)["level"])
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("lacking", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_source))
        .select("source_key", "class_key", "source_size", "target", "whole", "p", "lacking")
    )


def _ranked(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows with the columns of their length class and their place in Pareto's order (null: not drawn)."""
    table = joined(
        rows, base, rows.source.eqNullSafe(base.source_key) & (rows["class"] == base.class_key)
    )
    u = uniform(F.col("key"))
    pareto = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    place = F.struct(pareto.alias("q"), F.col("key"), F.coalesce("doc_id", F.lit(-1)).alias("id"))
    return table.withColumn("place", F.when(F.col("p") > 0, place))


def _edges(drawn: DataFrame, edge_rows: int) -> tuple[DataFrame, int]:
    """For each source the piece of the key's range in which its target is reached and the words before;
    and by how many bits the key is shortened to tell pieces apart."""
    shift = KEY_BITS - STEP
    rows = drawn.withColumn("before", F.lit(0).cast("long"))
    while True:
        running = Window.partitionBy("source_key").orderBy("piece")
        edge = checkpointed(
            rows.groupBy("source_key", F.shiftright("at", shift).alias("piece"))
            .agg(
                F.sum("size").alias("words"),
                F.count("*").alias("rows"),
                F.max("lacking").alias("lacking"),
                F.max("before").alias("before"),
            )
            .withColumn("upto", F.col("before") + F.sum("words").over(running))
            .filter(F.col("upto") > F.col("lacking"))
            .groupBy("source_key")
            .agg(F.min(F.struct("piece", (F.col("upto") - F.col("words")).alias("before"), "rows")).alias("e"))
            .select(F.col("source_key").alias("edge_key"), "e.piece", "e.before", "e.rows")
        )
        if shift == 0 or (edge.agg(F.max("rows")).first()[0] or 0) <= edge_rows:
            return edge.drop("rows"), shift
        rows = _at_edge(drawn, edge, shift)
        shift -= STEP


def _at_edge(drawn: DataFrame, edge: DataFrame, shift: int) -> DataFrame:
    same = F.col("source_key").eqNullSafe(F.col("edge_key"))
    return joined(drawn, edge, same & (F.shiftright("at", shift) == F.col("piece")), "inner")


def mixing_plan(
    rows: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    edge_rows: int = EDGE_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is decided for each length class of a source, the last place that each source takes, and
    the places of which single rows are taken: ``source_key, place, wanted, there``.

    ``rows`` has ``doc_id, source, size, class, key``.
    """
    words = checkpointed(rows.groupBy("source", "class").agg(F.sum("size").alias("words")))
    sizes = words.groupBy(F.col("source").alias("source_key")).agg(F.sum("words").alias("source_size"))
    base = checkpointed(expected_copies(words, targets(sizes, weights, share, cap), cap))
    x = F.col("place.q") / (1 + F.col("place.q"))
    drawn = (
        _ranked(rows, base)
        .filter(F.col("place").isNotNull())
        .select("source_key", "place", "size", "lacking", F.floor(x * (1 << KEY_BITS)).cast("long").alias("at"))
    )
    edge, shift = _edges(drawn, edge_rows)
    kinds = (
        _at_edge(drawn, edge, shift)
        .groupBy("edge_key", "place", "size")
        .agg(F.count("*").alias("n"), F.max("lacking").alias("lacking"), F.max("before").alias("before"))
    )
    running = Window.partitionBy("edge_key").orderBy("place")
    own_words = F.col("n") * F.col("size")
    state = (
        kinds.withColumn("upto", F.col("before") + F.sum(own_words).over(running))
        .filter(F.col("upto") > F.col("lacking"))
        .withColumn("rest", F.col("lacking") - (F.col("upto") - own_words))
        .groupBy("edge_key")
        .agg(F.min(F.struct("place", "size", "n", "rest")).alias("e"))
        .withColumn("fit", F.floor(F.col("e.rest") / F.col("e.size")).cast("long"))
        .select(
            "edge_key",
            F.col("e.place").alias("cut"),
            (F.col("fit") < F.col("e.n")).alias("more"),
            "fit",
            (F.col("e.rest") - F.col("fit") * F.col("e.size")).alias("gap"),
            F.array().cast("array<struct<q:double,key:string,id:bigint>>").alias("closing"),
        )
    )
    state = checkpointed(state)
    same = F.col("source_key").eqNullSafe(F.col("edge_key"))
    for turn in range(FITS + 1):
        beyond = (F.col("place") > F.col("cut")) | (F.col("place") == F.col("cut")) & F.col("more")
        left = joined(drawn, state, same, "inner").filter(
            beyond & (F.col("size") > 0) & ~F.array_contains("closing", F.col("place"))
        )
        miss = F.abs(F.col("gap") - F.col("size"))
        fits = F.col("size") <= F.col("gap") if turn < FITS else miss < F.abs("gap")
        best = (
            left.filter(fits)
            .groupBy(F.col("edge_key").alias("other"))
            .agg(F.min(F.struct(miss.alias("miss"), "place", "size")).alias("best"))
        )
        state = checkpointed(
            state.join(best, F.col("edge_key").eqNullSafe(F.col("other")), "left").select(
                "edge_key",
                "cut",
                "more",
                "fit",
                (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"),
                F.when(F.col("best").isNull(), F.col("closing"))
                .otherwise(F.concat("closing", F.array("best.place")))
                .alias("closing"),
            )
        )
    own = F.struct(F.col("cut").alias("place"), F.col("fit").alias("wanted"))
    added = F.transform("closing", lambda c: F.struct(c.alias("place"), F.lit(1).cast("long").alias("wanted")))
    single = (
        state.select("edge_key", F.explode(F.concat(F.array(own), added)).alias("e"))
        .groupBy("edge_key", F.col("e.place").alias("single"))
        .agg(F.sum("e.wanted").alias("wanted"))
        .filter("wanted > 0")
    )
    there = (
        joined(drawn, single, same & (F.col("place") == F.col("single")), "inner")
        .groupBy("edge_key", "single", "wanted")
        .agg(F.count("*").alias("there"))
    )
    return base, state.select("edge_key", "cut"), checkpointed(there)


def _decided(rows: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Rows with ``source_size, target, copies, taken``."""
    base, cuts, single = plan
    ranked = _ranked(rows, base)
    placed = joined(ranked, cuts.withColumnRenamed("edge_key", "cut_key"), F.col("source_key").eqNullSafe(F.col("cut_key")))
    same = F.col("source_key").eqNullSafe(F.col("edge_key")) & (F.col("place") == F.col("single"))
    placed = joined(placed, single, same)
    partly = F.coalesce(F.col("wanted") < F.col("there"), F.lit(False))
    nth = F.lit(1).cast("long")
    if not single.filter(partly).isEmpty():
        some = occurrences(placed.filter(partly), ["edge_key", "single"])
        placed = placed.filter(~partly).withColumn("nth", nth).unionByName(some)
        nth = F.col("nth")
    before = F.col("cut").isNull() | (F.col("place") < F.col("cut"))
    sampled = F.col("place").isNotNull() & (before | F.coalesce(nth <= F.col("wanted"), F.lit(False)))
    copies = F.coalesce("whole", F.lit(0)) + F.when(sampled, 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("long")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def _mixed(
    df: DataFrame,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """``_record`` (a row of ``df``) with the columns of ``OUT``."""
    size = word_count(text_col)
    narrow = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        draw_key(id_col, text_col, seed).alias("key"),
    ]
    length_class = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_record")
    rows = checkpointed(df.select(*narrow).withColumn("class", length_class))
    plan = mixing_plan(rows, weights, share, cap, edge_rows)
    return _decided(df.select(record, *narrow).withColumn("class", length_class), plan)


def mix(df: DataFrame, seed: int = 7, **options) -> DataFrame:
    """All rows with ``size, source_size, target, copies, taken``."""
    names = without(df, OUT).columns
    return _mixed(df, seed, **options).select(*[F.col(f"_record.`{c}`") for c in names], *OUT)


def mix_digest(df: DataFrame, seed: int = 7, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    ids = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return mix(ids, seed, **options).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every row, all its columns as they are, as often as it is taken."""
    taken = _mixed(df, **options).filter("copies > 0")
    return taken.select("_record", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_record.*")


MIX_SQL = r"""
WITH docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS key
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, source_size * 2 / w AS need, sum(source_size) OVER () AS all_size, sum(w) OVER () AS all_w,
         sum(source_size) OVER (ORDER BY source_size * 2 / w, source NULLS LAST) - source_size AS size_before,
         sum(w) OVER (ORDER BY source_size * 2 / w, source NULLS LAST) - w AS w_before,
         row_number() OVER (ORDER BY source_size * 2 / w, source NULLS LAST) AS place
  FROM sizes
), levels AS (
  SELECT *, (CAST(all_size AS DOUBLE) * 1.5::DOUBLE - CAST(size_before AS DOUBLE) * 2) / (all_w - w_before) AS level
  FROM ranked
), targets AS (
  SELECT source, source_size,
         least(CAST(source_size * 2 AS DOUBLE), w * (SELECT arg_min(level, place) FROM levels WHERE need >= level)) AS target
  FROM levels
), classed AS (
  SELECT *, CASE WHEN size > 0 THEN len(bin(size)) ELSE 0 END AS class FROM docs
), words AS (
  SELECT c.source, class, t.source_size, t.target, CAST(sum(size) AS BIGINT) AS words
  FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), class_levels AS (
  SELECT *, (target - CAST(sum(words) OVER (PARTITION BY source ORDER BY class DESC) - words AS DOUBLE) * 2)
    / CAST(sum(words * class) OVER (PARTITION BY source) - sum(words * class) OVER (PARTITION BY source ORDER BY class DESC) + words * class AS DOUBLE) AS level
  FROM words
), shared AS (
  SELECT source, arg_max(level, class) AS level FROM class_levels WHERE class > 0 AND 2::DOUBLE / class >= level GROUP BY source
), class_plan AS (
  SELECT l.source, l.class, l.source_size, l.target, l.words,
         CASE WHEN class = 0 THEN 0::DOUBLE ELSE least(2::DOUBLE, coalesce(class * s.level, 2::DOUBLE)) END AS e
  FROM class_levels l LEFT JOIN shared s ON l.source IS NOT DISTINCT FROM s.source
), lacks AS (
  SELECT *, target - CAST(sum(CAST(floor(e) AS BIGINT) * words) OVER (PARTITION BY source) AS DOUBLE) AS lacking FROM class_plan
), pareto AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole,
         CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q,
         row_number() OVER (PARTITION BY source, key, coalesce(doc_id, -1)) AS nth
  FROM (
    SELECT c.*, p.source_size, p.target, p.e, p.lacking,
           (CAST(('0x' || substr(c.key, 1, 12)) AS UBIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
    FROM classed c JOIN lacks p ON c.source IS NOT DISTINCT FROM p.source AND c.class = p.class
  )
), running AS (
  SELECT *, CASE WHEN q IS NOT NULL THEN
         sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END)
         OVER (PARTITION BY source ORDER BY q NULLS LAST, key, coalesce(doc_id, -1), nth) END AS upto
  FROM pareto
), gaps AS (
  SELECT *, lacking - coalesce(max(CASE WHEN upto <= lacking THEN upto END) OVER (PARTITION BY source), 0) AS gap
  FROM running
), rest AS (
  SELECT source, size, gap, struct_pack(q := q, key := key, id := coalesce(doc_id, -1)) AS place FROM gaps WHERE upto > lacking AND size > 0
), one AS (
  SELECT source, arg_min(struct_pack(p := place, size := size), struct_pack(m := gap - size, p := place)) AS b FROM rest WHERE size <= gap GROUP BY source
), rest1 AS (
  SELECT r.source, r.size, r.place, r.gap - coalesce(o.b.size, 0) AS gap FROM rest r LEFT JOIN one o ON r.source IS NOT DISTINCT FROM o.source
  WHERE o.b IS NULL OR o.b.p <> r.place
), two AS (
  SELECT source, arg_min(struct_pack(p := place, size := size), struct_pack(m := gap - size, p := place)) AS b FROM rest1 WHERE size <= gap GROUP BY source
), rest2 AS (
  SELECT r.source, r.size, r.place, r.gap - coalesce(o.b.size, 0) AS gap FROM rest1 r LEFT JOIN two o ON r.source IS NOT DISTINCT FROM o.source
  WHERE o.b IS NULL OR o.b.p <> r.place
), three AS (
  SELECT source, arg_min(struct_pack(p := place, size := size), struct_pack(m := abs(gap - size), p := place)) AS b FROM rest2
  WHERE abs(gap - size) < abs(gap) GROUP BY source
), closing AS (
  SELECT source, b.p.key AS key, b.p.id AS id FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)
), beyond AS (
  SELECT source, key, coalesce(doc_id, -1) AS id, min(nth) AS nth FROM gaps WHERE upto > lacking AND size > 0 GROUP BY ALL
)
SELECT g.doc_id, g.size, g.source_size, g.target,
       CAST((whole + CASE WHEN upto <= lacking THEN 1 WHEN c.key IS NOT NULL AND g.nth = b.nth THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM gaps g
LEFT JOIN closing c ON g.source IS NOT DISTINCT FROM c.source AND g.key = c.key AND coalesce(g.doc_id, -1) = c.id
LEFT JOIN beyond b ON g.source IS NOT DISTINCT FROM b.source AND g.key = b.key AND coalesce(g.doc_id, -1) = b.id
"""
