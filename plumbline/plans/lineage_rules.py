"""Queries on evidence, frames, constraints, rules, digests, documents and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data
from ..operators import frames_select, lineage, mapping, rules
from ..streaming import coverage as stream
from .registry import query, r6

_EVIDENCE = """WITH scans AS (SELECT c_custkey AS scan_id, 'G' || (c_custkey - CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) AS guid FROM customer),
images AS (SELECT o_orderkey AS image_id, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'X' || o_custkey ELSE 'G' || o_custkey END AS guid FROM orders),
rows_ AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 15 = 0 THEN o_custkey + 1 ELSE o_custkey END AS target, o_orderkey % 2 = 0 AS vendor FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, o_custkey + 2, false FROM orders WHERE o_orderkey % 35 = 0),
e AS (SELECT image_id, any_value(i.guid) AS guid, list_sort(list(DISTINCT scan_id) FILTER (scan_id IS NOT NULL)) AS embedded FROM images i LEFT JOIN scans s ON i.guid = s.guid GROUP BY 1),
r AS (SELECT image_id, count(*) AS n_rows, count(DISTINCT target) AS targets, bool_or(vendor) AS vendor, list_sort(list(DISTINCT scan_id) FILTER (scan_id IS NOT NULL)) AS by_rows
  FROM rows_ LEFT JOIN scans ON target = scan_id GROUP BY 1),
j AS (SELECT image_id, guid, n_rows, targets, vendor, coalesce(len(embedded), 0) AS own, coalesce(len(by_rows), 0) AS told, coalesce(list_has_any(by_rows, embedded), false) AS meet FROM e LEFT JOIN r USING (image_id)),
m AS (SELECT image_id, CASE WHEN n_rows IS NOT NULL AND targets > 1 THEN 'conflict'
  WHEN n_rows IS NOT NULL AND guid IS NOT NULL AND (told > 0 OR own > 0) AND NOT meet THEN 'conflict'
  WHEN n_rows IS NOT NULL AND told = 0 THEN 'orphan' WHEN n_rows IS NOT NULL AND told > 1 THEN 'ambiguous'
  WHEN n_rows IS NOT NULL AND (vendor OR (own = 1 AND meet)) THEN 'confirmed' WHEN n_rows IS NOT NULL THEN 'manual'
  WHEN guid IS NULL THEN 'unmapped' WHEN own = 0 THEN 'orphan' WHEN own = 1 THEN 'confirmed' ELSE 'ambiguous' END AS status FROM j)"""


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = data.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    scan = F.col("c_custkey")
    scans = data.table(spark, sf_dir, "customer").select(
        scan.alias("scan_id"), F.concat(F.lit("G"), (scan - (scan % 10 == 0).cast("int")).cast("string")).alias("guid")
    )
    guid = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, F.concat(F.lit("X"), cust.cast("string"))).otherwise(F.concat(F.lit("G"), cust.cast("string")))
    images = orders.select(key.alias("image_id"), guid.alias("guid"))
    first = orders.filter(key % 5 == 0).select(key.alias("image_id"), F.when(key % 15 == 0, cust + 1).otherwise(cust).alias("target"), (key % 2 == 0).alias("vendor"))
    second = orders.filter(key % 35 == 0).select(key.alias("image_id"), (cust + 2).alias("target"), F.lit(False).alias("vendor"))
    return mapping.evidence_mapping(images, scans, first.unionByName(second))


@query(_EVIDENCE + " SELECT image_id, status FROM m")
def evidence_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapping(spark, sf_dir).select("image_id", "status")


@query(_EVIDENCE + " SELECT status, count(*) AS n FROM m GROUP BY 1")
def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.status_counts(_mapping(spark, sf_dir))


@query(
    """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 33 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 10 <> 3
UNION ALL SELECT -1 - doc_id, lang, n_chars FROM documents WHERE doc_id % 50 = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'extra' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'differs' END AS kind,
 CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END) END AS fields
FROM documents a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang IS DISTINCT FROM b.lang OR a.n_chars IS DISTINCT FROM b.n_chars"""
)
def keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    d = F.col("doc_id")
    changed = docs.filter(d % 10 != 3).select(
        "doc_id", F.when(d % 11 == 0, "xx").otherwise(F.col("lang")).alias("lang"), (F.col("n_chars") + (d % 33 == 0).cast("int")).alias("n_chars")
    )
    extra = docs.filter(d % 50 == 0).select((-1 - d).alias("doc_id"), "lang", "n_chars")
    return mapping.keyed_diff(docs, changed.unionByName(extra), "doc_id", ["lang", "n_chars"])


@query(
    """SELECT 'order without customer' AS issue, o_orderkey::VARCHAR AS item FROM orders WHERE o_custkey % 97 = 0
UNION ALL SELECT 'repeated line', l_orderkey || '/' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'label without document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def constraint_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = data.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = data.table(spark, sf_dir, "customer").filter("c_custkey % 97 <> 0")
    lines = mapping.repeated(data.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    labels = mapping.orphans(data.table(spark, sf_dir, "labels"), data.table(spark, sf_dir, "documents"), "doc_id", "doc_id")
    return mapping.issues(
        ("order without customer", mapping.orphans(orders, customers, "o_custkey", "c_custkey"), F.col("o_orderkey")),
        ("repeated line", lines, F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))),
        ("label without document", labels, F.col("doc_id")),
    )


@query(
    f"""WITH RECURSIVE {data.FRAMES}, sharp AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS i FROM frames WHERE blur >= 60),
walk(source, i, event_id, last_, reason) AS (
  SELECT source, i, event_id, hash, 'keep' FROM sharp WHERE i = 1
  UNION ALL SELECT s.source, s.i, s.event_id, CASE WHEN bit_count(xor(s.hash, w.last_)) <= 10 THEN w.last_ ELSE s.hash END,
    CASE WHEN bit_count(xor(s.hash, w.last_)) <= 10 THEN 'duplicate' ELSE 'keep' END FROM walk w JOIN sharp s ON s.source = w.source AND s.i = w.i + 1)
SELECT f.source, f.event_id, coalesce(w.reason, 'blurred') = 'keep' AS keep, coalesce(w.reason, 'blurred') AS reason FROM frames f LEFT JOIN walk w ON f.event_id = w.event_id"""
)
def frame_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames_select.select_frames(data.frames(spark, sf_dir), ["source"], ["ts", "event_id"], "blur", "hash", 60.0, 10)
    return rows.select("source", "event_id", "keep", "reason")


@query(
    f"""WITH {data.FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) - 1 AS i FROM frames)
SELECT source, 'seg_' || lpad((i // 20)::VARCHAR, 4, '0') AS group_id, count(*) AS n FROM p GROUP BY ALL"""
)
def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames_select.consecutive_groups(data.frames(spark, sf_dir), ["source"], ["ts", "event_id"], 20)
    return rows.groupBy("source", "group_id").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (
  SELECT s_suppkey AS id, s_suppkey AS k, CASE WHEN s_suppkey % 9 <> 0 THEN 'surveyed' END AS scale_basis,
         CASE s_suppkey % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'e57' ELSE 'video360' END AS source,
         s_suppkey % 5 <> 0 AS has_reg, CASE WHEN s_suppkey % 7 <> 0 THEN 'r' || s_suppkey END AS reg_id,
         CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 0.9 END AS inlier, s_suppkey % 13 <> 0 AS allowed,
         CASE WHEN s_suppkey % 4 = 0 THEN 'none' WHEN s_suppkey % 4 = 1 THEN 'clear' ELSE 'over' END AS support,
         s_suppkey % 4 > 1 AS tests, s_suppkey % 8 = 7 AS leak, s_suppkey % 6 <> 5 AS held, s_suppkey % 10 <> 3 AS gone, s_suppkey % 17 <> 2 AS declared
  FROM supplier
), v AS (
  SELECT *, source LIKE 'video%' AS video, source LIKE 'video%' AND has_reg AND inlier > 0 AS usable,
         has_reg AND CASE support WHEN 'none' THEN reg_id IS NOT NULL WHEN 'clear' THEN false ELSE true END AS rests FROM m
), r AS (
  SELECT *, concat_ws('; ', CASE WHEN scale_basis IS NULL THEN 'no scale' END, CASE WHEN video AND NOT has_reg THEN 'video without registration' END,
      CASE WHEN video AND has_reg AND NOT usable THEN 'registration without usable figures' END,
      CASE WHEN usable AND reg_id IS NULL THEN 'registration without a record' END, CASE WHEN usable AND NOT allowed THEN 'registration permits no claim' END) AS metric,
    CASE WHEN tests AND leak THEN 'test groups in the initial cloud' ELSE '' END AS views,
    concat_ws('; ', CASE WHEN held AND NOT gone THEN 'points of the holdout not excluded' END, CASE WHEN held AND NOT declared THEN 'holdout not declared as excluded' END,
      CASE WHEN held AND rests THEN 'registered on the holdout' END) AS ranges FROM v
), d AS (SELECT *, tests AND views = '' AS novel, held AND metric = '' AND ranges = '' AS geometry FROM r)
SELECT id, concat_ws(',', CASE WHEN novel THEN 'novel_view' END, CASE WHEN geometry THEN 'geometry_holdout' END, CASE WHEN NOT novel AND NOT geometry THEN 'reconstruction' END) AS protocols,
  concat_ws(',', 'geometry_diagnostic', CASE WHEN novel THEN 'render_quality' END, CASE WHEN geometry THEN 'geometry_accuracy,volume_accuracy' END) AS claims,
  concat_ws('; ', nullif(metric, ''), nullif(views, ''), nullif(ranges, '')) AS refused FROM d"""
)
def protocol_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of scanner and video surveys: scale, registration, leaks, holdout and its support."""
    k = F.col("s_suppkey")
    span = lambda lo, hi: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    support = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.array(span(0.0, 40.0))).otherwise(F.array(span(0.0, 41.0)))
    registration = F.struct(
        F.when(k % 7 != 0, F.concat(F.lit("r"), k)).alias("id"),
        F.when(k % 11 == 0, 0.0).otherwise(0.9).alias("inlier_ratio"),
        F.lit(0.01).alias("rmse"),
        (k % 13 != 0).alias("claim_allowed"),
        support.alias("support"),
    )
    none = F.array().cast("array<struct<lo:double,hi:double>>")
    rows = data.table(spark, sf_dir, "supplier").select(
        k.alias("id"),
        F.when(k % 9 != 0, "surveyed").alias("scale_basis"),
        F.when(k % 3 == 0, "video").when(k % 3 == 1, "e57").otherwise("video360").alias("source"),
        F.when(k % 5 != 0, registration).alias("registration"),
        F.when(k % 4 > 1, F.array(F.lit("g1"), F.lit("g2"))).otherwise(F.array().cast("array<string>")).alias("test_groups"),
        F.when(k % 8 == 7, F.array(F.lit("g2"), F.lit("g3"))).otherwise(F.array(F.lit("g3"))).alias("init_groups"),
        F.when(k % 6 != 5, F.array(span(40.0, 46.0), span(90.0, 95.0))).otherwise(none).alias("holdout"),
        (k % 10 != 3).alias("points_excluded"),
        F.when(k % 17 != 2, F.array(span(39.5, 46.5), span(90.0, 95.0))).otherwise(F.array(span(39.5, 46.5), span(90.0, 94.0))).alias("excluded"),
    )
    return rules.judge(rows).select("id", "protocols", "claims", "refused")


@query(
    """WITH g AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_retailprice END AS rmse, p_size::DOUBLE AS inliers FROM part)
SELECT id, concat_ws('; ', CASE WHEN rmse IS NULL OR rmse > 1500 THEN 'rmse over 1500' END, CASE WHEN inliers < 10 THEN 'inliers under 10' END) AS refused,
 NOT (rmse IS NULL OR rmse > 1500 OR inliers < 10) AS allowed FROM g"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_retailprice")).alias("rmse"), F.col("p_size").cast("double").alias("inliers")
    )
    out = rules.gate(rows, {"rmse": ("max", 1500.0), "inliers": ("min", 10.0)})
    return out.select("id", F.array_join("refusals", "; ").alias("refused"), "allowed")


@query(
    """WITH f AS (SELECT source, lang || '/' || doc_id AS path, sha256(coalesce(text, '')) AS sha FROM documents)
SELECT source, count(*) AS files, sha256(string_agg(path || sha, '' ORDER BY string_split(path, '/'))) AS digest FROM f GROUP BY 1"""
)
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = data.table(spark, sf_dir, "documents").select(
        "source", F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")
    )
    return lineage.tree_digest(docs, ["source"])


@query(
    """SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 10 = 0 THEN 'missing' ELSE 'sha256' END AS problem FROM pages WHERE page_id % 10 = 0 OR page_id % 7 = 0
UNION ALL SELECT 'x' || page_id, 'extra' FROM pages WHERE page_id % 25 = 0"""
)
def verify_output_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of pages against a copy with lost, changed (same size) and added files."""
    pages = data.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    k = F.col("page_id")
    want = lineage.file_table(pages, "page_id", "html")
    changed = pages.filter(k % 10 != 0).withColumn("html", F.when(k % 7 == 0, F.overlay("html", F.lit("#"), F.lit(1))).otherwise(F.col("html")))
    extra = pages.filter(k % 25 == 0).select(F.concat(F.lit("x"), k.cast("string")).alias("page_id"), "html")
    have = lineage.file_table(changed.withColumn("page_id", k.cast("string")).unionByName(extra), "page_id", "html")
    return lineage.verify_tree(want, have)


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c(conv_id, i, turn, fingerprint) AS (SELECT conv_id, i, turn, sha256('|' || text) FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.i, t.turn, sha256(c.fingerprint || '|' || t.text) FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.i + 1)
SELECT conv_id, turn, fingerprint FROM c"""
)
def fingerprint_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return lineage.fingerprint_chain(rows, ["conv_id"], "turn", "text")


@query(
    """WITH a AS (SELECT source AS key, sha256('=' || count(*) || '|=' || max(doc_id)) AS v FROM documents GROUP BY 1),
b AS (SELECT source AS key, sha256('=' || count(*) || '|=' || max(doc_id)) AS v FROM documents WHERE doc_id % 40 <> 7 AND source <> 'src3' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, a.v AS "left", b.v AS "right" FROM a FULL JOIN b ON a.key = b.key WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v"""
)
def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def prints(docs: DataFrame) -> DataFrame:
        rows = docs.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n"), F.max("doc_id").alias("m"))
        return rows.select("key", lineage.fingerprint(F.col("n"), F.col("m")).alias("v"))

    docs = data.table(spark, sf_dir, "documents").select("source", "doc_id")
    return lineage.fingerprint_diff(prints(docs), prints(docs.filter("doc_id % 40 <> 7 AND source <> 'src3'")), "key", "v")


@query(
    """WITH r AS (SELECT s_suppkey AS stage, sha256('=' || s_name) AS old, s_suppkey % 3 <> 0 AS usable FROM supplier WHERE s_suppkey % 5 <> 0),
c AS (SELECT s_suppkey AS stage, CASE WHEN s_suppkey % 4 = 0 THEN sha256('=' || s_name || '!') ELSE sha256('=' || s_name) END AS new FROM supplier)
SELECT stage, CASE WHEN coalesce(usable, false) THEN CASE WHEN old = new THEN 'reuse' ELSE 'stale' END ELSE 'run' END AS decision FROM c LEFT JOIN r USING (stage)"""
)
def resume_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = data.table(spark, sf_dir, "supplier")
    recorded = s.filter(k % 5 != 0).select(k.alias("stage"), lineage.fingerprint(F.col("s_name")).alias("fingerprint"), (k % 3 != 0).alias("usable"))
    now = F.when(k % 4 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name"))
    return lineage.resume(recorded, s.select(k.alias("stage"), lineage.fingerprint(now).alias("fingerprint")), "stage")


@query(
    """SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1"""
)
def version_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of version 1.0 is parsed, brought to 1.1 (a typed column) and 1.2 (renamed)."""
    steps = lineage.Migrations("1.2")
    steps.step("1.0", "1.1")(lambda df: df.withColumn("body", F.from_json("props", "k bigint", {"mode": "FAILFAST"})))
    steps.step("1.1", "1.2")(lambda df: df.withColumn("k", F.col("body.k")).drop("body", "props"))
    rows = steps.migrate(data.table(spark, sf_dir, "events").select("event_type", "props"), "1.0")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean_k"), F.max("k").alias("max_k"))


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS state FROM events GROUP BY 1")
def job_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = data.table(spark, sf_dir, "events")
    return lineage.latest_state(events, ["user_id"], "event_type", "ts", "event_id").select("user_id", "state")


@query("SELECT o_orderpriority AS key, round(sum(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END), 2) AS seconds, count(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END) AS measured FROM orders GROUP BY 1")
def runtime_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("s"))
    return lineage.rollup(rows, ["key"], "s").select("key", F.round("seconds", 2).alias("seconds"), "measured")


@query(
    """WITH s AS (SELECT l_shipdate::DATE AS day, l_returnflag, l_linestatus, l_quantity FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT day) AS days FROM s GROUP BY CUBE (l_returnflag, l_linestatus)"""
)
def report_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping sets over a report table."""
    rows = data.table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return rows.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.count_distinct("day").alias("days"))


@query(
    """SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of the event stream, run to its end."""
    out = stream.windowed_counts(stream.event_stream(spark, sf_dir), "1 hour")
    done = stream.run_to_end(out, "complete")
    return done.select("event_type", F.unix_micros("start").alias("start_us"), "n", r6("value"))


@query(
    f"""WITH RECURSIVE {data.FRAMES}, sharp AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS i FROM frames WHERE blur >= 60),
walk(source, i, event_id, last_, reason) AS (
  SELECT source, i, event_id, hash, 'keep' FROM sharp WHERE i = 1
  UNION ALL SELECT s.source, s.i, s.event_id, CASE WHEN bit_count(xor(s.hash, w.last_)) <= 10 THEN w.last_ ELSE s.hash END,
    CASE WHEN bit_count(xor(s.hash, w.last_)) <= 10 THEN 'duplicate' ELSE 'keep' END FROM walk w JOIN sharp s ON s.source = w.source AND s.i = w.i + 1)
SELECT f.source, f.event_id, coalesce(w.reason, 'blurred') AS reason FROM frames f LEFT JOIN walk w ON f.event_id = w.event_id"""
)
def stream_frame_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame selection with the last kept frame as streaming state."""
    return stream.run_to_end(stream.frame_dedup(stream.event_stream(spark, sf_dir), 60.0, 10), "append")
