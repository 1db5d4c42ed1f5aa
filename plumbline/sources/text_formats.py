"""Text files of the survey tool chain as tables; read whole by Spark, so any file system works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import ContractError, require


def file_lines(spark: SparkSession, path: str, comment: str | None = "#", keep_blank: bool = False) -> DataFrame:
    """``file, line_no, line`` in order, without comments."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    if comment:
        lines = lines.filter(~F.startswith(F.ltrim("line"), F.lit(comment)))
    return lines if keep_blank else lines.filter(F.trim("line") != "")


def _numbers(line: Column, separator: str = r"\s+") -> Column:
    return F.transform(F.split(F.trim(line), separator), lambda t: F.try_to_number(t, F.lit("S999999999999D999999999999")).cast("double"))


def read_axis_csv(spark: SparkSession, path: str) -> DataFrame:
    """``vertex, x, y, z, s`` of a centerline CSV.

    With a header, columns go by name (x, y, z and s, chainage or chainage_m); without one there are three
    or four. The first ``s`` is the offset of the axis; NULL where the file has none.
    """
    lines = file_lines(spark, path)
    order = Window.partitionBy("file").orderBy("line_no")
    cells = F.transform(F.split("line", ","), lambda t: F.lower(F.trim(t)))
    rows = lines.select("file", cells.alias("c"), (F.row_number().over(order) - 1).alias("i"))
    first = rows.filter("i = 0").select("c").first()
    if first is None:
        raise ContractError("an empty axis file")
    names = list(first.c)
    try:
        [float(x) for x in names]
        header = False
    except ValueError:
        header = True
    if header:
        aliases = {"chainage": "s", "chainage_m": "s"}
        places = {aliases.get(n, n): k for k, n in enumerate(names)}
        if not {"x", "y", "z"} <= places.keys():
            raise ContractError(f"an axis file without x, y and z: {names}")
        rows = rows.filter("i > 0").withColumn("i", F.col("i") - 1)
    else:
        if len(names) not in (3, 4):
            raise ContractError(f"an axis file of {len(names)} columns")
        places = dict(zip(["s", "x", "y", "z"] if len(names) == 4 else ["x", "y", "z"], range(4), strict=False))
    value = lambda n: F.get("c", F.lit(places[n])).cast("double") if n in places else F.lit(None).cast("double")
    return rows.select(F.col("i").alias("vertex"), *[value(n).alias(n) for n in ("x", "y", "z", "s")])


def write_axis_csv(vertices: DataFrame, path: str) -> None:
    vertices.select("s", "x", "y", "z").coalesce(1).sortWithinPartitions("s").write.csv(path, header=True)


def read_targets_csv(spark: SparkSession, path: str) -> DataFrame:
    """``id, x, y, z``; an empty file is refused."""
    rows = spark.read.schema("id string, x double, y double, z double").csv(path, header=True, comment="#")
    if rows.isEmpty():
        raise ContractError("no targets")
    return rows


#: Names by which mapping files refer to images and to their targets (fixed values).
IMAGE_COLUMNS = ("image_id", "image_name", "image_guid")
TARGET_COLUMNS = ("scan_id", "scan_guid", "station_id")


def read_mapping(spark: SparkSession, path: str, evidence_type: str = "explicit_mapping") -> DataFrame:
    """``origin, image_ref, image_ref_kind, target_kind, target_value, evidence_type`` of a mapping CSV or
    JSON-lines file.

    Every row must name exactly one image and one target; a file with another row, or without rows, is refused.
    ``origin`` is ``file:line n`` (the header is line 1) or ``file:record n``.
    """
    is_json = path.endswith((".json", ".jsonl"))
    raw = spark.read.json(path) if is_json else spark.read.csv(path, header=True)
    place = F.row_number().over(Window.partitionBy("file").orderBy("at")) + F.lit(0 if is_json else 1)

    def named(columns):
        there = [c for c in columns if c in raw.columns]
        pairs = [F.struct(F.lit(c).alias("kind"), F.trim(F.col(c).cast("string")).alias("value")) for c in there]
        none = F.array().cast("array<struct<kind:string,value:string>>")
        return F.filter(F.array(*pairs), lambda p: F.length(p.value) > 0) if pairs else none

    rows = (
        raw.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        .withColumn("at", F.monotonically_increasing_id())
        .select("file", place.alias("n"), named(IMAGE_COLUMNS).alias("image"), named(TARGET_COLUMNS).alias("target"))
        .withColumn("origin", F.concat("file", F.lit(":record " if is_json else ":line "), "n"))
    )
    bad = rows.filter((F.size("image") != 1) | (F.size("target") != 1)).orderBy("origin").first()
    if bad is not None:
        raise ContractError(f"{bad.origin}: a row must name exactly one image and one target")
    if rows.isEmpty():
        raise ContractError(f"{path}: no rows")
    image, target = F.col("image")[0], F.col("target")[0]
    return rows.select(
        "origin",
        image["value"].alias("image_ref"),
        image["kind"].alias("image_ref_kind"),
        target["kind"].alias("target_kind"),
        target["value"].alias("target_value"),
        F.lit(evidence_type).alias("evidence_type"),
    )


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices ``vertex, x, y, z``, faces ``face, a, b, c``) of an OBJ file; polygons become fans.

    Vertices count from 1; negative references count from the end of the file.
    """
    lines = file_lines(spark, path).withColumn("t", F.split(F.trim("line"), r"\s+"))
    kind = F.get("t", F.lit(0))
    order = Window.partitionBy("file").orderBy("line_no")
    v = lines.filter(kind == "v")
    vertices = v.select(
        F.row_number().over(order).cast("long").alias("vertex"),
        *[F.get("t", F.lit(i + 1)).cast("double").alias(c) for i, c in enumerate("xyz")],
    )
    count = v.groupBy("file").agg(F.count("*").alias("n"))
    f = lines.filter(kind == "f").join(count, "file")
    reference = F.transform(F.slice("t", 2, 1 << 20), lambda x: F.element_at(F.split(x, "/"), 1).cast("long"))
    corners = F.transform(reference, lambda r: F.when(r < 0, F.col("n") + r + 1).otherwise(r))
    fans = f.select((F.row_number().over(order) - 1).alias("p"), corners.alias("k")).select(
        "p", "k", F.explode(F.sequence(F.lit(1), F.size("k") - 2)).alias("i")
    )
    at = lambda j: F.get("k", j)
    faces = fans.select("p", "i", at(F.lit(0)).alias("a"), at(F.col("i")).alias("b"), at(F.col("i") + 1).alias("c"))
    face = F.row_number().over(Window.orderBy("p", "i")) - 1
    return vertices, faces.select(face.cast("long").alias("face"), "a", "b", "c")


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One text file: vertices in order, then faces."""
    v = vertices.select(F.lit(0).alias("k"), F.col("vertex").alias("i"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = faces.select(F.lit(1).alias("k"), F.col("face").alias("i"), F.concat_ws(" ", F.lit("f"), "a", "b", "c").alias("value"))
    v.unionByName(f).repartition(1).sortWithinPartitions("k", "i").select("value").write.text(path)


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.withColumn("t", F.split(F.trim("line"), r"\s+"))


def read_colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``camera_id, model, width, height, params``."""
    t = _tokens(file_lines(spark, path))
    get = lambda i, kind: F.get("t", F.lit(i)).cast(kind)
    return t.select(
        get(0, "int").alias("camera_id"),
        get(1, "string").alias("model"),
        get(2, "int").alias("width"),
        get(3, "int").alias("height"),
        F.slice("t", 5, 1 << 20).cast("array<double>").alias("params"),
    )


def read_colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, qw..qz, tx..tz, camera_id, name, points array<struct<u, v, point_id>>``.

    A record is two lines, the second of which may be blank.
    """
    lines = file_lines(spark, path, keep_blank=True)
    order = Window.partitionBy("file").orderBy("line_no")
    placed = lines.withColumn("i", F.row_number().over(order) - 1).withColumn("next", F.lead("line").over(order))
    pose = _tokens(placed.filter("i % 2 = 0 AND trim(line) <> ''"))
    get = lambda i, kind: F.get("t", F.lit(i)).cast(kind)
    numbers = F.filter(F.split(F.trim(F.coalesce("next", F.lit(""))), r"\s+"), lambda x: x != "")
    triples = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_n") / 3).cast("int") - 1, F.lit(1)),
        lambda k: F.struct(
            F.get("_n", k * 3).cast("double").alias("u"), F.get("_n", k * 3 + 1).cast("double").alias("v"), F.get("_n", k * 3 + 2).cast("long").alias("point_id")
        ),
    )
    none = F.array().cast("array<struct<u:double,v:double,point_id:bigint>>")
    return pose.withColumn("_n", numbers).select(
        get(0, "int").alias("image_id"),
        *[get(i + 1, "double").alias(f"q{c}") for i, c in enumerate("wxyz")],
        *[get(i + 5, "double").alias(f"t{c}") for i, c in enumerate("xyz")],
        get(8, "int").alias("camera_id"),
        F.array_join(F.slice("t", 10, 1 << 20), " ").alias("name"),
        F.when(F.size("_n") >= 3, triples).otherwise(none).alias("points"),
    )


def read_colmap_points(spark: SparkSession, path: str) -> DataFrame:
    """``point_id, x, y, z, r, g, b, error, track array<struct<image_id, point2d_idx>>``."""
    t = _tokens(file_lines(spark, path))
    get = lambda i, kind: F.get("t", F.lit(i)).cast(kind)
    pairs = F.transform(
        F.sequence(F.lit(8), F.size("t") - 2, F.lit(2)),
        lambda k: F.struct(F.get("t", k).cast("int").alias("image_id"), F.get("t", k + 1).cast("int").alias("point2d_idx")),
    )
    none = F.array().cast("array<struct<image_id:int,point2d_idx:int>>")
    return t.select(
        get(0, "long").alias("point_id"),
        *[get(i + 1, "double").alias(c) for i, c in enumerate("xyz")],
        *[get(i + 4, "short").alias(c) for i, c in enumerate("rgb")],
        get(7, "double").alias("error"),
        F.when(F.size("t") >= 10, pairs).otherwise(none).alias("track"),
    )


def write_colmap_points(points: DataFrame, path: str) -> None:
    track = F.transform("track", lambda x: F.concat_ws(" ", x.image_id, x.point2d_idx))
    line = F.concat_ws(" ", "point_id", "x", "y", "z", "r", "g", "b", "error", F.array_join(track, " "))
    points.select(F.rtrim(line).alias("value")).write.text(path)


def strict_json(df: DataFrame, column: str, schema: str, versions: Sequence[str], version: str = "schema_version") -> DataFrame:
    """Documents as one struct column ``doc``; other fields, other types or another version are refused."""
    parsed = df.withColumn("doc", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    known = parsed.schema["doc"].dataType.fieldNames()
    unknown = F.size(F.array_except(F.json_object_keys(column), F.array(*[F.lit(k) for k in known]))) > 0
    broken = F.col("doc").isNull() | F.json_object_keys(column).isNull() | unknown
    broken = broken | ~F.coalesce(F.col(f"doc.{version}").isin(*versions), F.lit(False))
    return require(parsed, F.coalesce(broken, F.lit(True)), "documents that break the schema")
