"""Binary files as tables: PLY clouds, COLMAP models, depth maps, splats. Bytes come through Spark's
``binaryFile`` source, so any file system works; they are decoded in Arrow batches of bounded size."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ContractError

#: Scalar types of the format (fixed values).
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2",
    "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4",
    "double": "f8", "float64": "f8",
}
RENAMED = {"red": "r", "green": "g", "blue": "b"}
ROWS = 65_536


def ply_header(data: bytes) -> tuple[str, int, list[tuple[str, str]], str | None, int]:
    """(format, vertices, properties, frame, length of the header)."""
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply") or end < 0:
        raise ContractError("no PLY header")
    kind, count, fields, frame, element = "", 0, [], None, ""
    for line in data[:end].decode("ascii", "replace").splitlines():
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "comment" and "frame=" in line:
            frame = line.split("frame=")[1].split()[0]
        elif words[0] == "element":
            element = words[1]
            if element == "vertex":
                count = int(words[2])
        elif words[0] == "property" and element == "vertex":
            if words[1] == "list":
                raise ContractError("list properties of vertices are not read")
            fields.append((words[2], PLY_TYPES[words[1]]))
    return kind, count, fields, frame, end + len(b"end_header\n")


def _ply_rows(data: bytes) -> tuple[np.ndarray, str | None]:
    kind, count, fields, frame, start = ply_header(data)
    if kind == "ascii":
        rows = [tuple(line.split()) for line in data[start:].decode("ascii").splitlines()[:count]]
        table = np.array([tuple(float(v) for v in r) for r in rows], dtype=[(n, "f8") for n, _ in fields])
    else:
        order = "<" if kind == "binary_little_endian" else ">"
        table = np.frombuffer(data, dtype=[(n, order + t) for n, t in fields], count=count, offset=start)
    if len(table) != count:
        raise ContractError(f"{len(table)} of {count} vertices")
    return table, frame


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """``cloud, pid, x, y, z, r, g, b, nx, ny, nz, frame, attrs``: absent parts are NULL, other scalar
    properties are in the map ``attrs``; alpha is dropped."""
    schema = (
        "cloud string, pid long, x double, y double, z double, r short, g short, b short, "
        "nx double, ny double, nz double, frame string, attrs map<string,double>"
    )

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                table, frame = _ply_rows(data)
                names = {RENAMED.get(n, n): n for n in table.dtype.names}
                own = {"x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "alpha"}
                extra = [n for n in names if n not in own]
                for i in range(0, len(table), ROWS):
                    part = table[i : i + ROWS]
                    n = len(part)
                    get = lambda c, t: pa.array(part[names[c]].astype(t)) if c in names else pa.nulls(n, pa.from_numpy_dtype(t))  # noqa: B023, E731
                    values = [part[names[e]].astype(np.float64) for e in extra]
                    flat = np.stack(values, axis=1).ravel() if extra else np.zeros(0)
                    attrs = pa.MapArray.from_arrays(
                        pa.array(np.arange(n + 1, dtype=np.int32) * len(extra)), pa.array(extra * n, pa.string()), pa.array(flat)
                    )
                    columns = [pa.array([name] * n, pa.string()), pa.array(np.arange(i, i + n))]
                    columns += [get(c, np.float64) for c in "xyz"] + [get(c, np.int16) for c in "rgb"]
                    columns += [get(c, np.float64) for c in ("nx", "ny", "nz")]
                    columns += [pa.array([frame or "UNKNOWN"] * n, pa.string()), attrs]
                    yield pa.RecordBatch.from_arrays(columns, names=["cloud", "pid", "x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "frame", "attrs"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def ply_bytes(points: DataFrame, frame: str = "UNKNOWN", limit: float = 5000.0) -> DataFrame:
    """``part, content``: a binary PLY file for each partition of ``x, y, z [, r, g, b]``; coordinates
    beyond what a float holds to the millimetre are refused."""
    colour = all(c in points.columns for c in "rgb")
    chosen = [*"xyz", *("rgb" if colour else "")]

    def run(batches):
        parts = []
        for batch in batches:
            kind = [(c, "<f4") for c in "xyz"] + ([(c, "u1") for c in ("red", "green", "blue")] if colour else [])
            rows = np.empty(batch.num_rows, dtype=kind)
            for c, (name, t) in zip(chosen, kind, strict=True):
                values = batch.column(c).to_numpy(zero_copy_only=False)
                if t == "<f4" and len(values) and np.abs(values).max() > limit:
                    raise ContractError(f"coordinates over {limit} do not fit a float")
                rows[name] = values
            parts.append(rows)
        if not parts or not sum(map(len, parts)):
            return
        rows = np.concatenate(parts)
        header = ["ply", "format binary_little_endian 1.0", f"comment frame={frame}", f"element vertex {len(rows)}"]
        header += [f"property {'float' if t == '<f4' else 'uchar'} {n}" for n, t in kind]
        data = "\n".join([*header, "end_header\n"]).encode() + rows.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["content"])

    out = points.select(*chosen).mapInArrow(run, "content binary")
    return out.select(F.spark_partition_id().alias("part"), "content")


def read_colmap_points_bin(spark: SparkSession, path: str) -> DataFrame:
    """``point_id, x, y, z, r, g, b, error, track`` of a points3D.bin."""
    schema = "point_id long, x double, y double, z double, r short, g short, b short, error double, track array<struct<image_id:int,point2d_idx:int>>"

    def run(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                (n,), at, rows = struct.unpack_from("<Q", data), 8, []
                for k in range(n):
                    *head, length = struct.unpack_from("<QdddBBBdQ", data, at)
                    at += struct.calcsize("<QdddBBBdQ")
                    track = struct.unpack_from(f"<{2 * length}i", data, at)
                    at += 8 * length
                    rows.append((*head, [{"image_id": a, "point2d_idx": b} for a, b in zip(track[::2], track[1::2], strict=True)]))
                    if len(rows) == ROWS or k == n - 1:
                        yield pd.DataFrame(rows, columns=["point_id", "x", "y", "z", "r", "g", "b", "error", "track"])
                        rows = []

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_depth_maps(spark: SparkSession, path: str) -> DataFrame:
    """``image, row, col, depth`` of .npy maps, by file stem; NaN and infinities are left out."""

    def run(batches):
        import io

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                grid = np.load(io.BytesIO(data), allow_pickle=False)
                if grid.ndim != 2:
                    raise ContractError(f"a depth map of {grid.ndim} dimensions")
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows, cols = np.nonzero(np.isfinite(grid))
                for i in range(0, len(rows), ROWS):
                    r, c = rows[i : i + ROWS], cols[i : i + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stem] * len(r)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(grid[r, c].astype(np.float32))],
                        names=["image", "row", "col", "depth"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "image string, row int, col int, depth float")


#: First bytes of image codecs (fixed values).
MAGIC = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A"}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, codec, content`` of image blobs; an unknown codec is NULL."""
    files = spark.read.format("binaryFile").load(path)
    codec = F
    for name, magic in MAGIC.items():
        codec = codec.when(F.startswith("content", F.unhex(F.lit(magic))), name)
    return files.select("path", "length", codec.alias("codec"), "content")


def splat_bytes(gaussians: DataFrame) -> DataFrame:
    """``part, content``: 32-byte records in order of importance, partition by partition.

    Columns x, y, z, opacity (logit), scale_0..2 (log), rot_0..3, f_dc_0..2.
    """
    from ..operators.raster import splat_order

    importance = splat_order(*[F.col(c) for c in ("opacity", "scale_0", "scale_1", "scale_2")])
    ordered = gaussians.withColumn("_w", importance).orderBy(F.desc("_w"), "x", "y", "z").drop("_w")
    kind = [("xyz", "<f4", 3), ("scale", "<f4", 3), ("rgba", "u1", 4), ("rot", "u1", 4)]

    def run(batches):
        for batch in batches:
            g = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in batch.schema.names}
            rows = np.zeros(batch.num_rows, dtype=kind)
            rows["xyz"] = np.stack([g[c] for c in "xyz"], axis=1)
            rows["scale"] = np.exp(np.stack([g[f"scale_{i}"] for i in range(3)], axis=1))
            colour = 0.5 + 0.28209479177387814 * np.stack([g[f"f_dc_{i}"] for i in range(3)], axis=1)
            alpha = 1 / (1 + np.exp(-g["opacity"]))
            rows["rgba"] = np.clip(np.rint(np.c_[colour, alpha] * 255), 0, 255)
            q = np.stack([g[f"rot_{i}"] for i in range(4)], axis=1)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            rows["rot"] = np.clip(np.rint(q * 128 + 128), 0, 255)
            yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary())], names=["content"])

    return ordered.mapInArrow(run, "content binary").select(F.spark_partition_id().alias("part"), "content")
