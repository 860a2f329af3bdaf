"""Binary polygons: shapefiles with their tables, read by byte ranges, and well-known binary."""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.sources.archives import _store
from arborlens.workspace import materialize

RINGS = "array<array<struct<x:double,y:double>>>"
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_POLYGONS = (5, 15, 25)  # plain, with z, with m: the first part of a record is the same


def _points(data: bytes, n: int, order: str, at: int) -> list[dict]:
    xy = np.frombuffer(data, f"{order}f8", 2 * n, at).reshape(n, 2).tolist()
    return [{"x": x, "y": y} for x, y in xy]


def polygon_record(rings: list[list[dict]] | None) -> bytes:
    """Content of a shapefile record; rings are closed. None is the null shape."""
    if rings is None:
        return struct.pack("<i", 0)
    closed = [[*r, r[0]] if r[0] != r[-1] else r for r in rings if r]
    flat = np.array([(p["x"], p["y"]) for r in closed for p in r], "<f8").reshape(-1, 2)
    low, high = (flat.min(0).tolist(), flat.max(0).tolist()) if len(flat) else ([0.0, 0.0], [0.0, 0.0])
    starts = np.cumsum([0, *[len(r) for r in closed]])[:-1]
    return struct.pack("<i4dii", 5, *low, *high, len(closed), len(flat)) + starts.astype("<i4").tobytes() + flat.tobytes()


def record_rings(data: bytes) -> list[list[dict]] | None:
    """Rings of a record's content without their last, repeated point; None for the null shape."""
    (kind,) = struct.unpack_from("<i", data)
    if kind not in _POLYGONS:
        if kind:
            raise ValueError(f"shape type {kind} is no polygon")
        return None
    parts, n = struct.unpack_from("<ii", data, 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, 44), n]
    points = _points(data, n, "<", 44 + 4 * parts)
    return [points[a : b - 1] if points[a] == points[b - 1] else points[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]


def _header(words: int) -> bytes:
    return struct.pack(">i20xi", 9994, words) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)


def write_shapefiles(rows: DataFrame, path: str, width: int = 80) -> None:
    """rings and text columns -> in each task one shapefile (.shp, .shx, .dbf) in path. Texts longer than `width` bytes are
    refused, and so are names longer than ten."""
    names = [c for c in rows.columns if c != "rings"]
    if any(len(n.encode()) > 10 for n in names):
        raise ValueError("a column of a shapefile's table has at most ten letters")
    rows = rows.select(F.col("rings").cast(RINGS).alias("rings"), *[F.col(n).cast("string").alias(n) for n in names])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shp, shx, dbf, at, n = [], [], [], 50, 0
        for b in batches:
            for r in b.to_pylist():
                n += 1
                content = polygon_record(r["rings"])
                head = struct.pack(">ii", n, len(content) // 2)
                shp.append(head + content)
                shx.append(struct.pack(">ii", at, len(content) // 2))
                at += len(content) // 2 + 4
                cells = [(r[c] or "").encode() for c in names]
                if any(len(c) > width for c in cells):
                    raise ValueError(f"a text of more than {width} bytes")
                dbf.append(b" " + b"".join(c.ljust(width) for c in cells))
        if not n:
            return
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}"
        fields = b"".join(c.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14 for c in names)
        table = struct.pack("<4BIHH20x", 3, 124, 1, 1, n, 33 + len(fields), 1 + width * len(names)) + fields + b"\r"
        for suffix, data in ((".shx", [_header(50 + 4 * n), *shx]), (".dbf", [table, *dbf, b"\x1a"]), (".shp", [_header(at), *shp])):
            with fs.open_output_stream(name + suffix) as out:
                out.write(b"".join(data))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    materialize(rows.mapInArrow(kernel, "file string"), "shapefiles")


def read_shapefiles(spark: SparkSession, path: str, columns: list[str], range_bytes: int = 64 << 20) -> DataFrame:
    """file, record (1, 2, ...), rings and text columns of all shapefiles in path; a column that a table lacks is null.

    Tasks own byte ranges of the .shp files, which may begin inside a record: the index (.shx) tells which records start in
    a range, and those are the task's, to their end. Rows of the table have one length, so a task reads its own only.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = materialize(ranges, "ranges")
    tasks = max(1, ranges.count())
    out = f"file string, record long, rings {RINGS}" + "".join(f", `{c}` string" for c in columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = _store(file)
                with fs.open_input_file(f"{name[:-4]}.shx") as f:
                    index = np.frombuffer(f.read()[100:], ">i4").reshape(-1, 2).astype(np.int64)
                offsets = (2 * index[:, 0]).tolist()
                first, last = bisect_left(offsets, start), bisect_left(offsets, start + range_bytes)
                if first == last:
                    continue
                ends = (index[:, 0] + index[:, 1]) * 2 + 8
                with fs.open_input_file(f"{name[:-4]}.dbf") as f:
                    head = f.read_at(32, 0)
                    _, top, size = struct.unpack_from("<IHH", head, 4)
                    fields = f.read_at(top - 33, 32)
                    table = f.read_at(size * (last - first), top + size * first)
                places, at = {}, 1
                for k in range(0, len(fields), 32):
                    places[fields[k : k + 11].split(b"\0")[0].decode()] = (at, at + fields[k + 16])
                    at += fields[k + 16]
                with fs.open_input_file(name) as f:
                    for a in range(first, last, 1024):  # some records at a time
                        z = min(last, a + 1024)
                        data = f.read_at(int(ends[z - 1]) - offsets[a], offsets[a])
                        rings, texts = [], {c: [] for c in columns}
                        for k in range(a, z):
                            own = data[offsets[k] - offsets[a] + 8 : int(ends[k]) - offsets[a]]
                            rings.append(record_rings(own))
                            row = table[size * (k - first) : size * (k - first + 1)]
                            for c in columns:
                                texts[c].append(row[slice(*places[c])].decode().strip() if c in places else None)
                        n = z - a
                        yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(a + 1, z + 1), pa.int64()), pa.array(rings, _RINGS), *[pa.array(texts[c], pa.string()) for c in columns]], names=["file", "record", "rings", *columns])

    return ranges.repartition(tasks, "path", "start").mapInArrow(kernel, out)


def wkb_rings(data: bytes | None) -> list[list[dict]] | None:
    """Rings of a well-known binary POLYGON or MULTIPOLYGON, of either byte order in each part; None for null."""
    if data is None:
        return None

    def read(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind, n = struct.unpack_from(f"{order}II", data, at + 1)
        at, rings = at + 9, []
        for _ in range(n):
            if kind == 6:
                more, at = read(at)
                rings += more
                continue
            if kind != 3:
                raise ValueError(f"geometry type {kind} is no polygon")
            (m,) = struct.unpack_from(f"{order}I", data, at)
            points = _points(data, m, order, at + 4)
            at += 4 + 16 * m
            rings.append(points[:-1] if m > 1 and points[0] == points[-1] else points)
        return rings, at

    return read(0)[0]


def from_wkb():
    """Arrow UDF: well-known binary to rings."""

    @F.pandas_udf(RINGS)
    def decode(values: pd.Series) -> pd.Series:
        return values.map(wkb_rings)

    return decode
