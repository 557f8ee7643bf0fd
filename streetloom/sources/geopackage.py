"""GeoPackage files as DataFrames: SQLite tables read by row ranges, geometry decoded from WKB.

The file must be readable at one path by all executors.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from streetloom.functions.geometry import POLYGON

_SQL_TYPES = {"INT": "long", "REA": "double", "DOU": "double", "FLO": "double", "BOO": "boolean"}


def decode_wkb(data: bytes, at: int = 0) -> tuple[str, list]:
    """Kind and rings (or one line, or one point as a line) of a two-dimensional WKB geometry."""

    def read(at: int) -> tuple[str, list, int]:
        order = "<" if data[at] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5

        def line(at: int) -> tuple[list, int]:
            (n,) = struct.unpack_from(order + "I", data, at)
            flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
            return list(zip(flat[::2], flat[1::2], strict=True)), at + 4 + 16 * n

        if kind == 1:
            return "Point", [[struct.unpack_from(order + "2d", data, at)]], at + 16
        if kind == 2:
            points, at = line(at)
            return "LineString", [points], at
        if kind == 3:
            (n,) = struct.unpack_from(order + "I", data, at)
            at, rings = at + 4, []
            for _ in range(n):
                ring, at = line(at)
                rings.append(ring)
            return "Polygon", rings, at
        if kind in (4, 5, 6):
            (n,) = struct.unpack_from(order + "I", data, at)
            at, parts = at + 4, []
            for _ in range(n):
                _, rings, at = read(at)
                parts += rings
            return {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[kind], parts, at
        raise ValueError(f"geometry kind {kind} is not supported")

    return read(at)[:2]


def encode_wkb(kind: str, rings: list) -> bytes:
    line = lambda r: struct.pack(f"<I{2 * len(r)}d", len(r), *(v for p in r for v in p))
    if kind == "Point":
        return struct.pack("<BI2d", 1, 1, *rings[0][0])
    if kind == "LineString":
        return struct.pack("<BI", 1, 2) + line(rings[0])
    if kind == "Polygon":
        return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(line, rings))
    raise ValueError(kind)


def _geometry(blob: bytes | None) -> tuple[str | None, list | None]:
    if blob is None:
        return None, None
    size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
    return decode_wkb(blob, 8 + size)


def _typed(value, kind: pa.DataType):
    """SQLite lets any value into any column; what does not fit its declared type is null."""
    if value is None:
        return None
    try:
        if pa.types.is_boolean(kind):
            return bool(value)
        return int(value) if pa.types.is_integer(kind) else float(value) if pa.types.is_floating(kind) else str(value)
    except ValueError:
        return None


def list_layers(path: str, kind: str = "features") -> list[str]:
    """Names of the vector (``features``) or raster (``tiles``) layers."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = ? ORDER BY table_name", (kind,))]


def read_layer(spark: SparkSession, path: str, layer: str, rows_per_task: int = 50_000) -> DataFrame:
    """A vector layer with ``geom_type`` and ``geom`` (rings; a line or point is one ring) in the place of its geometry column."""
    if layer not in list_layers(path):
        raise ValueError(f"{path} has no layer {layer!r}")
    quoted = '"' + layer.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        (geometry,) = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        columns = [(r[1], _SQL_TYPES.get(r[2][:3].upper(), "string")) for r in db.execute(f"PRAGMA table_info({quoted})") if r[1] != geometry]
        low, last = db.execute(f"SELECT coalesce(min(rowid), 1), coalesce(max(rowid), 0) FROM {quoted}").fetchone()
    names = ", ".join('"' + c.replace('"', '""') + '"' for c in [geometry, *(c for c, _ in columns)])
    schema = ", ".join([*(f"`{c}` {t}" for c, t in columns), f"geom_type string, geom {POLYGON}"])

    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}.get(t, pa.string()) for _, t in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    found = db.execute(f"SELECT {names} FROM {quoted} WHERE rowid > ? AND rowid <= ? ORDER BY rowid", (first, first + rows_per_task)).fetchall()
                shapes = [_geometry(r[0]) for r in found]
                values = [pa.array([_typed(r[k + 1], kind) for r in found], kind) for k, kind in enumerate(kinds)]
                geoms = [None if g is None else [[{"x": x, "y": y} for x, y in ring] for ring in g] for _, g in shapes]
                yield pa.RecordBatch.from_arrays([*values, pa.array([k for k, _ in shapes], pa.string()), pa.array(geoms, pa.list_(pa.list_(point)))], [*(c for c, _ in columns), "geom_type", "geom"])

    starts = spark.range(low - 1, max(last, low), rows_per_task)
    return starts.repartition(max(1, -(-(last - low + 1) // rows_per_task))).mapInArrow(run, schema)
