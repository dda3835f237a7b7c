"""Vector tables: geometry as WKB with a stored bounding box, in any of several coordinate systems.

Boxes are four plain columns (xmin, ymin, xmax, ymax), so that filters on a box reach the scan and whole row groups are
passed over; so do filters on other columns. Geometry is decoded in Arrow batches into nested arrays of (x, y).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, utm

#: Numbers of shapes in WKB; fixed values.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: Parts of a shape (polygons, or one for each line or point), their rings, and the points of these.
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(_POINT)))
BOX = ("xmin", "ymin", "xmax", "ymax")


def parse_wkb(raw: bytes | None) -> tuple[str, list[list[np.ndarray]]] | None:
    """Kind and parts of a shape of either byte order, with or without z, m and a reference number; None for what is no shape."""
    try:
        return None if not raw else _shape(raw, 0)[:2]
    except (struct.error, ValueError, KeyError):
        return None


def _shape(raw: bytes, at: int) -> tuple[str, list[list[np.ndarray]], int]:
    order = "<" if raw[at] == 1 else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    at += 5
    if code & 0x20000000:
        at += 4
    extra = bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    width = 2 + (extra or (0, 1, 1, 2)[code // 1000])
    kind = KINDS[code % 1000]

    def count() -> int:
        nonlocal at
        n = struct.unpack_from(order + "I", raw, at)[0]
        at += 4
        return n

    def points(n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, order + "f8", n * width, at).reshape(n, width)[:, :2]
        at += n * width * 8
        return found

    if kind == "Point":
        p = points(1)
        return kind, [] if np.isnan(p).any() else [[p]], at
    if kind == "LineString":
        line = points(count())
        return kind, [[line]] if len(line) else [], at
    if kind == "Polygon":
        rings = [points(count()) for _ in range(count())]
        return kind, [rings] if rings else [], at
    parts = []
    for _ in range(count()):
        _, inner, at = _shape(raw, at)
        parts += inner
    return kind, parts, at


def _nested(shapes: list) -> pa.Array:
    """Arrow array of parts."""
    points, rings, parts, rows, missing = [np.zeros((0, 2))], [0], [0], [0], []
    for s in shapes:
        for part in s[1] if s else ():
            for ring in part:
                points.append(ring)
                rings.append(rings[-1] + len(ring))
            parts.append(parts[-1] + len(part))
        rows.append(rows[-1] + (len(s[1]) if s else 0))
        missing.append(s is None)
    flat = np.concatenate(points)
    xy = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype("<f8")), pa.array(flat[:, 1].astype("<f8"))], ["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(rings, pa.int32()), xy)
    middle = pa.ListArray.from_arrays(pa.array(parts, pa.int32()), inner)
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), middle, mask=pa.array(missing))


def decode_wkb(df: DataFrame, wkb: str = "geometry") -> DataFrame:
    """``kind`` and ``parts`` in place of a WKB column; both null where the bytes are null or no shape, no parts where it is empty."""
    kept = [c for c in df.columns if c not in (wkb, "kind", "parts")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("kind", T.StringType()), T.StructField("parts", PARTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = [parse_wkb(b) for b in batch.column(wkb).to_pylist()]
            kinds = pa.array([s and s[0] for s in shapes], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), kinds, _nested(shapes)], names=schema.names)

    return df.select(*kept, wkb).mapInArrow(run, schema)


def encode_wkb(df: DataFrame, kind: str, parts: str = "parts", name: str = "geometry") -> DataFrame:
    """WKB of shapes of one kind (a line's or point's parts hold one ring each) in place of ``parts``."""
    number = {v: k for k, v in KINDS.items()}[kind]
    kept = [c for c in df.columns if c not in (parts, name)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.BinaryType())])

    def ring(p: list, counted: bool = True) -> bytes:
        return (struct.pack("<I", len(p)) if counted else b"") + np.array([(q["x"], q["y"]) for q in p], "<f8").tobytes()

    def one(n: int, part: list) -> bytes:
        head = struct.pack("<BI", 1, n)
        if n == 3:
            return head + struct.pack("<I", len(part)) + b"".join(map(ring, part))
        return head + ring(part[0], n == 2)

    def whole(shape: list | None) -> bytes | None:
        if shape is None:
            return None
        if number > 3:
            return struct.pack("<BII", 1, number, len(shape)) + b"".join(one(number - 3, p) for p in shape)
        return one(number, shape[0]) if shape else struct.pack("<BII", 1, number, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([whole(s) for s in batch.column(parts).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=schema.names)

    return df.select(*kept, parts).mapInArrow(run, schema)


def with_box(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Add the bounding box of each shape; null for empty ones."""
    points = F.flatten(F.flatten(parts))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return df.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def _wgs84(x: Column, y: Column, crs: int) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates in 4326, 3857, or a UTM zone (326zz north, 327zz south)."""
    if crs == 4326:
        return x, y
    if crs == 3857:
        return F.degrees(x / geo.MERCATOR_RADIUS), F.degrees(2 * F.atan(F.exp(y / geo.MERCATOR_RADIUS))) - 90
    if crs // 100 in (326, 327) and 1 <= crs % 100 <= 60:
        lat, lon = utm.utm_latlon(x, y, utm.meridian(crs % 100), south=crs // 100 == 327)
        return lon, lat
    raise ValueError(f"unknown coordinate system {crs}")


def to_wgs84(df: DataFrame, crs: int, parts: str = "parts") -> DataFrame:
    """Shapes with longitude as x and latitude as y."""
    if crs == 4326:
        return df

    def point(p: Column) -> Column:
        lon, lat = _wgs84(p["x"], p["y"], crs)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return df.withColumn(parts, F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, point))))


def write_vectors(df: DataFrame, kind: str, path: str) -> None:
    """Shapes (``parts``) as WKB with their boxes, in rows sorted by place so that boxes of row groups are small."""
    boxed = with_box(df)
    ordered = boxed.repartitionByRange(F.floor("xmin"), F.floor("ymin")).sortWithinPartitions("xmin", "ymin")
    encode_wkb(ordered, kind).write.parquet(path)


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose stored box meets a box, in the coordinates of the file."""
    return df.filter((F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south))


def scan_vectors(spark: SparkSession, path: str, crs: int = 4326, box: tuple[float, float, float, float] | None = None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a vector table: the wanted columns, kind and parts in WGS84; null and empty shapes are left out.

    ``box`` (west, south, east, north, in the file's coordinates) and ``where`` are pushed to the scan; without stored boxes,
    boxes are worked out from the shapes after decoding.
    """
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    stored = set(BOX) <= set(df.columns)
    if box and stored:
        df = in_box(df, *box)
    kept = [c for c in (columns if columns is not None else df.columns) if c not in (*BOX, "geometry")]
    found = decode_wkb(df.select(*kept, "geometry")).filter("size(parts) > 0")
    if box and not stored:
        found = in_box(with_box(found), *box).drop(*BOX)
    return to_wgs84(found, crs)
