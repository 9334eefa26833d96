"""A Python data source for ESRI shapefiles with their dBase tables, by the published description of the format.

spark.dataSource.register(ShapefileSource); spark.read.format("shapefile").load(path) gives the attributes and `geometry`
as WKB. The .shp is cut into record ranges by its .shx, one partition each.
"""

from __future__ import annotations

import os
import struct
from datetime import date

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoskein.functions.codec import to_wkb

#: Shape types of the format, plain and with z (which may carry measures).
POINT, LINE, POLYGON, MULTIPOINT = (1, 11), (3, 13), (5, 15), (8, 18)
RECORDS = 50_000


def dbf_fields(path: str) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """(name, type, length, decimals) of each column, rows, bytes before the first and bytes of a row."""
    with open(path, "rb") as f:
        head = f.read(32)
        rows, start, size = struct.unpack("<IHH", head[4:12])
        fields = []
        while (d := f.read(32)) and d[0] != 0x0D:
            fields.append((d[:11].split(b"\0")[0].decode("latin-1"), chr(d[11]), d[16], d[17]))
    return fields, rows, start, size


def spark_type(kind: str, length: int, decimals: int) -> T.DataType:
    if kind in "NF":
        return T.DoubleType() if decimals or kind == "F" else T.IntegerType() if length < 10 else T.LongType()
    return {"D": T.DateType(), "L": T.BooleanType()}.get(kind, T.StringType())


def dbf_value(raw: bytes, kind: str, decimals: int, length: int):
    text = raw.decode("utf-8", "replace").strip(" \0")
    if kind == "L":
        return {"Y": True, "T": True, "N": False, "F": False}.get(text.upper())
    if not text or text.startswith("*"):
        return "" if kind == "C" else None
    if kind in "NF":
        return float(text) if decimals or kind == "F" else int(float(text))
    return date(int(text[:4]), int(text[4:6]), int(text[6:8])) if kind == "D" else text


def _area(ring: list[tuple]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def _within(p: tuple, ring: list[tuple]) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:]):
        if (a[1] > p[1]) != (b[1] > p[1]) and (b[0] - a[0]) / (b[1] - a[1]) * (p[1] - a[1]) + a[0] > p[0]:
            odd = not odd
    return odd


def shape_wkb(content: bytes) -> bytes | None:
    """A record's geometry as WKB; null shapes are None. Outer rings run clockwise, holes go to the ring around them."""
    (kind,) = struct.unpack_from("<i", content)
    if kind == 0:
        return None
    z = kind in (11, 13, 15, 18)
    if kind in POINT:
        return to_wkb({"type": "Point", "z": z, "coords": struct.unpack_from("<3d" if z else "<2d", content, 4)})
    parts = n = 0
    at = 36
    if kind in LINE + POLYGON:
        parts, n = struct.unpack_from("<2i", content, at)
        starts = [*struct.unpack_from(f"<{parts}i", content, at + 8), n]
        at += 8 + 4 * parts
    elif kind in MULTIPOINT:
        (n,) = struct.unpack_from("<i", content, at)
        starts, at = [0, n], at + 4
    else:
        raise TypeError(f"shape type {kind} isn't supported")
    flat = struct.unpack_from(f"<{2 * n}d", content, at)
    points = list(zip(flat[::2], flat[1::2]))
    if z:
        heights = struct.unpack_from(f"<{n}d", content, at + 16 * n + 16)
        points = [(*p, h) for p, h in zip(points, heights)]
    if kind in MULTIPOINT:
        return to_wkb({"type": "MultiPoint", "z": z, "coords": points})
    rings = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind in LINE:
        return to_wkb({"type": "LineString", "z": z, "coords": rings[0]} if parts == 1 else {"type": "MultiLineString", "z": z, "coords": rings})
    outer = [[r] for r in rings if _area(r) <= 0] or [[r] for r in rings]
    for hole in (r for r in rings if _area(r) > 0 and len(outer) < len(rings) + 1 and [r] not in outer):
        next((o for o in outer if _within(hole[0], o[0])), outer[0]).append(hole)
    return to_wkb({"type": "Polygon", "z": z, "coords": outer[0]} if len(outer) == 1 else {"type": "MultiPolygon", "z": z, "coords": outer})


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.base = path[:-4] if path.lower().endswith(".shp") else path

    def partitions(self):
        rows = (os.path.getsize(self.base + ".shx") - 100) // 8
        return [_Range(k, min(rows, k + RECORDS)) for k in range(0, rows, RECORDS)] or [_Range(0, 0)]

    def read(self, part):
        fields, _, start, size = dbf_fields(self.base + ".dbf")
        with open(self.base + ".shx", "rb") as index, open(self.base + ".shp", "rb") as shapes, open(self.base + ".dbf", "rb") as attributes:
            index.seek(100 + 8 * part.first)
            attributes.seek(start + size * part.first)
            for _ in range(part.first, part.last):
                offset, words = struct.unpack(">2i", index.read(8))
                shapes.seek(2 * offset + 8)
                row, values, at = attributes.read(size), [], 1
                for _, kind, length, decimals in fields:
                    values.append(dbf_value(row[at : at + length], kind, decimals, length))
                    at += length
                yield (*values, shape_wkb(shapes.read(2 * words)))


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def _base(self) -> str:
        path = self.options["path"].removeprefix("file:")
        return path[:-4] if path.lower().endswith(".shp") else path

    def schema(self) -> T.StructType:
        fields, *_ = dbf_fields(self._base() + ".dbf")
        return T.StructType([T.StructField(n, spark_type(k, size, d)) for n, k, size, d in fields] + [T.StructField("geometry", T.BinaryType())])

    def reader(self, schema):
        return _Reader(self._base())


def write_points(path: str, rows: list[tuple[float, float, int, str]]) -> None:
    """A small shapefile of points with columns id (whole number) and name; for fixtures and exports of few rows."""
    base = path[:-4] if path.lower().endswith(".shp") else path
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + 14 * len(rows)) + struct.pack("<2i8d", 1000, 1, *([0.0] * 8))
    with open(base + ".shp", "wb") as shp, open(base + ".shx", "wb") as shx:
        shp.write(head)
        shx.write(head[:24] + struct.pack(">i", 50 + 4 * len(rows)) + head[28:])
        for k, (x, y, *_) in enumerate(rows):
            shp.write(struct.pack(">2i", k + 1, 10) + struct.pack("<i2d", 1, x, y))
            shx.write(struct.pack(">2i", 50 + 14 * k, 10))
    with open(base + ".dbf", "wb") as dbf:
        column = lambda n, t, size: n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([size, 0]) + bytes(14)
        dbf.write(struct.pack("<4BIHH", 3, 124, 1, 1, len(rows), 97, 31) + bytes(20) + column("id", "N", 10) + column("name", "C", 20) + b"\r")
        for _, _, number, name in rows:
            dbf.write(b" " + str(number).rjust(10).encode() + name.encode()[:20].ljust(20))
        dbf.write(b"\x1a")
