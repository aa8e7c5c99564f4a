"""Well-known binary geometry as GeoJSON, and the GeoParquet columns of a footer."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WKB geometry codes and their GeoJSON names.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out


def _read(cursor: _Cursor) -> dict:
    """One geometry; each carries its own byte order and dimensions (ISO thousands or the extended flag bits)."""
    order = "<" if cursor.take("B")[0] else ">"
    code = cursor.take(order + "I")[0]
    has_id = code & 0x20000000
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    kind, thousands = code % 1000, code // 1000
    dims += (0, 1, 1, 2)[thousands] if thousands < 4 else 0
    if has_id:
        cursor.take(order + "I")
    if kind not in KINDS or thousands > 3:
        raise ValueError(f"Unsupported geometry type: {code}")

    def points(n: int) -> list:
        flat = cursor.take(f"{order}{n * dims}d")
        return [list(flat[i : i + dims]) for i in range(0, n * dims, dims)]

    def count() -> int:
        return cursor.take(order + "I")[0]

    if kind == 1:
        return {"type": KINDS[kind], "coordinates": points(1)[0]}
    if kind == 2:
        return {"type": KINDS[kind], "coordinates": points(count())}
    if kind == 3:
        return {"type": KINDS[kind], "coordinates": [points(count()) for _ in range(count())]}
    parts = [_read(cursor) for _ in range(count())]
    if kind == 7:
        return {"type": KINDS[kind], "geometries": parts}
    return {"type": KINDS[kind], "coordinates": [p["coordinates"] for p in parts]}


def wkb_to_geojson(data: bytes | None) -> dict | None:
    return None if data is None else _read(_Cursor(bytes(data)))


@F.pandas_udf(T.StringType())
def _geojson_text(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else json.dumps(wkb_to_geojson(b), separators=(",", ":")))


def geojson(column: Column) -> Column:
    """GeoJSON text of a WKB column. A geometry collection nests without bound, so there is no struct type for it."""
    return _geojson_text(column)


def geojson_lists(column: Column, kind: T.ArrayType) -> Column:
    """GeoJSON texts of a column of WKB lists, at any depth of lists."""

    def texts(value):
        return None if value is None else json.dumps(wkb_to_geojson(value), separators=(",", ":")) if isinstance(value, (bytes, bytearray)) else [texts(v) for v in value]

    def result(k: T.DataType) -> T.DataType:
        return T.ArrayType(result(k.elementType)) if isinstance(k, T.ArrayType) else T.StringType()

    @F.pandas_udf(result(kind))
    def run(data: pd.Series) -> pd.Series:
        return data.map(texts)

    return run(column)


def geo_columns(key_values: dict[str, str]) -> dict[str, str]:
    """Columns that a GeoParquet footer declares as WKB: 'geometry', or 'geography' where edges are spherical."""
    try:
        columns = json.loads(key_values.get("geo", "{}")).get("columns", {})
    except (ValueError, AttributeError):
        return {}
    return {name: "geography" if c.get("edges") == "spherical" else "geometry" for name, c in columns.items() if c.get("encoding") == "WKB"}


def geo_crs(key_values: dict[str, str]) -> dict[str, str]:
    """authority:code of each declared column's reference system, where it has one."""
    out = {}
    for name, c in json.loads(key_values.get("geo", "{}")).get("columns", {}).items():
        crs = c.get("crs") or {}
        one = crs.get("id") or next(iter(crs.get("ids") or []), None)
        if one:
            out[name] = f"{one['authority']}:{one['code']}"
    return out
