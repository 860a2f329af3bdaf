"""Geometry as column expressions: points, boxes, geohashes and rings of (x, y), longitude first. A sphere stands in for
the spheroid (radius 6,371,008.8 m), which puts distances and areas within about half a per cent of geodesic ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371008.8
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
RING = "array<struct<x:double,y:double>>"


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres (haversine)."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within(lat: Column, lon: Column, lat0: float, lon0: float, metres: float) -> Column:
    """Within metres of a point: a latitude band first, which a scan can prune by, then the distance."""
    band = metres / RADIUS * 57.29577951308232
    return lat.between(lat0 - band, lat0 + band) & (distance(lat, lon, F.lit(lat0), F.lit(lon0)) <= metres)


def boxes_meet(x1: Column, y1: Column, x2: Column, y2: Column, box: Sequence[float]) -> Column:
    return (x1 <= box[2]) & (x2 >= box[0]) & (y1 <= box[3]) & (y2 >= box[1])


def geohash_bounds(code: Column) -> Column:
    """(lon_min, lat_min, lon_max, lat_max) of a geohash of any length: five bits a character, longitude bits first."""
    bits = F.transform(F.split(code, ""), lambda c: F.instr(F.lit(BASE32), c) - 1)
    start = F.struct(F.lit(-180.0).alias("a"), F.lit(-90.0).alias("b"), F.lit(180.0).alias("c"), F.lit(90.0).alias("d"), F.lit(0).alias("n"))

    pairs = F.flatten(F.transform(bits, lambda d: F.transform(F.array(*[F.lit(k) for k in (4, 3, 2, 1, 0)]), lambda k: F.struct(d.alias("d"), k.alias("k")))))

    def step(s: Column, p: Column) -> Column:
        one = F.floor(p["d"] / F.pow(F.lit(2), p["k"])) % 2 == 1
        even = s["n"] % 2 == 0
        x, y = (s["a"] + s["c"]) / 2, (s["b"] + s["d"]) / 2
        return F.struct(
            F.when(even & one, x).otherwise(s["a"]).alias("a"), F.when(~even & one, y).otherwise(s["b"]).alias("b"),
            F.when(even & ~one, x).otherwise(s["c"]).alias("c"), F.when(~even & ~one, y).otherwise(s["d"]).alias("d"), (s["n"] + 1).alias("n"),
        )

    return F.aggregate(pairs, start, step, lambda s: F.struct(s["a"].alias("lon_min"), s["b"].alias("lat_min"), s["c"].alias("lon_max"), s["d"].alias("lat_max")))


def geohash(lat: Column, lon: Column, length: int = 7) -> Column:
    """The geohash of a point, from integer cells: bits of the longitude cell and the latitude cell in turn."""
    n = 5 * length
    nx, ny = (n + 1) // 2, n // 2
    x = F.least(F.floor((lon + 180) / 360 * (1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * (1 << ny)), F.lit((1 << ny) - 1)).cast("long")
    digits = []
    for i in range(length):
        digit = F.lit(0).cast("long")
        for b in range(5 * i, 5 * i + 5):
            source, left = (x, nx - 1 - b // 2) if b % 2 == 0 else (y, ny - 1 - b // 2)
            digit = digit * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1))
        digits.append(F.substring(F.lit(BASE32), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def ring(points: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def _edges(r: Column) -> Column:
    """Each point with the next, round to the first."""
    return F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(r: Column, x: Column, y: Column) -> Column:
    """Even-odd test against an outer ring; holes are ignored."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(_edges(r), lambda e: F.when(e["a"]["y"] == e["b"]["y"], False).otherwise(crosses(e)))) % 2 == 1


def planar_area(r: Column) -> Column:
    """Shoelace area, positive."""
    return F.abs(F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def centroid(r: Column) -> Column:
    """Area centroid (x, y) of a ring."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    total = lambda f: F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + f(e))
    area = total(cross)
    return F.struct((total(lambda e: (e["a"]["x"] + e["b"]["x"]) * cross(e)) / (3 * area)).alias("x"), (total(lambda e: (e["a"]["y"] + e["b"]["y"]) * cross(e)) / (3 * area)).alias("y"))


def sphere_area(r: Column) -> Column:
    """Square metres of a ring on the sphere."""
    part = lambda e: F.radians(e["b"]["x"] - e["a"]["x"]) * (2 + F.sin(F.radians(e["a"]["y"])) + F.sin(F.radians(e["b"]["y"])))
    return F.abs(F.aggregate(_edges(r), F.lit(0.0), lambda s, e: s + part(e))) * (RADIUS * RADIUS / 2)


def rough_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Square kilometres of a polygon from its box: degrees to km, shortened by latitude, 70 % filled."""
    return (x2 - x1) * 111.32 * F.cos(F.radians((y1 + y2) / 2)) * (y2 - y1) * 111.32 * 0.7


def box_overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Planar area that two boxes (x1, y1, x2, y2) share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def ring_bounds(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def _side(a: Column, b: Column, p: Column) -> Column:
    """Positive where p lies left of a-b, negative right of it."""
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def simple_ring(r: Column) -> Column:
    """No two sides cross, and none turns back on the one before it. Compares all sides of the ring."""
    sides = F.filter(_edges(r), lambda e: e["a"] != e["b"])
    cross = lambda e, f: (_side(e["a"], e["b"], f["a"]) * _side(e["a"], e["b"], f["b"]) < 0) & (_side(f["a"], f["b"], e["a"]) * _side(f["a"], f["b"], e["b"]) < 0)
    dot = lambda e, f: (e["b"]["x"] - e["a"]["x"]) * (f["b"]["x"] - f["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (f["b"]["y"] - f["a"]["y"])
    back = lambda e, f: (e["b"] == f["a"]) & (_side(e["a"], e["b"], f["b"]) == 0) & (dot(e, f) < 0)
    return ~F.exists(sides, lambda e: F.exists(sides, lambda f: cross(e, f) | back(e, f)))


def valid_ring(r: Column) -> Column:
    """At least three different corners, an area, and no side that crosses or turns back on another."""
    return F.coalesce((F.size(F.array_distinct(r)) >= 3) & (planar_area(r) > 0) & simple_ring(r), F.lit(False))


def _clipped(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for k, q in enumerate(points):
            p = points[k - 1]
            pin, qin = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if pin != qin:
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if qin:
                out.append(q)
        points = out
    return points


def clip_to_box(box: tuple[float, float, float, float]):
    """Arrow UDF: a ring cut to a box (Sutherland-Hodgman); empty where they do not meet."""

    @F.pandas_udf(RING)
    def clip(rings: pd.Series) -> pd.Series:
        cut = [_clipped([(p["x"], p["y"]) for p in r], box) if r is not None else [] for r in rings]
        return pd.Series([[{"x": x, "y": y} for x, y in c] for c in cut])

    return clip


def _simplified(p: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        s, e = stack.pop()
        (x1, y1), (x2, y2) = p[s], p[e]
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        far, at = 0.0, None
        for k in range(s + 1, e):
            x, y = p[k]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
            if d > far:
                far, at = d, k
        if at is not None and far > tolerance:
            keep.add(at)
            stack += [(s, at), (at, e)]
    return [p[k] for k in sorted(keep)]


def simplify(tolerance: float):
    """Arrow UDF: a line or ring without the corners that lie within tolerance of the rest (Douglas-Peucker)."""

    @F.pandas_udf(RING)
    def thin(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rings in parts:
            yield pd.Series([[{"x": x, "y": y} for x, y in _simplified([(p["x"], p["y"]) for p in r], tolerance)] if r is not None and len(r) else [] for r in rings])

    return thin
