"""Polygons as Columns: ``array<array<struct<x,y>>>``, the exterior ring first, rings unclosed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import points as P
from .box import of_ring


def let(value: Column, body: Callable) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def edges(ring: Column) -> Column:
    """``array<struct<p,q>>`` of consecutive vertices, closing edge included."""
    return let(ring, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, F.least(F.size(r), F.lit(1)))), lambda p, q: F.struct(p.alias("p"), q.alias("q"))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def signed_area(ring: Column) -> Column:
    """Shoelace; positive for counter-clockwise rings with y upwards."""
    return _sum(F.transform(edges(ring), _cross)) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def exterior(poly: Column) -> Column:
    return poly[0]


def interiors(poly: Column) -> Column:
    return F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0)))


def remove_holes(poly: Column) -> Column:
    return F.slice(poly, 1, 1)


def area(poly: Column) -> Column:
    """Exterior less interiors."""
    return ring_area(exterior(poly)) - _sum(F.transform(interiors(poly), ring_area))


def _moments(ring: Column) -> Column:
    """``struct<a,mx,my>``: unsigned area and its first moments."""
    def of(e):
        sums = F.aggregate(
            e, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")),
            lambda acc, g: F.struct(
                (acc["a"] + _cross(g) / 2).alias("a"), (acc["mx"] + (g["p"]["x"] + g["q"]["x"]) * _cross(g) / 6).alias("mx"),
                (acc["my"] + (g["p"]["y"] + g["q"]["y"]) * _cross(g) / 6).alias("my")))
        return let(sums, lambda s: F.when(s["a"] < 0, F.struct((-s["a"]).alias("a"), (-s["mx"]).alias("mx"), (-s["my"]).alias("my"))).otherwise(s))

    return let(edges(ring), of)


def centroid(poly: Column) -> Column:
    """Centre of area, holes excluded; null coordinates for area 0."""
    def of(rings):
        total = lambda n: rings[0][n] - _sum(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: r[n]))
        return F.struct(F.try_divide(total("mx"), total("a")).alias("x"), F.try_divide(total("my"), total("a")).alias("y"))

    return let(F.transform(poly, _moments), of)


def is_clockwise(ring: Column) -> Column:
    """Whether the sum of (x2 - x1)(y2 + y1) over the edges is positive."""
    return _sum(F.transform(edges(ring), lambda e: (e["q"]["x"] - e["p"]["x"]) * (e["q"]["y"] + e["p"]["y"]))) > 0


def oriented(poly: Column) -> Column:
    """Exterior counter-clockwise, interiors clockwise."""
    turn = lambda r, clockwise: F.when(is_clockwise(r) == clockwise, r).otherwise(F.reverse(r))
    return F.transform(poly, lambda r, i: F.when(i == 0, turn(r, False)).otherwise(turn(r, True)))


def order_vertices(ring: Column) -> Column:
    """Vertices by their angle about the mean."""
    def of(r):
        mx, my = _sum(F.transform(r, lambda p: p["x"])) / F.size(r), _sum(F.transform(r, lambda p: p["y"])) / F.size(r)
        keyed = F.transform(r, lambda p: F.struct(F.atan2(p["y"] - my, p["x"] - mx).alias("t"), p.alias("p")))
        return F.transform(F.array_sort(keyed), lambda k: k["p"])

    return let(ring, of)


def box(poly: Column) -> Column:
    return of_ring(exterior(poly))


def multi_box(parts: Column) -> Column:
    """Least box around the exteriors of several polygons."""
    return of_ring(F.flatten(F.transform(parts, lambda p: p[0])))


def bounding_polygon(poly: Column) -> Column:
    from .box import to_polygon

    return to_polygon(box(poly))


def map_rings(poly: Column, func: Callable) -> Column:
    return F.transform(poly, func)


def about_point(poly: Column, about) -> tuple[Column, Column]:
    """Named anchor of a polygon: origin, centroid, a point, or extreme directions like ``xmin,ymax`` (the first decides, the second breaks ties)."""
    if not isinstance(about, str):
        return P.num(about[0]), P.num(about[1])
    if about == "origin":
        return F.lit(0.0), F.lit(0.0)
    if about in ("centroid", "center"):
        c = centroid(poly)
        return c["x"], c["y"]
    keys = []
    for part in about.split(","):
        axis, end = part.strip()[0], part.strip()[1:4]
        if axis not in "xy" or end not in ("min", "max"):
            raise KeyError(about)
        keys.append((axis, 1 if end == "min" else -1))
    best = F.array_min(F.transform(exterior(poly), lambda p: F.struct(*[(p[a] * s).alias(f"k{i}") for i, (a, s) in enumerate(keys)], p["x"].alias("x"), p["y"].alias("y"))))
    return best["x"], best["y"]


def translate(poly: Column, dx, dy) -> Column:
    return map_rings(poly, lambda r: P.translate(r, dx, dy))


def scale(poly: Column, sx, sy=None, about="origin") -> Column:
    at = about_point(poly, about)
    return map_rings(poly, lambda r: P.scale(r, sx, sy, at))


def rotate(poly: Column, theta, about="origin") -> Column:
    at = about_point(poly, about)
    return map_rings(poly, lambda r: P.rotate(r, theta, at))


def warp(poly: Column, m: Column) -> Column:
    from .matrix import warp_point

    return F.when(m.isNull(), poly).otherwise(F.transform(poly, lambda r: F.transform(r, lambda p: warp_point(m, p))))


def round_half_even(poly: Column, decimals: int = 0) -> Column:
    return map_rings(poly, lambda r: P.round_half_even(r, decimals))


def swap_axes(poly: Column) -> Column:
    return map_rings(poly, P.swap_axes)


def clip_vertices(poly: Column, x_min, y_min, x_max, y_max) -> Column:
    """Exterior vertices clamped into a box (no geometric clipping)."""
    clamp = lambda v, lo, hi: F.least(F.greatest(v, P.num(lo)), P.num(hi))
    return F.transform(poly, lambda r, i: F.when(i == 0, P.map_xy(r, lambda p: clamp(p["x"], x_min, x_max), lambda p: clamp(p["y"], y_min, y_max))).otherwise(r))


def regular(n, x=0.0, y=0.0, r=1.0) -> Column:
    """Regular polygon of ``n`` vertices about (x, y)."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: P.point(P.num(x) + P.num(r) * F.cos(i * (2 * math.pi) / n), P.num(y) + P.num(r) * F.sin(i * (2 * math.pi) / n)))
    return F.array(ring)


def circle(x=0.0, y=0.0, r=1.0, resolution: int = 64) -> Column:
    return regular(resolution, x, y, r)


def star(x=0.0, y=0.0, r=1.0) -> Column:
    """Outline of the five-pointed star inscribed in a circle."""
    inner = math.cos(2 * math.pi / 5) / math.cos(math.pi / 5)
    pts = [((r if i % 2 == 0 else r * inner), i * math.pi / 5) for i in range(10)]
    return F.array(F.array(*[P.point(x + q * math.cos(t), y + q * math.sin(t)) for q, t in pts]))


# codecs ------------------------------------------------------------------------------


def to_wkt(poly: Column) -> Column:
    """POLYGON text with closed rings."""
    pair = lambda p: F.concat(P._number(p["x"]), F.lit(" "), P._number(p["y"]))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), pair), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(poly, ring), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Rings of POLYGON text, unclosed."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def ring(s):
        pts = F.transform(F.split(F.trim(s), r"\s*,\s*"), lambda p: F.struct(
            F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
        return let(pts, lambda r: F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r))

    return F.transform(rings, ring)


def to_geojson(poly: Column) -> Column:
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), _coordinates(poly).alias("coordinates")))


def multi_to_geojson(parts: Column) -> Column:
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(parts, _coordinates).alias("coordinates")))


def _coordinates(poly: Column) -> Column:
    return F.transform(poly, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))


def _rings(coordinates: Column) -> Column:
    def ring(c):
        pts = F.transform(c, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        return let(pts, lambda r: F.when((F.size(r) > 1) & (r[0] == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r))

    return F.transform(coordinates, ring)


def from_geojson(text: Column) -> Column:
    parsed = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    return F.when(parsed["type"] == "Polygon", _rings(parsed["coordinates"]))


def multi_from_geojson(text: Column) -> Column:
    many = F.from_json(text, "type string, coordinates array<array<array<array<double>>>>")
    one = F.from_json(text, "type string, coordinates array<array<array<double>>>")
    return F.when(one["type"] == "Polygon", F.array(_rings(one["coordinates"]))).when(many["type"] == "MultiPolygon", F.transform(many["coordinates"], _rings))


def to_coco(poly: Column) -> Column:
    """Flat x, y, ... of a polygon without holes; null if it has some."""
    return F.when(F.size(poly) == 1, F.flatten(F.transform(exterior(poly), lambda p: F.array(p["x"], p["y"]))))


def to_coco_new(poly: Column) -> Column:
    return F.struct(_coordinates(poly)[0].alias("exterior"), F.slice(_coordinates(poly), 2, F.greatest(F.size(poly) - 1, F.lit(0))).alias("interiors"))


def from_coco(flat: Column) -> Column:
    return F.array(F.transform(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: F.struct(
        F.get(flat, i * 2).cast("double").alias("x"), F.get(flat, i * 2 + 1).cast("double").alias("y"))))


def segmentation_kind(text: Column) -> Column:
    """What a COCO segmentation string holds: ``rle``, ``polygon``, ``multipolygon``, ``geojson`` or null."""
    v = F.try_parse_json(text)
    has = lambda path: F.try_variant_get(v, path, "string").isNotNull()
    return (
        F.when(has("$.counts"), "rle").when(has("$.coordinates"), "geojson").when(has("$.exterior"), "polygon")
        .when(has("$[0].exterior") | F.try_variant_get(v, "$[0][0]", "double").isNotNull(), "multipolygon")
        .when(F.try_variant_get(v, "$[0]", "double").isNotNull(), "polygon"))
