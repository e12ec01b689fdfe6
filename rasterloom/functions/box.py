"""Axis-aligned boxes as Column expressions.

A box is ``struct<x1,y1,x2,y2:double>`` (left, top, right, bottom).  Every function takes
and returns Columns, so boxes stay in whole-stage codegen; null boxes give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted names of box formats.
FORMATS = {
    "xywh": "xywh", "cxywh": "cxywh", "ltrb": "ltrb", "tlbr": "ltrb", "xyxy": "ltrb",
    "xxyy": "xxyy", "extent": "xxyy", "yyxx": "yyxx", "rchw": "rchw",
}
#: Field names of each format, in order.
FIELDS = {
    "ltrb": ("x1", "y1", "x2", "y2"), "xywh": ("x", "y", "w", "h"), "cxywh": ("cx", "cy", "w", "h"),
    "xxyy": ("x1", "x2", "y1", "y2"), "yyxx": ("y1", "y2", "x1", "x2"), "rchw": ("r", "c", "h", "w"),
}


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def make(x1, y1, x2, y2) -> Column:
    return F.struct(*[num(v).cast("double").alias(n) for v, n in zip((x1, y1, x2, y2), FIELDS["ltrb"], strict=True)])


def canonical(fmt: str) -> str:
    try:
        return FORMATS[fmt.lower().lstrip("_")]
    except KeyError:
        raise KeyError(f"unknown box format {fmt!r}") from None


def from_format(fmt: str, a, b, c, d) -> Column:
    """Box from four numbers in the given format."""
    a, b, c, d = map(num, (a, b, c, d))
    return {
        "ltrb": lambda: make(a, b, c, d), "xywh": lambda: make(a, b, a + c, b + d),
        "cxywh": lambda: make(a - c / 2, b - d / 2, a + c / 2, b + d / 2),
        "xxyy": lambda: make(a, c, b, d), "yyxx": lambda: make(c, a, d, b), "rchw": lambda: make(b, a, b + d, a + c),
    }[canonical(fmt)]()


def to_format(box: Column, fmt: str) -> Column:
    """Struct with the fields of another format."""
    fmt = canonical(fmt)
    x1, y1, x2, y2 = sides(box)
    values = {
        "ltrb": (x1, y1, x2, y2), "xywh": (x1, y1, x2 - x1, y2 - y1),
        "cxywh": ((x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1),
        "xxyy": (x1, x2, y1, y2), "yyxx": (y1, y2, x1, x2), "rchw": (y1, x1, y2 - y1, x2 - x1),
    }[fmt]
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS[fmt], strict=True)])


def sides(box: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(box[n] for n in FIELDS["ltrb"])


def width(box: Column) -> Column:
    return box["x2"] - box["x1"]


def height(box: Column) -> Column:
    return box["y2"] - box["y1"]


def area(box: Column) -> Column:
    """Product of the signed sides."""
    return width(box) * height(box)


def aspect_ratio(box: Column) -> Column:
    """Width over height; null for height 0."""
    return F.try_divide(width(box), height(box))


def center_x(box: Column) -> Column:
    return (box["x1"] + box["x2"]) / 2


def center_y(box: Column) -> Column:
    return (box["y1"] + box["y2"]) / 2


def center(box: Column) -> Column:
    return F.struct(center_x(box).alias("x"), center_y(box).alias("y"))


def corners(box: Column) -> Column:
    """Ring of the four corners: left top, left bottom, right bottom, right top."""
    x1, y1, x2, y2 = sides(box)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x1, y2), (x2, y2), (x2, y1))])


def to_polygon(box: Column) -> Column:
    return F.array(corners(box))


def of_ring(ring: Column) -> Column:
    """Least box around an array of points; null for no points."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.when(F.size(ring) > 0, make(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def translate(box: Column, dx, dy) -> Column:
    dx, dy = num(dx), num(dy)
    return make(box["x1"] + dx, box["y1"] + dy, box["x2"] + dx, box["y2"] + dy)


def scale(box: Column, sx, sy=None, about: str | tuple = "origin") -> Column:
    """Scaled about the origin, its own center or a point ``(x, y)``."""
    sx, sy = num(sx), num(sx if sy is None else sy)
    if about == "origin":
        return make(box["x1"] * sx, box["y1"] * sy, box["x2"] * sx, box["y2"] * sy)
    if isinstance(about, str):
        if about not in ("center", "centroid"):
            raise KeyError(about)
        ax, ay = center_x(box), center_y(box)
    else:
        ax, ay = map(num, about)
    move = lambda v, a, s: (v - a) * s + a
    return make(move(box["x1"], ax, sx), move(box["y1"], ay, sy), move(box["x2"], ax, sx), move(box["y2"], ay, sy))


def clip(box: Column, x_min, y_min, x_max, y_max) -> Column:
    clamp = lambda v, lo, hi: F.least(F.greatest(v, num(lo)), num(hi))
    x1, y1, x2, y2 = sides(box)
    return make(clamp(x1, x_min, x_max), clamp(y1, y_min, y_max), clamp(x2, x_min, x_max), clamp(y2, y_min, y_max))


def pad(box: Column, left, top, right, bottom) -> Column:
    return make(box["x1"] - num(left), box["y1"] - num(top), box["x2"] + num(right), box["y2"] + num(bottom))


def resize(box: Column, new_width=None, new_height=None, about: str = "xy") -> Column:
    """Sets width or height and keeps the top left corner (``xy``) or the center (``cxy``)."""
    w = width(box) if new_width is None else num(new_width)
    h = height(box) if new_height is None else num(new_height)
    if about == "xy":
        return make(box["x1"], box["y1"], box["x1"] + w, box["y1"] + h)
    if about == "cxy":
        cx, cy = center_x(box), center_y(box)
        return make(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)
    raise ValueError(about)


def transpose(box: Column) -> Column:
    return make(box["y1"], box["x1"], box["y2"], box["x2"])


def round_half_even(box: Column) -> Column:
    return make(*[F.rint(v) for v in sides(box)])


def quantize(box: Column) -> Column:
    """Least box of whole numbers around it."""
    x1, y1, x2, y2 = sides(box)
    return make(F.floor(x1), F.floor(y1), F.ceil(x2), F.ceil(y2))


def nonnegative(box: Column) -> Column:
    """Sides swapped where the extent is negative."""
    x1, y1, x2, y2 = sides(box)
    return make(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def from_slice(y_start, y_stop, x_start, x_stop, shape: tuple | None = None, clip: bool = True, endpoint: bool = True, wrap: bool = False) -> Column:
    """Box of a (row, column) slice.

    ``wrap`` counts negative ends from the far side; ``clip`` keeps ends inside ``shape``
    and turns empty slices into boxes without extent; without ``endpoint`` the last row and
    column are not part of the extent.
    """
    ends = list(map(num, (y_start, y_stop, x_start, x_stop)))
    if shape is not None:
        size = [num(shape[0]), num(shape[0]), num(shape[1]), num(shape[1])]
        ends[1], ends[3] = F.coalesce(ends[1], size[1]), F.coalesce(ends[3], size[3])
        if wrap:
            ends = [F.when(v < 0, v + s).otherwise(v) for v, s in zip(ends, size, strict=True)]
        if clip:
            ends = [F.least(F.greatest(v, F.lit(0.0)), s) for v, s in zip(ends, size, strict=True)]
    elif clip:
        ends = [F.greatest(v, F.lit(0.0)) for v in ends]
    y1, y2, x1, x2 = ends
    if clip:
        y2, x2 = F.greatest(y1, y2), F.greatest(x1, x2)
    if not endpoint:
        y2, x2 = F.greatest(y1, y2 - 1), F.greatest(x1, x2 - 1)
    return make(x1, y1, x2, y2)


def to_slice(box: Column, endpoint: bool = True) -> Column:
    more = 0 if endpoint else 1
    names = ("y_start", "y_stop", "x_start", "x_stop")
    values = (box["y1"], box["y2"] + more, box["x1"], box["x2"] + more)
    return F.struct(*[v.cast("int").alias(n) for v, n in zip(values, names, strict=True)])


def warp(box: Column, m: Column) -> Column:
    """Hull of the corners under a 3x3 matrix ``m``; an axis-aligned affine keeps it exact.  A null matrix is the identity."""
    from . import matrix

    x1, y1, x2, y2 = sides(box)
    pts = [matrix.apply(m, x, y) for x, y in ((x1, y1), (x1, y2), (x2, y2), (x2, y1))]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    hull = make(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    straight = (m["a12"] == 0) & (m["a21"] == 0) & (m["a31"] == 0) & (m["a32"] == 0) & (m["a33"] == 1)
    simple = make(x1 * m["a11"] + m["a13"], y1 * m["a22"] + m["a23"], x2 * m["a11"] + m["a13"], y2 * m["a22"] + m["a23"])
    return F.when(m.isNull(), box).when(straight, simple).otherwise(hull)


def warp_with(box: Column, func) -> Column:
    """Hull of the corners under any function of point structs."""
    return of_ring(F.transform(corners(box), func))


def contains(box: Column, x: Column, y: Column) -> Column:
    """Closed on all sides."""
    return (box["x1"] <= x) & (box["y1"] <= y) & (box["x2"] >= x) & (box["y2"] >= y)


def isect_area(a: Column, b: Column, bias: float = 0.0) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + bias, F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + bias, F.lit(0.0))
    return w * h


def iou(a: Column, b: Column, bias: float = 0.0) -> Column:
    """Intersection over union; NaN where both are empty."""
    inter = isect_area(a, b, bias)
    union = (width(a) + bias) * (height(a) + bias) + (width(b) + bias) * (height(b) + bias) - inter
    return F.coalesce(F.try_divide(inter, union), F.when(inter.isNotNull() & union.isNotNull(), F.lit(float("nan"))))


def iooa(a: Column, b: Column, bias: float = 0.0) -> Column:
    """Intersection over the area of ``b``, whose area 0 counts as 1."""
    size = (width(b) + bias) * (height(b) + bias)
    return isect_area(a, b, bias) / F.when(size == 0, F.lit(1.0)).otherwise(size)


def intersection(a: Column, b: Column) -> Column:
    """Common part; NaN on all sides for disjoint boxes."""
    x1, y1 = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    x2, y2 = F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    nan = F.lit(float("nan"))
    return F.when((x1 <= x2) & (y1 <= y2), make(x1, y1, x2, y2)).otherwise(make(nan, nan, nan, nan))


def union_hull(a: Column, b: Column) -> Column:
    """Least box around both; NaN for a box with negative extent."""
    nan = F.lit(float("nan"))
    good = (a["x1"] <= a["x2"]) & (a["y1"] <= a["y2"]) & (b["x1"] <= b["x2"]) & (b["y1"] <= b["y2"])
    hull = make(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))
    return F.when(good, hull).otherwise(make(nan, nan, nan, nan))


def same(a: Column, b: Column) -> Column:
    return a["x1"].eqNullSafe(b["x1"]) & a["y1"].eqNullSafe(b["y1"]) & a["x2"].eqNullSafe(b["x2"]) & a["y2"].eqNullSafe(b["y2"])


def random(seed: int, limit: float = 1.0, whole: bool = False) -> Column:
    """Box with seeded uniform corners in [0, limit]; one per row."""
    u = [F.rand(seed + i) * limit for i in range(4)]
    u = [F.floor(v) for v in u] if whole else u
    return nonnegative(make(*u))


def to_coco(box: Column) -> Column:
    return F.array(box["x1"], box["y1"], width(box), height(box))


def to_json(box: Column, fmt: str = "ltrb") -> Column:
    return F.to_json(F.struct(F.lit(canonical(fmt)).alias("format"), to_format(box, fmt).alias("data")))
