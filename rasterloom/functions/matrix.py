"""3x3 transforms as Column expressions: ``struct<a11..a33:double>``; null stands for the identity."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .box import num

NAMES = [f"a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


def make(*values) -> Column:
    """From nine numbers, or six for an affine transform."""
    values = [*values, 0, 0, 1] if len(values) == 6 else list(values)
    return F.struct(*[num(v).cast("double").alias(n) for v, n in zip(values, NAMES, strict=True)])


def eye() -> Column:
    return make(1, 0, 0, 0, 1, 0)


def entries(m: Column) -> list[Column]:
    return [m[n] for n in NAMES]


def bound(m: Column, body):
    """``body(m)`` with anything but a plain column evaluated once, so compositions stay linear in size."""
    if re.fullmatch(r"Column<'[\w.`]+'>", str(m)):
        return body(m)
    return F.transform(F.array(m), body)[0]


def or_eye(m: Column) -> Column:
    return F.coalesce(m, eye())


def matmul(a: Column, b: Column) -> Column:
    """``a`` after ``b``."""
    def product(p, q):
        x, y = entries(p), entries(q)
        return make(*[x[3 * i] * y[j] + x[3 * i + 1] * y[3 + j] + x[3 * i + 2] * y[6 + j] for i in range(3) for j in range(3)])

    return bound(or_eye(a), lambda p: bound(or_eye(b), lambda q: product(p, q)))


def det(m: Column) -> Column:
    def of(p):
        a, b, c, d, e, f, g, h, i = entries(p)
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    return bound(or_eye(m), of)


def inv(m: Column) -> Column:
    """Adjugate over determinant; null entries if singular; null stays null (identity)."""
    def of(p):
        a, b, c, d, e, f, g, h, i = entries(p)
        size = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
        adjugate = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
        return F.when(p.isNotNull(), make(*[F.try_divide(v, size) for v in adjugate]))

    return bound(m, of)


def transpose(m: Column) -> Column:
    e = entries(m)
    return F.when(m.isNotNull(), make(*[e[3 * j + i] for i in range(3) for j in range(3)]))


def isclose_identity(m: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    def of(p):
        close = F.lit(True)
        for v, one in zip(entries(p), (1, 0, 0, 0, 1, 0, 0, 0, 1), strict=True):
            close = close & (F.abs(v - one) <= atol + rtol * one)
        return close

    return bound(or_eye(m), of)


def is_affine(m: Column) -> Column:
    e = or_eye(m)
    return (e["a31"] == 0) & (e["a32"] == 0) & (e["a33"] == 1)


def scale(sx, sy=None) -> Column:
    return make(sx, 0, 0, 0, sx if sy is None else sy, 0)


def translate(tx, ty) -> Column:
    return make(1, 0, tx, 0, 1, ty)


def rotate(theta) -> Column:
    t = num(theta)
    return make(F.cos(t), -F.sin(t), 0, F.sin(t), F.cos(t), 0)


def shear_x(k) -> Column:
    return make(1, k, 0, 0, 1, 0)


def affine(scale_=(1, 1), offset=(0, 0), theta=0, shearx=0, about=(0, 0)) -> Column:
    """Scale, then x-shear, then rotation, then offset, about a point; in closed form."""
    sx, sy = map(num, scale_)
    tx, ty = map(num, offset)
    x0, y0 = map(num, about)
    t, k = num(theta), num(shearx)
    c, s = F.cos(t), F.sin(t)
    a11, a21 = sx * c, sx * s
    a12, a22 = sy * (k * c - s), sy * (k * s + c)
    return make(a11, a12, tx + x0 - x0 * a11 - y0 * a12, a21, a22, ty + y0 - x0 * a21 - y0 * a22)


def projective(scale_=(1, 1), offset=(0, 0), theta=0, shearx=0, uv=(0, 0), about=(0, 0)) -> Column:
    """An affine transform followed by the perspective terms ``uv``, about a point."""
    x0, y0 = map(num, about)
    bend = make(1, 0, 0, 0, 1, 0, uv[0], uv[1], 1)
    inner = matmul(affine(scale_, offset, theta, shearx), bend)
    return matmul(matmul(translate(x0, y0), inner), translate(-x0, -y0))


def decompose(m: Column) -> Column:
    """``struct<tx,ty,sx,sy,shearx,theta>`` of an affine transform; the larger of sine and cosine is divided by."""
    return bound(or_eye(m), _decomposed)


def _decomposed(e: Column) -> Column:
    theta = F.atan2(e["a21"], e["a11"])
    s, c = F.sin(theta), F.cos(theta)
    slant = e["a12"] * c + e["a22"] * s
    sy = F.when(F.abs(c) < F.abs(s), F.try_divide(slant * c - e["a12"], s)).otherwise(F.try_divide(e["a22"] - slant * s, c))
    return F.struct(
        e["a13"].alias("tx"), e["a23"].alias("ty"), F.sqrt(e["a11"] * e["a11"] + e["a21"] * e["a21"]).alias("sx"),
        sy.alias("sy"), F.try_divide(slant, sy).alias("shearx"), theta.alias("theta"))


def decompose_projective(m: Column) -> Column:
    """Affine parameters and ``u, v`` of an affine transform followed by perspective terms.

    With bottom row ``(u, v, 1)`` of ``affine @ bend``, the affine part's entries are those
    of the product less ``u`` or ``v`` times its offset.
    """
    return bound(or_eye(m), _decomposed_projective)


def _decomposed_projective(e: Column) -> Column:
    u, v = F.try_divide(e["a31"], e["a33"]), F.try_divide(e["a32"], e["a33"])
    tx, ty = F.try_divide(e["a13"], e["a33"]), F.try_divide(e["a23"], e["a33"])
    part = make(
        F.try_divide(e["a11"], e["a33"]) - tx * u, F.try_divide(e["a12"], e["a33"]) - tx * v, tx,
        F.try_divide(e["a21"], e["a33"]) - ty * u, F.try_divide(e["a22"], e["a33"]) - ty * v, ty)
    return bound(decompose(part), lambda d: F.struct(*[d[n].alias(n) for n in ("tx", "ty", "sx", "sy", "shearx", "theta")], u.alias("u"), v.alias("v")))


def eccentricity(m: Column) -> Column:
    """Of the ellipse that the unit circle becomes."""
    e = or_eye(m)
    a, b, c, d = e["a11"], e["a12"], e["a21"], e["a22"]
    p, q = (a * a + b * b + c * c + d * d) / 2, a * d - b * c
    spread = F.sqrt(F.greatest(p * p - q * q, F.lit(0.0)))
    return F.try_divide(F.sqrt(2 * spread), F.sqrt(p + spread))


def concise(m: Column) -> Column:
    """Map of the parameters that differ from the identity's."""
    d = decompose(m)
    default = {"tx": 0.0, "ty": 0.0, "sx": 1.0, "sy": 1.0, "shearx": 0.0, "theta": 0.0}
    pairs = F.create_map(*[x for n in default for x in (F.lit(n), d[n])])
    plain = F.create_map(*[x for n, v in default.items() for x in (F.lit(n), F.lit(v))])
    return F.map_filter(pairs, lambda k, v: F.abs(v - plain[k]) > 1e-12)


def to_gdal(m: Column) -> Column:
    e = or_eye(m)
    return F.array(*[e[n] for n in ("a13", "a11", "a12", "a23", "a21", "a22")])


def from_gdal(a: Column) -> Column:
    return make(a[1], a[2], a[0], a[4], a[5], a[3])


def to_shapely(m: Column) -> Column:
    e = or_eye(m)
    return F.array(*[e[n] for n in ("a11", "a12", "a21", "a22", "a13", "a23")])


def from_shapely(a: Column) -> Column:
    return make(a[0], a[1], a[4], a[2], a[3], a[5])


def fliprot(flip_axis: int | None = None, rot_k: int = 0, canvas_dsize: tuple = (0, 0)) -> Column:
    """Optional flip (axis 0 up-down, 1 left-right, 2 both), then ``rot_k`` quarter turns of an image of (width, height)."""
    w, h = canvas_dsize
    out = eye()
    if flip_axis is not None:
        out = make(-1 if flip_axis in (1, 2) else 1, 0, (w - 1) if flip_axis in (1, 2) else 0, 0, -1 if flip_axis in (0, 2) else 1, (h - 1) if flip_axis in (0, 2) else 0)
    for _ in range(rot_k % 4):
        # a quarter turn takes (x, y) to (y, w - 1 - x)
        out = matmul(make(0, 1, 0, -1, 0, w - 1), out)
        w, h = h, w
    return out


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Image of a point; a vanishing third coordinate gives null."""
    w = m["a31"] * x + m["a32"] * y + m["a33"]
    px = m["a11"] * x + m["a12"] * y + m["a13"]
    py = m["a21"] * x + m["a22"] * y + m["a23"]
    flat = (m["a31"] == 0) & (m["a32"] == 0) & (m["a33"] == 1)
    return F.when(flat, px).otherwise(F.try_divide(px, w)), F.when(flat, py).otherwise(F.try_divide(py, w))


def warp_point(m: Column, p: Column) -> Column:
    def of(e):
        x, y = apply(e, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return bound(or_eye(m), of)


def warp_points(m: Column, pts: Column) -> Column:
    return F.when(m.isNull(), pts).otherwise(F.transform(pts, lambda p: warp_point(m, p)))


def add_homog(x: Column, y: Column) -> Column:
    return F.array(x, y, F.lit(1.0))


def remove_homog(v: Column, mode: str = "divide") -> Column:
    if mode == "drop":
        return F.slice(v, 1, F.size(v) - 1)
    return F.transform(F.slice(v, 1, F.size(v) - 1), lambda a: F.try_divide(a, F.element_at(v, -1)))


def random(seed: int) -> Column:
    """Seeded affine transform per row: scale in [1, 2], offset in [-1, 1], angle within an eighth turn."""
    r = lambda i, lo, hi: F.rand(seed + i) * (hi - lo) + lo
    return affine((r(0, 1, 2), r(1, 1, 2)), (r(2, -1, 1), r(3, -1, 1)), r(4, -math.pi / 8, math.pi / 8))


def fit_affine(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y", u: str = "u", v: str = "v") -> DataFrame:
    """Per group the affine transform that takes (x, y) nearest to (u, v): ``by, n, a11..a23``.

    Centred moments are sums, so each group is one map-side-combined aggregate.  No points
    give no row, one point a translation, two a similarity, more the least-squares solution;
    collinear points, whose normal equations are singular, give nulls.
    """
    def s(e):
        return F.sum(e)

    X, Y, P, Q = (F.col(c).cast("double") for c in (x, y, u, v))
    m = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), s(X).alias("x"), s(Y).alias("y"), s(P).alias("u"), s(Q).alias("v"),
        s(X * X).alias("xx"), s(X * Y).alias("xy"), s(Y * Y).alias("yy"),
        s(X * P).alias("xu"), s(Y * P).alias("yu"), s(X * Q).alias("xv"), s(Y * Q).alias("yv"))
    n = F.col("n")
    c = lambda ab, a, b: F.col(ab) - F.col(a) * F.col(b) / n
    xx, xy, yy = c("xx", "x", "x"), c("xy", "x", "y"), c("yy", "y", "y")
    xu, yu, xv, yv = c("xu", "x", "u"), c("yu", "y", "u"), c("xv", "x", "v"), c("yv", "y", "v")
    d, r = xx * yy - xy * xy, xx + yy
    cases = lambda full, pair, one: F.when(n == 1, F.lit(one)).when(n == 2, F.try_divide(pair, r)).otherwise(F.try_divide(full, d))
    out = m.select(
        *by, "n", "x", "y", "u", "v",
        cases(xu * yy - yu * xy, xu + yv, 1.0).alias("a11"), cases(yu * xx - xu * xy, yu - xv, 0.0).alias("a12"),
        cases(xv * yy - yv * xy, xv - yu, 0.0).alias("a21"), cases(yv * xx - xv * xy, xu + yv, 1.0).alias("a22"))
    return out.select(
        *by, "n", "a11", "a12", ((F.col("u") - F.col("a11") * F.col("x") - F.col("a12") * F.col("y")) / n).alias("a13"),
        "a21", "a22", ((F.col("v") - F.col("a21") * F.col("x") - F.col("a22") * F.col("y")) / n).alias("a23"))


def fit_projective(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y", u: str = "u", v: str = "v") -> DataFrame:
    """Per group the homography by the direct linear transform: ``by, n, a11..a33`` with a33 1.

    The 9x9 normal matrix of the linear system is a sum over points, so it is aggregated
    natively; its null vector comes from an eigendecomposition of that one row a group.
    Coordinates are first whitened with the moments of all points of the group.
    """
    import numpy as np
    import pandas as pd

    names = [(x, "x"), (y, "y"), (u, "u"), (v, "v")]
    stats = pairs.groupBy(*by).agg(
        *[F.avg(a).alias(f"m_{b}") for a, b in names], *[F.stddev_pop(a).alias(f"s_{b}") for a, b in names])
    white = pairs.join(stats, by) if by else pairs.crossJoin(F.broadcast(stats))
    z = {b: (F.col(a) - F.col(f"m_{b}")) / F.when(F.col(f"s_{b}") > 0, F.col(f"s_{b}")).otherwise(1.0) for a, b in names}
    one, zero = F.lit(1.0), F.lit(0.0)
    rows = [
        [z["x"], z["y"], one, zero, zero, zero, -z["u"] * z["x"], -z["u"] * z["y"], -z["u"]],
        [zero, zero, zero, z["x"], z["y"], one, -z["v"] * z["x"], -z["v"] * z["y"], -z["v"]]]
    at = [(i, j) for i in range(9) for j in range(i, 9)]
    normal = white.groupBy(*by, *[f"{p}_{b}" for p in "ms" for _, b in names]).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]) for i, j in at]).alias("upper"))

    def solve(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                a = np.zeros((9, 9))
                for (i, j), value in zip(at, r["upper"], strict=True):
                    a[i, j] = a[j, i] = value
                h = np.linalg.eigh(a)[1][:, 0].reshape(3, 3)
                w = lambda p, q: np.array([[1 / (r[f"s_{p}"] or 1.0), 0, -r[f"m_{p}"] / (r[f"s_{p}"] or 1.0)], [0, 1 / (r[f"s_{q}"] or 1.0), -r[f"m_{q}"] / (r[f"s_{q}"] or 1.0)], [0, 0, 1]])
                h = np.linalg.inv(w("u", "v")) @ h @ w("x", "y")
                out.append((h / h[2, 2]).ravel())
            yield pd.concat([f[[*by, "n"]].reset_index(drop=True), pd.DataFrame(np.array(out).reshape(-1, 9), columns=NAMES)], axis=1)

    kinds = dict(pairs.dtypes)
    return normal.mapInPandas(solve, ", ".join([*(f"{b} {kinds[b]}" for b in by), "n long", *(f"{n} double" for n in NAMES)]))
