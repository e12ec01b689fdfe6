"""Operations on packed rasters that expressions cannot state: resampling, spectra, contours, hulls.

Each is a NumPy kernel and an Arrow-batched UDF around it; an image never leaves its row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..sources.images import RASTER, to_array, to_struct

# resampling --------------------------------------------------------------------------


def _weights(kind: str):
    if kind == "linear":
        return 1, lambda d: np.maximum(0, 1 - np.abs(d))
    if kind == "cubic":
        a = -0.75

        def w(d):
            d = np.abs(d)
            return np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
        return 2, w
    if kind == "lanczos":
        return 4, lambda d: np.where(np.abs(d) < 4, np.sinc(d) * np.sinc(d / 4), 0)
    raise KeyError(kind)


def _edge(i: np.ndarray, n: int, border: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices folded into [0, n) and which of them count."""
    if border == "replicate":
        return np.clip(i, 0, n - 1), np.ones(i.shape, bool)
    if border == "wrap":
        return i % n, np.ones(i.shape, bool)
    if border in ("reflect", "reflect101"):
        period = 2 * n if border == "reflect" else max(1, 2 * (n - 1))
        j = np.mod(i, period)
        return np.where(j < n, j, (2 * n - 1 - j) if border == "reflect" else period - j), np.ones(i.shape, bool)
    return np.clip(i, 0, n - 1), (i >= 0) & (i < n)


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, kind: str = "linear", border: str = "constant", value: float = 0.0) -> np.ndarray:
    """Values of an image at sub-pixel positions."""
    a = a.astype(float)
    if kind == "nearest":
        iy, oky = _edge(np.rint(y).astype(int), a.shape[0], border)
        ix, okx = _edge(np.rint(x).astype(int), a.shape[1], border)
        return np.where((oky & okx)[..., None], a[iy, ix], value)
    r, w = _weights(kind)
    fy, fx = np.floor(y).astype(int), np.floor(x).astype(int)
    out, total = np.zeros((*y.shape, a.shape[2])), np.zeros(y.shape)
    for i in range(1 - r, r + 1):
        iy, oky = _edge(fy + i, a.shape[0], border)
        wy = w(y - fy - i)
        for j in range(1 - r, r + 1):
            ix, okx = _edge(fx + j, a.shape[1], border)
            ww = wy * w(x - fx - j)
            out += ww[..., None] * np.where((oky & okx)[..., None], a[iy, ix], value)
            total += ww
    return out / np.where(total == 0, 1, total)[..., None]


def warp(a: np.ndarray, m: np.ndarray, height: int, width: int, kind: str = "linear", border: str = "constant", value: float = 0.0) -> np.ndarray:
    """Image under a 3x3 transform, pixel centres at whole coordinates."""
    inv = np.linalg.inv(m)
    yy, xx = np.mgrid[:height, :width].astype(float)
    u, v, w = (inv[i, 0] * xx + inv[i, 1] * yy + inv[i, 2] for i in range(3))
    return sample(a, v / w, u / w, kind, border, value)


def resize(a: np.ndarray, height: int, width: int, kind: str = "auto", antialias: bool = False) -> np.ndarray:
    """``nearest linear cubic lanczos area auto``; pixel areas are aligned at the corners."""
    sy, sx = a.shape[0] / height, a.shape[1] / width
    if kind == "auto":
        kind = "area" if max(sy, sx) > 1 else "lanczos"
    if antialias and max(sy, sx) > 1 and kind not in ("area", "nearest"):
        a = blur(a, max(sy, 1) * 0.5, max(sx, 1) * 0.5)
    if kind == "area":
        def mean(n, m):
            w = np.zeros((m, n))
            for i in range(m):
                lo, hi = i * n / m, (i + 1) * n / m
                j = np.arange(int(lo), min(n, math.ceil(hi)))
                w[i, j] = np.minimum(j + 1, hi) - np.maximum(j, lo)
            return w / w.sum(axis=1, keepdims=True)
        return np.einsum("ij,jkc,lk->ilc", mean(a.shape[0], height), a.astype(float), mean(a.shape[1], width))
    y, x = (np.arange(height) + 0.5) * sy - 0.5, (np.arange(width) + 0.5) * sx - 0.5
    if kind == "nearest":
        y, x = np.floor((np.arange(height)) * sy), np.floor((np.arange(width)) * sx)
    yy, xx = np.meshgrid(y, x, indexing="ij")
    return sample(a, yy, xx, kind, "replicate")


def target_size(height: int, width: int, scale=None, dsize=None, max_dim=None, min_dim=None) -> tuple[int, int]:
    """(height, width) from exactly one of a scale, a (width, height) with one part perhaps None, or a bound on a side."""
    if sum(v is not None for v in (scale, dsize, max_dim, min_dim)) != 1:
        raise ValueError("give exactly one of scale, dsize, max_dim and min_dim")
    if dsize is not None:
        w, h = dsize
        return (round(height * w / width) if h is None else h), (round(width * h / height) if w is None else w)
    if max_dim is not None or min_dim is not None:
        scale = max_dim / max(height, width) if max_dim is not None else min_dim / min(height, width)
    sx, sy = scale if isinstance(scale, tuple) else (scale, scale)
    return max(1, round(height * sy)), max(1, round(width * sx))


def letterbox(a: np.ndarray, height: int, width: int, value: float = 0.0) -> np.ndarray:
    """Scaled to fit, centred, padded."""
    s = min(height / a.shape[0], width / a.shape[1])
    inner = resize(a, max(1, round(a.shape[0] * s)), max(1, round(a.shape[1] * s)))
    out = np.full((height, width, a.shape[2]), value, float)
    top, left = (height - inner.shape[0]) // 2, (width - inner.shape[1]) // 2
    out[top:top + inner.shape[0], left:left + inner.shape[1]] = inner
    return out


def blur(a: np.ndarray, sigma_y: float, sigma_x: float) -> np.ndarray:
    out = a.astype(float)
    for axis, sigma in ((0, sigma_y), (1, sigma_x)):
        r = max(1, math.ceil(3 * sigma))
        k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
        n = out.shape[axis]
        out = sum(w * np.take(out, _edge(np.arange(n) + i, n, "reflect101")[0], axis) for i, w in zip(range(-r, r + 1), k / k.sum(), strict=True))
    return out


# spectra -----------------------------------------------------------------------------


def radial_mask(height: int, width: int, radius: float) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    return ((y - height // 2) ** 2 + (x - width // 2) ** 2 <= radius * radius).astype(float)


def fourier_mask(a: np.ndarray, mask: np.ndarray, clip: tuple | None = None) -> np.ndarray:
    """Each channel's centred spectrum times ``mask``, transformed back."""
    spectrum = np.fft.fftshift(np.fft.fft2(a.astype(float), axes=(0, 1)), axes=(0, 1)) * mask[:, :, None]
    out = np.fft.ifft2(np.fft.ifftshift(spectrum, axes=(0, 1)), axes=(0, 1)).real
    return out.clip(*clip) if clip else out


# shapes ------------------------------------------------------------------------------


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull by monotone chains."""
    pts = sorted(set(map(tuple, np.asarray(points, dtype=float).tolist())))
    if len(pts) < 3:
        return np.array(pts).reshape(-1, 2)

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def oriented_box(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Least-area rectangle ``cx, cy, w, h, theta`` around points, w >= h, theta in [-pi/2, pi/2)."""
    hull = convex_hull(points)
    best = None
    for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        t = math.atan2(q[1] - p[1], q[0] - p[0])
        r = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        z = hull @ r.T
        lo, hi = z.min(axis=0), z.max(axis=0)
        w, h = hi - lo
        if best is None or w * h < best[0]:
            c = r.T @ ((lo + hi) / 2)
            best = (w * h, c[0], c[1], w, h, t)
    _, cx, cy, w, h, t = best
    if w < h:
        w, h, t = h, w, t + math.pi / 2
    return float(cx), float(cy), float(w), float(h), (t + math.pi / 2) % math.pi - math.pi / 2


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open chain of points."""
    ring = np.asarray(ring, dtype=float)
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    stack = [(0, len(ring) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d, p = ring[j] - ring[i], ring[i + 1:j] - ring[i]
        n = np.hypot(*d)
        dist = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / n if n else np.hypot(p[:, 0], p[:, 1])
        k = int(dist.argmax())
        if dist[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[keep]


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a counter-clockwise convex one (Sutherland-Hodgman)."""
    out = [tuple(p) for p in subject]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        ring, out = out, []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return np.array(out).reshape(-1, 2)


def ring_area(ring: np.ndarray) -> float:
    x, y = np.asarray(ring, dtype=float).reshape(-1, 2).T
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def convex_iou(a: np.ndarray, b: np.ndarray) -> float:
    """IoU of the hulls of two rings."""
    a, b = convex_hull(a), convex_hull(b)
    inter = ring_area(clip_convex(a, b))
    union = ring_area(a) + ring_area(b) - inter
    return inter / union if union else float("nan")


def morph_rings(a: np.ndarray, b: np.ndarray, alpha: float, n: int | None = None) -> np.ndarray:
    """Ring between two rings, matched by arc length."""
    n = n or max(len(a), len(b))

    def along(r):
        closed = np.vstack([r, r[:1]])
        at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(closed, axis=0).T))])
        t = np.arange(n) / n * at[-1]
        return np.stack([np.interp(t, at, closed[:, i]) for i in (0, 1)], axis=1)

    return (1 - alpha) * along(np.asarray(a, float)) + alpha * along(np.asarray(b, float))


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines of the 1-cells along cell borders: exteriors one way, holes the other."""
    m = np.pad(np.asarray(mask).astype(bool), 1)
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    ys, xs = np.nonzero(m)
    for y, x in zip(ys.tolist(), xs.tolist(), strict=True):
        for ny, nx, a, b in ((y - 1, x, (x, y), (x + 1, y)), (y, x + 1, (x + 1, y), (x + 1, y + 1)), (y + 1, x, (x + 1, y + 1), (x, y + 1)), (y, x - 1, (x, y + 1), (x, y))):
            if not m[ny, nx]:
                nxt.setdefault(a, []).append(b)
    out = []
    while nxt:
        start = next(iter(nxt))
        ring, at = [start], nxt[start].pop()
        if not nxt[start]:
            del nxt[start]
        while at != start:
            ring.append(at)
            step = nxt[at].pop()
            if not nxt[at]:
                del nxt[at]
            at = step
        pts = np.array(ring) - 1
        corner = (np.roll(pts, 1, axis=0) - pts) @ np.array([[0, 1], [-1, 0]])
        out.append(pts[(corner * (np.roll(pts, -1, axis=0) - pts)).sum(axis=1) != 0])
    return out


# UDFs --------------------------------------------------------------------------------


def raster_udf(kernel, dtype: str | None = None):
    """Column function over packed rasters: ``kernel`` maps an array to an array."""
    @F.pandas_udf(RASTER)
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.to_dict("records"):
            a = np.asarray(kernel(to_array(r)))
            out.append(to_struct(a.astype(dtype or a.dtype)))
        return pd.DataFrame(out, columns=["height", "width", "channels", "dtype", "data"])
    return run


def resize_udf(height: int, width: int, kind: str = "auto"):
    return raster_udf(lambda a: resize(a, height, width, kind))


def warp_udf(matrix, height: int, width: int, kind: str = "linear", border: str = "constant"):
    m = np.asarray(matrix, float)
    return raster_udf(lambda a: warp(a, m, height, width, kind, border))


def fourier_udf(radius: float):
    return raster_udf(lambda a: fourier_mask(a, radial_mask(*a.shape[:2], radius)))
