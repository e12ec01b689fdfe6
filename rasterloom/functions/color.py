"""Colours as Columns: three channels in [0, 1], hue in degrees."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Named colours (CSS basic set and a few common ones) as 24-bit numbers.
NAMED = {
    "aqua": 0x00FFFF, "black": 0x000000, "blue": 0x0000FF, "brown": 0xA52A2A, "coral": 0xFF7F50, "crimson": 0xDC143C,
    "cyan": 0x00FFFF, "darkblue": 0x00008B, "darkgreen": 0x006400, "darkred": 0x8B0000, "fuchsia": 0xFF00FF, "gold": 0xFFD700,
    "gray": 0x808080, "green": 0x008000, "indigo": 0x4B0082, "ivory": 0xFFFFF0, "khaki": 0xF0E68C, "lavender": 0xE6E6FA,
    "lime": 0x00FF00, "magenta": 0xFF00FF, "maroon": 0x800000, "navy": 0x000080, "olive": 0x808000, "orange": 0xFFA500,
    "orchid": 0xDA70D6, "pink": 0xFFC0CB, "plum": 0xDDA0DD, "purple": 0x800080, "red": 0xFF0000, "salmon": 0xFA8072,
    "silver": 0xC0C0C0, "tan": 0xD2B48C, "teal": 0x008080, "tomato": 0xFF6347, "turquoise": 0x40E0D0, "violet": 0xEE82EE,
    "wheat": 0xF5DEB3, "white": 0xFFFFFF, "yellow": 0xFFFF00,
}


def named_colors(spark: SparkSession) -> DataFrame:
    """``name, r, g, b`` of the palette; its size is fixed, so joins may broadcast it."""
    rows = [(n, (v >> 16 & 255) / 255, (v >> 8 & 255) / 255, (v & 255) / 255) for n, v in sorted(NAMED.items())]
    return spark.createDataFrame(rows, "name string, r double, g double, b double")


def to_hex(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.lower(F.lpad(F.hex(to_255(c)), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def to_255(c: Column) -> Column:
    """Truncates like an integer cast."""
    return (c * 255).cast("int")


def from_hex(text: Column) -> Column:
    """``array<double>`` of three or four channels of ``#rrggbb[aa]``; null for other text."""
    parts = F.regexp_extract_all(F.substring(F.trim(text), 2, 8), F.lit("([0-9A-Fa-f]{2})"), F.lit(1))
    return F.when(F.trim(text).rlike(r"^#([0-9A-Fa-f]{2}){3,4}$"), F.transform(parts, lambda p: F.conv(p, 16, 10).cast("double") / 255))


def is_base01(channels: Column) -> Column:
    return F.forall(channels, lambda c: (c >= 0) & (c <= 1))


def is_base255(channels: Column) -> Column:
    return F.forall(channels, lambda c: (c > 0) & (c <= 255)) & F.exists(channels, lambda c: c > 1)


def resolve(df: DataFrame, column: str, out: str = "rgb") -> DataFrame:
    """Adds ``out`` (array of channels) for names or hex strings; unknown text gives null."""
    palette = F.broadcast(named_colors(df.sparkSession).select(F.col("name").alias("_n"), F.array("r", "g", "b").alias("_rgb")))
    joined = df.join(palette, F.lower(F.col(column)) == F.col("_n"), "left")
    return joined.withColumn(out, F.coalesce("_rgb", from_hex(F.col(column)))).drop("_n", "_rgb")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 360), saturation and value in [0, 1]."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    hue = F.when(d == 0, F.lit(0.0)).when(hi == r, F.pmod(F.try_divide(g - b, d), F.lit(6.0))).when(hi == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    return hue * 60, F.coalesce(F.try_divide(d, hi), F.lit(0.0)), hi


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    def channel(n):
        k = F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)


def rgb_to_hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    light = (hi + lo) / 2
    sat = F.coalesce(F.try_divide(hi - lo, 1 - F.abs(2 * light - 1)), F.lit(0.0))
    return rgb_to_hsv(r, g, b)[0], light, sat


def hls_to_rgb(h: Column, l: Column, s: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    a = s * F.least(l, 1 - l)

    def channel(n):
        k = F.pmod(F.lit(float(n)) + h / 30, F.lit(12.0))
        return l - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return channel(0), channel(8), channel(4)


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of sRGB under D65."""
    r, g, b = _linear(r), _linear(g), _linear(b)
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    fy = (l + 16) / 116
    inv = lambda t: F.when(t * t * t > 216 / 24389, t * t * t).otherwise((116 * t - 16) / (24389 / 27))
    x, y, z = 0.95047 * inv(fy + a / 500), inv(fy), 1.08883 * inv(fy - b / 200)
    lin = (3.2404542 * x - 1.5371385 * y - 0.4985314 * z, -0.9692660 * x + 1.8760108 * y + 0.0415560 * z, 0.0556434 * x - 0.2040259 * y + 1.0572252 * z)
    return tuple(F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055) for c in lin)


SPACES = {"hsv": (rgb_to_hsv, hsv_to_rgb), "hls": (rgb_to_hls, hls_to_rgb), "lab": (rgb_to_lab, lab_to_rgb)}


def convert(channels: tuple, src: str, dst: str) -> tuple:
    """Channels between ``rgb bgr hsv hls lab``, through rgb; ``gray`` only as a goal."""
    if src == dst:
        return channels
    rgb = channels if src == "rgb" else channels[::-1] if src == "bgr" else SPACES[src][1](*channels)
    if dst == "gray":
        return (gray(*rgb),)
    return rgb if dst == "rgb" else rgb[::-1] if dst == "bgr" else SPACES[dst][0](*rgb)


def distance(a: tuple, b: tuple, space: str = "lab") -> Column:
    pa, pb = convert(a, "rgb", space), convert(b, "rgb", space)
    total = F.lit(0.0)
    for x, y in zip(pa, pb, strict=True):
        total = total + (x - y) * (x - y)
    return F.sqrt(total)


def interpolate(a: tuple, b: tuple, alpha, ispace: str = "rgb", ospace: str = "rgb") -> tuple:
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    pa, pb = convert(a, "rgb", ispace), convert(b, "rgb", ispace)
    return convert(tuple(x * (1 - alpha) + y * alpha for x, y in zip(pa, pb, strict=True)), ispace, ospace)


def adjust_color(rgb: tuple, saturate: float = 0.0, lighten: float = 0.0) -> tuple:
    """Shifts saturation and value in HSV, clamped."""
    h, s, v = rgb_to_hsv(*rgb)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return hsv_to_rgb(h, clamp(s + saturate), clamp(v + lighten))


def adjust_image(rgb: tuple, saturate: float = 0.0, lighten: float = 0.0) -> tuple:
    """Moves lightness and saturation in HLS a share of the way to 1 or 0."""
    h, l, s = rgb_to_hls(*rgb)  # noqa: E741
    move = lambda c, by: F.least(F.greatest(c + (1 - c) * by if by > 0 else c * (1 + by), F.lit(0.0)), F.lit(1.0))
    return hls_to_rgb(h, move(l, lighten), move(s, saturate))


def nearest_named(df: DataFrame, rgb: tuple[str, str, str], key: list[str], space: str = "lab") -> DataFrame:
    """``key, name, delta`` of the closest palette colour per row; of equally close ones the first by name.

    The palette is a fixed list of some forty literals, folded over in one expression, so
    there is neither a join nor a shuffle.
    """
    own = convert(tuple(F.col(c) for c in rgb), "rgb", space)
    palette = []
    for name, v in sorted(NAMED.items()):
        other = tuple(F.lit((v >> s & 255) / 255) for s in (16, 8, 0))
        goal = convert(other, "rgb", space)
        palette.append(F.struct(*[g.alias(f"c{i}") for i, g in enumerate(goal)], F.lit(name).alias("name")))
    base = df.select(*key, F.array(*own).alias("_own"))
    delta = lambda p: F.sqrt(sum(((p[f"c{i}"] - F.col("_own")[i]) * (p[f"c{i}"] - F.col("_own")[i]) for i in range(3)), F.lit(0.0)))
    best = F.array_min(F.transform(F.array(*palette), lambda p: F.struct(delta(p).alias("delta"), p["name"].alias("name"))))
    return base.select(*key, best.alias("_b")).select(*key, F.col("_b.name").alias("name"), F.col("_b.delta").alias("delta"))


def distinct(n: int) -> list[tuple[float, float, float]]:
    """``n`` colours at even steps of hue."""
    return [colorsys.hsv_to_rgb(i / max(1, n), 0.85, 0.95) for i in range(n)]


def make_orimask(radians: Column, mag: Column | None = None) -> tuple[Column, Column, Column]:
    """Colour of a direction: hue is the angle, saturation and value the magnitude."""
    full = F.pmod(radians, F.lit(2 * 3.141592653589793)) / (2 * 3.141592653589793) * 360
    m = F.lit(1.0) if mag is None else F.least(mag, F.lit(1.0))
    return hsv_to_rgb(full, m, m)
