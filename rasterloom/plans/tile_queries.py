"""Queries of tiled warps and resizes, each border and interpolation; :mod:`.queries` adds them to its own."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from ..functions import polygon as G
from ..operators import contours, runlength, tiles
from . import fixtures
from .queries import ID, PIXELS, q6, query, r6

#: Rotates, shears, scales and shifts 8x8 images so that a part of the result lies outside on every side.
MATRIX = np.array([[1.25, 0.5, -1.0], [-0.25, 1.0, 2.0], [0.0, 0.0, 1.0]])
TILTED = np.array([[1.25, 0.5, -1.0], [-0.25, 1.0, 2.0], [0.01, 0.02, 1.0]])

_FOLD = {
    "constant": "{i}", "replicate": "greatest(least({i},7),0)", "wrap": "((({i})%8)+8)%8",
    "reflect": "case when ((({i})%16)+16)%16<8 then ((({i})%16)+16)%16 else 15-((({i})%16)+16)%16 end",
    "reflect101": "case when ((({i})%14)+14)%14<8 then ((({i})%14)+14)%14 else 14-((({i})%14)+14)%14 end",
}
_SINC = "(case when {d}=0 then 1 else sin(pi()*{d})/(pi()*{d}) end)"
_WEIGHT = {
    "nearest": (0, "1"), "linear": (1, "greatest(0,1-abs({d}))"),
    "cubic": (2, "(case when abs({d})<=1 then 1.25*abs({d})**3-2.25*abs({d})**2+1 when abs({d})<2 then -0.75*abs({d})**3+3.75*abs({d})**2-6*abs({d})+3 else 0 end)"),
    "lanczos": (4, f"(case when abs({{d}})<4 then {_SINC}*{_SINC.replace('{d}', '({d}/4)')} else 0 end)"),
}


def sampled_sql(inverse: np.ndarray, height: int, width: int, kind: str, border: str, value: float) -> str:
    """All taps of all pixels of the result, weighed and summed."""
    u, v, w = (f"({float(r[0])!r}*x+{float(r[1])!r}*y+{float(r[2])!r})" for r in inverse)
    reach, weight = _WEIGHT[kind]
    taps = f"range({1 - reach},{reach + 1})" if reach else "range(1)"
    base = "floor({c})" if reach else "round_even({c},0)"
    return f"""with {PIXELS}, g as (select i//{width} as y, i%{width} as x from range({height * width}) r(i)),
 p as (select y, x, {v}/{w} as sy, {u}/{w} as sx from g),
 t as (select y, x, sy, sx, cast({base.format(c="sy")} as int)+a as iy, cast({base.format(c="sx")} as int)+b as ix from p, unnest({taps}) s(a), unnest({taps}) q(b)),
 k as (select y, x, {_FOLD[border].format(i="iy")} as jy, {_FOLD[border].format(i="ix")} as jx, {weight.format(d="(sy-iy)")}*{weight.format(d="(sx-ix)")} as w from t)
 select d.vec_id, k.y, k.x, {q6(f"sum(w*coalesce(s.v,{value}))/sum(w)", "v")} from (select distinct vec_id from pixels_v) d cross join k
 left join pixels_v s on s.vec_id=d.vec_id and s.y=k.jy and s.x=k.jx group by 1,2,3"""


def _add(name: str, matrix: np.ndarray, height: int, width: int, kind: str, border: str, value: float = 0.0, tile: int = 5) -> None:
    def run(spark, sf_dir):
        source = tiles.tiled(fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", "v"), ID, tile)
        made = tiles.untiled(tiles.warp(source, ID, matrix, height, width, tile, kind, border, value), ID, tile)
        return made.select("vec_id", "y", "x", r6("v", "v"))

    query(name, sampled_sql(np.linalg.inv(matrix), height, width, kind, border, value))(run)


for _kind in ("nearest", "linear", "cubic", "lanczos"):
    _add(f"warp_tiled_{_kind}", MATRIX, 11, 10, _kind, "constant", 0.25)
    _add(f"resize_tiled_{_kind}", np.array([[1.625, 0, 0.3125], [0, 0.75, -0.125], [0, 0, 1.0]]), 6, 13, _kind, "replicate")
for _border in ("replicate", "reflect", "reflect101", "wrap"):
    _add(f"warp_tiled_{_border}", MATRIX, 11, 10, "linear", _border)
_add("warp_tiled_projective", TILTED, 10, 10, "linear", "constant")


_SIDES = f"""with {PIXELS}, o as (select vec_id, y, x from pixels_v where b=1), d as (select * from (values (0,1),(1,0),(0,-1),(-1,0)) t(dy,dx)),
 s as (select o.vec_id, count(*) filter (where n.vec_id is null) as sides from o cross join d left join o n on n.vec_id=o.vec_id and n.y=o.y+dy and n.x=o.x+dx group by 1)
 select o.vec_id, {q6("count(*)", "area")}, {q6("any_value(sides)", "outline")} from o join s using (vec_id) group by 1"""


@query("mask_contours", _SIDES)
def mask_contours(spark, sf_dir):
    pixels = fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", F.col("b").alias("v"))
    rings = contours.mask_rings(runlength.encode_masks(pixels, ID), ID, tile=5.0)
    length = F.aggregate(G.edges(F.col("points")), F.lit(0.0), lambda acc, e: acc + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))
    return rings.groupBy("vec_id").agg(r6(F.sum("area"), "area"), r6(F.sum(length), "outline"))
