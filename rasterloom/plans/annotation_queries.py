"""Queries of segmentations of mixed form, of heatmaps brought to one grid and of patches between pixels; :mod:`.queries` adds them to its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions import segmentation
from ..operators import heatmap, runlength, subpixel
from . import fixtures
from .queries import BOXES, PIXELS, q6, query, r6

_N = "det_id % 40 as zeros, 1 + det_id % 31 as ones"
_AREA = "(x2-x1)*(y2-y1)"


@query("segmentation_mixed", f"""with {BOXES}, k as (select *, det_id % 7 as form, {_N} from boxes_v)
 select image_id, case form when 0 then 'polygon' when 1 then 'polygon' when 2 then 'multipolygon' when 3 then 'multipolygon' when 4 then 'mask' when 5 then 'mask' else 'null' end as kind,
 count(*) as n, {q6(f"coalesce(sum(case form when 0 then {_AREA} when 1 then {_AREA}*0.75 when 2 then {_AREA}*1.25 when 3 then {_AREA} when 4 then ones when 5 then ones end), 0)", "area")} from k group by 1, 2""")
def segmentation_mixed(spark, sf_dir):
    d = fixtures.boxes(spark, sf_dir).select("image_id", "det_id", "box.*").withColumns({"zeros": F.col("det_id") % 40, "ones": 1 + F.col("det_id") % 31})
    corners = lambda s: [F.col(c) if s == 1 else F.col(c[0] + "1") + (F.col(c) - F.col(c[0] + "1")) * s for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")]
    flat = lambda s=1: F.array(*corners(s))
    ring = lambda s=1: F.array(*[F.array(*corners(s)[i:i + 2]) for i in range(0, 8, 2)])
    size, counts = F.array(F.lit(8), F.lit(10)), F.array(F.col("zeros"), F.col("ones"), 80 - F.col("zeros") - F.col("ones"))
    forms = [
        F.to_json(flat()), F.to_json(F.struct(ring().alias("exterior"), F.array(ring(0.5)).alias("interiors"))), F.to_json(F.array(flat(), flat(0.5))),
        F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring())).alias("coordinates"))), F.to_json(F.struct(size.alias("size"), counts.alias("counts"))),
        F.to_json(F.struct(size.alias("size"), runlength.to_coco_string(counts.cast("array<int>")).alias("counts")))]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(F.col("det_id") % 7 == i, form).otherwise(text)
    lists = d.withColumn("v", F.parse_json(text)).groupBy("image_id").agg(F.collect_list(F.coalesce("v", F.parse_json(F.lit("null")))).alias("items"))
    made = lists.select("image_id", F.explode(segmentation.coerce_list(F.col("items"))).alias("s"))
    return made.groupBy("image_id", F.coalesce("s.kind", F.lit("null")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), r6(F.coalesce(F.sum(segmentation.area(F.col("s"))), F.lit(0.0)), "area"))


#: Matrices from the grids of even and odd heatmaps to the image.
EVEN, ODD = (2.0, 0.0, 0.0, 0.0, 2.0, 0.0), (2.5, 0.25, -1.0, 0.5, 2.0, 1.0)


def _other_to_even() -> str:
    a, b, c, d, e, f = ODD
    size = a * e - b * d
    return f"((2*x-({c}))*{e}-(2*y-({f}))*{b})/{size} as sx, ((2*y-({f}))*{a}-(2*x-({c}))*{d})/{size} as sy"


@query("heatmap_align", f"""with {PIXELS}, g as (select i//8 as y, i%8 as x from range(64) r(i)), t as (select y, x, {_other_to_even()} from g),
 w as (select y, x, floor(sy)+a as iy, floor(sx)+b as ix, (1-abs(sy-floor(sy)-a))*(1-abs(sx-floor(sx)-b)) as w from t, range(2) p(a), range(2) q(b)),
 o as (select vec_id//2 as pair, w.y, w.x, sum(w*abs(coalesce(s.v,0))) as p from (select distinct vec_id from pixels_v where vec_id%2=1) d cross join w left join (select vec_id as id, y as sy, x as sx, v from pixels_v) s on s.id=d.vec_id and s.sy=w.iy and s.sx=w.ix group by 1,2,3),
 e as (select vec_id//2 as pair, y, x, abs(v) as p from pixels_v where vec_id%2=0),
 c as (select * from o union all select * from e)
 select pair, cast(y as bigint) as y, cast(x as bigint) as x, {q6("case when min(p)=0 then 0 else exp(avg(ln(nullif(p,0)))) end", "p")} from c group by 1,2,3""")
def heatmap_align(spark, sf_dir):
    maps = fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", F.abs("v").alias("p"))
    to_img = F.when(F.col("vec_id") % 2 == 0, M.make(*EVEN)).otherwise(M.make(*ODD))
    frames = maps.select("vec_id").distinct().select("vec_id", to_img.alias("to_img"), M.make(*EVEN).alias("target"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    aligned = heatmap.align(maps, frames, ["vec_id"], "p").withColumn("pair", F.floor(F.col("vec_id") / 2))
    return heatmap.combine(aligned, ["pair"], "p").select("pair", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("p", "p"))


#: Where the embeddings of a group lie in its canvas of 20 by 20: steps of quarters of a pixel.
_OY, _OX = "(vec_id*7 % 53)*0.25", "(vec_id*13 % 61)*0.25 - 1.5"


@query("subpixel_accumulate", f"""with {PIXELS}, s as (select vec_id%50 as grp, {_OY}+y as py, {_OX}+x as px, v from pixels_v),
 t as (select grp, floor(py)+a as y, floor(px)+b as x, (1-abs(py-floor(py)-a))*(1-abs(px-floor(px)-b))*v as v from s, range(2) p(a), range(2) q(b)),
 d as (select grp, i//20 as y, i%20 as x from (select distinct grp from s), range(400) r(i))
 select d.grp, cast(d.y as bigint) as y, cast(d.x as bigint) as x, {q6("coalesce(sum(t.v), 0)", "v")} from d left join t on t.grp=d.grp and t.y=d.y and t.x=d.x group by 1,2,3""")
def subpixel_accumulate(spark, sf_dir):
    patches = fixtures.pixels(spark, sf_dir).select((F.col("vec_id") % 50).alias("grp"), F.col("vec_id").alias("patch"), "y", "x", "v", F.expr(_OY).cast("double").alias("oy"), F.expr(_OX).cast("double").alias("ox"))
    cells = patches.select("grp").distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(399))))
    canvas = cells.select("grp", F.floor(F.col("_i") / 20).alias("y"), (F.col("_i") % 20).alias("x"), F.lit(0.0).alias("v"))
    return subpixel.splat(canvas, patches, ["grp"]).select("grp", "y", "x", r6("v", "v"))
