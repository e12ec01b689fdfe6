"""Queries over the shared tables that exercise the operators, each with SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import color as C
from ..functions import matrix as M
from ..functions import points as P
from ..functions import polygon as G
from ..operators import detections, draw, heatmap, joins, nms, raster, runlength
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BOXES = "boxes_v as (" + fixtures.BOXES_SQL.format(lineitem="lineitem") + ")"
PIXELS = f"pixels_v as ({fixtures.PIXELS_DUCK})"
CORR = "corr_v as (select *, 2*x-y+3 as u, x+0.5*y-1 as v from (" + fixtures.CORR_SQL.format(orders="orders") + "))"


def query(name: str, sql: str | None = None):
    def add(func):
        QUERIES[name] = func
        if sql:
            ORACLE[name] = sql
        return func
    return add


def r6(c, name: str):
    """Rounded half even, without negative zeros."""
    return (F.bround(c, 6) + F.lit(0.0)).alias(name)


def q6(expr: str, name: str) -> str:
    return f"round_even({expr}, 6) + 0.0::double as {name}"


def box_query(name: str, make, sql: str, fields=("x1", "y1", "x2", "y2")):
    """A struct of numbers per detection; ``make`` takes the box column."""
    def run(spark, sf_dir):
        out = fixtures.boxes(spark, sf_dir).select("det_id", make(F.col("box")).alias("o"))
        return out.select("det_id", *[r6(F.col(f"o.{f}").cast("double"), f) for f in fields])

    QUERIES[name] = run
    ORACLE[name] = f"with {BOXES} select det_id, {sql} from boxes_v"


# boxes -------------------------------------------------------------------------------

W, H = "(x2-x1)", "(y2-y1)"
CX, CY = "((x1+x2)/2)", "((y1+y2)/2)"


def four(*exprs: str, names=("x1", "y1", "x2", "y2")) -> str:
    return ", ".join(q6(f"cast({e} as double)", n) for e, n in zip(exprs, names, strict=True))


for _fmt, _exprs in {
    "xywh": ("x1", "y1", W, H), "cxywh": (CX, CY, W, H), "xxyy": ("x1", "x2", "y1", "y2"), "yyxx": ("y1", "y2", "x1", "x2"), "rchw": ("y1", "x1", H, W),
}.items():
    box_query(f"box_toformat_{_fmt}", lambda b, f=_fmt: B.to_format(b, f), four(*_exprs, names=B.FIELDS[_fmt]), B.FIELDS[_fmt])

box_query("box_area_aspect", lambda b: F.struct(B.area(b).alias("area"), B.aspect_ratio(b).alias("aspect")), f"{q6(f'{W}*{H}', 'area')}, {q6(f'{W}/nullif({H},0)', 'aspect')}", ("area", "aspect"))
box_query("box_center", B.center, f"{q6(CX, 'x')}, {q6(CY, 'y')}", ("x", "y"))
box_query("box_clip", lambda b: B.clip(b, 50, 60, 400, 300), four("least(greatest(x1,50),400)", "least(greatest(y1,60),300)", "least(greatest(x2,50),400)", "least(greatest(y2,60),300)"))
box_query("box_pad", lambda b: B.pad(b, 1, 2, 3, 4), four("x1-1", "y1-2", "x2+3", "y2+4"))
box_query("box_resize_about_xy", lambda b: B.resize(b, new_width=10), four("x1", "y1", "x1+10", f"y1+{H}"))
box_query("box_resize_about_center", lambda b: B.resize(b, 10, 6, "cxy"), four(f"{CX}-5", f"{CY}-3", f"{CX}+5", f"{CY}+3"))
box_query("box_scale", lambda b: B.scale(b, 2, 0.5), four("x1*2", "y1*0.5", "x2*2", "y2*0.5"))
box_query("box_scale_about_center", lambda b: B.scale(b, 2, 0.5, "center"), four(f"(x1-{CX})*2+{CX}", f"(y1-{CY})*0.5+{CY}", f"(x2-{CX})*2+{CX}", f"(y2-{CY})*0.5+{CY}"))
box_query("box_translate", lambda b: B.translate(b, -7.25, 3.5), four("x1-7.25", "y1+3.5", "x2-7.25", "y2+3.5"))
box_query("box_quantize", lambda b: B.quantize(B.scale(b, 0.3)), four("floor(x1*0.3)", "floor(y1*0.3)", "ceil(x2*0.3)", "ceil(y2*0.3)"))
box_query("box_round", lambda b: B.round_half_even(B.scale(b, 0.25)), four(*[f"round_even({c}*0.25,0)" for c in ("x1", "y1", "x2", "y2")]))
box_query("box_transpose", B.transpose, four("y1", "x1", "y2", "x2"))
box_query("box_nonneg_extent", lambda b: B.nonnegative(B.pad(b, -20, 0, -20, 0)), four("least(x1+20,x2-20)", "least(y1,y2)", "greatest(x1+20,x2-20)", "greatest(y1,y2)"))
box_query("box_from_slice", lambda b: B.from_slice(b["y1"], b["y2"], b["x1"], b["x2"], (300, 400)), four("least(x1,400)", "least(y1,300)", "greatest(least(x1,400),least(x2,400))", "greatest(least(y1,300),least(y2,300))"))
box_query("box_to_slices", B.to_slice, four("trunc(y1)", "trunc(y2)", "trunc(x1)", "trunc(x2)", names=("y_start", "y_stop", "x_start", "x_stop")), ("y_start", "y_stop", "x_start", "x_stop"))
box_query("box_corners_hull_warp", lambda b: B.warp(b, M.make(0.5, -1, 10, 1.5, 0.25, -4)), four(
    "least(0.5*x1-y1+10,0.5*x1-y2+10,0.5*x2-y1+10,0.5*x2-y2+10)", "least(1.5*x1+0.25*y1-4,1.5*x1+0.25*y2-4,1.5*x2+0.25*y1-4,1.5*x2+0.25*y2-4)",
    "greatest(0.5*x1-y1+10,0.5*x1-y2+10,0.5*x2-y1+10,0.5*x2-y2+10)", "greatest(1.5*x1+0.25*y1-4,1.5*x1+0.25*y2-4,1.5*x2+0.25*y1-4,1.5*x2+0.25*y2-4)"))
box_query("box_warp_axis_aligned", lambda b: B.warp(b, M.make(2, 0, 1, 0, 3, -2)), four("x1*2+1", "y1*3-2", "x2*2+1", "y2*3-2"))
box_query("box_polygon_area", lambda b: F.struct(G.area(B.to_polygon(b)).alias("area")), q6(f"{W}*{H}", "area"), ("area",))


@query("box_filter_score", f"with {BOXES} select det_id, class_idx, {q6('score', 'score')} from boxes_v where score > 0.1 and class_idx <> 1")
def box_filter_score(spark, sf_dir):
    return fixtures.boxes(spark, sf_dir).where("score > 0.1 and class_idx <> 1").select("det_id", "class_idx", r6("score", "score"))


@query("box_take", f"with {BOXES}, n as (select *, row_number() over (partition by image_id order by det_id)-1 as i from boxes_v) select image_id, pos, det_id from n join (select * from (values (0,5),(1,0),(2,5)) t(pos,i)) p using (i)")
def box_take(spark, sf_dir):
    arrays = fixtures.boxes(spark, sf_dir).groupBy("image_id").agg(F.sort_array(F.collect_list("det_id")).alias("ids"))
    taken = arrays.select("image_id", F.posexplode(P.take(F.col("ids"), F.array(*map(F.lit, (5, 0, 5))))).alias("pos", "det_id"))
    return taken.where("det_id is not null")


@query("box_concat", f"with {BOXES} select class_idx, count(*) as n, {q6('sum(x1)', 'sx')} from (select * from boxes_v where class_idx=0 union all select * from boxes_v where class_idx=2) group by class_idx")
def box_concat(spark, sf_dir):
    b = fixtures.boxes(spark, sf_dir)
    return b.where("class_idx = 0").unionByName(b.where("class_idx = 2")).groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("box.x1"), "sx"))


@query("boxes_bounding_box", f"with {BOXES} select image_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from boxes_v group by image_id")
def boxes_bounding_box(spark, sf_dir):
    return fixtures.boxes(spark, sf_dir).groupBy("image_id").agg(F.min("box.x1").alias("x1"), F.min("box.y1").alias("y1"), F.max("box.x2").alias("x2"), F.max("box.y2").alias("y2"))


ISECT = "greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0)"
PAIRS = f"""with {BOXES}, p as (select a.image_id, a.det_id as l_id, b.det_id as r_id, {ISECT} as i, (a.x2-a.x1)*(a.y2-a.y1) as aa, (b.x2-b.x1)*(b.y2-b.y1) as ab
 from boxes_v a join boxes_v b on a.image_id=b.image_id and a.class_idx=0 and b.class_idx=1)"""


def _pairs(spark, sf_dir):
    b = fixtures.boxes(spark, sf_dir)
    left, right = b.where("class_idx = 0").select("image_id", "det_id", "box"), b.where("class_idx = 1").select("image_id", "det_id", "box")
    return joins.ious(left, right, ["image_id"]).where("isect > 0").select("image_id", F.col("l_det_id").alias("l_id"), F.col("r_det_id").alias("r_id"), "isect", "iou", "iooa")


@query("ious_pairs", PAIRS + f" select image_id, l_id, r_id, {q6('i/(aa+ab-i)', 'iou')} from p where i > 0")
def ious_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("image_id", "l_id", "r_id", r6("iou", "iou"))


@query("isect_area_pairs", PAIRS + f" select image_id, l_id, r_id, {q6('i', 'isect')} from p where i > 0")
def isect_area_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("image_id", "l_id", "r_id", r6("isect", "isect"))


@query("iooas_pairs", PAIRS + f" select image_id, l_id, r_id, {q6('i/(case when ab=0 then 1 else ab end)', 'iooa')} from p where i > 0")
def iooas_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("image_id", "l_id", "r_id", r6("iooa", "iooa"))


ZIP = f"with {BOXES}, z as (select a.det_id, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, a.x1+10 as bx1, a.y1-5 as by1, a.x2+10 as bx2, a.y2-5 as by2 from boxes_v a)"


def _zipped(spark, sf_dir):
    b = fixtures.boxes(spark, sf_dir).select("det_id", "box")
    return joins.zipped(b, b.withColumn("box", B.translate(F.col("box"), 10, -5)), ["det_id"])


@query("intersection_zip", ZIP + " select det_id, greatest(ax1,bx1) as x1, greatest(ay1,by1) as y1, least(ax2,bx2) as x2, least(ay2,by2) as y2 from z where greatest(ax1,bx1)<=least(ax2,bx2) and greatest(ay1,by1)<=least(ay2,by2)")
def intersection_zip(spark, sf_dir):
    return _zipped(spark, sf_dir).select("det_id", "intersection.*").where(~F.isnan("x1"))


@query("union_hull_zip", ZIP + " select det_id, least(ax1,bx1) as x1, least(ay1,by1) as y1, greatest(ax2,bx2) as x2, greatest(ay2,by2) as y2 from z")
def union_hull_zip(spark, sf_dir):
    return _zipped(spark, sf_dir).select("det_id", "hull.*")


@query("points_in_boxes", f"with {BOXES}, p as (select event_id, event_id % 997 as image_id, value as x, cast(user_id % 512 as double) as y from events) select event_id, det_id from p join boxes_v b on b.image_id=p.image_id and x1<=x and x<=x2 and y1<=y and y<=y2")
def points_in_boxes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 997).alias("image_id"), F.col("value").alias("x"), (F.col("user_id") % 512).cast("double").alias("y"))
    return joins.points_in_boxes(p, fixtures.boxes(spark, sf_dir).select("image_id", "det_id", "box"), ["image_id"]).select("event_id", "det_id")


# suppression -------------------------------------------------------------------------


def _nms_sql(keys: str) -> str:
    return f"""with {BOXES}, g as (select {keys}, list({{'x1':x1,'y1':y1,'x2':x2,'y2':y2,'id':det_id}} order by score desc, det_id desc) as l from boxes_v group by {keys}),
 k as (select {keys}, list_reduce(list_transform(l, lambda e: [e]), lambda acc, n: case when len(list_filter(acc, lambda k: coalesce((greatest(least(k.x2,n[1].x2)-greatest(k.x1,n[1].x1),0)*greatest(least(k.y2,n[1].y2)-greatest(k.y1,n[1].y1),0))
 / nullif((k.x2-k.x1)*(k.y2-k.y1)+(n[1].x2-n[1].x1)*(n[1].y2-n[1].y1)-greatest(least(k.x2,n[1].x2)-greatest(k.x1,n[1].x1),0)*greatest(least(k.y2,n[1].y2)-greatest(k.y1,n[1].y1),0),0),0) > 0.1)) > 0 then acc else list_concat(acc, n) end) as kept from g)
 select {keys}, u.id as det_id from k, unnest(kept) t(u)"""


@query("nms", _nms_sql("image_id"))
def nms_query(spark, sf_dir):
    return nms.non_max_suppression(fixtures.boxes(spark, sf_dir), ["image_id"], 0.1).select("image_id", "det_id")


@query("nms_perclass", _nms_sql("image_id, class_idx"))
def nms_perclass(spark, sf_dir):
    return nms.non_max_suppression(fixtures.boxes(spark, sf_dir), ["image_id"], 0.1, class_col="class_idx").select("image_id", "class_idx", "det_id")


@query("nms_fast", f"""with {BOXES} select a.image_id, a.det_id from boxes_v a where not exists (select 1 from boxes_v b where a.image_id=b.image_id and (b.score>a.score or (b.score=a.score and b.det_id>a.det_id))
 and {ISECT} > 0.1*((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-{ISECT}))""")
def nms_fast(spark, sf_dir):
    return nms.fast_nms(fixtures.boxes(spark, sf_dir), ["image_id"], 0.1).select("image_id", "det_id")


@query("daq_nms")
def daq_nms(spark, sf_dir):
    return nms.spatial_nms(fixtures.boxes(spark, sf_dir), ["image_id"], 64.0, 0.1, tile=256.0).select("image_id", "det_id")


@query("det_rank", f"with {BOXES} select image_id, det_id, row_number() over (partition by image_id order by score desc, det_id desc) as rank from boxes_v")
def det_rank(spark, sf_dir):
    from pyspark.sql.window import Window

    at = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("det_id"))
    return fixtures.boxes(spark, sf_dir).select("image_id", "det_id", F.row_number().over(at).cast("long").alias("rank"))


# transforms --------------------------------------------------------------------------

TF = """tf_v as (select o_orderkey, 1+o_custkey%7 as sx, 2+o_custkey%3 as sy, cast(o_orderkey%50 as double) as tx, cast(o_orderkey%31 as double) as ty, (o_orderkey%13)*0.1 as theta, (o_orderkey%5)*0.05 as k from orders),
 m_v as (select *, sx*cos(theta) as a11, sy*(k*cos(theta)-sin(theta)) as a12, tx as a13, sx*sin(theta) as a21, sy*(k*sin(theta)+cos(theta)) as a22, ty as a23 from tf_v)"""


def _transforms(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    m = M.affine((1 + cust % 7, 2 + cust % 3), ((key % 50).cast("double"), (key % 31).cast("double")), (key % 13) * 0.1, (key % 5) * 0.05)
    return o.select("o_orderkey", m.alias("m"))


@query("affine_decompose", f"with {TF} select o_orderkey, {q6('cast(sx as double)', 'sx')}, {q6('cast(sy as double)', 'sy')}, {q6('k', 'shearx')}, {q6('theta', 'theta')}, {q6('tx', 'tx')}, {q6('ty', 'ty')} from m_v")
def affine_decompose(spark, sf_dir):
    d = _transforms(spark, sf_dir).select("o_orderkey", M.decompose(F.col("m")).alias("d"))
    return d.select("o_orderkey", *[r6(F.col(f"d.{n}").cast("double"), n) for n in ("sx", "sy", "shearx", "theta", "tx", "ty")])


@query("affine_compose", f"with {TF} select o_orderkey, {q6('2*a11-a21+5*0', 'a11')}, {q6('2*a12-a22', 'a12')}, {q6('2*a13-a23+5', 'a13')}, {q6('0.5*a21', 'a21')}, {q6('0.5*a22', 'a22')}, {q6('0.5*a23-3', 'a23')} from m_v")
def affine_compose(spark, sf_dir):
    c = _transforms(spark, sf_dir).select("o_orderkey", M.matmul(M.make(2, -1, 5, 0, 0.5, -3), F.col("m")).alias("c"))
    return c.select("o_orderkey", *[r6(F.col(f"c.{n}"), n) for n in M.NAMES[:6]])


@query("affine_inverse", f"""with {TF}, d as (select *, a11*a22-a12*a21 as det from m_v) select o_orderkey, {q6('a22/det', 'a11')}, {q6('-a12/det', 'a12')}, {q6('(a12*a23-a13*a22)/det', 'a13')}, {q6('-a21/det', 'a21')}, {q6('a11/det', 'a22')}, {q6('(a13*a21-a11*a23)/det', 'a23')} from d""")
def affine_inverse(spark, sf_dir):
    c = _transforms(spark, sf_dir).select("o_orderkey", M.inv(F.col("m")).alias("c"))
    return c.select("o_orderkey", *[r6(F.col(f"c.{n}"), n) for n in M.NAMES[:6]])


@query("affine_fit_moments", f"with {CORR} select o_orderpriority, count(*) as n, 2.0::double as a11, (-1.0)::double as a12, 3.0::double as a13, 1.0::double as a21, 0.5::double as a22, (-1.0)::double as a23 from corr_v group by 1")
def affine_fit_moments(spark, sf_dir):
    fit = M.fit_affine(fixtures.correspondences(spark, sf_dir), ["o_orderpriority"])
    return fit.select("o_orderpriority", "n", *[r6(F.col(n), n) for n in M.NAMES[:6]])


@query("projective_fit", f"with {CORR} select o_orderpriority, count(*) as n, 2.0::double as a11, (-1.0)::double as a12, 3.0::double as a13, 1.0::double as a21, 0.5::double as a22, (-1.0)::double as a23 from corr_v group by 1")
def projective_fit(spark, sf_dir):
    fit = M.fit_projective(fixtures.correspondences(spark, sf_dir), ["o_orderpriority"])
    return fit.select("o_orderpriority", "n", *[(F.bround(F.col(n), 4) + F.lit(0.0)).alias(n) for n in M.NAMES[:6]])


@query("warp_points_affine", f"with {TF} select o_orderkey, {q6('a11*3+a12*4+a13', 'x')}, {q6('a21*3+a22*4+a23', 'y')} from m_v")
def warp_points_affine(spark, sf_dir):
    w = _transforms(spark, sf_dir).select("o_orderkey", M.warp_points(F.col("m"), F.array(P.point(3, 4)))[0].alias("p"))
    return w.select("o_orderkey", r6("p.x", "x"), r6("p.y", "y"))


@query("warp_points_projective", f"with {CORR} select o_orderpriority, count(*) as n, {q6('sum((2*x+1)/(0.01*x+0.02*y+1))', 'sx')}, {q6('sum((x-y)/(0.01*x+0.02*y+1))', 'sy')} from corr_v group by 1")
def warp_points_projective(spark, sf_dir):
    m = M.make(2, 0, 1, 1, -1, 0, 0.01, 0.02, 1)
    p = fixtures.correspondences(spark, sf_dir).select("o_orderpriority", M.warp_point(m, P.point(F.col("x"), F.col("y"))).alias("p"))
    return p.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("p.x"), "sx"), r6(F.sum("p.y"), "sy"))


# runs and masks ----------------------------------------------------------------------


@query("rle_encode", f"with {PIXELS}, a as (select vec_id, y*8+x as i, b, lag(b) over (partition by vec_id order by y, x) as p from pixels_v), g as (select *, sum(case when p is null or p<>b then 1 else 0 end) over (partition by vec_id order by i) - 1 as run from a) select vec_id, cast(run as bigint) as run, cast(min(i) as bigint) as start, count(*) as length, min(b) as v from g group by vec_id, run")
def rle_encode(spark, sf_dir):
    return runlength.encode(fixtures.pixels(spark, sf_dir), ["vec_id"], "C", "b").select("vec_id", F.col("run").cast("long").alias("run"), F.col("start").cast("long").alias("start"), "length", "v")


def _masks(spark, sf_dir):
    return runlength.encode_masks(fixtures.pixels(spark, sf_dir).drop("v"), ["vec_id"], "F", "b")


@query("rle_decode", f"with {PIXELS} select vec_id, cast(x*8+y as bigint) as i, b from pixels_v")
def rle_decode(spark, sf_dir):
    return _masks(spark, sf_dir).select("vec_id", F.posexplode(runlength.decode(F.col("mask.counts"))).alias("i", "b")).select("vec_id", F.col("i").cast("long").alias("i"), "b")


@query("mask_area", f"with {PIXELS} select vec_id, cast(sum(b) as bigint) as area from pixels_v group by 1")
def mask_area(spark, sf_dir):
    return _masks(spark, sf_dir).select("vec_id", runlength.area(F.col("mask")).alias("area"))


@query("mask_xywh", f"with {PIXELS} select vec_id, cast(min(x) as bigint) as x, cast(min(y) as bigint) as y, cast(max(x)-min(x)+1 as bigint) as w, cast(max(y)-min(y)+1 as bigint) as h from pixels_v where b=1 group by 1")
def mask_xywh(spark, sf_dir):
    runs = runlength.one_runs(_masks(spark, sf_dir), ["vec_id"]).withColumn("height", F.lit(8))
    return runlength.bounding_xywh(runs, ["vec_id"], "height").select("vec_id", *[F.col(c).cast("long").alias(c) for c in "xywh"])


SHIFT = f"with {PIXELS}, s as (select vec_id, x+1 as x, y-2 as y from pixels_v where b=1)"


@query("rle_translate", SHIFT + " select vec_id, sum(case when x between 0 and 8 and y between 0 and 5 then 1 else 0 end)::bigint as area, sum(case when x between 0 and 8 and y between 0 and 5 then x*6+y else 0 end)::bigint as place from s group by 1")
def rle_translate(spark, sf_dir):
    moved = runlength.translate(_masks(spark, sf_dir), ["vec_id"], 1, -2, 6, 9)
    flat = moved.select("vec_id", F.posexplode(runlength.decode(F.col("mask.counts"))).alias("i", "b"))
    return flat.groupBy("vec_id").agg(F.sum("b").cast("long").alias("area"), F.sum(F.col("b") * F.col("i")).cast("long").alias("place"))


GROUPED = f"with {PIXELS}, g as (select vec_id % 50 as grp, x*8+y as i, sum(b) as n, count(*) as m from pixels_v group by 1, 2)"


def _grouped_runs(spark, sf_dir):
    masks = _masks(spark, sf_dir)
    runs = runlength.one_runs(masks, ["vec_id"]).withColumn("grp", F.col("vec_id") % 50)
    return runs, masks.groupBy((F.col("vec_id") % 50).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("mask_union", GROUPED + " select grp, count(*) as area from g where n > 0 group by 1")
def mask_union(spark, sf_dir):
    runs, _ = _grouped_runs(spark, sf_dir)
    return runlength.merge_runs(runs.select("grp", "start", "stop"), ["grp"]).groupBy("grp").agg(F.sum(F.col("stop") - F.col("start")).alias("area"))


@query("mask_intersection", GROUPED.replace("% 50", "% 150") + " select grp, count(*) as area from g where n = m group by 1")
def mask_intersection(spark, sf_dir):
    masks = _masks(spark, sf_dir)
    n = masks.groupBy((F.col("vec_id") % 150).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    runs = runlength.one_runs(masks, ["vec_id"]).withColumn("grp", F.col("vec_id") % 150).join(n, "grp")
    return runlength.intersect_runs(runs.select("grp", "n", "start", "stop"), ["grp"], "n").groupBy("grp").agg(F.sum(F.col("stop") - F.col("start")).alias("area"))


@query("mask_iou", f"with {PIXELS}, p as (select a.vec_id as l_id, b.vec_id as r_id, sum(a.b*b.b) as i, sum(greatest(a.b,b.b)) as u from pixels_v a join pixels_v b on a.vec_id%50=b.vec_id%50 and a.vec_id<b.vec_id and a.y=b.y and a.x=b.x group by 1,2) select l_id, r_id, {q6('i/u', 'iou')} from p where i>0")
def mask_iou(spark, sf_dir):
    masks = _masks(spark, sf_dir)
    runs = runlength.one_runs(masks, ["vec_id"]).withColumn("grp", F.col("vec_id") % 50)
    size = masks.select("vec_id", runlength.area(F.col("mask")).alias("area"))
    pairs = runlength.overlap(runs.withColumnRenamed("vec_id", "l_id"), runs.withColumnRenamed("vec_id", "r_id"), "l_id", "r_id", ["grp"]).where("l_id < r_id")
    both = pairs.join(size.select(F.col("vec_id").alias("l_id"), F.col("area").alias("la")), "l_id").join(size.select(F.col("vec_id").alias("r_id"), F.col("area").alias("ra")), "r_id")
    return both.select("l_id", "r_id", r6(F.col("overlap") / (F.col("la") + F.col("ra") - F.col("overlap")), "iou"))


# polygons ----------------------------------------------------------------------------


def _polygons(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = (3 + F.col("o_orderkey") % 6).cast("int")
    return o.select("o_orderkey", G.regular(n, (F.col("o_custkey") % 50).cast("double"), (F.col("o_orderkey") % 40).cast("double"), (1 + F.col("o_custkey") % 9).cast("double")).alias("poly"), n.alias("n"))


POLY = "p as (select o_orderkey, 3+o_orderkey%6 as n, cast(o_custkey%50 as double) as cx, cast(o_orderkey%40 as double) as cy, cast(1+o_custkey%9 as double) as r from orders)"


@query("polygon_area", f"with {POLY} select o_orderkey, {q6('n*r*r*sin(2*pi()/n)/2', 'area')} from p")
def polygon_area(spark, sf_dir):
    return _polygons(spark, sf_dir).select("o_orderkey", r6(G.area(F.col("poly")), "area"))


@query("polygon_centroid", f"with {POLY} select o_orderkey, {q6('cx', 'x')}, {q6('cy', 'y')} from p")
def polygon_centroid(spark, sf_dir):
    c = _polygons(spark, sf_dir).select("o_orderkey", G.centroid(F.col("poly")).alias("c"))
    return c.select("o_orderkey", r6("c.x", "x"), r6("c.y", "y"))


@query("polygon_orientation", f"with {POLY} select o_orderkey, false as clockwise, true as turned, n from p")
def polygon_orientation(spark, sf_dir):
    p = _polygons(spark, sf_dir)
    ring = G.exterior(F.col("poly"))
    return p.select("o_orderkey", G.is_clockwise(ring).alias("clockwise"), G.is_clockwise(F.reverse(ring)).alias("turned"), F.size(ring).cast("long").alias("n"))


@query("polygon_wkt_roundtrip", f"with {POLY} select o_orderkey, n from p")
def polygon_wkt_roundtrip(spark, sf_dir):
    p = _polygons(spark, sf_dir).withColumn("back", G.from_wkt(G.to_wkt(F.col("poly"))))
    return p.where(F.col("back") == F.col("poly")).select("o_orderkey", F.size(F.col("back")[0]).cast("long").alias("n"))


@query("polygon_geojson_roundtrip", f"with {POLY} select o_orderkey, n from p")
def polygon_geojson_roundtrip(spark, sf_dir):
    p = _polygons(spark, sf_dir).withColumn("back", G.from_geojson(G.to_geojson(F.col("poly"))))
    return p.where(F.col("back") == F.col("poly")).select("o_orderkey", F.size(F.col("back")[0]).cast("long").alias("n"))


@query("polygon_warp_area", f"with {POLY} select o_orderkey, {q6('6*n*r*r*sin(2*pi()/n)/2', 'area')} from p")
def polygon_warp_area(spark, sf_dir):
    return _polygons(spark, sf_dir).select("o_orderkey", r6(G.area(G.warp(F.col("poly"), M.make(2, 1, 5, 0, 3, -1))), "area"))


# rasters -----------------------------------------------------------------------------


@query("ensure_float01", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {q6('cast(l_partkey % 256 as double)/255', 'v')} from lineitem")
def ensure_float01(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(raster.ensure_float01(F.col("l_partkey") % 256), "v"))


@query("ensure_uint255", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(least(greatest(l_discount*8,0),1)*255) as int) as v from lineitem where l_discount*8 <= 1")
def ensure_uint255(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_discount * 8 <= 1")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raster.ensure_uint255(F.col("l_discount") * 8).alias("v"))


def pixel_query(name: str, make, sql: str, digits: int = 6):
    def run(spark, sf_dir):
        out = make(fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", "v"))
        return out.select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), (F.bround(F.col("v"), digits) + F.lit(0.0)).alias("v"))

    QUERIES[name] = run
    ORACLE[name] = f"with {PIXELS} select vec_id, cast(y as bigint) as y, cast(x as bigint) as x, round_even(v, {digits}) + 0.0::double as v from ({sql})"


ID = ["vec_id"]
pixel_query("normalize_minmax", lambda p: raster.normalize(p, ID).select("vec_id", "y", "x", F.col("norm").alias("v")), "select vec_id, y, x, (v-min(v) over w)/(max(v) over w-min(v) over w) as v from pixels_v window w as (partition by vec_id)")
pixel_query("normalize_robust", lambda p: raster.normalize_intensity(p, ID).select("vec_id", "y", "x", F.col("norm").alias("v")), "select p.vec_id, y, x, least(greatest((v-lo)/(hi-lo),0),1) as v from pixels_v p join (select vec_id, quantile_cont(v,0.01) as lo, quantile_cont(v,0.9) as hi from pixels_v group by 1) q on p.vec_id=q.vec_id")
pixel_query("crop_border", lambda p: raster.crop_border(p.withColumn("v", F.when(F.col("v") > 0.15, F.lit(1.0)).otherwise(255.0)), ID), "select p.vec_id, y-ly as y, x-lx as x, case when v>0.15 then 1.0 else 255.0 end::double as v from pixels_v p join (select vec_id, min(y) as ly, max(y) as hy, min(x) as lx, max(x) as hx from pixels_v where v>0.15 group by 1) b on p.vec_id=b.vec_id where y between ly and hy and x between lx and hx")
pixel_query("pixel_crop_pad", lambda p: raster.crop(p, ID, -1, 2, 6, 8, 0.5), "select g.vec_id, g.y, g.x, coalesce(p.v,0.5) as v from (select d.vec_id, i//8 as y, i%8 as x from (select distinct vec_id from pixels_v) d, unnest(range(48)) r(i)) g left join pixels_v p on p.vec_id=g.vec_id and p.y=g.y-1 and p.x=g.x+2")
_K = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]


def _stencil(weights: list[list[float]], reflect: bool = True, agg: str = "sum") -> str:
    """DuckDB text of a stencil with reflected borders on 8x8 rasters."""
    r = len(weights) // 2
    rows = ", ".join(f"({i - r},{j - r},{w!r}::double)" for i, row in enumerate(weights) for j, w in enumerate(row))
    fold = lambda e: f"(7 - abs((({e}) % 14 + 14) % 14 - 7))"
    return f"select t.vec_id, t.y, t.x, sum(s.v*k.w) as v from pixels_v t, (values {rows}) k(dy,dx,w), pixels_v s where s.vec_id=t.vec_id and s.y={fold('t.y+k.dy')} and s.x={fold('t.x+k.dx')} group by 1,2,3"


_G = raster.gaussian_patch(3, 3).tolist()
pixel_query("gaussian_blur", lambda p: raster.gaussian_blur(p, ID, 3), _stencil(_G))
pixel_query("pyr_down", lambda p: raster.pyr_down(p, ID), "select vec_id, y//2 as y, x//2 as x, v from (" + _stencil([[a * b / 256 for b in (1, 4, 6, 4, 1)] for a in (1, 4, 6, 4, 1)]) + ") where y%2=0 and x%2=0")
for _mode, _fun in (("dilate", "max"), ("erode", "min")):
    pixel_query(f"morph_{_mode}", lambda p, m=_mode: raster.morphology(p, ID, m, 3), f"select t.vec_id, t.y, t.x, {_fun}(coalesce(s.v,0)) as v from pixels_v t cross join (select a-1 as dy, b-1 as dx from unnest(range(3)) u(a), unnest(range(3)) w(b)) k left join pixels_v s on s.vec_id=t.vec_id and s.y=t.y+k.dy and s.x=t.x+k.dx group by 1,2,3")
pixel_query("resize_nearest", lambda p: raster.resize_nearest(p, ID, 5, 12), "select d.vec_id, i//12 as y, i%12 as x, p.v from (select distinct vec_id from pixels_v) d, unnest(range(60)) r(i), pixels_v p where p.vec_id=d.vec_id and p.y=(i//12)*8//5 and p.x=(i%12)*8//12")
pixel_query("resize_area", lambda p: raster.resize_area(p, ID, 2), "select vec_id, y//2 as y, x//2 as x, avg(v) as v from pixels_v group by 1,2,3")
pixel_query("warp_nearest", lambda p: raster.warp_nearest(p, ID, [[0, 1, 0], [-1, 0, 7], [0, 0, 1]], 8, 8), "select vec_id, 7-x as y, y as x, v from pixels_v")
pixel_query("subpixel_translate", lambda p: raster.translate_bilinear(p, ID, 1.5, 0.25), "select vec_id, y, x, sum(t) as v from (select vec_id, y+m.dy as y, x+m.dx as x, v*m.w as t from pixels_v, (values (1,0,0.375::double),(2,0,0.375::double),(1,1,0.125::double),(2,1,0.125::double)) m(dy,dx,w)) where y<8 and x<8 group by 1,2,3")


@query("alpha_overlay", f"with {PIXELS}, a as (select vec_id, y, x, v as c1, abs(v) as a1, 0.5 as c2, b*0.5 as a2 from pixels_v) select vec_id, y, x, {q6('coalesce((c1*a1+c2*a2*(1-a1))/nullif(a1+a2*(1-a1),0),0)', 'v')}, {q6('a1+a2*(1-a1)', 'alpha')} from a")
def alpha_overlay(spark, sf_dir):
    c, a = raster.alpha_over(F.col("v"), F.abs("v"), F.lit(0.5), F.col("b") * 0.5)
    p = fixtures.pixels(spark, sf_dir)
    return p.select("vec_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6(c, "v"), r6(a, "alpha"))


@query("subpixel_bilinear", f"""with {PIXELS}, q as (select vec_id, (vec_id%60)/10.0 as px, (vec_id%45)/10.0 as py from (select distinct vec_id from pixels_v)),
 f as (select *, floor(px) as fx, floor(py) as fy, px-floor(px) as dx, py-floor(py) as dy from q)
 select f.vec_id, {q6('sum(p.v*(case when p.x=fx then 1-dx else dx end)*(case when p.y=fy then 1-dy else dy end))', 'v')} from f join pixels_v p on p.vec_id=f.vec_id and p.x in (fx,fx+1) and p.y in (fy,fy+1) group by 1""")
def subpixel_bilinear(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", "v")
    pts = p.select("vec_id").distinct().select("vec_id", ((F.col("vec_id") % 60) / 10.0).alias("px"), ((F.col("vec_id") % 45) / 10.0).alias("py"))
    return raster.sample_bilinear(pts, p, ID, []).select("vec_id", r6("v", "v"))


@query("stack_grid_offsets", """with i as (select o_custkey as grp, o_orderkey, 1+o_orderkey%9 as height, 1+o_orderkey%7 as width, row_number() over (partition by o_custkey order by o_orderkey)-1 as i, greatest(floor(sqrt(count(*) over (partition by o_custkey))),1) as n from orders),
 g as (select *, floor(i/n) as r, i%n as c from i), x as (select *, coalesce(sum(width) over (partition by grp, r order by c rows between unbounded preceding and 1 preceding),0) as x0 from g),
 h as (select grp, r, max(height) as h from g group by 1,2), y as (select grp, r, coalesce(sum(h) over (partition by grp order by r rows between unbounded preceding and 1 preceding),0) as y0 from h)
 select o_orderkey, cast(y0 as bigint) as y0, cast(x0 as bigint) as x0 from x join y using (grp, r)""")
def stack_grid_offsets(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    images = o.select(F.col("o_custkey").alias("grp"), "o_orderkey", (1 + F.col("o_orderkey") % 9).alias("height"), (1 + F.col("o_orderkey") % 7).alias("width"))
    return raster.stack_grid_offsets(images, ["grp"], "o_orderkey").select("o_orderkey", F.col("y0").cast("long").alias("y0"), F.col("x0").cast("long").alias("x0"))


@query("connected_components")
def connected_components(spark, sf_dir):
    return raster.connected_components(fixtures.pixels(spark, sf_dir).select("vec_id", "y", "x", F.col("b").alias("v")), ID, 4)


# colour ------------------------------------------------------------------------------

RGB = "c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey%256)/255.0::double as r, (l_suppkey%256)/255.0::double as g, (l_orderkey%256)/255.0::double as b from lineitem)"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _colors(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    return l.select(*KEY, *[((F.col(c) % 256) / 255.0).alias(n) for c, n in (("l_partkey", "r"), ("l_suppkey", "g"), ("l_orderkey", "b"))])


@query("rgb_to_hsv", f"""with {RGB}, m as (select *, greatest(r,g,b) as hi, greatest(r,g,b)-least(r,g,b) as d from c)
 select {', '.join(KEY)}, round_even(60*(case when d=0 then 0 when hi=r then case when g<b then (g-b)/d+6 else (g-b)/d end when hi=g then (b-r)/d+2 else (r-g)/d+4 end),6) as h, {q6('case when hi=0 then 0 else d/hi end', 's')}, {q6('hi', 'v')} from m""")
def rgb_to_hsv(spark, sf_dir):
    h, s, v = C.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return _colors(spark, sf_dir).select(*KEY, r6(h, "h"), r6(s, "s"), r6(v, "v"))


@query("color_distance", f"with {RGB} select {', '.join(KEY)}, {q6('sqrt((r-0.2)*(r-0.2)+(g-0.4)*(g-0.4)+(b-0.6)*(b-0.6))', 'd')} from c")
def color_distance(spark, sf_dir):
    d = C.distance((F.col("r"), F.col("g"), F.col("b")), (F.lit(0.2), F.lit(0.4), F.lit(0.6)), "rgb")
    return _colors(spark, sf_dir).select(*KEY, r6(d, "d"))


PALETTE = ", ".join(f"('{n}', {(v >> 16 & 255)}/255.0::double, {(v >> 8 & 255)}/255.0::double, {(v & 255)}/255.0::double)" for n, v in sorted(C.NAMED.items()))


@query("nearest_named_color", f"with {RGB}, p as (select * from (values {PALETTE}) t(name, pr, pg, pb)), d as (select {', '.join(KEY)}, name, round_even(sqrt((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)),6) as delta, row_number() over (partition by {', '.join(KEY)} order by sqrt((r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)), name) as k from c, p) select {', '.join(KEY)}, delta from d where k=1")
def nearest_named_color(spark, sf_dir):
    return C.nearest_named(_colors(spark, sf_dir), ("r", "g", "b"), KEY, "rgb").select(*KEY, r6("delta", "delta"))


@query("color_hex", f"with {RGB} select {', '.join(KEY)}, '#' || lower(lpad(hex(l_partkey%256),2,'0')) || lower(lpad(hex(l_suppkey%256),2,'0')) || lower(lpad(hex(l_orderkey%256),2,'0')) as h from c")
def color_hex(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    part = [((F.col(c) % 256) + 0.25) / 255.0 for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    return l.select(*KEY, C.to_hex(*part).alias("h"))



# detections, heatmaps, drawing -------------------------------------------------------


@query("det_labels", f"with {BOXES} select det_id, 'class' || class_idx || ' @ ' || printf('%.4f', score) as label from boxes_v")
def det_labels(spark, sf_dir):
    b = fixtures.boxes(spark, sf_dir)
    return b.select("det_id", detections.labels(F.concat(F.lit("class"), F.col("class_idx")), F.col("score")).alias("label"))


@query("coco_roundtrip", f"with {BOXES} select det_id, image_id, class_idx, 'c' || class_idx as class, x1, y1, x2, y2 from boxes_v")
def coco_roundtrip(spark, sf_dir):
    b = fixtures.boxes(spark, sf_dir).withColumns({
        "class": F.concat(F.lit("c"), F.col("class_idx")), "weight": F.lit(1.0), "segmentation": F.lit(None).cast("string"),
        "keypoints": F.lit(None).cast("array<struct<x:double,y:double,class_idx:int,visible:int>>")})
    categories = spark.createDataFrame([(i, 10 + i, f"c{i}") for i in range(3)], "class_idx int, category_id long, name string")
    text = detections.to_annotations(b, categories).select(F.col("json").alias("value"))
    back = detections.from_annotations(detections.parse_annotations(text), categories)
    return back.select("det_id", "image_id", "class_idx", "class", "box.*")


@query("heatmap_combine", f"with {PIXELS}, a as (select vec_id % 20 as grp, y, x, abs(v) as p from pixels_v) select grp, cast(y as bigint) as y, cast(x as bigint) as x, {q6('case when min(p)=0 then 0 else exp(avg(ln(nullif(p,0)))) end', 'p')} from a group by 1,2,3")
def heatmap_combine(spark, sf_dir):
    p = fixtures.pixels(spark, sf_dir).select((F.col("vec_id") % 20).alias("grp"), "y", "x", F.abs("v").alias("p"))
    return heatmap.combine(p, ["grp"], "p").select("grp", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6("p", "p"))


@query("heatmap_detect", f"with {PIXELS}, r as (select *, sum(case when v>0.2 then 1 else 0 end) over w as n, row_number() over (partition by vec_id order by v desc, y, x) as k from pixels_v window w as (partition by vec_id)) select vec_id, x-0.5 as x1, y-0.5 as y1, x+0.5 as x2, y+0.5 as y2, {q6('v', 'score')} from r where v>0.2 or (n<5 and k<=5)")
def heatmap_detect(spark, sf_dir):
    d = heatmap.detect(fixtures.pixels(spark, sf_dir), ["vec_id"], "v", 0.2, 5)
    return d.select("vec_id", "box.*", r6("score", "score"))


#: The three queries under these names take images below 40 only, as their SQL does; those named ``_all`` take every image.
SMALL = f"with {BOXES}, d as (select image_id, det_id, class_idx, score, x1/16 as x1, y1/16 as y1, x2/16 as x2, y2/16 as y2 from boxes_v where image_id < 40)"
GRID = "g as (select i.image_id, k//36 as y, k%36 as x from (select distinct image_id from d) i, unnest(range(1296)) r(k))"


@query("heatmap_rasterize", SMALL + f", {GRID}, c as (select g.image_id, g.y, g.x, first(class_idx order by (x2-x1)*(y2-y1), score desc, det_id) as class_idx from g join d on d.image_id=g.image_id and g.x between x1 and x2 and g.y between y1 and y2 group by 1,2,3) select g.image_id, cast(g.y as bigint) as y, cast(g.x as bigint) as x, cast(coalesce(c.class_idx, 9) as int) as class_idx from g left join c using (image_id, y, x)")
def heatmap_rasterize(spark, sf_dir, images="image_id < 40"):
    d = fixtures.boxes(spark, sf_dir).where(images).withColumn("box", B.scale(F.col("box"), 1 / 16))
    r = heatmap.rasterize(d, ["image_id"], 36, 36, 9, "box")
    return r.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("class_idx").cast("int").alias("class_idx"))


@query("draw_boxes", SMALL + ", t as (select image_id, det_id, cast(trunc(x1) as int) as x1, cast(trunc(y1) as int) as y1, cast(trunc(x2) as int) as x2, cast(trunc(y2) as int) as y2 from d), c as (select distinct image_id, y, x from t, lateral (select unnest(range(y1, y2+1)) as y) a, lateral (select unnest(range(x1, x2+1)) as x) b where y=y1 or y=y2 or x=x1 or x=x2) select image_id, count(*) as n, cast(sum(y) as bigint) as sy, cast(sum(x) as bigint) as sx from c group by 1")
def draw_boxes(spark, sf_dir, images="image_id < 40"):
    d = fixtures.boxes(spark, sf_dir).where(images).withColumn("box", B.scale(F.col("box"), 1 / 16))
    return draw.box_outline(d, ["image_id"]).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("sy"), F.sum("x").cast("long").alias("sx"))


@query("polygon_fill", SMALL + f", {GRID} select d.det_id, count(*) as n from g join d on d.image_id=g.image_id and g.x >= x1 and g.x <= x2 and g.y >= y1 and g.y < y2 group by 1")
def polygon_fill(spark, sf_dir, images="image_id < 40"):
    d = fixtures.boxes(spark, sf_dir).where(images).withColumn("poly", B.to_polygon(B.scale(F.col("box"), 1 / 16)))
    return draw.fill_polygons(d, ["det_id"], 36, 36).groupBy("det_id").agg(F.sum(F.col("stop") - F.col("start")).alias("n"))


def every_image(name: str):
    """Registers ``name`` once more over all images, checked by the same SQL without its filter."""
    def run(spark, sf_dir):
        return QUERIES[name](spark, sf_dir, images="true")

    QUERIES[f"{name}_all"] = run
    ORACLE[f"{name}_all"] = ORACLE[name].replace(SMALL, SMALL.replace(" where image_id < 40", ""))


for _name in ("heatmap_rasterize", "draw_boxes", "polygon_fill"):
    every_image(_name)


@query("checkerboard", "select cast(i//24 as bigint) as y, cast(i%24 as bigint) as x, cast((i//24//4 + i%24//4) % 2 as double) as v from unnest(range(384)) r(i)")
def checkerboard(spark, sf_dir):
    return raster.checkerboard(spark, 24, 16, 4).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")

from . import annotation_queries, file_queries, mask_queries, overlay_queries, tile_queries  # noqa: E402, F401 - they add their queries
