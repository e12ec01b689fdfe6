"""Segmentations of any written form as one typed column, told apart by the shape of a VARIANT, in the JVM.

The result is ``struct<kind, mask, polygons>``: ``kind`` is ``mask``, ``polygon`` or
``multipolygon``, ``mask`` the runs of :mod:`..operators.runlength`, ``polygons`` an array of
polygons of :mod:`.polygon`; what a kind doesn't have is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import polygon as G

NULL_POLICIES = ("raise", "return-None", "return-nan")


def unpack_counts(text: Column) -> Column:
    """Counts of a compressed COCO string; see :func:`..operators.runlength.unpack_counts`. Time is quadratic in their number."""
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, char: Column) -> Column:
        chunk = F.ascii(char) - 48
        value = state["v"] + F.call_function("shiftleft", chunk.bitwiseAND(31).cast("bigint"), state["s"])
        shift, n = state["s"] + 5, F.size(state["out"])
        signed = value - F.when(chunk.bitwiseAND(16) != 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)).otherwise(F.lit(0).cast("bigint"))
        count = signed + F.when(n > 2, F.get(state["out"], n - 2)).otherwise(0)
        more = F.struct(value.alias("v"), shift.alias("s"), state["out"].alias("out"))
        ended = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("s"), F.concat(state["out"], F.array(count.cast("int"))).alias("out"))
        return F.when(chunk.bitwiseAND(32) != 0, more).otherwise(ended)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda state: state["out"])


def _ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _explicit(part: Column) -> Column:
    """Rings of ``struct<exterior, interiors>``."""
    return F.concat(F.array(_ring(part["exterior"])), F.coalesce(F.transform(part["interiors"], _ring), F.array().cast("array<array<struct<x:double,y:double>>>")))


def _handled(policy: str, kind: str) -> Column:
    if policy not in NULL_POLICIES:
        raise KeyError(f"unknown null policy {policy!r}; known are {', '.join(NULL_POLICIES)}")
    return F.raise_error(F.lit("cannot accept null input")).cast(kind) if policy == "raise" else F.lit(None).cast(kind)


KIND = "struct<kind:string,mask:struct<height:int,width:int,order:string,counts:array<int>>,polygons:array<array<array<struct<x:double,y:double>>>>>"


def coerce(data: Column, null_policy: str = "raise") -> Column:
    """Segmentation of a VARIANT.

    An object with ``counts`` (numbers or a compressed string) and ``size`` (or ``shape``,
    ``dims``: height, width) is a mask; with ``exterior`` (and ``interiors``) or of type
    ``Polygon`` a polygon; of type ``MultiPolygon`` a multipolygon.  A list of numbers is a
    polygon ``x, y, ...``; a list of such lists, or of objects with ``exterior``, a multipolygon;
    an empty list is null.  Null, also JSON's, follows ``null_policy``: raise, or null for both
    ways of returning.  Anything else raises, as do counts that don't fill the mask.
    """
    get = lambda path, kind: F.try_variant_get(data, path, kind)
    part = "struct<exterior:array<array<double>>,interiors:array<array<array<double>>>>"
    size = F.coalesce(*[get(f"$.{c}", "array<int>") for c in ("size", "shape", "dims")])
    shape = F.schema_of_variant(data)
    text = get("$.counts", "string")
    counts = F.coalesce(get("$.counts", "array<int>"), unpack_counts(F.when(~text.startswith("["), text)))
    known = counts.isNotNull() & (F.size(size) == 2) & F.forall(counts, lambda n: n >= 0)
    full = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, n: a + n) == F.get(size, F.lit(0)).cast("bigint") * F.get(size, F.lit(1))
    mask = F.struct(F.get(size, F.lit(0)).alias("height"), F.get(size, F.lit(1)).alias("width"), F.coalesce(get("$.order", "string"), F.lit("F")).alias("order"), counts.alias("counts"))
    typed = get("$.type", "string")
    made = lambda kind, mask=None, polygons=None: F.struct(
        F.lit(kind).alias("kind"), (F.lit(None) if mask is None else mask).alias("mask"), (F.lit(None) if polygons is None else polygons).alias("polygons")).cast(KIND)
    one = lambda rings: F.when(rings.isNotNull(), made("polygon", polygons=F.array(rings)))
    many = lambda parts: F.when(parts.isNotNull(), made("multipolygon", polygons=parts))
    even = lambda flat: (F.size(flat) % 2 == 0) & F.forall(flat, lambda v: v.isNotNull())
    flat, lists, parts, single = get("$", "array<double>"), get("$", "array<array<double>>"), get("$", f"array<{part}>"), get("$", part)
    found = (
        F.when(shape.startswith("OBJECT<") & get("$.counts", "variant").isNotNull(), F.when(known & full, made("mask", mask=mask)))
        .when(get("$.exterior", "variant").isNotNull(), one(_explicit(single)))
        .when(typed == "Polygon", one(G._rings(get("$.coordinates", "array<array<array<double>>>"))))
        .when(typed == "MultiPolygon", many(F.transform(get("$.coordinates", "array<array<array<array<double>>>>"), G._rings)))
        .when(get("$[0].exterior", "variant").isNotNull(), F.when(F.forall(parts, lambda p: p["exterior"].isNotNull()), many(F.transform(parts, _explicit))))
        .when(get("$[0]", "double").isNotNull(), F.when(even(flat), one(G.from_coco(flat))))
        .when(lists.isNotNull(), F.when(F.forall(lists, lambda f: f.isNotNull() & even(f)), many(F.transform(lists, G.from_coco)))))
    wrong = F.raise_error(F.concat(F.lit("cannot interpret segmentation "), F.to_json(data))).cast(KIND)
    empty = get("$", "array<variant>").isNotNull() & (F.size(get("$", "array<variant>")) == 0)
    return F.when(data.isNull() | (shape == "VOID"), _handled(null_policy, KIND)).when(empty, F.lit(None).cast(KIND)).otherwise(F.coalesce(found, wrong))


def coerce_list(items: Column, null_policy: str = "raise") -> Column:
    """Segmentations of an array of VARIANTs, as many and in the same order; null elements stay null, a null array follows ``null_policy``."""
    return F.when(items.isNotNull(), F.transform(items, lambda v: coerce(v, "return-None"))).otherwise(_handled(null_policy, f"array<{KIND}>"))


def area(segmentation: Column) -> Column:
    """Ones of a mask, or the sum of the polygons' areas; null for null."""
    ones = F.aggregate(F.filter(segmentation["mask"]["counts"], lambda n, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, n: a + n).cast("double")
    return F.when(segmentation["kind"] == "mask", ones).otherwise(F.aggregate(F.transform(segmentation["polygons"], G.area), F.lit(0.0), lambda a, p: a + p))
