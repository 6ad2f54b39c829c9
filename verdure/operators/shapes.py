"""Polygons as arrays of points: normalising, mapping, and filling into row spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def normalised(points: Column) -> Column:
    """JSON text of any known shape of points as an array of parts: pairs, {x,y} records, lists of polygons, one record.

    One or two points give a part for each; three or more are one polygon."""
    v = F.try_parse_json(points)
    kind = lambda c, t: F.try_variant_get(c, "$", t)

    def whole(c: Column) -> Column:
        """NULL unless every element has the wanted shape."""
        return F.when(F.size(c) > 0, F.when(F.forall(c, lambda e: e.isNotNull()), c))

    from_pairs = lambda c: whole(F.transform(c, lambda p: F.when((F.size(p) >= 2) & F.forall(p, lambda e: e.isNotNull()), F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))))
    pairs = from_pairs(kind(v, "array<array<double>>"))
    records = whole(F.transform(kind(v, "array<struct<x double, y double>>"), lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    one = F.when(kind(v, "struct<x double, y double>")["x"].isNotNull(), F.array(F.struct(kind(v, "struct<x double, y double>")["x"].alias("x"), kind(v, "struct<x double, y double>")["y"].alias("y"))))
    lists = whole(F.transform(kind(v, "array<array<array<double>>>"), from_pairs))
    record_lists = whole(F.transform(kind(v, "array<array<struct<x double, y double>>>"), lambda c: whole(F.transform(c, lambda p: F.when(p["x"].isNotNull(), F.struct(p["x"].alias("x"), p["y"].alias("y")))))))
    flat = F.coalesce(pairs, records, one)
    split = F.when(F.size(flat) >= 3, F.array(flat)).otherwise(F.transform(flat, lambda p: F.array(p)))
    return F.coalesce(split, lists, record_lists)


def rescaled(points: Column, ref_w: Column, ref_h: Column, width: Column, height: Column, image_space: Column) -> Column:
    """Points on the target raster: scaled from their reference size if they lie in image space, truncated, clamped."""
    sx = F.when(image_space & (ref_w > 0), width / ref_w).otherwise(F.lit(1.0))
    sy = F.when(image_space & (ref_h > 0), height / ref_h).otherwise(F.lit(1.0))
    fit = lambda v, s, n: F.greatest(F.lit(0), F.least((v * s).cast("int"), n.cast("int") - 1)).cast("double")
    return F.transform(points, lambda p: F.struct(fit(p["x"], sx, width).alias("x"), fit(p["y"], sy, height).alias("y")))


def mean_point(points: Column) -> Column:
    """Arithmetic mean of the vertices."""
    n = F.nullif(F.size(points), F.lit(0))
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k])
    return F.struct((total("x") / n).alias("x"), (total("y") / n).alias("y"))


def shrunk(points: Column, factor: float = 0.07, swell: bool = False) -> Column:
    """Vertices moved towards their mean by a factor of 0 to 1, or away from it.

    The known definition has only the factor and a direction; scaling about the vertex mean is this library's choice."""
    k = 1 + factor if swell else 1 - factor
    from_mean = lambda m: F.transform(points, lambda p: F.struct((m["x"] + (p["x"] - m["x"]) * k).alias("x"), (m["y"] + (p["y"] - m["y"]) * k).alias("y")))
    return F.when(F.size(points) < 3, points).otherwise(F.transform(F.array(mean_point(points)), from_mean)[0])


def spans(polygons: DataFrame, key: str = "poly_id", keep: tuple[str, ...] = (), pairs: bool = False) -> DataFrame:
    """(key, keep, y, x0, x1): filled row spans of each polygon, boundary included, that do not overlap.

    Inside is even-odd at pixel centres; edges add the pixels of a rounded line. One point is one pixel; two points are
    nothing, or with ``pairs`` two pixels. Polygons explode to edges and edges to rows, so no polygon meets a raster."""
    p = F.transform("points", lambda q: F.struct(F.rint(q["x"]).alias("x"), F.rint(q["y"]).alias("y")))
    rows = polygons.select(key, *keep, p.alias("p")).withColumn("n", F.size("p"))
    base = [key, *keep]
    edge = rows.filter("n >= 3").select(*base, F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.col("p")[i].alias("a"), F.col("p")[(i + 1) % F.col("n")].alias("b")))).alias("e"))
    edge = edge.select(*base, F.col("e.a.x").alias("xa"), F.col("e.a.y").alias("ya"), F.col("e.b.x").alias("xb"), F.col("e.b.y").alias("yb"))
    low, high = F.least("ya", "yb").cast("long"), F.greatest("ya", "yb").cast("long")
    cross = edge.filter("ya != yb").select(*base, "xa", "ya", "xb", "yb", F.explode(F.sequence(low, high - 1)).alias("y"))
    at = F.col("xa") + (F.col("y") - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    cross = cross.groupBy(*base, "y").agg(F.sort_array(F.collect_list(at)).alias("c"))
    pair = lambda i: F.struct(F.ceil(F.col("c")[2 * i]).alias("x0"), F.floor(F.col("c")[2 * i + 1]).alias("x1"))
    inside = cross.select(*base, "y", F.explode(F.transform(F.sequence(F.lit(0), F.expr("size(c) div 2 - 1").cast("int")), pair)).alias("s")).select(*base, "y", "s.x0", "s.x1").filter("x0 <= x1")
    steps = F.greatest(F.abs(F.col("xb") - F.col("xa")), F.abs(F.col("yb") - F.col("ya")))
    line = edge.select(*base, "xa", "ya", "xb", "yb", steps.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))).alias("i"))
    along = lambda a, b: F.rint(F.col(a) + F.when(F.col("n") > 0, (F.col(b) - F.col(a)) * F.col("i") / F.nullif("n", F.lit(0.0))).otherwise(0.0)).cast("long")
    line = line.select(*base, along("ya", "yb").alias("y"), along("xa", "xb").alias("x0")).withColumn("x1", F.col("x0"))
    few = rows.filter(F.col("n").between(1, 2) if pairs else F.col("n") == 1).select(*base, F.explode("p").alias("q")).select(*base, F.col("q.y").cast("long").alias("y"), F.col("q.x").cast("long").alias("x0"), F.col("q.x").cast("long").alias("x1"))
    every = inside.unionByName(line).unionByName(few).groupBy(*base, "y").agg(F.sort_array(F.collect_set(F.struct("x0", "x1"))).alias("s"))

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["x0"].alias("x0"), F.greatest(last["x1"], s["x1"]).alias("x1"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["x0"] <= last["x1"] + 1, longer).otherwise(F.concat(acc, F.array(s)))

    empty = F.array().cast("array<struct<x0:bigint,x1:bigint>>")
    return every.select(*base, "y", F.explode(F.aggregate("s", empty, join)).alias("s")).select(*base, "y", "s.x0", "s.x1")


def rotated_point(x: Column, y: Column, w: Column, h: Column, degrees: Column) -> Column:
    """A point of a w by h raster after a clockwise turn by a multiple of 90."""
    r = F.pmod(F.floor(degrees / 90), F.lit(4))
    px = F.when(r == 1, h - 1 - y).when(r == 2, w - 1 - x).when(r == 3, y).otherwise(x)
    py = F.when(r == 1, x).when(r == 2, h - 1 - y).when(r == 3, w - 1 - x).otherwise(y)
    return F.struct(px.alias("x"), py.alias("y"))
