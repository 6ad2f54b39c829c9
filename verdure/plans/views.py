"""Views that give the driver's tables the shapes of pixels, polygons and catalogs, in Spark and as SQL text.

The Spark side and the SQL side of a view use the same arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

SIDE = 32
#: Shapes to an image: there are ten times as many suppliers as whole images.
PER_IMAGE = 10
POINTS = "array<struct<x:double,y:double>>"


def pixels(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value", "user_id", "props")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    b1, b2 = F.col("value"), F.col("user_id").cast("double")
    b4 = F.col("value") * 2 - F.col("user_id")
    if gaps:
        b1 = F.when(F.col("event_id") % 97 != 0, b1)
        b2 = F.when(F.col("event_id") % 53 == 0, F.lit(-9999.0)).otherwise(b2)
    area = SIDE * SIDE
    return e.select(
        F.expr(f"event_id div {area}").alias("image_id"),
        F.expr(f"(event_id % {area}) div {SIDE}").alias("y"),
        (F.col("event_id") % SIDE).alias("x"),
        b1.alias("b1"), b2.alias("b2"), k.alias("b3"), b4.alias("b4"),
    )


_PIX = "SELECT event_id // 1024 AS image_id, (event_id % 1024) // 32 AS y, event_id % 32 AS x, {b1} AS b1, {b2} AS b2, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS b3, value * 2 - user_id AS b4 FROM events"
PIXELS = _PIX.format(b1="value", b2="CAST(user_id AS DOUBLE)")
GAPS = _PIX.format(b1="CASE WHEN event_id % 97 <> 0 THEN value END", b2="CASE WHEN event_id % 53 = 0 THEN -9999.0 ELSE CAST(user_id AS DOUBLE) END")


def _shape(s: Column) -> Column:
    return (
        F.when(s % 17 == 5, "point").when(s % 17 == 6, "pair").when(s % 23 == 7, "outside").when(s % 3 == 0, "rect").when(s % 3 == 1, "tri").otherwise("diamond")
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shape per supplier: poly_id, grp, image_id, name, shape, points."""
    s = F.col("s_suppkey")
    x0, y0, w, h, r = (F.col(c).cast("double") for c in ("x0", "y0", "w", "h", "r"))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    rect = lambda d: F.array(p(x0 + d, y0), p(x0 + w + d, y0), p(x0 + w + d, y0 + h), p(x0 + d, y0 + h))
    points = (
        F.when(F.col("shape") == "point", F.array(p(x0, y0)))
        .when(F.col("shape") == "pair", F.array(p(x0, y0), p(x0 + w, y0 + h)))
        .when(F.col("shape") == "outside", rect(100))
        .when(F.col("shape") == "rect", rect(0))
        .when(F.col("shape") == "tri", F.array(p(x0, y0), p(x0 + w, y0), p(x0, y0 + w)))
        .otherwise(F.array(p(x0 + 6 - r, y0 + 6), p(x0 + 6, y0 + 6 - r), p(x0 + 6 + r, y0 + 6), p(x0 + 6, y0 + 6 + r)))
    )
    base = table(spark, sf_dir, "supplier").select(
        s.alias("poly_id"), F.concat(F.lit("g"), (s % 5).cast("string")).alias("grp"), F.expr(f"s_suppkey div {PER_IMAGE}").alias("image_id"), F.col("s_name").alias("name"),
        _shape(s).alias("shape"), (s * 7 % 20).alias("x0"), (s * 5 % 20).alias("y0"), (s % 9 + 3).alias("w"), (s % 7 + 2).alias("h"), (s % 4 + 2).alias("r"),
    )
    return base.select("poly_id", "grp", "image_id", "name", "shape", points.alias("points"))


#: The same shapes with their numbers, and which pixels lie in each.
SHAPES = """SELECT s_suppkey AS poly_id, 'g' || (s_suppkey % 5) AS grp, s_suppkey // 10 AS image_id, s_name AS name,
  CASE WHEN s_suppkey % 17 = 5 THEN 'point' WHEN s_suppkey % 17 = 6 THEN 'pair' WHEN s_suppkey % 23 = 7 THEN 'outside' WHEN s_suppkey % 3 = 0 THEN 'rect'
       WHEN s_suppkey % 3 = 1 THEN 'tri' ELSE 'diamond' END AS shape,
  s_suppkey * 7 % 20 AS x0, s_suppkey * 5 % 20 AS y0, s_suppkey % 9 + 3 AS w, s_suppkey % 7 + 2 AS h, s_suppkey % 4 + 2 AS r FROM supplier"""
INSIDE = """SELECT poly_id, grp, image_id, shape, t.x AS x, u.y AS y FROM shapes, range(0, 150) t(x), range(0, 40) u(y) WHERE
  (shape = 'point' AND t.x = x0 AND u.y = y0) OR (shape = 'pair' AND ((t.x = x0 AND u.y = y0) OR (t.x = x0 + w AND u.y = y0 + h)))
  OR (shape = 'rect' AND t.x BETWEEN x0 AND x0 + w AND u.y BETWEEN y0 AND y0 + h) OR (shape = 'outside' AND t.x BETWEEN x0 + 100 AND x0 + w + 100 AND u.y BETWEEN y0 AND y0 + h)
  OR (shape = 'tri' AND t.x >= x0 AND u.y >= y0 AND (t.x - x0) + (u.y - y0) <= w) OR (shape = 'diamond' AND abs(t.x - x0 - 6) + abs(u.y - y0 - 6) <= r)"""


#: A shape's first and last point, the mean of its points and its box, as SQL over the columns of SHAPES.
FIRST = ("CASE shape WHEN 'outside' THEN x0 + 100 WHEN 'diamond' THEN x0 + 6 - r ELSE x0 END", "CASE shape WHEN 'diamond' THEN y0 + 6 ELSE y0 END")
LAST_Y = "CASE shape WHEN 'point' THEN y0 WHEN 'tri' THEN y0 + w WHEN 'diamond' THEN y0 + 6 + r ELSE y0 + h END"
MEAN = (
    "CASE shape WHEN 'point' THEN x0 * 1.0 WHEN 'outside' THEN x0 + w / 2.0 + 100 WHEN 'tri' THEN x0 + w / 3.0 WHEN 'diamond' THEN x0 + 6.0 ELSE x0 + w / 2.0 END",
    "CASE shape WHEN 'point' THEN y0 * 1.0 WHEN 'tri' THEN y0 + w / 3.0 WHEN 'diamond' THEN y0 + 6.0 ELSE y0 + h / 2.0 END",
)
BOX = """SELECT poly_id, image_id, CASE shape WHEN 'outside' THEN x0 + 100 WHEN 'diamond' THEN x0 + 6 - r ELSE x0 END AS xl, CASE shape WHEN 'point' THEN x0 WHEN 'outside' THEN x0 + w + 100 WHEN 'diamond' THEN x0 + 6 + r ELSE x0 + w END AS xh,
  CASE shape WHEN 'diamond' THEN y0 + 6 - r ELSE y0 END AS yl, CASE shape WHEN 'point' THEN y0 WHEN 'tri' THEN y0 + w WHEN 'diamond' THEN y0 + 6 + r ELSE y0 + h END AS yh FROM shapes"""


def with_sql(select: str, *views: str) -> str:
    """WITH clause over the named views, then the select."""
    known = {"pixels": PIXELS, "gaps": GAPS, "shapes": SHAPES, "inside": INSIDE, "gps": GPS, "targets": TARGETS, "catalog": CATALOG, "recipes": RECIPES}
    return "WITH " + ", ".join(f"{v} AS ({known[v]})" for v in views) + " " + select


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position per supplier: number, filename, latitude, longitude. Names have four digits, so that numbers from 10,000 on share them."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("number"), F.concat(F.lit("IMG_"), F.lpad(k.cast("string"), 4, "0"), F.lit(".tif")).alias("filename"), ((k * 37 % 1200) / 10 - 60).alias("latitude"), ((k * 91 % 3400) / 10 - 170).alias("longitude"))


GPS = "SELECT 'IMG_' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '.tif' AS filename, (s_suppkey * 37 % 1200) / 10.0 - 60 AS latitude, (s_suppkey * 91 % 3400) / 10.0 - 170 AS longitude FROM supplier"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("target_index"), ((k * 53 % 1200) / 10 - 60).alias("latitude"), ((k * 17 % 3400) / 10 - 170).alias("longitude"))


TARGETS = "SELECT c_custkey AS target_index, (c_custkey * 53 % 1200) / 10.0 - 60 AS latitude, (c_custkey * 17 % 3400) / 10.0 - 170 AS longitude FROM customer"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of both naming schemes from orders: path, folder, width, height, n_bands, sixteen_bit."""
    k = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.when(k % 3 == 0, F.concat(F.lit("20221212_"), pad(k % 240000, 6), F.lit("_"), pad(k % 1000, 3), F.lit("_IR.tif"))).otherwise(
        F.concat(F.lit("IMG_"), pad(F.expr("o_orderkey div 2") % 10000, 4), F.lit("_"), (k % 7).cast("string"), F.lit("_radiance.tif"))
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("file_id"), name.alias("filename"), F.concat(F.lit("folder"), (k % 4).cast("string")).alias("folder"),
        (k % 5 + 20).alias("width"), (k % 3 + 10).alias("height"), F.when(k % 3 == 0, 3).when(k % 2 == 0, 1).otherwise(5).cast("long").alias("n_bands"), (k % 6 < 4).alias("sixteen_bit"),
    )


CATALOG = """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN '20221212_' || lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') || '_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '_IR.tif'
  ELSE 'IMG_' || lpad(CAST((o_orderkey // 2) % 10000 AS VARCHAR), 4, '0') || '_' || (o_orderkey % 7) || '_radiance.tif' END AS filename, 'folder' || (o_orderkey % 4) AS folder,
  o_orderkey % 5 + 20 AS width, o_orderkey % 3 + 10 AS height, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 5 END AS BIGINT) AS n_bands, o_orderkey % 6 < 4 AS sixteen_bit FROM orders"""


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit recipes: rotate, crop rectangle with its reference size, resize percentages; one per image."""
    k = F.col("s_suppkey")
    rot = (k % 4 * 90).cast("int")
    return table(spark, sf_dir, "supplier").select(
        k.alias("image_id"), rot.alias("rotate"), (k % 5).cast("int").alias("crop_x"), (k % 3).cast("int").alias("crop_y"), (k % 7 + 9).cast("int").alias("crop_w"), (k % 11 + 8).cast("int").alias("crop_h"),
        F.lit(SIDE).alias("ref_w"), F.lit(SIDE).alias("ref_h"), F.when(k % 2 == 0, F.lit(50.0)).otherwise(F.lit(100.0)).alias("scale"),
    )


RECIPES = """SELECT s_suppkey AS image_id, CAST(s_suppkey % 4 * 90 AS INT) AS rotate, CAST(s_suppkey % 5 AS INT) AS crop_x, CAST(s_suppkey % 3 AS INT) AS crop_y, CAST(s_suppkey % 7 + 9 AS INT) AS crop_w,
  CAST(s_suppkey % 11 + 8 AS INT) AS crop_h, 32 AS ref_w, 32 AS ref_h, CASE WHEN s_suppkey % 2 = 0 THEN 50.0 ELSE 100.0 END AS scale FROM supplier"""
