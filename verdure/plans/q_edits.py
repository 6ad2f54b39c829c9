"""Queries over edit recipes as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import edits as E
from . import views as V
from .q_raster import _TURN_X, _TURN_Y
from .registry import query


@query("rotated_rects", V.with_sql("""SELECT image_id, CAST(CASE rotate WHEN 90 THEN greatest(0, 31 - crop_y - crop_h) WHEN 180 THEN greatest(0, 31 - crop_x - crop_w) WHEN 270 THEN crop_y ELSE crop_x END AS INT) AS x,
  CAST(CASE rotate WHEN 90 THEN crop_x WHEN 180 THEN greatest(0, 31 - crop_y - crop_h) WHEN 270 THEN greatest(0, 31 - crop_x - crop_w) ELSE crop_y END AS INT) AS y,
  CAST(CASE WHEN rotate % 180 <> 0 THEN crop_h ELSE crop_w END AS INT) AS width, CAST(CASE WHEN rotate % 180 <> 0 THEN crop_w ELSE crop_h END AS INT) AS height FROM recipes""", "recipes"))
def rotated_rects(spark, sf_dir):
    c = lambda n: F.col(n)
    return V.recipes(spark, sf_dir).select("image_id", E.rotated_rect(c("crop_x"), c("crop_y"), c("crop_w"), c("crop_h"), c("ref_w"), c("ref_h"), c("rotate")).alias("r")).select("image_id", "r.*")


@query("crop_basis", V.with_sql("SELECT image_id, CASE WHEN rotate % 180 <> 0 THEN 'pre_rotate' ELSE 'after_rotate' END AS basis FROM recipes", "recipes"))
def crop_basis(spark, sf_dir):
    return V.recipes(spark, sf_dir).withColumns({"ref_w": F.lit(40), "ref_h": F.lit(30)}).select("image_id", E.crop_basis(F.lit(40), F.lit(30)).alias("basis"))


_FX = "CASE rotate WHEN 90 THEN crop_h - (7.5 - crop_y) WHEN 180 THEN crop_w - (5.25 - crop_x) WHEN 270 THEN 7.5 - crop_y ELSE 5.25 - crop_x END"
_FY = "CASE rotate WHEN 90 THEN 5.25 - crop_x WHEN 180 THEN crop_h - (7.5 - crop_y) WHEN 270 THEN crop_w - (5.25 - crop_x) ELSE 7.5 - crop_y END"


@query("point_to_edited", V.with_sql(f"""SELECT image_id, (({_FX}) * greatest(1, round_even(ew * scale / 100, 0)) / ew) AS x, (({_FY}) * greatest(1, round_even(eh * scale / 100, 0)) / eh) AS y
  FROM (SELECT *, CASE WHEN rotate % 180 <> 0 THEN crop_h ELSE crop_w END AS ew, CASE WHEN rotate % 180 <> 0 THEN crop_w ELSE crop_h END AS eh FROM recipes)""", "recipes"))
def point_to_edited(spark, sf_dir):
    p = E.raw_to_edited(F.lit(5.25), F.lit(7.5), F.lit(V.SIDE), F.lit(V.SIDE))
    return V.recipes(spark, sf_dir).select("image_id", p["x"].alias("x"), p["y"].alias("y"))


@query("point_round_trip", V.with_sql("SELECT image_id, CAST(5.25 AS DOUBLE) AS x, CAST(7.5 AS DOUBLE) AS y FROM recipes", "recipes"))
def point_round_trip(spark, sf_dir):
    side = F.lit(V.SIDE)
    there = V.recipes(spark, sf_dir).withColumn("p", E.raw_to_edited(F.lit(5.25), F.lit(7.5), side, side))
    back = E.edited_to_raw(F.col("p.x"), F.col("p.y"), side, side)
    return there.select("image_id", back["x"].alias("x"), back["y"].alias("y"))


@query("mask_polygons_by_name", V.with_sql("SELECT poly_id, image_id FROM shapes WHERE shape NOT IN ('point', 'pair') AND poly_id % 2 = 0", "shapes"))
def mask_polygons_by_name(spark, sf_dir):
    polys = V.polygons(spark, sf_dir)
    lists = polys.filter("poly_id % 2 = 0").groupBy("image_id").agg(F.collect_set("name").alias("names"))
    return E.mask_polygons(polys, lists).select("poly_id", "image_id")


@query("combined_mask", V.with_sql("""SELECT g.image_id, g.y, g.x, (coalesce(b1 IS NULL OR b2 = -9999, false) OR EXISTS (SELECT 1 FROM inside i WHERE i.image_id = g.image_id AND i.y = g.y AND i.x = g.x AND i.shape <> 'pair')) AS masked FROM gaps g""", "gaps", "shapes", "inside"))
def combined_mask(spark, sf_dir):
    missing = B.is_nodata([-9999.0], ["b1", "b2"])
    return E.combined_mask(V.pixels(spark, sf_dir, gaps=True), missing, V.polygons(spark, sf_dir)).select("image_id", "y", "x", "masked")


_REPLAYED = f"""SELECT image_id, {_TURN_Y.format(d='rotate', x='cx', y='cy', h='crop_h', w='crop_w')} AS y, {_TURN_X.format(d='rotate', x='cx', y='cy', h='crop_h', w='crop_w')} AS x, b1, b2, CASE WHEN rotate % 180 <> 0 THEN crop_w ELSE crop_h END AS h, CASE WHEN rotate % 180 <> 0 THEN crop_h ELSE crop_w END AS w, scale FROM (
  SELECT p.image_id, y - crop_y AS cy, x - crop_x AS cx, b1, b2, rotate, crop_h, crop_w, scale FROM pixels p JOIN recipes r ON p.image_id = r.image_id WHERE x >= crop_x AND x < crop_x + crop_w AND y >= crop_y AND y < crop_y + crop_h)"""
_SHRUNK = f"""SELECT image_id, ty AS y, tx AS x, sum(b1 * wy * wx) / sum(wy * wx) AS b1, sum(b2 * wy * wx) / sum(wy * wx) AS b2 FROM (SELECT s.*, a.k AS ty, b.k AS tx, least(y + 1.0, (a.k + 1) * h * 1.0 / nh) - greatest(y * 1.0, a.k * h * 1.0 / nh) AS wy, least(x + 1.0, (b.k + 1) * w * 1.0 / nw) - greatest(x * 1.0, b.k * w * 1.0 / nw) AS wx
  FROM (SELECT *, greatest(1, round_even(h * scale / 100, 0)) AS nh, greatest(1, round_even(w * scale / 100, 0)) AS nw FROM ({_REPLAYED})) s, range(0, 32) a(k), range(0, 32) b(k) WHERE a.k < nh AND b.k < nw) WHERE wy > 1e-9 AND wx > 1e-9 GROUP BY 1, 2, 3"""


@query("edited_geometry", V.with_sql(f"SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, (b1) AS b1 FROM ({_SHRUNK})", "pixels", "recipes"))
def edited_geometry(spark, sf_dir):
    have = V.recipes(spark, sf_dir)
    px = V.pixels(spark, sf_dir).join(have.select("image_id"), "image_id", "left_semi")
    return E.geometry_only(px, have, V.SIDE, V.SIDE).select("image_id", "y", "x", "b1")


@query("edited_rasters", V.with_sql(f""", s AS ({_SHRUNK}) SELECT s.image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, ((b1 - m) * (10.0 / CASE WHEN sd >= 1e-6 THEN sd ELSE 1 END) + 50.0) AS b1,
  ((b1 - m) * (10.0 / CASE WHEN sd >= 1e-6 THEN sd ELSE 1 END) + 50.0 + b2) AS b5 FROM s JOIN (SELECT image_id, avg(b1) AS m, stddev_pop(b1) AS sd FROM s GROUP BY 1) a ON a.image_id = s.image_id""", "pixels", "recipes").replace(") , s AS", "), s AS"))
def edited_rasters(spark, sf_dir):
    have = V.recipes(spark, sf_dir)
    px = V.pixels(spark, sf_dir).join(have.select("image_id"), "image_id", "left_semi")
    rows = E.edited(px, have, V.SIDE, V.SIDE, {"b1": (50.0, 10.0)}, "b1+b2")
    return rows.select("image_id", "y", "x", "b1", "b5")


@query("feature_input", V.with_sql("""SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS INT) AS b1 FROM (SELECT p.image_id, y, x, trunc(greatest(0, least(1, (b1 - lo) / (hi - lo))) * 255) AS v FROM pixels p JOIN
  (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM (SELECT image_id, unnest([b1, b2, b3]) AS v FROM pixels) GROUP BY 1) a ON a.image_id = p.image_id) GROUP BY 1, 2, 3""", "pixels"))
def feature_input(spark, sf_dir):
    px = V.pixels(spark, sf_dir).withColumns({"h": F.lit(V.SIDE), "w": F.lit(V.SIDE)})
    return E.feature_input(px, 16).select("image_id", "y", "x", "b1")
