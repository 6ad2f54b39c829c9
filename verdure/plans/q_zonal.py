"""Queries over polygons and the pixels in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..operators import chips, shapes, zonal
from . import views as V
from .registry import query

_VALID = "b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL AND NOT abs(b1 + 9999) <= 9.999 AND NOT abs(b2 + 9999) <= 9.999 AND NOT abs(b3 + 9999) <= 9.999"


@query("zonal_mean_gcc", V.with_sql(f"""SELECT s.poly_id, s.grp, s.image_id, coalesce(n, 0) AS n, gcc FROM shapes s LEFT JOIN (
  SELECT i.poly_id, count(*) AS n, (avg(b2 / (CASE WHEN b1 + b2 + b3 = 0 THEN 1 ELSE b1 + b2 + b3 END))) AS gcc FROM inside i JOIN gaps g ON i.image_id = g.image_id AND i.x = g.x AND i.y = g.y
  WHERE {_VALID} GROUP BY i.poly_id) a ON a.poly_id = s.poly_id""", "gaps", "shapes", "inside"))
def zonal_mean_gcc(spark, sf_dir):
    px, polys = V.pixels(spark, sf_dir, gaps=True), V.polygons(spark, sf_dir)
    gcc = B.gcc(F.col("b1"), F.col("b2"), F.col("b3"))
    missing = B.is_nodata([-9999.0], ["b1", "b2", "b3"])
    rows = zonal.zonal(px, polys, [F.count("*").alias("n"), F.avg(gcc).alias("gcc")], missing)
    return rows.withColumn("n", F.coalesce("n", F.lit(0)))


@query("zonal_mean_bands", V.with_sql("""SELECT s.poly_id, s.grp, s.image_id, mean_b1, mean_b4 FROM shapes s LEFT JOIN (SELECT i.poly_id, (avg(b1)) AS mean_b1, (avg(b4)) AS mean_b4 FROM inside i
  JOIN pixels g ON i.image_id = g.image_id AND i.x = g.x AND i.y = g.y GROUP BY i.poly_id) a ON a.poly_id = s.poly_id""", "pixels", "shapes", "inside"))
def zonal_mean_bands(spark, sf_dir):
    return zonal.zonal(V.pixels(spark, sf_dir), V.polygons(spark, sf_dir), [F.avg(b).alias(f"mean_{b}") for b in ("b1", "b4")])


@query("polygon_pixels", V.with_sql("SELECT i.poly_id, i.grp, g.* FROM inside i JOIN pixels g ON i.image_id = g.image_id AND i.x = g.x AND i.y = g.y", "pixels", "shapes", "inside"))
def polygon_pixels(spark, sf_dir):
    return zonal.pixels_in(V.pixels(spark, sf_dir), V.polygons(spark, sf_dir))


@query("rasterised_polygons", V.with_sql("SELECT poly_id, y, min(x) AS x0, max(x) AS x1 FROM inside WHERE shape <> 'pair' GROUP BY poly_id, y", "shapes", "inside"))
def rasterised_polygons(spark, sf_dir):
    return shapes.spans(V.polygons(spark, sf_dir)).select("poly_id", "y", "x0", "x1")


@query("polygon_statistics", V.with_sql("""SELECT i.poly_id, (avg(b1)) AS b1_mean, (quantile_cont(b1, 0.5)) AS b1_median, (stddev_pop(b1)) AS b1_std, (quantile_cont(b1, 0.05)) AS b1_q5,
  (quantile_cont(b1, 0.95)) AS b1_q95 FROM inside i JOIN gaps g ON i.image_id = g.image_id AND i.x = g.x AND i.y = g.y GROUP BY i.poly_id""", "gaps", "shapes", "inside"))
def polygon_statistics(spark, sf_dir):
    rows = zonal.pixels_in(V.pixels(spark, sf_dir, gaps=True), V.polygons(spark, sf_dir)).groupBy("poly_id").agg(*zonal.statistics("b1", (5, 0.95)))
    return rows.select("poly_id", *[F.col(c).alias(c) for c in rows.columns if c != "poly_id"])


@query("scene_and_polygon_statistics", V.with_sql("""SELECT z.poly_id, z.m AS poly_mean, s.m AS scene_mean, s.sd AS scene_std, s.q AS scene_median FROM (SELECT i.poly_id, i.image_id, (avg(b1)) AS m FROM inside i
  JOIN pixels g ON i.image_id = g.image_id AND i.x = g.x AND i.y = g.y GROUP BY i.poly_id, i.image_id) z
  JOIN (SELECT image_id, (avg(b1)) AS m, (stddev_pop(b1)) AS sd, (quantile_cont(b1, 0.5)) AS q FROM pixels GROUP BY image_id) s ON s.image_id = z.image_id""", "pixels", "shapes", "inside"))
def scene_and_polygon_statistics(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    z = zonal.pixels_in(px, V.polygons(spark, sf_dir)).groupBy("poly_id", "image_id").agg(F.avg("b1").alias("poly_mean"))
    s = zonal.scene_statistics(px, "b1", ()).select("image_id", *[F.col(f"b1_{c}").alias(f"scene_{c}") for c in ("mean", "std", "median")])
    return z.join(s, "image_id").drop("image_id")


@query("class_counts_in_polygons", V.with_sql("""SELECT s.poly_id, coalesce(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS class_0, coalesce(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS class_1,
  coalesce(sum(CASE WHEN c = 2 THEN 1 ELSE 0 END), 0)::BIGINT AS class_2 FROM shapes s LEFT JOIN (SELECT i.poly_id, CAST(b3 AS BIGINT) % 3 AS c FROM inside i JOIN pixels g ON i.image_id = g.image_id AND i.x = g.x AND i.y = g.y) p
  ON p.poly_id = s.poly_id GROUP BY s.poly_id""", "pixels", "shapes", "inside"))
def class_counts_in_polygons(spark, sf_dir):
    px = V.pixels(spark, sf_dir).withColumn("class_id", F.col("b3").cast("long") % 3)
    return zonal.class_counts(px, V.polygons(spark, sf_dir), [0, 1, 2])


_FOLD = "CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > {m} THEN 2 * {m} - ({v}) ELSE {v} END"
_WIN = "LEFT JOIN pixels n{k} ON n{k}.image_id = c.image_id AND n{k}.y = greatest(0, " + _FOLD.format(v="c.y + ({dy})", m="c.my") + ") AND n{k}.x = greatest(0, " + _FOLD.format(v="c.x + ({dx})", m="c.mx") + ")"


@query("pixel_windows_reflect", V.with_sql("SELECT c.image_id, c.y, c.x, n0.b1 AS b1_w0, n4.b1 AS b1_w4, n5.b1 AS b1_w5, n8.b1 AS b1_w8 FROM (SELECT p.image_id, y, x, my, mx FROM pixels p JOIN (SELECT image_id, max(y) AS my, max(x) AS mx FROM pixels GROUP BY image_id) a ON a.image_id = p.image_id) c "
  + " ".join(_WIN.format(k=k, dy=k // 3 - 1, dx=k % 3 - 1) for k in (0, 4, 5, 8)), "pixels"))
def pixel_windows_reflect(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    return zonal.windows(px, px.select("image_id", "y", "x"), 3, ["b1"]).select("image_id", "y", "x", "b1_w0", "b1_w4", "b1_w5", "b1_w8")


@query("channel_layout", V.with_sql("SELECT image_id, y, x, b1 AS R, b2 AS G, b3 AS B, b4 AS band_4, CAST(NULL AS DOUBLE) AS band_5 FROM pixels", "pixels"))
def channel_layout(spark, sf_dir):
    return zonal.channel_layout(V.pixels(spark, sf_dir), 5, True)


@query("distinct_export_rows", V.with_sql("SELECT DISTINCT image_id, b2, b3 FROM pixels", "pixels"))
def distinct_export_rows(spark, sf_dir):
    return V.pixels(spark, sf_dir).select("image_id", "b2", "b3").dropDuplicates()


@query("polygon_inventory", V.with_sql("""SELECT grp, count(*) AS shapes, sum(CASE WHEN shape IN ('point', 'pair') THEN 0 ELSE 1 END)::BIGINT AS polygons, sum(CASE WHEN shape IN ('point', 'pair') THEN 1 ELSE 0 END)::BIGINT AS point_sets,
  sum(CASE shape WHEN 'point' THEN 1 WHEN 'pair' THEN 2 ELSE 0 END)::BIGINT AS dots, array_to_string(list_sort(list(DISTINCT CAST(image_id AS VARCHAR)))[1:2], ',') AS examples FROM shapes GROUP BY grp""", "shapes"))
def polygon_inventory(spark, sf_dir):
    return zonal.inventory(V.polygons(spark, sf_dir)).withColumn("examples", F.array_join("examples", ","))


@query("polygons_by_root", V.with_sql("""SELECT CASE k WHEN 0 THEN '0 (RGB)' WHEN 1 THEN '1' ELSE 'No Root ID' END AS label, count(*) AS shapes, sum(CASE WHEN shape IN ('point', 'pair') THEN 0 ELSE 1 END)::BIGINT AS polygons, sum(CASE WHEN shape IN ('point', 'pair') THEN 1 ELSE 0 END)::BIGINT AS point_sets,
  sum(CASE shape WHEN 'point' THEN 1 WHEN 'pair' THEN 2 ELSE 0 END)::BIGINT AS dots, array_to_string(list_sort(list(DISTINCT CAST(image_id AS VARCHAR)))[1:2], ',') AS examples FROM (SELECT *, poly_id % 3 AS k FROM shapes) GROUP BY 1""", "shapes"))
def polygons_by_root(spark, sf_dir):
    rows = V.polygons(spark, sf_dir).withColumn("root", F.when(F.col("poly_id") % 3 < 2, (F.col("poly_id") % 3).cast("string")))
    names = V.table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("0").alias("root"), F.lit("RGB").alias("root_name"))
    return zonal.inventory_by_root(rows, names).withColumn("examples", F.array_join("examples", ","))


@query("roi_band_values", V.with_sql(f"SELECT i.poly_id, g.x, g.y, g.b1, (2 * g.b2 - (g.b1 + g.b3)) AS exg FROM inside i JOIN gaps g ON i.image_id = g.image_id AND i.x = g.x AND i.y = g.y WHERE {_VALID}", "gaps", "shapes", "inside"))
def roi_band_values(spark, sf_dir):
    px = V.pixels(spark, sf_dir, gaps=True).filter(~B.is_nodata([-9999.0], ["b1", "b2", "b3"]))
    rows = zonal.pixels_in(px, V.polygons(spark, sf_dir))
    return rows.select("poly_id", "x", "y", "b1", B.exg(F.col("b1"), F.col("b2"), F.col("b3")).alias("exg"))


@query("pixel_probe", V.with_sql("""SELECT q.c_custkey AS probe, q.image_id, q.y, q.x, g.b1, (g.b2 - g.b3) AS value, g.b1 < 50 AS missing FROM (SELECT c_custkey, c_custkey // 150 AS image_id, c_custkey * 3 % 40 AS y, c_custkey * 7 % 40 AS x FROM customer) q
  LEFT JOIN pixels g ON g.image_id = q.image_id AND g.y = q.y AND g.x = q.x""", "pixels"))
def pixel_probe(spark, sf_dir):
    k = F.col("c_custkey")
    points = V.table(spark, sf_dir, "customer").select(k.alias("probe"), F.expr("c_custkey div 150").alias("image_id"), (k * 3 % 40).alias("y"), (k * 7 % 40).alias("x"))
    rows = zonal.probe(V.pixels(spark, sf_dir), points, F.col("b1") < 50, F.col("b2") - F.col("b3"))
    return rows.select("probe", "image_id", "y", "x", "b1", "value", "missing")


@query("segmentation_labels", V.with_sql("""SELECT image_id, y, x, max(label) AS label FROM (SELECT l.image_id, p.y, p.x, l.label FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY poly_id) AS label FROM shapes) l JOIN (
  SELECT poly_id, x, y FROM inside WHERE shape <> 'pair' UNION ALL SELECT poly_id, CAST(round_even(x0 + w / 2.0, 0) AS BIGINT), CAST(round_even(y0 + h / 2.0, 0) AS BIGINT) FROM shapes WHERE shape = 'pair') p ON p.poly_id = l.poly_id) t GROUP BY image_id, y, x""", "shapes", "inside"))
def segmentation_labels(spark, sf_dir):
    return chips.labelled(chips.objects(V.polygons(spark, sf_dir))).withColumn("label", F.col("label").cast("long"))


@query("object_table", V.with_sql("SELECT CAST(row_number() OVER (PARTITION BY image_id ORDER BY poly_id) AS INTEGER) AS object_id, grp AS group_name, image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY poly_id) AS INTEGER) AS polygon_index, poly_id FROM shapes", "shapes"))
def object_table(spark, sf_dir):
    return chips.object_table(chips.objects(V.polygons(spark, sf_dir)))


@query("polygon_chips", V.with_sql("""SELECT b.poly_id, g.image_id, g.y - ya AS chip_y, g.x - xa AS chip_x, g.b1, g.b2, g.b3, g.b4 FROM (SELECT poly_id, image_id, CAST(greatest(0, floor(mx - hx)) AS BIGINT) AS xa, CAST(ceil(mx + hx) AS BIGINT) AS xb, CAST(greatest(0, floor(my - hy)) AS BIGINT) AS ya, CAST(ceil(my + hy) AS BIGINT) AS yb
  FROM (SELECT poly_id, image_id, (xl + xh) / 2.0 AS mx, greatest((xh - xl) * CAST(1.4 AS DOUBLE), 16.0) / 2 AS hx, (yl + yh) / 2.0 AS my, greatest((yh - yl) * CAST(1.4 AS DOUBLE), 16.0) / 2 AS hy FROM (""" + V.BOX + """))) b
  JOIN pixels g ON g.image_id = b.image_id AND g.x BETWEEN xa AND xb AND g.y BETWEEN ya AND yb""", "pixels", "shapes"))
def polygon_chips(spark, sf_dir):
    return zonal.chips(V.pixels(spark, sf_dir), V.polygons(spark, sf_dir))


@query("rescaled_polygons", V.with_sql(f"SELECT poly_id, CAST(trunc(least(greatest(({V.FIRST[0]}) * 2.0, 0), 63)) AS BIGINT) AS first_x, CAST(least(trunc(({V.FIRST[1]}) * 0.5), 15) AS BIGINT) AS first_y FROM shapes", "shapes"))
def rescaled_polygons(spark, sf_dir):
    side = F.lit(32)
    p = shapes.rescaled(F.col("points"), side, side, F.lit(64), F.lit(16), F.lit(True))
    return V.polygons(spark, sf_dir).select("poly_id", p[0]["x"].cast("long").alias("first_x"), p[0]["y"].cast("long").alias("first_y"))


@query("shrunk_polygons", V.with_sql(f"SELECT poly_id, CASE WHEN shape IN ('point', 'pair') THEN fx * 1.0 ELSE mx + (fx - mx) * 0.8 END AS first_x, CASE WHEN shape IN ('point', 'pair') THEN ly * 1.0 ELSE my + (ly - my) * 0.8 END AS last_y FROM (SELECT poly_id, shape, {V.FIRST[0]} AS fx, {V.LAST_Y} AS ly, CAST({V.MEAN[0]} AS DOUBLE) AS mx, CAST({V.MEAN[1]} AS DOUBLE) AS my FROM shapes)", "shapes"))
def shrunk_polygons(spark, sf_dir):
    p = shapes.shrunk(F.col("points"), 0.2)
    return V.polygons(spark, sf_dir).select("poly_id", p[0]["x"].alias("first_x"), F.element_at(p, -1)["y"].alias("last_y"))


@query("polygon_mean_point", V.with_sql(f"SELECT poly_id, CAST({V.MEAN[0]} AS DOUBLE) AS mx, CAST({V.MEAN[1]} AS DOUBLE) AS my FROM shapes", "shapes"))
def polygon_mean_point(spark, sf_dir):
    m = shapes.mean_point(F.col("points"))
    return V.polygons(spark, sf_dir).select("poly_id", m["x"].alias("mx"), m["y"].alias("my"))


@query("polygon_parts", V.with_sql("""SELECT poly_id, CASE WHEN shape IN ('point') THEN 1 WHEN shape = 'pair' THEN 2 ELSE 1 END::BIGINT AS parts, CASE WHEN shape IN ('point', 'pair') THEN 1 WHEN shape = 'tri' THEN 3 ELSE 4 END::BIGINT AS first_size FROM shapes""", "shapes"))
def polygon_parts(spark, sf_dir):
    rows = V.polygons(spark, sf_dir)
    pairs = F.concat(F.lit("["), F.array_join(F.transform("points", lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    text = F.when(F.col("poly_id") % 2 == 0, F.to_json("points")).otherwise(pairs)
    return rows.select("poly_id", shapes.normalised(text).alias("parts")).select("poly_id", F.size("parts").cast("long").alias("parts"), F.size(F.col("parts")[0]).cast("long").alias("first_size"))
