"""Queries over raster geometry and radiometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import radiometry as R
from . import views as V
from .registry import query


def _side():
    return F.lit(V.SIDE)


_DEG = "(image_id % 4 * 90)"
_TURN_Y = "CASE {d} WHEN 90 THEN {x} WHEN 180 THEN {h} - 1 - {y} WHEN 270 THEN {w} - 1 - {x} ELSE {y} END"
_TURN_X = "CASE {d} WHEN 90 THEN {h} - 1 - {y} WHEN 180 THEN {w} - 1 - {x} WHEN 270 THEN {y} ELSE {x} END"


@query("rotated_rasters", V.with_sql(f"SELECT image_id, {_TURN_Y.format(d=_DEG, x='x', y='y', h=32, w=32)} AS y, {_TURN_X.format(d=_DEG, x='x', y='y', h=32, w=32)} AS x, b1 FROM pixels", "pixels"))
def rotated_rasters(spark, sf_dir):
    return G.rotate(V.pixels(spark, sf_dir), _side(), _side(), F.col("image_id") % 4 * 90).select("image_id", "y", "x", "b1")


@query("cropped_rasters", V.with_sql("""SELECT p.image_id, y - crop_y AS y, x - crop_x AS x, b1 FROM pixels p JOIN recipes r ON p.image_id = r.image_id
  WHERE x >= crop_x AND x < crop_x + crop_w AND y >= crop_y AND y < crop_y + crop_h""", "pixels", "recipes"))
def cropped_rasters(spark, sf_dir):
    rows = V.pixels(spark, sf_dir).join(V.recipes(spark, sf_dir), "image_id")
    return G.crop(rows, _side(), _side()).select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "b1")


@query("replayed_recipes", V.with_sql(f"""SELECT image_id, {_TURN_Y.format(d='rotate', x='cx', y='cy', h='crop_h', w='crop_w')} AS y, {_TURN_X.format(d='rotate', x='cx', y='cy', h='crop_h', w='crop_w')} AS x, b1 FROM (
  SELECT p.image_id, y - crop_y AS cy, x - crop_x AS cx, b1, rotate, crop_h, crop_w FROM pixels p JOIN recipes r ON p.image_id = r.image_id WHERE x >= crop_x AND x < crop_x + crop_w AND y >= crop_y AND y < crop_y + crop_h)""", "pixels", "recipes"))
def replayed_recipes(spark, sf_dir):
    rows = G.replay(V.pixels(spark, sf_dir), V.recipes(spark, sf_dir), V.SIDE, V.SIDE).filter("h is not null")
    have = V.recipes(spark, sf_dir).select("image_id")
    return rows.join(have, "image_id", "left_semi").select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "b1")


_STEP = 32.0 / 12


@query("area_resample", V.with_sql(f"""SELECT image_id, t.y AS y, u.x AS x, (sum(b1 * wy * wx) / sum(wy * wx)) AS b1 FROM (SELECT p.*, ty, tx, least(y + 1.0, (ty + 1) * 32.0 / 12) - greatest(y * 1.0, ty * 32.0 / 12) AS wy, least(x + 1.0, (tx + 1) * 32.0 / 12) - greatest(x * 1.0, tx * 32.0 / 12) AS wx
  FROM pixels p, range(0, 12) a(ty), range(0, 12) b(tx)) s, LATERAL (SELECT ty AS y) t, LATERAL (SELECT tx AS x) u WHERE wy > 1e-9 AND wx > 1e-9 GROUP BY 1, 2, 3""", "pixels"))
def area_resample(spark, sf_dir):
    rows = V.pixels(spark, sf_dir).select("image_id", "y", "x", "b1").withColumns({"h": _side(), "w": _side()})
    return G.shrink(rows, F.lit(12), F.lit(12)).select("image_id", "y", "x", "b1")


@query("nodata_resample", V.with_sql("""SELECT image_id, y // 2 AS y, x // 2 AS x, CASE WHEN bool_or(b2 = -9999) THEN -9999.0 ELSE (avg(b2)) END AS b2 FROM gaps GROUP BY 1, 2, 3""", "gaps"))
def nodata_resample(spark, sf_dir):
    rows = V.pixels(spark, sf_dir, gaps=True).select("image_id", "y", "x", "b2").withColumns({"h": _side(), "w": _side()})
    return G.shrink(rows, F.lit(16), F.lit(16), F.col("b2") == -9999, -9999.0).select("image_id", "y", "x", "b2")


_GROWN = """SELECT image_id, ty AS y, tx AS x, CASE WHEN bool_or(b2 = -9999 AND abs(wy * wx) > 1e-12) THEN -9999.0 ELSE sum(b2 * wy * wx) END AS b2 FROM (SELECT g.*, {wy} AS wy, {wx} AS wx, p.b2 FROM (SELECT image_id, ty, tx, (ty + 0.5) * 32 / {n}.0 - 0.5 AS sy, (tx + 0.5) * 32 / {n}.0 - 0.5 AS sx FROM (SELECT DISTINCT image_id FROM gaps WHERE image_id % 2 = {k}), range(0, {n}) r(ty), range(0, {n}) s(tx)) g, range(-2, 34) a(k), range(-2, 34) b(k), gaps p
  WHERE p.image_id = g.image_id AND p.y = greatest(0, least(31, a.k)) AND p.x = greatest(0, least(31, b.k)) AND a.k BETWEEN floor(g.sy) - {t} AND floor(g.sy) + {t} + 1 AND b.k BETWEEN floor(g.sx) - {t} AND floor(g.sx) + {t} + 1) GROUP BY 1, 2, 3"""
_CUBIC_W = "CASE WHEN abs({d}) <= 1 THEN 1.25 * power(abs({d}), 3) - 2.25 * power(abs({d}), 2) + 1 WHEN abs({d}) < 2 THEN -0.75 * power(abs({d}), 3) + 3.75 * power(abs({d}), 2) - 6 * abs({d}) + 3 ELSE 0 END"
_LINEAR_W = "greatest(0, 1 - abs({d}))"


def _grown(n: int, k: int, t: int, weight: str) -> str:
    return _GROWN.format(n=n, k=k, t=t, wy=weight.format(d="(g.sy - a.k)"), wx=weight.format(d="(g.sx - b.k)"))


@query("nodata_growth", V.with_sql(f"SELECT * FROM ({_grown(48, 0, 0, _LINEAR_W)}) UNION ALL SELECT * FROM ({_grown(64, 1, 1, _CUBIC_W)})", "gaps"))
def nodata_growth(spark, sf_dir):
    """Masked pixels in growing rasters: bilinear to one and a half, cubic to double the size, by image."""
    rows = V.pixels(spark, sf_dir, gaps=True).select("image_id", "y", "x", "b2").withColumns({"h": _side(), "w": _side()})
    side = F.when(F.col("image_id") % 2 == 0, 48).otherwise(64)
    return G.resize(rows, side, side, F.col("b2") == -9999, -9999.0).select("image_id", "y", "x", "b2")


@query("nodata_warp", V.with_sql("""SELECT g.image_id, g.y, g.x, CASE WHEN bool_or(p.b2 = -9999 AND abs(greatest(0, 1 - abs(g.sy - a.k)) * greatest(0, 1 - abs(g.sx - b.k))) > 1e-12) THEN -9999.0 ELSE sum(coalesce(p.b2, 0) * greatest(0, 1 - abs(g.sy - a.k)) * greatest(0, 1 - abs(g.sx - b.k))) END AS b2 FROM (SELECT f.image_id, ty AS y, tx AS x, 0.1 * tx + 0.9 * ty + 1.25 AS sy, 0.8 * tx - 0.2 * ty + 2.5 AS sx
  FROM (SELECT DISTINCT image_id FROM gaps) f, range(0, 32) r(ty), range(0, 32) s(tx)) g CROSS JOIN range(-10, 45) a(k) CROSS JOIN range(-10, 45) b(k) LEFT JOIN gaps p ON p.image_id = g.image_id AND p.y = a.k AND p.x = b.k
  WHERE a.k BETWEEN floor(g.sy) AND floor(g.sy) + 1 AND b.k BETWEEN floor(g.sx) AND floor(g.sx) + 1 GROUP BY 1, 2, 3""", "gaps"))
def nodata_warp(spark, sf_dir):
    px = V.pixels(spark, sf_dir, gaps=True).select("image_id", "y", "x", "b2")
    sizes = px.select("image_id").distinct().withColumns({"h": _side(), "w": _side()})
    m = [F.lit(v) for v in (0.8, -0.2, 2.5, 0.1, 0.9, 1.25, 0.0, 0.0, 1.0)]
    return G.warp(px, sizes, m, F.col("b2") == -9999, -9999.0).select("image_id", "y", "x", "b2")


_FULL = "(SELECT image_id FROM pixels GROUP BY image_id HAVING count(*) = 1024)"
_BI = """SELECT g.image_id, g.ty AS y, g.tx AS x, (sum(p.b1 * greatest(0, 1 - abs(g.sy - a.k)) * greatest(0, 1 - abs(g.sx - b.k)))) AS b1 FROM (SELECT image_id, ty, tx, (ty + 0.5) * 32 / 48.0 - 0.5 AS sy, (tx + 0.5) * 32 / 48.0 - 0.5 AS sx
  FROM {full} f, range(0, 48) r(ty), range(0, 48) s(tx)) g, range(-1, 33) a(k), range(-1, 33) b(k) JOIN pixels p ON p.image_id = g.image_id AND p.y = greatest(0, least(31, a.k)) AND p.x = greatest(0, least(31, b.k))
  WHERE a.k BETWEEN floor(g.sy) AND floor(g.sy) + 1 AND b.k BETWEEN floor(g.sx) AND floor(g.sx) + 1 GROUP BY 1, 2, 3"""


def _full(spark, sf_dir, side):
    px = V.pixels(spark, sf_dir).select("image_id", "y", "x", "b1")
    sizes = px.groupBy("image_id").count().filter("count = 1024").select("image_id", _side().alias("h"), _side().alias("w"), F.lit(side).alias("new_h"), F.lit(side).alias("new_w"))
    return px, sizes


@query("bilinear_resample", V.with_sql(_BI.format(full=_FULL).replace("FROM (SELECT image_id, ty", "FROM (SELECT f.image_id, ty"), "pixels").replace("JOIN pixels p ON p.image_id = g.image_id AND p.y", ", pixels p WHERE p.image_id = g.image_id AND p.y").replace("\n  WHERE a.k BETWEEN", "\n  AND a.k BETWEEN"))
def bilinear_resample(spark, sf_dir):
    px, sizes = _full(spark, sf_dir, 48)
    return G.enlarge(px, sizes, parts=G.parts_of(sizes)).select("image_id", "y", "x", "b1")


_CUBE = "CASE WHEN abs({d}) <= 1 THEN 1.25 * power(abs({d}), 3) - 2.25 * power(abs({d}), 2) + 1 WHEN abs({d}) < 2 THEN -0.75 * power(abs({d}), 3) + 3.75 * power(abs({d}), 2) - 6 * abs({d}) + 3 ELSE 0 END"


@query("cubic_resample", V.with_sql(f"""SELECT g.image_id, g.ty AS y, g.tx AS x, (sum(p.b1 * ({_CUBE.format(d='(g.sy - a.k)')}) * ({_CUBE.format(d='(g.sx - b.k)')}))) AS b1 FROM (SELECT f.image_id, ty, tx, (ty + 0.5) * 32 / 64.0 - 0.5 AS sy, (tx + 0.5) * 32 / 64.0 - 0.5 AS sx
  FROM {_FULL} f, range(0, 64) r(ty), range(0, 64) s(tx)) g, range(-2, 34) a(k), range(-2, 34) b(k), pixels p WHERE p.image_id = g.image_id AND p.y = greatest(0, least(31, a.k)) AND p.x = greatest(0, least(31, b.k))
  AND a.k BETWEEN floor(g.sy) - 1 AND floor(g.sy) + 2 AND b.k BETWEEN floor(g.sx) - 1 AND floor(g.sx) + 2 GROUP BY 1, 2, 3""", "pixels"))
def cubic_resample(spark, sf_dir):
    px, sizes = _full(spark, sf_dir, 64)
    return G.enlarge(px, sizes, cubic=True, parts=G.parts_of(sizes)).select("image_id", "y", "x", "b1")


_HALF = "SELECT image_id, y // 2 AS y, x // 2 AS x, avg(b1) AS b1 FROM pixels WHERE image_id % 4 = 0 GROUP BY 1, 2, 3"
_WHOLE = "(SELECT image_id FROM pixels GROUP BY image_id HAVING count(*) = 1024 AND image_id % 4 = {k})"


def _of(name: str, k: int) -> str:
    """The select of a registered resampling query over every fourth image."""
    from .registry import ORACLE_SQL

    text = ORACLE_SQL[name]
    return text[text.index(" SELECT g.image_id") :].replace("HAVING count(*) = 1024", f"HAVING count(*) = 1024 AND image_id % 4 = {k}")


@query("resized_rasters", V.with_sql(f"SELECT image_id, y, x, b1 FROM ({_HALF}) UNION ALL SELECT image_id, y, x, b1 FROM ({_of('bilinear_resample', 1)}) UNION ALL SELECT image_id, y, x, b1 FROM ({_of('cubic_resample', 2)}) UNION ALL SELECT image_id, y, x, b1 FROM pixels WHERE image_id % 4 = 3", "pixels").replace("FROM pixels WHERE image_id % 4", "FROM pixels WHERE image_id IN (SELECT image_id FROM pixels GROUP BY image_id HAVING count(*) = 1024) AND image_id % 4"))
def resized_rasters(spark, sf_dir):
    """Half, one and a half times, twice and once the size, by image."""
    px, sizes = _full(spark, sf_dir, 32)
    rows = px.join(sizes.select("image_id", "h", "w"), "image_id")
    side = F.element_at(F.array(*map(F.lit, (16, 48, 64, 32))), (F.col("image_id") % 4 + 1).cast("int"))
    return G.resize(rows, side, side).select("image_id", "y", "x", "b1")


@query("warped_rasters", V.with_sql("""SELECT g.image_id, g.y, g.x, (sum(coalesce(p.b1, 0) * greatest(0, 1 - abs(g.sy - a.k)) * greatest(0, 1 - abs(g.sx - b.k)))) AS b1 FROM (SELECT f.image_id, ty AS y, tx AS x, 0.1 * tx + 0.9 * ty + 1.25 AS sy, 0.8 * tx - 0.2 * ty + 2.5 AS sx
  FROM (SELECT image_id FROM pixels GROUP BY image_id HAVING count(*) = 1024) f, range(0, 32) r(ty), range(0, 32) s(tx)) g CROSS JOIN range(-10, 45) a(k) CROSS JOIN range(-10, 45) b(k) LEFT JOIN pixels p ON p.image_id = g.image_id AND p.y = a.k AND p.x = b.k
  WHERE a.k BETWEEN floor(g.sy) AND floor(g.sy) + 1 AND b.k BETWEEN floor(g.sx) AND floor(g.sx) + 1 GROUP BY 1, 2, 3""", "pixels"))
def warped_rasters(spark, sf_dir):
    px, sizes = _full(spark, sf_dir, 32)
    m = [F.lit(v) for v in (0.8, -0.2, 2.5, 0.1, 0.9, 1.25, 0.0, 0.0, 1.0)]
    return G.warp(px, sizes.select("image_id", "h", "w"), m).select("image_id", "y", "x", "b1")


@query("random_points", "SELECT image_id, point, x >= 0 AND x < 32 AND y >= 0 AND y < 20 AS inside FROM (SELECT s_suppkey AS image_id, CAST(t.p AS INT) AS point, 1 AS x, 1 AS y FROM supplier, range(1, 6) t(p))")
def random_points(spark, sf_dir):
    sizes = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(20).alias("h"), F.lit(32).alias("w"))
    rows = G.random_points(sizes, 5)
    return rows.select("image_id", "point", (F.col("x").between(0, 31) & F.col("y").between(0, 19)).alias("inside"))


@query("reference_mean_std", V.with_sql("SELECT image_id, (avg(b1)) AS m_b1, (stddev_pop(b1)) AS s_b1 FROM gaps WHERE b2 <> -9999 GROUP BY image_id", "gaps"))
def reference_mean_std(spark, sf_dir):
    rows = R.mean_std(V.pixels(spark, sf_dir, gaps=True), ["b1"], masked=F.col("b2") == -9999)
    return rows.select("image_id", "m_b1", "s_b1")


_CDF = """SELECT b.bin, (b.bin + 0.5) / 1024 AS x, sum(coalesce(c, 0)) OVER (ORDER BY b.bin) * 1.0 / n AS y, lo, hi FROM (SELECT CAST(bin AS INT) AS bin FROM range(0, 1024) t(bin)) b CROSS JOIN
  (SELECT quantile_cont(b1, 0.0001) AS lo, quantile_cont(b1, 0.9999) AS hi, count(b1) AS n FROM pixels WHERE image_id = 0) e LEFT JOIN
  (SELECT CAST(least(floor((b1 - lo) / (hi - lo) * 1024), 1023) AS INT) AS bin, count(*) AS c FROM pixels, (SELECT quantile_cont(b1, 0.0001) AS lo, quantile_cont(b1, 0.9999) AS hi FROM pixels WHERE image_id = 0) WHERE image_id = 0 AND b1 BETWEEN lo AND hi GROUP BY 1) h ON h.bin = b.bin"""


@query("reference_cdf", V.with_sql(f"SELECT bin, (x) AS x, (y) AS y, (lo) AS lo, (hi) AS hi FROM ({_CDF})", "pixels"))
def reference_cdf(spark, sf_dir):
    rows = R.reference_cdf(V.pixels(spark, sf_dir).filter("image_id = 0"), "b1")
    return rows.select("bin", "x", "y", "lo", "hi")


@query("mean_std_match", V.with_sql("""SELECT p.image_id, y, x, ((b1 - m) * (12.0 / s) + 100.0) AS b1 FROM pixels p JOIN (SELECT image_id, avg(b1) AS m, stddev_pop(b1) AS s FROM pixels GROUP BY image_id) a ON a.image_id = p.image_id""", "pixels"))
def mean_std_match(spark, sf_dir):
    return R.match_mean_std(V.pixels(spark, sf_dir), {"b1": (100.0, 12.0)}).select("image_id", "y", "x", "b1")


@query("cdf_match", V.with_sql(f""", ref AS ({_CDF}), z AS (SELECT image_id, y, x, CAST(trunc(greatest(0, least(1, (b1 - lo) / (hi - lo))) * 2047) AS INT) AS bin, lo, hi FROM pixels, (SELECT any_value(lo) AS lo, any_value(hi) AS hi FROM ref)),
  s AS (SELECT image_id, bin, sum(c) OVER (PARTITION BY image_id ORDER BY bin) * 1.0 / sum(c) OVER (PARTITION BY image_id) AS v, lo, hi FROM (SELECT image_id, bin, count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi FROM z GROUP BY 1, 2)),
  j AS (SELECT s.*, (SELECT max(bin) FROM ref WHERE ref.y <= s.v) AS k FROM s),
  t AS (SELECT j.image_id, j.bin, CASE WHEN a.bin IS NULL THEN 0.5 / 1024 WHEN b.bin IS NULL OR b.y <= a.y THEN a.x ELSE a.x + (v - a.y) / (b.y - a.y) * (b.x - a.x) END * (j.hi - j.lo) + j.lo AS new FROM j LEFT JOIN ref a ON a.bin = k LEFT JOIN ref b ON b.bin = k + 1)
  SELECT z.image_id, y, x, (new) AS b1 FROM z JOIN t ON t.image_id = z.image_id AND t.bin = z.bin""", "pixels").replace(") , ref", "), ref"))
def cdf_match(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    return R.match_cdf(px, "b1", R.reference_cdf(px.filter("image_id = 0"), "b1")).select("image_id", "y", "x", "b1")


@query("percentile_stretch", V.with_sql("""SELECT p.image_id, y, x, CAST(trunc(greatest(0, least(1, (b1 - lo) / (hi - lo))) * 255) AS INT) AS b1 FROM pixels p JOIN (SELECT image_id, quantile_cont(b1, 0.005) AS lo, quantile_cont(b1, 0.995) AS hi FROM pixels GROUP BY image_id) a ON a.image_id = p.image_id""", "pixels"))
def percentile_stretch(spark, sf_dir):
    return R.stretch(V.pixels(spark, sf_dir), ["b1"]).select("image_id", "y", "x", "b1")


@query("min_max_bytes", V.with_sql("""SELECT p.image_id, y, x, CAST(trunc((b4 - lo) / (hi - lo) * 255) AS INT) AS b4 FROM pixels p JOIN (SELECT image_id, min(b4) AS lo, max(b4) AS hi FROM pixels GROUP BY image_id) a ON a.image_id = p.image_id""", "pixels"))
def min_max_bytes(spark, sf_dir):
    return R.min_max_bytes(V.pixels(spark, sf_dir), ["b4"]).select("image_id", "y", "x", "b4")


@query("statistics_sample", V.with_sql("""SELECT image_id, y, x, b1 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5('42|' || image_id || '|' || y || '|' || x)) AS n FROM pixels WHERE b2 > 20 AND y % s = 0 AND x % s = 0) WHERE n <= 40""".replace("FROM pixels WHERE", "FROM (SELECT p.*, greatest(1, CAST(floor(sqrt(a / 256.0)) AS INT)) AS s FROM pixels p JOIN (SELECT image_id, (max(y) + 1) * (max(x) + 1) AS a FROM pixels GROUP BY image_id) t ON t.image_id = p.image_id) WHERE"), "pixels"))
def statistics_sample(spark, sf_dir):
    return R.sampled(V.pixels(spark, sf_dir), 16, 40, masked=F.col("b2") <= 20).select("image_id", "y", "x", "b1")
