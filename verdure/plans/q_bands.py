"""Queries over band expressions, indices and missing-value masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from . import views as V
from .registry import query

BANDS = ["b1", "b2", "b3", "b4"]


_CLEAN = "SELECT image_id, y, x, coalesce(b1, 0) AS b1, b2, b3, b4 FROM gaps"


@query("band_expression_zero_fill", f"WITH gaps AS ({V.GAPS}), z AS ({_CLEAN}) SELECT image_id, y, x, (CASE WHEN b1 + b2 <> 0 THEN (b1 - b2) / (b1 + b2) ELSE 0 END) AS ndvi, CAST(CASE WHEN b1 > 100 AND NOT b2 < 20 THEN 1 ELSE 0 END AS DOUBLE) AS bright FROM z")
def band_expression_zero_fill(spark, sf_dir):
    px = B.evaluate(V.pixels(spark, sf_dir, gaps=True), {"ndvi": "(b1-b2)/(b1+b2)", "bright": "(b1>100) AND NOT (b2<20)"})
    return px.select("image_id", "y", "x", "ndvi", "bright")


@query("band_expression_preserve", V.with_sql("SELECT image_id, y, x, (b1 / nullif(b2 - b3, 0)) AS ratio FROM gaps", "gaps"))
def band_expression_preserve(spark, sf_dir):
    px = B.evaluate(V.pixels(spark, sf_dir, gaps=True), {"ratio": "b1/(b2-b3)"}, "preserve")
    return px.select("image_id", "y", "x", "ratio")


@query("band_expression_functions", V.with_sql("""SELECT image_id, y, x, (greatest(10, least(200, b1))) AS clipped, (CASE WHEN b3 > 50 THEN b1 ELSE b4 END) AS chosen,
  (sqrt(greatest(b4, 0)) + ln(greatest(b1, 1e-12)) + abs(b4)) AS mathy, ((b1 + b2 + b3) / 3) AS m3, (list_median([b1, b2, b3])) AS med3,
  (sqrt((power(b1 - (b1 + b2) / 2, 2) + power(b2 - (b1 + b2) / 2, 2)) / 2)) AS sd2, (least(b1, b2)) AS lo FROM pixels""".replace("list_median([b1, b2, b3])", "b1 + b2 + b3 - least(b1, b2, b3) - greatest(b1, b2, b3)"), "pixels"))
def band_expression_functions(spark, sf_dir):
    px = B.evaluate(V.pixels(spark, sf_dir), {"clipped": "clip(b1, 10, 200)", "chosen": "where(b3>50, b1, b4)", "mathy": "sqrt(b4)+log(b1)+abs(b4)", "m3": "mean(b1,b2,b3)", "med3": "pmedian(b1,b2,b3)", "sd2": "std(b1,b2)", "lo": "MIN(b1,b2)"})
    return px.select("image_id", "y", "x", *[F.col(c).alias(c) for c in ("clipped", "chosen", "mathy", "m3", "med3", "sd2", "lo")])


@query("band_expression_image_reducers", V.with_sql("""SELECT p.image_id, y, x, ((b1 - m) / s) AS z, (b2 - q) AS off FROM pixels p
  JOIN (SELECT image_id, avg(b1) AS m, stddev_pop(b1) AS s, quantile_cont(b2, 0.5) AS q FROM pixels GROUP BY image_id) a ON p.image_id = a.image_id""", "pixels"))
def band_expression_image_reducers(spark, sf_dir):
    px = B.evaluate(V.pixels(spark, sf_dir), {"z": "(b1-mean(b1))/std(b1)", "off": "b2-median(b2)"})
    return px.select("image_id", "y", "x", "z", "off")


@query("band_expression_display", V.with_sql("""SELECT p.image_id, y, x, CAST(CASE WHEN lo = hi THEN 128 ELSE floor((b1 + b3 - lo) * 255 / nullif(hi - lo, 0)) END AS INT) AS band FROM pixels p
  JOIN (SELECT image_id, min(b1 + b3) AS lo, max(b1 + b3) AS hi FROM pixels GROUP BY image_id) a ON p.image_id = a.image_id""", "pixels"))
def band_expression_display(spark, sf_dir):
    return B.display_bytes(V.pixels(spark, sf_dir), "b1+b3").select("image_id", "y", "x", "band")


@query("many_named_formulas", V.with_sql("SELECT image_id, (avg(b1 - b2)) AS d, (avg(CASE WHEN b1 + b3 <> 0 THEN b3 / (b1 + b3) ELSE 0 END)) AS s FROM pixels GROUP BY image_id", "pixels"))
def many_named_formulas(spark, sf_dir):
    px = B.evaluate(V.pixels(spark, sf_dir), B.parse_formulas("d = b1-b2\ns=b3/(b1+b3)\nbad = b1**2\n# note"), strict=False)
    return px.groupBy("image_id").agg(F.avg("d").alias("d"), F.avg("s").alias("s"))


@query("vegetation_indices", V.with_sql("""SELECT image_id, y, x, (2 * b2 - (b1 + b3)) AS exg, (b2 / (CASE WHEN b1 + b2 + b3 = 0 THEN 1 ELSE b1 + b2 + b3 END)) AS gcc,
  (b3 / (CASE WHEN b1 + b2 + b3 = 0 THEN 1 ELSE b1 + b2 + b3 END)) AS bcc, ((b2 - b3) / (CASE WHEN b2 + b3 = 0 THEN 1 ELSE b2 + b3 END)) AS gbd, (2 * b3 + b1 - 2 * b2) AS wdx, (b1 + b2 + b3) AS shd FROM pixels""", "pixels"))
def vegetation_indices(spark, sf_dir):
    r, g, b = F.col("b1"), F.col("b2"), F.col("b3")
    named = {"exg": B.exg(r, g, b), "gcc": B.gcc(r, g, b), "bcc": B.bcc(r, g, b), "gbd": B.gbd(g, b), "wdx": B.wdx(r, g, b), "shd": B.shd(r, g, b)}
    return V.pixels(spark, sf_dir).select("image_id", "y", "x", *[c.alias(n) for n, c in named.items()])


@query("export_band_order", V.with_sql("SELECT image_id, y, x, b3 AS b1, b2, b1 AS b3, b4 FROM pixels", "pixels"))
def export_band_order(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    return px.select("image_id", "y", "x", *[F.col(s).alias(d) for s, d in zip(B.export_order(4), BANDS)])


_NODATA = "(b1 IS NULL OR b2 IS NULL OR b3 IS NULL OR abs(coalesce(b1, 0) + 9999) <= 9.999 OR abs(b2 + 9999) <= 9.999 OR abs(b3 + 9999) <= 9.999 OR coalesce(b1 < 5, false) OR abs(b3 - 7) <= 1e-6)"


def _nodata():
    return B.is_nodata(B.parse_nodata("{-9999, b1<5; b3 == 7, -9999}"), ["b1", "b2", "b3"])


@query("nodata_mask", V.with_sql(f"SELECT image_id, count(*) AS n, CAST(sum(CASE WHEN {_NODATA} THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM gaps GROUP BY image_id", "gaps"))
def nodata_mask(spark, sf_dir):
    px = V.pixels(spark, sf_dir, gaps=True)
    return px.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(_nodata().cast("long")).alias("missing"))


@query("mask_invalid_to_null", V.with_sql("SELECT image_id, y, x, b1, CASE WHEN NOT abs(b2 + 9999) <= 9.999 THEN b2 END AS b2 FROM gaps", "gaps"))
def mask_invalid_to_null(spark, sf_dir):
    return B.mask_missing(V.pixels(spark, sf_dir, gaps=True), [-9999.0], ["b1", "b2"]).select("image_id", "y", "x", "b1", "b2")


@query("expression_on_unmasked", V.with_sql(f"SELECT image_id, y, x, (CASE WHEN {_NODATA} THEN b1 ELSE CASE WHEN b3 <> 0 THEN b2 / b3 ELSE 0 END END) AS v FROM gaps", "gaps"))
def expression_on_unmasked(spark, sf_dir):
    px = V.pixels(spark, sf_dir, gaps=True)
    value, _ = B.parse("b2/b3", BANDS)
    return px.select("image_id", "y", "x", B.apply_masked(value, F.col("b1"), _nodata()).alias("v"))


@query("append_derived_band", V.with_sql("SELECT image_id, y, x, b1, b2, b3, b4, (b1 + b2) AS b5 FROM pixels", "pixels"))
def append_derived_band(spark, sf_dir):
    value, _ = B.parse("b1+b2", BANDS)
    return B.append_band(V.pixels(spark, sf_dir), value)


_SUM3 = "(b1 + b2 + b3)"


@query("default_expressions", V.with_sql(f"""SELECT image_id, y, x, CAST(b1 > 150 AS INT) * 1.0::DOUBLE AS boolean1, CAST(b1 > 150 AND b2 > 165 AS INT) * 1.0::DOUBLE AS boolean2, CAST({_SUM3} <> 0 AND b2 / nullif({_SUM3}, 0) > 0.41 AS INT) * 1.0::DOUBLE AS boolean3, {_SUM3} AS sum,
  coalesce(b2 / nullif({_SUM3}, 0), 0) AS "GCC", 2 * b2 - (b1 + b3) AS "EXG", coalesce(b3 / nullif({_SUM3}, 0), 0) AS "RCC", coalesce(b1 / nullif({_SUM3}, 0), 0) AS "BCC", 2 * b1 + b3 - 2 * b2 AS "WDX_2", b1 + 2 * b1 - b2 AS "WDX", b1 + 2 * b3 - 2 * b2 AS "WDX_3" FROM pixels""", "pixels"))
def default_expressions(spark, sf_dir):
    return B.evaluate(V.pixels(spark, sf_dir), B.DEFAULT_EXPRESSIONS).select("image_id", "y", "x", *B.DEFAULT_EXPRESSIONS)
