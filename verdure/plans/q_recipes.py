"""Queries that replay recipe documents, from their text to pixels, over images of unlike sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chips
from ..operators import recipes as R
from . import views as V
from .registry import query

#: Every second image is whole (32 by 32), the others have 10 to 12 lines of 20 to 24 pixels.
_H = "CASE WHEN image_id % 2 = 0 THEN 32 ELSE image_id % 3 + 10 END"
_W = "CASE WHEN image_id % 2 = 0 THEN 32 ELSE image_id % 5 + 20 END"


def images(spark, sf_dir):
    """image_id, h, w of each image whose supplier there is, and the text of its recipe document."""
    k = F.col("image_id")
    sizes = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id")).withColumns({"h": F.expr(_H), "w": F.expr(_W)})
    crop = F.struct((k % 4).alias("x"), (k % 3).alias("y"), (k % 7 + 9).alias("width"), (k % 4 + 7).alias("height"))
    resize = (
        F.when(k % 5 == 0, F.to_json(F.struct(F.lit(50).alias("scale"))))
        .when(k % 5 == 1, F.to_json(F.struct(F.lit(12).alias("px_w"), F.lit(0).alias("px_h"))))
        .when(k % 5 == 2, F.to_json(F.struct(F.lit(150).alias("width"), F.lit(120).alias("height"))))
        .when(k % 5 == 3, F.to_json(F.struct(F.lit(200).alias("scale"))))
    )
    stats = '{"mode":"meanstd","ref_stats":[{"mean":100.0,"std":12.0}]}'
    cdf = '{"mode":"cdf","ref_cdf":{"per_band":[{"x":[0.0,0.25,1.0],"y":[0.0,0.5,1.0],"lo":0.0,"hi":400.0},{"x":[0.0,1.0],"y":[0.0,1.0],"lo":0.0,"hi":5000.0}]}}'
    part = lambda name, text: F.concat(F.lit(f'"{name}":'), text)
    formula = F.when(k % 4 == 0, "b1 + b2").when(k % 4 == 1, "(b1 - b2) / (b1 + b2)").when(k % 4 == 2, "b1 - mean(b1)")
    fields = F.array_compact(
        F.array(
            part("rotate", (k % 4 * 90).cast("string")),
            F.when(k % 7 == 6, part("rotate_enabled", F.lit("false"))),
            F.when(k % 3 != 2, part("crop_rect", F.to_json(crop))),
            F.when(k % 3 == 0, part("crop_rect_ref_size", F.to_json(F.struct("w", "h")))),
            F.when(resize.isNotNull(), part("resize", resize)),
            F.when(k % 3 == 0, part("hist_match", F.lit(stats))).when(k % 3 == 1, part("hist_match", F.lit(cdf))),
            F.when(formula.isNotNull(), part("band_expression", F.concat(F.lit('"'), formula, F.lit('"')))),
            F.when(k % 11 == 3, part("band_enabled", F.lit("false"))),
            part("nodata_values", F.lit('[-9999, "b1<20"]')),
        )
    )
    return sizes.withColumn("body", F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))


def sized_pixels(spark, sf_dir):
    rows = V.pixels(spark, sf_dir, gaps=True).select("image_id", "y", "x", F.coalesce("b1", F.lit(-9999.0)).alias("b1"), "b2")
    return rows.filter((F.col("y") < F.expr(_H)) & (F.col("x") < F.expr(_W)))


# Sizes per image, as the replay folds them.
_PLAN = f""", i AS (SELECT s_suppkey AS image_id, CAST({_H.replace('image_id', 's_suppkey')} AS INT) AS h, CAST({_W.replace('image_id', 's_suppkey')} AS INT) AS w FROM supplier),
r AS (SELECT *, CASE WHEN image_id % 7 = 6 THEN 0 ELSE image_id % 4 * 90 END AS deg FROM i),
t AS (SELECT *, deg IN (90, 180, 270) AND image_id % 3 = 0 AS first, CASE WHEN deg IN (90, 270) THEN w ELSE h END AS th, CASE WHEN deg IN (90, 270) THEN h ELSE w END AS tw FROM r),
a AS (SELECT *, CASE WHEN first THEN h ELSE th END AS ah, CASE WHEN first THEN w ELSE tw END AS aw FROM t),
k AS (SELECT *, image_id % 3 = 0 AS ref, round_even((image_id % 4) * CASE WHEN image_id % 3 = 0 THEN aw / w ELSE 1 END, 0) AS x0, round_even((image_id % 3) * CASE WHEN image_id % 3 = 0 THEN ah / h ELSE 1 END, 0) AS y0,
  round_even((image_id % 7 + 9) * CASE WHEN image_id % 3 = 0 THEN aw / w ELSE 1 END, 0) AS cw, round_even((image_id % 4 + 7) * CASE WHEN image_id % 3 = 0 THEN ah / h ELSE 1 END, 0) AS ch FROM a),
b AS (SELECT *, CASE WHEN image_id % 3 = 2 THEN 0 ELSE least(x0, aw) END AS bx0, CASE WHEN image_id % 3 = 2 THEN 0 ELSE least(y0, ah) END AS by0, CASE WHEN image_id % 3 = 2 THEN aw ELSE least(x0 + cw, aw) END AS bx1, CASE WHEN image_id % 3 = 2 THEN ah ELSE least(y0 + ch, ah) END AS by1 FROM k),
c AS (SELECT *, CASE WHEN first AND deg IN (90, 270) THEN bx1 - bx0 ELSE by1 - by0 END AS n, CASE WHEN first AND deg IN (90, 270) THEN by1 - by0 ELSE bx1 - bx0 END AS m FROM b),
z AS (SELECT *, greatest(1, CASE image_id % 5 WHEN 0 THEN round_even(n * 0.5, 0) WHEN 1 THEN round_even(12.0 * n / m, 0) WHEN 2 THEN round_even(n * 1.2, 0) WHEN 3 THEN n * 2 ELSE n END) AS nn, greatest(1, CASE image_id % 5 WHEN 0 THEN round_even(m * 0.5, 0) WHEN 1 THEN 12 WHEN 2 THEN round_even(m * 1.5, 0) WHEN 3 THEN m * 2 ELSE m END) AS nm FROM c),
q AS (SELECT *, CASE WHEN nn = n AND nm = m THEN 'none' WHEN nn < n OR nm < m THEN 'area' WHEN greatest(nn / n, nm / m) < 2 THEN 'linear' ELSE 'cubic' END AS kind FROM z)"""

_TURN = "CASE {d} WHEN 90 THEN {a} WHEN 180 THEN {b} WHEN 270 THEN {c} ELSE {e} END"
_TY = _TURN.format(d="deg", a="{x}", b="{h} - 1 - {y}", c="{w} - 1 - {x}", e="{y}")
_TX = _TURN.format(d="deg", a="{h} - 1 - {y}", b="{w} - 1 - {x}", c="{y}", e="{x}")
_CUTS = f""", o AS (SELECT g.image_id, coalesce(g.b1, -9999) AS b1, g.b2, coalesce(g.b1, -9999) < 20 OR g.b2 = -9999 AS masked, q.*  EXCLUDE (image_id), CASE WHEN first THEN y ELSE {_TY.format(x='x', y='y', h='h', w='w')} END AS y1, CASE WHEN first THEN x ELSE {_TX.format(x='x', y='y', h='h', w='w')} END AS x1
  FROM gaps g JOIN q ON q.image_id = g.image_id WHERE g.y < q.h AND g.x < q.w),
o2 AS (SELECT *, y1 - by0 AS y2, x1 - bx0 AS x2 FROM o WHERE y1 >= by0 AND y1 < by1 AND x1 >= bx0 AND x1 < bx1),
p0 AS (SELECT *, CASE WHEN first THEN {_TY.format(x='x2', y='y2', h='(by1 - by0)', w='(bx1 - bx0)')} ELSE y2 END AS y, CASE WHEN first THEN {_TX.format(x='x2', y='y2', h='(by1 - by0)', w='(bx1 - bx0)')} ELSE x2 END AS x FROM o2)"""


def _match(source: str, name: str, due: str) -> str:
    """CTEs that match the images of ``source`` that are due: image_id % 3 = 0 by mean and deviation (b1), = 1 along a CDF (b1, b2)."""
    z = "CAST(trunc(greatest(0, least(1, ({b} - 0) / {hi})) * 2047) AS INT)"
    interp = {"b1": "(CASE WHEN v < 0.5 THEN v / 0.5 * 0.25 ELSE 0.25 + (v - 0.5) / 0.5 * 0.75 END) * 400", "b2": "v * 5000"}
    out = f", {name}s AS (SELECT image_id, avg(b1) AS mu, stddev_pop(b1) AS sd FROM {source} WHERE NOT masked GROUP BY 1)"
    for b, hi in (("b1", 400), ("b2", 5000)):
        k = z.format(b=b, hi=hi)
        out += f""", {name}_{b} AS (SELECT image_id, bin, {interp[b]} AS new FROM (SELECT image_id, bin, sum(n) OVER (PARTITION BY image_id ORDER BY bin) * 1.0 / sum(n) OVER (PARTITION BY image_id) AS v FROM (SELECT image_id, {k} AS bin, count(*) AS n FROM {source} WHERE NOT masked GROUP BY 1, 2)))"""
    cases = f"CASE WHEN masked OR NOT ({due}) THEN p.b1 WHEN p.image_id % 3 = 0 THEN (p.b1 - mu) * (12.0 / CASE WHEN sd >= 1e-6 THEN sd ELSE 1 END) + 100 WHEN p.image_id % 3 = 1 THEN l1.new ELSE p.b1 END"
    out += f""", {name} AS (SELECT p.* REPLACE ({cases} AS b1, CASE WHEN masked OR NOT ({due}) OR p.image_id % 3 <> 1 THEN p.b2 ELSE l2.new END AS b2) FROM {source} p LEFT JOIN {name}s s ON s.image_id = p.image_id
  LEFT JOIN {name}_b1 l1 ON l1.image_id = p.image_id AND l1.bin = {z.format(b='p.b1', hi=400)} LEFT JOIN {name}_b2 l2 ON l2.image_id = p.image_id AND l2.bin = {z.format(b='p.b2', hi=5000)})"""
    return out


_CUBE = "CASE WHEN abs({d}) <= 1 THEN 1.25 * power(abs({d}), 3) - 2.25 * power(abs({d}), 2) + 1 WHEN abs({d}) < 2 THEN -0.75 * power(abs({d}), 3) + 3.75 * power(abs({d}), 2) - 6 * abs({d}) + 3 ELSE 0 END"


def _weights(name: str, n: str, m: str) -> str:
    """CTEs of (image_id, t, p, wt): the weight of source place p in target t along one side."""
    return f""", {name}t AS (SELECT image_id, kind, {n} AS n, {m} AS m, unnest(range(0, CAST({m} AS BIGINT))) AS t FROM q WHERE kind <> 'none'),
{name}u AS (SELECT *, (t + 0.5) * n / m - 0.5 AS pos, unnest(CASE WHEN kind = 'area' THEN range(CAST(floor(t * n / m) AS BIGINT), CAST(ceil((t + 1) * n / m) AS BIGINT)) WHEN kind = 'cubic' THEN range(CAST(floor((t + 0.5) * n / m - 0.5) AS BIGINT) - 1, CAST(floor((t + 0.5) * n / m - 0.5) AS BIGINT) + 3)
  ELSE range(CAST(floor((t + 0.5) * n / m - 0.5) AS BIGINT), CAST(floor((t + 0.5) * n / m - 0.5) AS BIGINT) + 2) END) AS p0 FROM {name}t),
{name} AS (SELECT image_id, t, greatest(0, least(n - 1, p0)) AS p, sum(CASE WHEN kind = 'area' THEN (least(p0 + 1.0, (t + 1) * n / m) - greatest(p0 * 1.0, t * n / m)) / (n / m) WHEN kind = 'cubic' THEN {_CUBE.format(d='(pos - p0)')} ELSE greatest(0, 1 - abs(pos - p0)) END) AS wt FROM {name}u GROUP BY 1, 2, 3)"""


_RESIZED = (
    _weights("wy", "n", "nn")
    + _weights("wx", "m", "nm")
    + """, s1 AS (SELECT p.image_id, t AS y, x, sum(wt * b1) AS b1, sum(wt * b2) AS b2, sum(CASE WHEN masked THEN abs(wt) ELSE 0 END) AS k FROM p1 p JOIN wy ON wy.image_id = p.image_id AND wy.p = p.y WHERE abs(wt) > 1e-12 GROUP BY 1, 2, 3),
s2 AS (SELECT s.image_id, s.y, t AS x, sum(wt * b1) AS b1, sum(wt * b2) AS b2, sum(abs(wt) * k) > 1e-12 AS masked FROM s1 s JOIN wx ON wx.image_id = s.image_id AND wx.p = s.x WHERE abs(wt) > 1e-12 GROUP BY 1, 2, 3),
p2 AS (SELECT image_id, y, x, CASE WHEN masked THEN -9999 ELSE b1 END AS b1, CASE WHEN masked THEN -9999 ELSE b2 END AS b2, masked FROM s2 UNION ALL SELECT image_id, y, x, b1, b2, masked FROM p1 WHERE kind = 'none')"""
)
_SHRINKS = "p.image_id IN (SELECT image_id FROM q WHERE kind = 'area')"
_FINAL = """ SELECT p.image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, b1, b2, CASE WHEN p.image_id % 11 = 3 THEN NULL WHEN p.image_id % 4 = 0 THEN b1 + b2 WHEN p.image_id % 4 = 1 THEN CASE WHEN b1 + b2 <> 0 THEN (b1 - b2) / (b1 + b2) ELSE 0 END WHEN p.image_id % 4 = 2 THEN b1 - mb END AS b3
FROM p3 p JOIN (SELECT image_id, avg(b1) AS mb FROM p3 GROUP BY 1) a ON a.image_id = p.image_id"""
REPLAYED = V.with_sql(_PLAN[2:] + _CUTS + _match("p0", "p1", f"NOT ({_SHRINKS})") + _RESIZED + _match("p2", "p3", _SHRINKS) + _FINAL, "gaps").replace(")  i AS (", "), i AS (", 1).replace(") i AS (", "), i AS (", 1)


@query("replayed_documents", REPLAYED)
def replayed_documents(spark, sf_dir):
    """From recipe documents to edited pixels: turns, crops, both matches, every resampling with NoData, formulas by image."""
    have = R.typed(images(spark, sf_dir)).select("image_id", "h", "w", "recipe")
    return R.replayed(sized_pixels(spark, sf_dir), have).select("image_id", "y", "x", "b1", "b2", "b3")


@query("planned_sizes", V.with_sql(_PLAN[2:] + " SELECT image_id, CAST(nn AS INT) AS new_h, CAST(nm AS INT) AS new_w, nullif(kind, 'none') AS kind FROM q", "gaps").replace(") i AS (", "), i AS (", 1))
def planned_sizes(spark, sf_dir):
    """The size of every image after its recipe, by scale, pixels or percents, without its pixels."""
    return R.planned(R.typed(images(spark, sf_dir))).select("image_id", F.col("new_h").cast("int").alias("new_h"), F.col("new_w").cast("int").alias("new_w"), "kind")


_CHIP = 20
_AXIS = "greatest(16, round_even((xh - xl + 1) * CAST(1.4 AS DOUBLE), 0))"
_BOXES = f"""SELECT *, greatest(0, least(round_even(xl + (xh - xl + 1) / 2.0 - gw / 2.0, 0), 32 - gw)) AS cx, greatest(0, least(round_even(yl + (yh - yl + 1) / 2.0 - gh / 2.0, 0), 32 - gh)) AS cy FROM (SELECT poly_id, image_id, xl, xh, yl, yh, {_AXIS} AS gw, {_AXIS.replace("xh", "yh").replace("xl", "yl")} AS gh FROM
  (SELECT b.poly_id, b.image_id, CASE shape WHEN 'point' THEN least(31, xl) ELSE xl END AS xl, CASE shape WHEN 'point' THEN least(31, xh) ELSE xh END AS xh, yl, yh FROM ({V.BOX}) b JOIN shapes s ON s.poly_id = b.poly_id))"""
_CHIPPED = f""", boxes AS ({_BOXES}), q AS (SELECT poly_id AS image_id, least(gh, 32 - cy) AS n, least(gw, 32 - cx) AS m, {_CHIP} AS nn, {_CHIP} AS nm, CASE WHEN least(gh, 32 - cy) = {_CHIP} AND least(gw, 32 - cx) = {_CHIP} THEN 'none' WHEN least(gh, 32 - cy) >= {_CHIP} AND least(gw, 32 - cx) >= {_CHIP} THEN 'area' ELSE 'linear' END AS kind FROM boxes),
p1 AS (SELECT b.poly_id AS image_id, g.y - cy AS y, g.x - cx AS x, g.b1, g.b2, false AS masked, kind FROM boxes b JOIN q ON q.image_id = b.poly_id JOIN pixels g ON g.image_id = b.image_id AND g.y >= cy AND g.y < cy + n AND g.x >= cx AND g.x < cx + m)"""


def _sizes(spark, sf_dir):
    """Images that are whole: 32 by 32."""
    whole = V.pixels(spark, sf_dir).groupBy("image_id").count().filter("count = 1024")
    return whole.select("image_id", F.lit(V.SIDE).alias("h"), F.lit(V.SIDE).alias("w"))


_WHOLE = "(SELECT image_id FROM pixels GROUP BY image_id HAVING count(*) = 1024)"


@query("chip_rasters", V.with_sql(_CHIPPED[2:] + _RESIZED + f" SELECT p.image_id AS poly_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, b1, b2 FROM p2 p JOIN shapes s ON s.poly_id = p.image_id WHERE s.image_id IN {_WHOLE}", "pixels", "shapes").replace(") boxes AS (", "), boxes AS (", 1))
def chip_rasters(spark, sf_dir):
    """Chips around all polygons of whole images, resampled to one size."""
    boxes = chips.chip_boxes(V.polygons(spark, sf_dir), _sizes(spark, sf_dir), _CHIP)
    return chips.chip_rasters(V.pixels(spark, sf_dir).select("image_id", "y", "x", "b1", "b2"), boxes, _CHIP)


@query("chip_vertices", V.with_sql(f"boxes AS ({_BOXES}) SELECT b.poly_id, CAST(cx AS INT) AS chip_x, CAST(cy AS INT) AS chip_y, CAST(least(gw, 32 - cx) AS INT) AS chip_w, CAST(least(gh, 32 - cy) AS INT) AS chip_h, (({V.FIRST[0]}) - cx) * {_CHIP} / least(gw, 32 - cx) AS first_x, (({V.FIRST[1]}) - cy) * {_CHIP} / least(gh, 32 - cy) AS first_y FROM boxes b JOIN shapes s ON s.poly_id = b.poly_id WHERE b.image_id IN {_WHOLE}", "pixels", "shapes").replace(") boxes AS (", "), boxes AS (", 1))
def chip_vertices(spark, sf_dir):
    """Where each chip lies, and its polygon's first vertex on it."""
    boxes = chips.chip_boxes(V.polygons(spark, sf_dir), _sizes(spark, sf_dir), _CHIP)
    return boxes.select("poly_id", "chip_x", "chip_y", "chip_w", "chip_h", F.col("vertices")[0]["x"].alias("first_x"), F.col("vertices")[0]["y"].alias("first_y"))
