"""Queries over features, similarity and spatial matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as S
from ..operators import spatial as P
from . import views as V
from .registry import query


def _rgb(spark, sf_dir):
    """Bytes from the pixel view: R = b1 mod 256, G = b2, B = b3 * 2."""
    px = V.pixels(spark, sf_dir)
    return px.select("image_id", "y", "x", F.floor("b1").cast("int").alias("v1"), F.col("b2").cast("int").alias("b2"), (F.col("b3") * 2).cast("int").alias("b3")).select("image_id", "y", "x", (F.col("v1") % 256).alias("b1"), "b2", "b3")


_RGB = "SELECT image_id, y, x, CAST(floor(b1) AS INT) % 256 AS b1, CAST(b2 AS INT) AS b2, CAST(b3 * 2 AS INT) AS b3 FROM pixels"
_LEVEL = "SELECT image_id, y, x, CAST(floor(b1) AS INT) % 256 AS l FROM pixels"


def _level(spark, sf_dir):
    return _rgb(spark, sf_dir).select("image_id", "y", "x", F.col("b1").alias("l")).withColumns({"h": F.lit(32), "w": F.lit(32)})


_LIN = "CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE power(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_F = "CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116 END"
_LAB = f"""SELECT image_id, b1, b2, b3, CAST(greatest(0, least(255, round_even((CASE WHEN yy > 0.008856 THEN 116 * cbrt(yy) - 16 ELSE 903.3 * yy END) * 255 / 100, 0))) AS INT) AS l,
  CAST(greatest(0, least(255, round_even(500 * (({_F.format(t='xx')}) - ({_F.format(t='yy')})) + 128, 0))) AS INT) AS a, CAST(greatest(0, least(255, round_even(200 * (({_F.format(t='yy')}) - ({_F.format(t='zz')})) + 128, 0))) AS INT) AS b FROM (
  SELECT *, (0.412453 * r + 0.357580 * g + 0.180423 * bl) / 0.950456 AS xx, 0.212671 * r + 0.715160 * g + 0.072169 * bl AS yy, (0.019334 * r + 0.119193 * g + 0.950227 * bl) / 1.088754 AS zz FROM (
  SELECT *, {_LIN.format(c='b1')} AS r, {_LIN.format(c='b2')} AS g, {_LIN.format(c='b3')} AS bl FROM ({_RGB})))"""


@query("colour_features", V.with_sql(f"""SELECT image_id, (avg(l)) AS mean_L, (stddev_pop(l)) AS std_L, (avg(a)) AS mean_a, (avg(b)) AS mean_b, ((avg(b1) + 1e-6) / (avg(b2) + 1e-6)) AS ratio_rg FROM ({_LAB}) GROUP BY image_id""", "pixels"))
def colour_features(spark, sf_dir):
    rows = S.colour_statistics(_rgb(spark, sf_dir))
    return rows.select("image_id", *[F.col(c).alias(c) for c in ("mean_L", "std_L", "mean_a", "mean_b", "ratio_rg")])


@query("lightness_histogram", V.with_sql(f"""SELECT i.image_id, CAST(b.bin AS INT) AS bin, (coalesce(c, 0) / (n + 1e-6)) AS share FROM (SELECT image_id, count(*) AS n FROM ({_LEVEL}) GROUP BY 1) i CROSS JOIN range(0, 32) b(bin) LEFT JOIN
  (SELECT image_id, l // 8 AS bin, count(*) AS c FROM ({_LEVEL}) GROUP BY 1, 2) h ON h.image_id = i.image_id AND h.bin = b.bin""", "pixels"))
def lightness_histogram(spark, sf_dir):
    return S.histogram(_level(spark, sf_dir), "l").select("image_id", F.posexplode("hist").alias("bin", "share")).withColumn("share", F.col("share"))


@query("lightness_entropy", V.with_sql(f"SELECT image_id, (-sum(p * log2(p))) AS entropy FROM (SELECT image_id, c / (sum(c) OVER (PARTITION BY image_id) + 1e-6) AS p FROM (SELECT image_id, l, count(*) AS c FROM ({_LEVEL}) GROUP BY 1, 2)) GROUP BY 1", "pixels"))
def lightness_entropy(spark, sf_dir):
    return S.entropy(_level(spark, sf_dir), "l").withColumn("entropy", F.col("entropy"))


@query("block_homogeneity", V.with_sql(f"SELECT image_id, (var_pop(m)) AS spatial_variance, (stddev_pop(m) / (avg(m) + 1e-6)) AS coeff_variation FROM (SELECT image_id, y // 4 AS by, x // 4 AS bx, round_even(avg(l), 0) AS m FROM ({_LEVEL}) GROUP BY 1, 2, 3) GROUP BY 1", "pixels"))
def block_homogeneity(spark, sf_dir):
    rows = S.block_homogeneity(_level(spark, sf_dir), "l")
    return rows.select("image_id", *[F.col(c).alias(c) for c in ("spatial_variance", "coeff_variation")])


_PAIRS = " UNION ALL ".join(f"SELECT a.image_id, a.l // 8 AS i, b.l // 8 AS j FROM lev a JOIN lev b ON a.image_id = b.image_id AND b.y = a.y + ({dy}) AND b.x = a.x + ({dx})" for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)))


@query("texture_features", V.with_sql(f""", lev AS ({_LEVEL}), g AS (SELECT image_id, i, j, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY image_id) AS p FROM ({_PAIRS}) GROUP BY 1, 2, 3)
  SELECT g.image_id, (sum(p * (i - j) * (i - j))) AS glcm_contrast, (sum(p / (1 + abs(i - j)))) AS glcm_homogeneity, (sum(p * p)) AS glcm_energy,
  (sum(p * (i - mi) * (j - mj)) / (sqrt(sum(p * (i - mi) * (i - mi))) * sqrt(sum(p * (j - mj) * (j - mj))))) AS glcm_correlation FROM g JOIN (SELECT image_id, sum(p * i) AS mi, sum(p * j) AS mj FROM g GROUP BY 1) m ON m.image_id = g.image_id GROUP BY g.image_id""", "pixels").replace(") , lev", "), lev"))
def texture_features(spark, sf_dir):
    rows = S.texture(_level(spark, sf_dir), "l")
    return rows.select("image_id", "glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation")


@query("batch_image_features")
def batch_image_features(spark, sf_dir):
    return S.features(_rgb(spark, sf_dir).withColumns({"h": F.lit(32), "w": F.lit(32)}))


def _rows(spark, sf_dir):
    e = F.col("embedding")
    total = F.aggregate(F.slice(e, 33, 32), F.lit(0.0), lambda a, v: a + F.abs(v.cast("double")))
    hist = F.transform(F.slice(e, 33, 32), lambda v: F.abs(v.cast("double")) / total)
    scalars = [e[i].cast("double").alias(n) for i, n in enumerate(S.WEIGHTS)]
    return V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", *scalars, hist.alias("hist"))


_LIST = "list_sum(list_transform(range({a}, {b}), lambda i: {e}))"
_SCORES_SQL = """, f AS (SELECT vec_id, label, {cols}, {hists} FROM embeddings), r AS (SELECT * FROM f WHERE vec_id IN (3, 7)), s AS (SELECT count(*) AS n, {sums} FROM f),
  sc AS (SELECT r.vec_id AS ref_id, f.vec_id AS image_id, f.label, exp(-(0.7 * sqrt({terms}) + 0.3 * -ln(greatest(1e-10, least(1.0, ({bc}) / sqrt(r.ht * f.ht))))) / 2.0) AS score FROM f CROSS JOIN r CROSS JOIN s) """
_MEAN = "((s{i} + r.c{i}) / (n + 1))"
_SC = _SCORES_SQL.format(
    cols=", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS c{i}" for i in range(14)),
    hists=", ".join(f"abs(CAST(embedding[{i + 33}] AS DOUBLE)) AS h{i}" for i in range(32)) + ", " + " + ".join(f"abs(CAST(embedding[{i + 33}] AS DOUBLE))" for i in range(32)) + " AS ht",
    sums=", ".join(f"sum(c{i}) AS s{i}, sum(c{i} * c{i}) AS q{i}" for i in range(14)),
    terms=" + ".join(f"{w} * power((r.c{i} - f.c{i}) / sqrt((q{i} + r.c{i} * r.c{i}) / (n + 1) - {_MEAN.format(i=i)} * {_MEAN.format(i=i)}), 2)" for i, w in enumerate(S.WEIGHTS.values())),
    bc=" + ".join(f"sqrt(r.h{i} * f.h{i})" for i in range(32)),
).removeprefix(", ")


def _scored(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows, S.scores(rows, rows.filter("image_id in (3, 7)"))


@query("similarity_scores", f"WITH {_SC} SELECT ref_id, image_id, (score) AS score FROM sc")
def similarity_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[1].withColumn("score", F.col("score"))


@query("similarity_top", f"WITH {_SC} SELECT image_id, (max(score)) AS score FROM sc GROUP BY image_id ORDER BY max(score) DESC, image_id LIMIT 20")
def similarity_top(spark, sf_dir):
    return S.top(S.best_score(_scored(spark, sf_dir)[1]), 20).withColumn("score", F.col("score"))


@query("similarity_split", f"WITH {_SC} SELECT image_id, max(score) >= 0.1 AS selected FROM sc GROUP BY image_id")
def similarity_split(spark, sf_dir):
    return S.split_at(S.best_score(_scored(spark, sf_dir)[1]), 0.1).select("image_id", "selected")


@query("similarity_histogram", f"WITH {_SC} , b AS (SELECT max(score) AS score FROM sc GROUP BY image_id) SELECT CAST(least(29, floor((score - lo) / (hi - lo) * 30)) AS INT) AS bin, count(*) AS n FROM b, (SELECT min(score) AS lo, max(score) AS hi FROM b) GROUP BY 1")
def similarity_histogram(spark, sf_dir):
    return S.score_histogram(S.best_score(_scored(spark, sf_dir)[1]))


@query("similarity_summary", f"WITH {_SC} SELECT label, (avg(score)) AS mean, (stddev_pop(score)) AS std, (min(score)) AS min, (max(score)) AS max, count(*) AS n FROM sc GROUP BY label")
def similarity_summary(spark, sf_dir):
    rows, scored = _scored(spark, sf_dir)
    out = S.summary_by(scored.join(rows.select("image_id", "label"), "image_id"), "label")
    return out.select("label", *[F.col(c).alias(c) for c in ("mean", "std", "min", "max")], "n")


_NEAR = """SELECT target_index, filename, degrees, latitude, longitude, ilat, ilon FROM (SELECT t.*, g.filename, g.latitude AS ilat, g.longitude AS ilon, sqrt(power(t.latitude - g.latitude, 2) + power(t.longitude - g.longitude, 2)) AS degrees,
  row_number() OVER (PARTITION BY target_index ORDER BY sqrt(power(t.latitude - g.latitude, 2) + power(t.longitude - g.longitude, 2)), g.filename) AS k FROM targets t CROSS JOIN gps g) WHERE k = 1"""


@query("nearest_image", V.with_sql(f"SELECT target_index, (degrees) AS degrees FROM ({_NEAR})", "gps", "targets"))
def nearest_image(spark, sf_dir):
    return P.nearest(V.targets(spark, sf_dir), V.gps(spark, sf_dir)).select("target_index", "degrees")


_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians(g.latitude) - radians(t.latitude)) / 2), 2) + cos(radians(t.latitude)) * cos(radians(g.latitude)) * power(sin(radians(g.longitude - t.longitude) / 2), 2))))"


def _pairs(spark, sf_dir):
    t = V.targets(spark, sf_dir).select("target_index", F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    g = V.gps(spark, sf_dir).select((F.regexp_extract("filename", "[0-9]+", 0).cast("long")).alias("k"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    return t.join(g, F.col("target_index") % 100 == F.col("k"))


@query("distance_metres", V.with_sql(f"SELECT t.target_index, ({_HAV}) AS metres FROM targets t JOIN gps g ON g.filename = 'IMG_' || lpad(CAST(t.target_index % 100 AS VARCHAR), 4, '0') || '.tif'", "gps", "targets"))
def distance_metres(spark, sf_dir):
    return _pairs(spark, sf_dir).select("target_index", P.haversine(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))).alias("metres"))


@query("geodesic_metres")
def geodesic_metres(spark, sf_dir):
    return P.geodesic_metres(_pairs(spark, sf_dir)).select("target_index", "metres")


@query("best_match_per_source", "SELECT l_suppkey AS source, min_by(l_orderkey, struct_pack(d := coalesce(CASE WHEN l_linenumber < 6 THEN l_extendedprice END, CAST('inf' AS DOUBLE)), t := l_orderkey)) AS target_index FROM lineitem GROUP BY 1")
def best_match_per_source(spark, sf_dir):
    m = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("target_index"), F.lit("x").alias("closest_image"), F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice")).alias("distance_meters"))
    return P.best_match(m).select("source", "target_index")


_STEM = "regexp_replace(filename, '[.][^.]*$', '')"
_CANON = f"regexp_replace(lower({_STEM}), '(_(radiance|ir))+$', '')"


@query("source_polygon_lookup", V.with_sql(f"""SELECT c.file_id, CASE WHEN c.file_id % 2 = 0 THEN 'exact' ELSE 'canonical' END AS found FROM catalog c""", "catalog"))
def source_polygon_lookup(spark, sf_dir):
    from ..operators.catalog import stem

    rows = V.catalog(spark, sf_dir)
    base = stem(F.col("filename"))
    wanted = rows.select("file_id", F.lit("g").alias("grp"), F.when(F.col("file_id") % 2 == 0, F.concat(F.lit("f"), F.col("file_id").cast("string"))).otherwise(F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit("_Thermal_RGB"))).alias("base"))
    polys = rows.select(F.lit("g").alias("grp"), F.concat(F.lit("f"), F.col("file_id").cast("string"), F.when(F.col("file_id") % 2 == 0, F.lit("")).otherwise(F.lit("_nir"))).alias("base"), base.alias("path"))
    out = P.source_polygons(wanted, polys).join(rows.select("file_id", base.alias("own")), "file_id")
    return out.select("file_id", F.when(F.col("path") != F.col("own"), "wrong").when(F.col("file_id") % 2 == 0, "exact").otherwise("canonical").alias("found"))


@query("fan_out_to_root", "SELECT p_partkey AS source, count(*) AS n, string_agg(dest, ',' ORDER BY ordinal) AS dests FROM (SELECT p.p_partkey, 'B' || q.p_partkey AS dest, q.p_partkey AS ordinal FROM part p JOIN part q ON q.p_partkey // 4 = p.p_partkey // 4) GROUP BY 1")
def fan_out_to_root(spark, sf_dir):
    part = V.table(spark, sf_dir, "part")
    mapping = part.select(F.expr("p_partkey div 4").alias("root_id"), F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("base"), F.col("p_partkey").alias("ordinal"))
    winners = part.select(F.col("p_partkey").alias("source"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("base"))
    rows = P.fan_out(winners, mapping).groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", "dest"))).alias("d"))
    return rows.select("source", "n", F.array_join(F.transform("d", lambda s: s["dest"]), ",").alias("dests"))


@query("match_provenance", "SELECT s_suppkey, 'src' AS source_project, CAST(s_acctbal AS DOUBLE) AS distance, s_nationkey * 1.0 AS latitude FROM supplier")
def match_provenance(spark, sf_dir):
    rows = V.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("closest_image"), F.col("s_acctbal").alias("distance_meters"), F.col("s_nationkey").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"))
    m = P.provenance(rows, F.lit("src"), F.lit("dst"))
    return m.select("s_suppkey", "import_metadata.source_project", F.col("import_metadata.distance_meters").alias("distance"), "import_metadata.target_coordinates.latitude")


@query("resolved_image_names", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'I' || p_partkey || '.tif' WHEN 1 THEN 'I' || p_partkey || '_IR.tif' END AS filename FROM part")
def resolved_image_names(spark, sf_dir):
    part, k = V.table(spark, sf_dir, "part"), F.col("p_partkey")
    files = part.filter(k % 3 < 2).select(F.concat(F.lit("I"), k.cast("string"), F.when(k % 3 == 0, ".tif").otherwise("_IR.tif")).alias("filename"))
    names = part.select("p_partkey", F.concat(F.lit("i"), k.cast("string"), F.when(k % 3 == 1, "_radiance").otherwise("")).alias("name"))
    return P.resolved_images(names, files).select("p_partkey", "filename")


@query("dms_to_degrees", "SELECT c_custkey, ((c_custkey % 90 + c_custkey % 60 / 60.0 + c_custkey % 50 / 3600.0) * CASE WHEN c_custkey % 4 < 2 THEN -1 ELSE 1 END) AS degrees FROM customer")
def dms_to_degrees(spark, sf_dir):
    k = F.col("c_custkey")
    ref = F.element_at(F.array(*map(F.lit, "SwNE")), (k % 4 + 1).cast("int"))
    return V.table(spark, sf_dir, "customer").select("c_custkey", P.from_dms(k % 90, k % 60, k % 50, ref).alias("degrees"))


_SUP = "SELECT s_suppkey, 'g' || (s_suppkey % 5) AS grp, s_suppkey // 10 AS image_id, s_name AS name, CASE WHEN s_suppkey % 8 < 5 THEN 'r1' ELSE 'r2' END AS root FROM supplier"


def _rooted(spark, sf_dir):
    rows = V.polygons(spark, sf_dir)
    return rows.select("grp", "image_id", "name", F.when(F.col("poly_id") % 8 < 5, "r1").otherwise("r2").alias("root"))


def _offsets(spark, sf_dir):
    return V.polygons(spark, sf_dir).select("image_id").distinct().filter("image_id % 3 = 0").select("image_id", (F.col("image_id") + 100).alias("target_image"))


@query("copied_polygons", f"SELECT grp, image_id, name, root FROM ({_SUP}) UNION ALL SELECT grp, image_id + 100, name, 'r9' FROM ({_SUP}) WHERE grp IN ('g1', 'g2') AND root = 'r1' AND image_id % 3 = 0")
def copied_polygons(spark, sf_dir):
    return P.copied(_rooted(spark, sf_dir), ["g1", "g2"], "r9", _offsets(spark, sf_dir))


@query("moved_polygons", f"SELECT grp, image_id, name, root FROM ({_SUP}) WHERE NOT (grp IN ('g1', 'g2') AND image_id % 3 = 0) UNION ALL SELECT grp, image_id + 100, name, 'r9' FROM ({_SUP}) WHERE grp IN ('g1', 'g2') AND root = 'r1' AND image_id % 3 = 0")
def moved_polygons(spark, sf_dir):
    return P.moved(_rooted(spark, sf_dir), ["g1", "g2"], "r9", _offsets(spark, sf_dir))
