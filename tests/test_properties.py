"""Goldens worked out by hand, properties, and what plans must not hold."""

import pytest
from pyspark.sql import functions as F

from verdure.functions import bands
from verdure.operators import catalog, geometry, radiometry, shapes, similarity, spatial, zonal
from verdure.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def raster(spark, values):
    rows = [(1, y, x, float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, b1 double")


def grid(df, col="b1"):
    out = {}
    for r in df.collect():
        out[r["y"], r["x"]] = r[col]
    h, w = max(y for y, _ in out) + 1, max(x for _, x in out) + 1
    return [[out.get((y, x)) for x in range(w)] for y in range(h)]


def test_turning_by_hand_and_four_turns(spark):
    px = raster(spark, [[1, 2, 3], [4, 5, 6]])
    assert grid(geometry.rotate(px, F.lit(2), F.lit(3), F.lit(90))) == [[4, 1], [5, 2], [6, 3]]
    assert grid(geometry.rotate(px, F.lit(2), F.lit(3), F.lit(180))) == [[6, 5, 4], [3, 2, 1]]
    assert grid(geometry.rotate(px, F.lit(2), F.lit(3), F.lit(270))) == [[3, 6], [2, 5], [1, 4]]
    turned, h, w = px, 2, 3
    for _ in range(4):
        turned, h, w = geometry.rotate(turned, F.lit(h), F.lit(w), F.lit(90)), w, h
    assert grid(turned) == grid(px)


def test_area_means_keep_the_mean(spark):
    px = raster(spark, [[1, 3, 5, 7], [1, 3, 5, 7], [2, 2, 4, 4], [2, 2, 4, 4]]).withColumns({"h": F.lit(4), "w": F.lit(4)})
    assert grid(geometry.shrink(px, F.lit(2), F.lit(2))) == [[2, 6], [2, 4]]
    assert grid(geometry.shrink(px, F.lit(1), F.lit(1))) == [[3.5]]


def test_enlarging_a_flat_raster_keeps_it_flat(spark):
    px = raster(spark, [[7, 7], [7, 7]])
    sizes = spark.createDataFrame([(1, 2, 2, 5, 5)], "image_id long, h int, w int, new_h int, new_w int")
    for cubic in (False, True):
        assert all(abs(v - 7) < 1e-9 for line in grid(geometry.enlarge(px, sizes, cubic)) for v in line)


@pytest.mark.parametrize("points,want", [
    ([(0, 0), (3, 0), (3, 2), (0, 2)], {(y, x) for y in range(3) for x in range(4)}),
    ([(2, 0), (4, 2), (2, 4), (0, 2)], {(y, x) for y in range(5) for x in range(5) if abs(x - 2) + abs(y - 2) <= 2}),
    ([(1, 1)], {(1, 1)}),
    ([(1, 1), (3, 3)], set()),
    ([(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)], {(y, x) for y in range(5) for x in range(5) if y <= 2 or abs(x - 2) >= y - 2}),
])
def test_filled_polygons(spark, points, want):
    polys = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in points])], f"poly_id int, points {shapes.POINTS}")
    got = {(r["y"], x) for r in shapes.spans(polys).collect() for x in range(r["x0"], r["x1"] + 1)}
    assert got == want


def test_spans_of_a_partition_count_every_pixel(spark):
    rows = [(i, 1, "g", [(float(8 * (i % 4)), float(8 * (i // 4))), (float(8 * (i % 4) + 7), float(8 * (i // 4))), (float(8 * (i % 4) + 7), float(8 * (i // 4) + 7)), (float(8 * (i % 4)), float(8 * (i // 4) + 7))]) for i in range(16)]
    polys = spark.createDataFrame(rows, f"poly_id int, image_id long, grp string, points {shapes.POINTS}")
    px = raster(spark, [[0] * 32] * 32)
    assert zonal.pixels_in(px, polys).count() == 32 * 32


@pytest.mark.parametrize("text,parts", [
    ("[[0,0],[1,0],[1,1]]", [3]), ('[{"x":0,"y":0},{"x":1,"y":0}]', [1, 1]), ("[[[0,0],[1,0],[1,1]],[[5,5],[6,6],[7,7]]]", [3, 3]), ('{"x":1,"y":2}', [1]), ("[]", None), ("junk", None), ('[{"x":1}]', None), ('[[1],[2]]', None),
])
def test_points_of_every_shape(spark, text, parts):
    got = spark.createDataFrame([(text,)], "t string").select(shapes.normalised(F.col("t")).alias("p")).first()["p"]
    assert (None if got is None else [len(p) for p in got]) == parts


def test_matching_an_image_to_itself_moves_little(spark):
    px = raster(spark, [[(x * 7 + y * 13) % 97 for x in range(24)] for y in range(24)])
    ref = radiometry.reference_cdf(px, "b1")
    out = radiometry.match_cdf(px, "b1", ref).withColumnRenamed("b1", "new").join(px, ["image_id", "y", "x"])
    assert out.agg(F.max(F.abs(F.col("new") - F.col("b1")))).first()[0] < 2.0


def test_a_reference_is_most_like_itself(spark):
    rows = [(i, [float((i * k) % 7) for k in range(14)], [1 / 32.0] * 32) for i in range(5)]
    df = spark.createDataFrame(rows, "image_id long, v array<double>, hist array<double>").select("image_id", "hist", *[F.col("v")[i].alias(n) for i, n in enumerate(similarity.WEIGHTS)])
    got = {r["image_id"]: r["score"] for r in similarity.scores(df, df.filter("image_id = 2")).collect()}
    assert abs(got[2] - 1) < 1e-9 and max(v for k, v in got.items() if k != 2) < 1


def test_distances(spark):
    pairs = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (50.06632, -5.71475, 58.64402, -3.07009), (10.0, 20.0, 10.0, 20.0)], "lat1 double, lon1 double, lat2 double, lon2 double")
    got = [r["metres"] for r in spatial.geodesic_metres(pairs).collect()]
    assert abs(got[0] - 111319.491) < 0.01 and abs(got[1] - 969954.166) < 2 and got[2] == 0


def test_names(spark):
    rows = [("IMG_0113_8_radiance.tif", "IMG_0113"), ("20221212_103001_750_IR.tif", "20221212_103001_750"), ("single.tif", "single"), ("a_b.tif", "a_b")]
    got = {r["n"]: r["r"] for r in spark.createDataFrame([(n,) for n, _ in rows], "n string").select("n", catalog.root_key(F.col("n")).alias("r")).collect()}
    assert got == dict(rows)
    bases = {"IMG_1_radiance_NIR": "img_1", "rgb": "rgb", "A_ir_b": "a_ir_b", "": ""}
    got = {r["n"]: r["b"] for r in spark.createDataFrame([(n,) for n in bases], "n string").select("n", catalog.canonical_base(F.col("n")).alias("b")).collect()}
    assert got == bases


def test_zero_fill_and_preserve(spark):
    px = spark.createDataFrame([(1, 0, 0, None, 2.0), (1, 0, 1, float("nan"), 0.0), (1, 1, 0, float("inf"), 4.0), (1, 1, 1, 6.0, 3.0)], "image_id long, y long, x long, b1 double, b2 double")
    zero = [r["v"] for r in bands.evaluate(px, {"v": "b1/b2"}).orderBy("y", "x").collect()]
    kept = [r["v"] for r in bands.evaluate(px, {"v": "b1/b2"}, "preserve").orderBy("y", "x").collect()]
    assert zero == [0, 0, 0, 2] and kept == [None, None, None, 2]


PURE = ["band_expression_functions", "nodata_mask", "zonal_mean_gcc", "polygon_statistics", "area_resample", "bilinear_resample", "cdf_match", "percentile_stretch", "texture_features", "similarity_scores", "edited_rasters"]


@pytest.mark.parametrize("name", PURE)
def test_plans_stay_in_the_engine(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan


def test_expressions_need_no_shuffle_and_read_few_columns(spark):
    plan = QUERIES["vegetation_indices"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = QUERIES["statistics_sample"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_polygon_join_uses_equal_keys(spark):
    plan = QUERIES["polygon_pixels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "NestedLoop" not in plan
