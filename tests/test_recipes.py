"""Recipe replay on images beyond the first 64, against brute force."""

import datetime

import pytest

from verdure.plans.registry import QUERIES

IDS = (0, 63, 64, 65, 66, 67, 71)


def value(i, y, x):
    return float((i * 7 + y * 37 + x * 101) % 251) + 0.25


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("recipes")
    spark.createDataFrame([(k, f"s{k}") for k in (*IDS, 99)], "s_suppkey long, s_name string").write.parquet(f"{at}/supplier.parquet")
    now = datetime.datetime(2024, 1, 1)
    rows = [(i * 1024 + y * 32 + x, now, y, "a", value(i, y, x), '{"k": 3}') for i in IDS for y in range(32) for x in range(32)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    return str(at)


def cropped(i):
    cx, cy, w, h = i % 5, i % 3, i % 7 + 9, i % 11 + 8
    return [[value(i, cy + y, cx + x) for x in range(w)] for y in range(h)]


def replayed(i):
    rows = cropped(i)
    for _ in range(i % 4):
        rows = [list(r) for r in zip(*rows[::-1])]
    return rows


def flat(pictures):
    return {(i, y, x): v for i, rows in pictures.items() for y, row in enumerate(rows) for x, v in enumerate(row)}


def test_every_image_is_cropped_and_replayed(spark, folder):
    for name, want in (("cropped_rasters", cropped), ("replayed_recipes", replayed)):
        got = {(r["image_id"], r["y"], r["x"]): r["b1"] for r in QUERIES[name](spark, folder).collect()}
        assert got == flat({i: want(i) for i in IDS})


def test_every_image_is_edited(spark, folder):
    geometry = {(r["image_id"], r["y"], r["x"]): r["b1"] for r in QUERIES["edited_geometry"](spark, folder).collect()}
    whole = flat({i: replayed(i) for i in IDS if i % 2})  # odd images keep their size, even ones are halved
    assert {k: v for k, v in geometry.items() if k[0] % 2} == whole
    size = lambda n: max(1, round(n / 2))
    halved = {(i, y, x) for i in IDS if i % 2 == 0 for y in range(size(len(replayed(i)))) for x in range(size(len(replayed(i)[0])))}
    assert {k for k in geometry if k[0] % 2 == 0} == halved
    assert {(r["image_id"], r["y"], r["x"]) for r in QUERIES["edited_rasters"](spark, folder).collect()} == set(geometry)


def test_whole_replay_with_registration_nodata_and_classes(spark):
    from pyspark.sql import functions as F

    from verdure.operators import edits, geometry, learn

    px = spark.range(3 * 64).select((F.col("id") / 64).cast("long").alias("image_id"), (F.col("id") % 64 / 8).cast("long").alias("y"), (F.col("id") % 8).alias("x"), (F.col("id") % 64).cast("double").alias("b1"), F.col("id").cast("double").alias("b2"))
    shift = [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(0, 50.0, *[None] * 9), (1, 100.0, *shift), (2, 200.0, *[None] * 9)]
    recipes = spark.createDataFrame(rows, "image_id long, scale double, " + ", ".join(f"m{k} double" for k in range(9)))
    plain = {"rotate": F.lit(0), "crop_x": F.lit(0), "crop_y": F.lit(0), "crop_w": F.lit(8), "crop_h": F.lit(8), "ref_w": F.lit(8), "ref_h": F.lit(8)}
    recipes = recipes.withColumns(plain)
    out = edits.edited(px, recipes, 8, 8, expression="b1+b2", masked=F.col("b1") == 0, restore=-9999.0)
    got = {(r["image_id"], r["y"], r["x"]): r for r in out.collect()}
    assert len(got) == 16 + 64 + 256
    assert got[0, 0, 0]["b1"] == -9999.0 and got[0, 1, 1]["b1"] == (18 + 19 + 26 + 27) / 4
    assert got[1, 3, 2]["b1"] == 3 * 8 + 3 and got[1, 3, 7]["b1"] == 0  # one pixel to the right, zero outside
    sizes = spark.createDataFrame([(2, 8, 8, 16, 16)], "image_id long, h long, w long, new_h long, new_w long")
    want = {(r["y"], r["x"]): r["b1"] for r in geometry.enlarge(px.filter("image_id = 2"), sizes, True, F.col("b1") == 0, -9999.0).collect()}
    assert all(abs(got[2, y, x]["b1"] - v) < 1e-9 for (y, x), v in want.items()) and abs(got[2, 5, 5]["b3"] - got[2, 5, 5]["b1"] - got[2, 5, 5]["b2"]) < 1e-9
    model = learn.fit(px.withColumn("label", F.when(F.col("b1") < 32, "low").otherwise("high")), ["b1"], "forest", numTrees=5, maxDepth=3)
    classes = edits.edited(px, recipes, 8, 8, model=model, model_bands=["b1"]).filter("image_id = 1")
    assert {(r["b1"] < 32, r["b3"]) for r in classes.collect()} == {(True, 1.0), (False, 0.0)}
