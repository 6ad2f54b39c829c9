"""Recipe documents: typed reading, sizes, resampling by strips with NoData, registration and formulas by image."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import geometry, recipes, strips


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "image_id long, body string")


def read(spark, *texts):
    return [r["recipe"] for r in recipes.typed(bodies(spark, *texts)).orderBy("image_id").collect()]


def test_documents_that_are_none(spark):
    assert read(spark, None, "", "no json", "[1, 2]", "7", '"x"', '{"rotate": 90') == [None] * 7


def test_flags_switch_parts_off_and_default_to_on(spark):
    full = {"rotate": -90, "crop_rect": {"x": 1.9, "y": 2, "width": 3, "height": 4}, "resize": {"scale": 50}, "band_expression": " b1 ", "nodata_values": [-9999, "b2 <= 3", "junk", 0.5], "hist_match": {"ref_stats": [{"mean": 1}]}}
    on, off = read(spark, json.dumps(full), json.dumps(full | {f"{k}_enabled": False for k in ("rotate", "crop", "hist", "resize", "band", "nodata")}))
    assert on["rotate"] == 270 and on["crop"]["crop_x"] == 1 and on["crop"]["ref_w"] is None and on["resize"]["scale"] == 50 and on["formula"] == "b1"
    assert [(n["value"], n["band"], n["op"], n["limit"]) for n in on["nodata"]] == [(-9999.0, None, None, None), (None, 2, "<=", 3.0), (0.5, None, None, None)]
    assert on["hist"]["mode"] == "meanstd" and on["hist"]["stats"][0]["mean"] == 1
    assert off["rotate"] == 0 and all(off[k] is None for k in ("crop", "hist", "resize", "formula", "nodata"))
    (odd,) = read(spark, '{"rotate": 45, "crop_rect": null, "resize": 3, "hist_match": {"mode": "None"}, "registration": {"enabled": true, "matrix": [[1,0,0,5],[0,1,0,6],[0,0,1,0],[0,0,0,1]]}}')
    assert odd["rotate"] == 0 and odd["crop"] is None and odd["hist"] is None and odd["matrix"] == [1, 0, 5, 0, 1, 6, 0, 0, 1]


def replay(spark, images, pictures, **more):
    """images: {id: recipe}; pictures: {id: 2-d array of one band}. Returns {id: array} of b1, and of the derived band."""
    rows = [(i, y, x, None if v is None or np.isnan(v) else float(v)) for i, p in pictures.items() for y, line in enumerate(p) for x, v in enumerate(line)]
    px = spark.createDataFrame(rows, "image_id long, y long, x long, b1 double")
    sizes = spark.createDataFrame([(i, *pictures[i].shape, json.dumps(r) if isinstance(r, dict) else r) for i, r in images.items()], "image_id long, h int, w int, body string")
    out = {}
    for r in recipes.replayed(px, recipes.typed(sizes), **more).collect():
        out.setdefault(r["image_id"], {})[r["y"], r["x"]] = (r["b1"], r["b2"])
    return out


def grid(values, k=0):
    h, w = max(y for y, _ in values) + 1, max(x for _, x in values) + 1
    assert len(values) == h * w
    return np.array([[np.nan if values[y, x][k] is None else values[y, x][k] for x in range(w)] for y in range(h)])


def test_sizes_orders_and_missing_recipes(spark):
    rng = np.random.default_rng(1)
    a, b, c = rng.random((5, 8)), rng.random((3, 4)), rng.random((6, 6))
    images = {
        1: {"rotate": 90, "crop_rect": {"x": 1, "y": 2, "width": 3, "height": 2}, "crop_rect_ref_size": {"w": 8, "h": 5}},
        2: {"rotate": 90, "crop_rect": {"x": 1, "y": 0, "width": 2, "height": 3}},
        3: None,
    }
    got = replay(spark, images, {1: a, 2: b, 3: c, 4: c})
    assert sorted(got) == [1, 2, 3]
    assert np.allclose(grid(got[1]), np.rot90(a[2:4, 1:4], -1)) and np.allclose(grid(got[2]), np.rot90(b, -1)[0:3, 1:3]) and np.allclose(grid(got[3]), c)
    assert np.isnan(grid(got[3], 1)).all()


def weights(n, m, kind):
    out = np.zeros((m, n))
    for t in range(m):
        at = (t + 0.5) * n / m - 0.5
        for p in range(-4, n + 4):
            d = abs(at - p)
            if kind == "linear":
                w = max(0.0, 1 - d)
            elif kind == "cubic":
                w = 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3 if d < 2 else 0.0
            else:
                w = max(0.0, min(p + 1, (t + 1) * n / m) - max(p, t * n / m)) / (n / m)
            out[t, min(max(p, 0), n - 1)] += w
    return out


@pytest.mark.parametrize("resize, kind", [({"scale": 40}, "area"), ({"px_w": 11, "px_h": 8}, "linear"), ({"width": 310, "height": 230}, "cubic"), ({"px_h": 3}, "area"), ({"width": 130, "height": 50}, "area")])
def test_resampling_with_a_hole_equals_weights(spark, resize, kind):
    rng = np.random.default_rng(2)
    a = rng.random((7, 9))
    a[3, 4] = -9999
    got = grid(replay(spark, {1: {"resize": resize, "nodata_values": [-9999]}}, {1: a})[1])
    wy, wx = weights(7, got.shape[0], kind), weights(9, got.shape[1], kind)
    hole = np.abs(wy[:, 3])[:, None] * np.abs(wx[:, 4])[None] > 1e-12
    want = np.where(hole, -9999, wy @ a @ wx.T)
    assert hole.any() and not hole.all() and np.allclose(got, want)


def test_growing_rasters_keep_holes_apart(spark):
    """Of tens with one hole, no value between them may come."""
    a = np.full((4, 4), 10.0)
    a[1, 2] = -9999
    rows = [(1, y, x, float(a[y, x]), 4, 4) for y in range(4) for x in range(4)]
    px = spark.createDataFrame(rows, "image_id long, y long, x long, b1 double, h int, w int")
    for side in (3, 6, 9):
        out = geometry.resize(px, F.lit(side), F.lit(side), F.col("b1") == -9999, -9999.0).collect()
        values = [r["b1"] for r in out]
        assert len(values) == side * side and -9999.0 in values and all(v == -9999 or abs(v - 10) < 1e-9 for v in values)
    assert {round(v[0], 6) for v in replay(spark, {1: {"resize": {"scale": 150}, "nodata_values": [-9999]}}, {1: a})[1].values()} == {10.0, -9999.0}


def test_registration_restores_what_a_hole_touches(spark):
    a = np.arange(36, dtype=float).reshape(6, 6) + 100
    a[2, 2] = -1
    half = {"enabled": True, "matrix": [[1, 0, 0.5], [0, 1, 0], [0, 0, 1]]}
    got = replay(spark, {1: {"registration": half, "nodata_values": [-1]}, 2: {"registration": half | {"enabled": False}}}, {1: a, 2: a})
    one = grid(got[1])
    assert (np.argwhere(one == -1) == [[2, 1], [2, 2]]).all()
    assert abs(one[0, 0] - 100.5) < 1e-9 and abs(one[0, 5] - 52.5) < 1e-9  # half of the last pixel, zero beyond
    assert np.allclose(grid(got[2]), a)


def test_each_image_has_its_own_reference_and_formula(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((6, 6)) * 10, rng.random((4, 9)) * 10
    mean = {"hist_match": {"mode": "meanstd", "ref_stats": [{"mean": 50, "std": 4}]}, "band_expression": "b1 * 2"}
    cdf = {"hist_match": {"mode": "cdf", "ref_cdf": {"per_band": [{"x": [0, 1], "y": [0, 1], "lo": 0, "hi": 10}]}}, "band_expression": "b1 - mean(b1)"}
    got = replay(spark, {1: mean, 2: cdf, 3: mean | {"band_expression": "no such name"}, 4: mean | {"resize": {"scale": 50}}}, {1: a, 2: b, 3: a, 4: a})
    assert np.allclose(grid(got[1]), (a - a.mean()) * 4 / a.std() + 50) and np.allclose(grid(got[1], 1), 2 * grid(got[1]))
    bins = np.clip(b / 10 * 2047, 0, 2047).astype(int)
    share = np.cumsum(np.bincount(bins.ravel(), minlength=2048)) / b.size
    assert np.allclose(grid(got[2]), share[bins] * 10) and np.allclose(grid(got[2], 1), grid(got[2]) - grid(got[2]).mean())
    assert np.isnan(grid(got[3], 1)).all()
    small = weights(6, 3, "area") @ a @ weights(6, 3, "area").T  # an image that shrinks is matched after it has
    assert np.allclose(grid(got[4]), (small - small.mean()) * 4 / small.std() + 50)


def test_missing_values_stay_missing(spark):
    a = np.full((4, 4), 3.0)
    a[0, 0] = np.nan
    got = grid(replay(spark, {1: {"resize": {"scale": 150}}}, {1: a})[1])
    assert np.isnan(got[0, 0]) and not np.isnan(got[5, 5]) and np.nanmax(got) == 3.0


def test_too_many_formulas_are_refused(spark, monkeypatch):
    monkeypatch.setattr(recipes, "MOST_FORMULAS", 1)
    with pytest.raises(ValueError, match="formulas"):
        replay(spark, {1: {"band_expression": "b1"}, 2: {"band_expression": "b1+1"}}, {1: np.ones((2, 2)), 2: np.ones((2, 2))})


def test_empty_tables(spark):
    px = spark.createDataFrame([], "image_id long, y long, x long, b1 double")
    sizes = spark.createDataFrame([], "image_id long, h int, w int, body string")
    assert recipes.replayed(px, recipes.typed(sizes)).collect() == []


def test_only_one_exchange_of_lines(spark):
    """Growing or shrinking moves each strip once; strips of unchanged images do not move."""
    rows = spark.createDataFrame([], "image_id long, y long, b1 array<double>, mask array<double>, h int, w int, new_h int, new_w int, kind string, restore double")
    plan = strips.resized(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
