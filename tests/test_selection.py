"""Quantiles by counting, against Spark's own exact percentile, which holds a group's values."""

import random
from math import inf, isnan, nan

import pytest
from pyspark.sql import functions as F

from verdure.operators import radiometry, selection, zonal

FRACTIONS = [0.0, 0.0001, 0.05, 1 / 3, 0.5, 0.95, 0.9999, 1.0]
PIXELS = "image_id long, v double, w double"


def _groups():
    r = random.Random(5)
    groups = {
        1: [float(r.randrange(256)) for _ in range(3000)],  # many ties
        2: [r.gauss(0, 1) for _ in range(3000)],
        3: [10 ** r.uniform(-300, 300) * r.choice([-1, 1]) for _ in range(2000)],  # of all sizes
        4: [1000 + r.random() * 1e-9 for _ in range(2000)],  # all in one bin at first
        5: [7.0] * 2500,
        6: [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 300,
        7: [3.0],
        8: [],
    }
    return [(g, v, v if g % 2 else None) for g, vs in groups.items() for v in (vs or [None])] + [(1, None, 4.0), (None, 1.0, 1.0)]


@pytest.mark.parametrize("few", [10, 4096])
def test_quantiles_equal_exact_percentiles(spark, few):
    rows = spark.createDataFrame(_groups(), PIXELS)
    got = {(r["image_id"], r["column"], r["fraction"]): r["value"] for r in selection.quantiles(rows, ["image_id"], {"v": ["v"], "both": ["v", "w"]}, FRACTIONS, few).collect()}
    want = {}
    pooled = rows.select("image_id", "v").union(rows.select("image_id", "w"))
    for name, table in (("v", rows), ("both", pooled)):
        for r in table.filter("image_id is not null").groupBy("image_id").agg(F.percentile("v", F.array(*[F.lit(f) for f in FRACTIONS])).alias("q")).collect():
            want |= {(r["image_id"], name, f): q for f, q in zip(FRACTIONS, r["q"] or [])}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-320) for k in want)


def test_infinite_values_and_nan_have_their_places(spark):
    vs = [-inf] * 40 + [float(i) for i in range(100)] + [inf] * 40 + [nan] * 20
    rows = spark.createDataFrame([(1, v, v) for v in vs], PIXELS)
    at = {n: n / (len(vs) - 1) for n in (0, 39, 40, 90, 139, 140, 179, 180, 199)}
    got = {r["fraction"]: r["value"] for r in selection.quantiles(rows, [], {"v": ["v"]}, list(at.values()), 10).collect()}
    near = {n: got[f] for n, f in at.items()}
    assert near[0] == -inf and near[90] == pytest.approx(50) and isnan(near[199])


def test_no_rows(spark):
    none = spark.createDataFrame([], PIXELS)
    assert selection.quantiles(none, ["image_id"], {"v": ["v"]}, [0.5]).collect() == []
    assert zonal.scene_statistics(none, "v").collect() == []
    ends = radiometry.reference_cdf(none, "v", 4).collect()
    assert [(r["lo"], r["hi"], r["y"]) for r in ends] == [(0.0, 1.0, 0.0)] * 4


def test_scene_statistics_leave_out_what_is_not_finite(spark):
    rows = spark.createDataFrame([(1, v, 0.0) for v in (1.0, 2.0, 4.0, nan, inf, None)] + [(2, nan, 0.0)], PIXELS)
    got = {r["image_id"]: r.asDict() for r in zonal.scene_statistics(rows, "v", (0.25, 75)).collect()}
    assert (got[1]["v_mean"], got[1]["v_median"], got[1]["v_q25"], got[1]["v_q75"]) == (pytest.approx(7 / 3), 2.0, 1.5, 3.0)
    assert got[2]["v_mean"] is None and got[2]["v_median"] is None


def test_no_plan_holds_an_image_whole(spark):
    rows = spark.createDataFrame([(1, float(i % 997) + i / 1e6, 0.0) for i in range(20000)], "image_id long, b1 double, b2 double")
    for made in (radiometry.stretch(rows, ["b1"], 1, 99), radiometry.stretch(rows, ["b1", "b2"], pooled=True), radiometry.reference_cdf(rows, "b1"), zonal.scene_statistics(rows, "b1")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile" not in plan and "median(" not in plan
