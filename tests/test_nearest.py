"""The nearest image by a tree of cells, against all pairs."""

import random
from math import hypot

from verdure.operators import spatial

TARGET, IMAGE = "target_index long, latitude double, longitude double", "filename string, latitude double, longitude double"


def found(spark, targets, images):
    rows = spatial.nearest(spark.createDataFrame(targets, TARGET), spark.createDataFrame(images, IMAGE)).collect()
    assert len({r["target_index"] for r in rows}) == len(rows)
    return {r["target_index"]: (r["degrees"], r["filename"]) for r in rows}


def wanted(targets, images):
    places = [(f, y, x) for f, y, x in images if y is not None and x is not None]
    return {i: min((hypot(lat - y, lon - x), f) for f, y, x in places) for i, lat, lon in targets if lat is not None and lon is not None}


def agree(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[i][0] - want[i][0]) < 1e-9 and got[i][1] == want[i][1] for i in want)


def test_dense_spot_beside_a_sparse_world(spark):
    r = random.Random(3)
    images = [(f"c{i:05}", 10 + r.gauss(0, 1e-4), 20 + r.gauss(0, 1e-4)) for i in range(1500)]
    images += [(f"s{i:05}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(200)] + [("none", None, 3.0)]
    targets = [(i, 10 + r.gauss(0, 2e-4), 20 + r.gauss(0, 2e-4)) for i in range(150)]  # in the spot
    targets += [(1000 + i, 10 + r.uniform(-3, 3), 20 + r.uniform(-3, 3)) for i in range(100)]  # around it
    targets += [(2000 + i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(100)] + [(3000, None, 1.0)]
    agree(found(spark, targets, images), wanted(targets, images))


def test_grid_with_ties_and_repeated_places(spark):
    images = [(f"g{y}_{x}_{k}", float(y), float(x)) for y in range(-9, 9) for x in range(-9, 9) for k in range(2)]
    targets = [(i, y / 2, x / 2) for i, (y, x) in enumerate((y, x) for y in range(-8, 8) for x in range(-8, 8))]
    agree(found(spark, targets, images), wanted(targets, images))


def test_few_and_none(spark):
    assert found(spark, [(1, 0.0, 0.0)], [("none", None, None)]) == {}
    assert found(spark, [], [("a", 1.0, 1.0)]) == {}
    assert found(spark, [(1, 0.0, 0.0), (2, 5.0, float("nan"))], [("a", 3.0, 4.0)]) == {1: (5.0, "a")}


def test_a_target_looks_into_few_cells(spark):
    """What is gathered for a target does not follow from how many places the spot has."""
    r = random.Random(4)
    spot = spark.createDataFrame([(f"c{i:05}", 10 + r.random() * 1e-3, 20 + r.random() * 1e-3) for i in range(20000)], "filename string, ilat double, ilon double")
    levels = spatial._levels(spot)
    assert len(levels) > 3
    sizes = [len(c["places"]) for level in levels for row in level.collect() for c in row["children"] if c["places"] is not None]
    assert sum(sizes) == 20000 and max(sizes) <= spatial.LEAF
    assert max(len(row["children"]) for level in levels for row in level.collect()) <= 64
