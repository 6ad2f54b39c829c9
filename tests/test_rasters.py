"""Bitmaps written and read through the data source, against Spark's own image reader."""

from verdure.sources import files, rasters


def test_written_images_read_back_as_they_were(spark, tmp_path):
    rows = [(i, y, x, (i * 7 + y * 3 + x) % 256, (y * 11) % 256, (x * 13) % 256) for i, (h, w) in enumerate([(1, 1), (5, 7), (8, 3), (2, 300)]) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id long, y long, x long, b1 int, b2 int, b3 int")
    folder = str(tmp_path / "a")
    rasters.write_bitmaps(px, folder)
    want = sorted((str(i), *r) for i, *r in rows)
    assert sorted(map(tuple, rasters.read_bitmaps(spark, folder).collect())) == want
    assert sorted(map(tuple, rasters.read_bitmaps(spark, "file://" + folder).collect())) == want
    other = files.read_images(spark, folder).select("image_id", "y", "x", "b1", "b2", "b3").collect()
    assert sorted((r[0].removesuffix(".bmp"), r[1], r[2], int(r[3]), int(r[4]), int(r[5])) for r in other) == want
    assert [p.name for p in (tmp_path / "a").glob(".*")] == []


def test_values_are_held_to_bytes_and_gaps_are_black(spark, tmp_path):
    px = spark.createDataFrame([("k", 1, 1, 300.0, -5.0, 2.5), ("k", 0, 0, None, 7.0, 3.5)], "image_id string, y long, x long, b1 double, b2 double, b3 double")
    rasters.write_bitmaps(px, str(tmp_path / "b"))
    got = {(r["y"], r["x"]): (r["b1"], r["b2"], r["b3"]) for r in rasters.read_bitmaps(spark, str(tmp_path / "b")).collect()}
    assert got == {(0, 0): (0, 7, 4), (0, 1): (0, 0, 0), (1, 0): (0, 0, 0), (1, 1): (255, 0, 2)}


def test_empty_tables_and_foreign_files(spark, tmp_path):
    rasters.write_bitmaps(spark.createDataFrame([], "image_id long, y long, x long, b1 int, b2 int, b3 int"), str(tmp_path / "c"))
    (tmp_path / "c").mkdir(exist_ok=True)
    assert rasters.read_bitmaps(spark, str(tmp_path / "c")).collect() == []
    (tmp_path / "c" / "note.txt").write_text("no image")
    assert rasters.read_bitmaps(spark, str(tmp_path / "c")).count() == 0


def test_images_of_one_place_are_one_place(spark):
    from verdure.operators import spatial

    images = [(f"c{i:05}", 10.0 + i % 3, 20.0) for i in range(6000)] + [(f"s{i}", -40.0 + i, -100.0) for i in range(10)] + [("none", None, 1.0)]
    targets = [(0, 10.1, 20.1), (1, 12.4, 20.0), (2, -33.2, -99.0), (3, None, 5.0)]
    got = spatial.nearest(spark.createDataFrame(targets, "target_index long, latitude double, longitude double"), spark.createDataFrame(images, "filename string, latitude double, longitude double"))
    assert {r["target_index"]: r["filename"] for r in got.collect()} == {0: "c00000", 1: "c00002", 2: "s7"}
