import json
import struct

import pytest
from pyspark.sql import functions as F

from verdure.sources import files
from verdure.streaming import refresh


def bmp(path, pixels):
    """A 24-bit BMP of rows of (r, g, b)."""
    h, w = len(pixels), len(pixels[0])
    pad = -w * 3 % 4
    body = b"".join(b"".join(bytes((b, g, r)) for r, g, b in row) + b"\0" * pad for row in pixels[::-1])
    head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    path.write_bytes(head + body)


def test_images_become_pixel_rows(spark, tmp_path):
    bmp(tmp_path / "a.bmp", [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (10, 11, 12)], [(13, 14, 15), (16, 17, 18)]])
    rows = files.read_images(spark, str(tmp_path)).orderBy("y", "x").collect()
    assert [(r["y"], r["x"], r["b1"], r["b2"], r["b3"], r["b4"]) for r in rows][:3] == [(0, 0, 1, 2, 3, None), (0, 1, 4, 5, 6, None), (1, 0, 7, 8, 9, None)]
    assert len(rows) == 6 and rows[0]["image_id"] == "a.bmp"
    listed = files.list_images(spark, str(tmp_path)).collect()
    assert [r["filename"] for r in listed] == ["a.bmp"]
    files.write_pixels(files.read_images(spark, str(tmp_path)), str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).filter("y = 1").count() == 2


def test_polygon_files(spark, tmp_path):
    record = {"name": "t", "coord_space": "image", "image_ref_size": {"w": 10, "h": 20}, "points": [[0, 0], [4, 0], [4, 4]], "coordinates": {"latitude": 1.5, "longitude": 2.5}}
    (tmp_path / "leaf_IMG_1_polygons.json").write_text(json.dumps(record))
    (tmp_path / "leaf_IMG_2_polygons.json").write_text(json.dumps({**record, "points": [{"x": 1, "y": 2}]}))
    (tmp_path / "leaf_IMG_3_polygons.json").write_text(json.dumps({**record, "points": [[[0, 0], [1, 0], [1, 1]], [[5, 5], [6, 5], [6, 6]]]}))
    (tmp_path / "leaf_IMG_4_polygons.json").write_text("{broken")
    (tmp_path / "other.json").write_text(json.dumps(record))
    rows = files.read_polygons(spark, str(tmp_path)).orderBy("base", "part").collect()
    assert [(r["grp"], r["base"], r["part"], len(r["points"])) for r in rows] == [("leaf", "IMG_1", 0, 3), ("leaf", "IMG_2", 0, 1), ("leaf", "IMG_3", 0, 3), ("leaf", "IMG_3", 1, 3)]
    assert rows[0]["ref_h"] == 20 and rows[0]["latitude"] == 1.5


def test_projects_need_their_keys(spark, tmp_path):
    whole = {"all_polygons": {"g": {"/x/a.tif": {"points": [[0, 0], [1, 1]], "name": "n"}}}, "current_root_index": 0, "root_offset": 1, "root_coordinates": {}}
    (tmp_path / "one.json").write_text(json.dumps(whole))
    (tmp_path / "two.json").write_text(json.dumps({k: v for k, v in whole.items() if k != "root_offset"}))
    rows = files.read_projects(spark, str(tmp_path)).collect()
    assert [(r["grp"], r["image_path"], len(r["parts"])) for r in rows] == [("g", "/x/a.tif", 2)]


def test_delimited_text_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b;c\n" + "\n".join(f"{i};x{i};{i * i}" for i in range(50)))
    assert files.read_table(spark, str(tmp_path / "t.csv")).columns == ["a", "b", "c"]
    assert files.read_table(spark, str(tmp_path / "t.csv"), sample=10).count() == 10
    rows = spark.createDataFrame([("s1", 1, "g"), ("s2", 2, "h")], "source string, n int, grp string")
    files.write_matches(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).filter("source = 's2'").first()["n"] == 2
    files.write_polygons(rows, str(tmp_path / "p"))
    assert {json.loads(r["value"])["n"] for r in spark.read.text(str(tmp_path / "p")).collect()} == {1, 2}
    files.write_table(rows, str(tmp_path / "c"), ";")
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "c")).count() == 2


def test_exif_joins_by_path(spark):
    docs = spark.createDataFrame([('[{"SourceFile":"/a","Make":"m","ISO":100},{"Make":"none"}]',), ("broken",)], "value string")
    rows = files.with_exif(spark.createDataFrame([("/a",), ("/b",)], "path string"), files.exif_rows(docs)).orderBy("path").collect()
    assert rows[0]["tags"] == {"Make": "m", "ISO": "100"} and rows[1]["tags"] is None


def test_stream_refresh_keeps_the_last_version(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    put = lambda n, rows: (landing / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    put(1, [{"filename": "a", "latitude": 1.0, "longitude": 1.0, "version": 1}, {"filename": "b", "latitude": 2.0, "longitude": 2.0, "version": 1}])
    follow = lambda: refresh.follow(spark, str(landing), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    follow()
    put(2, [{"filename": "a", "latitude": 9.0, "longitude": 9.0, "version": 2}, {"filename": "b", "latitude": 0.0, "longitude": 0.0, "version": 0}])
    follow()
    rows = {r["filename"]: r["latitude"] for r in refresh.current(spark, str(tmp_path / "t"), 1).collect()}
    assert rows == {"a": 9.0, "b": 2.0}


def test_a_batch_rewrites_only_the_buckets_of_its_names(spark, tmp_path):
    landing, table = tmp_path / "in", tmp_path / "t"
    landing.mkdir()
    put = lambda n, rows: (landing / f"{n}.json").write_text("\n".join(json.dumps({"latitude": 1.0, "longitude": 1.0, **r}) for r in rows))
    run = lambda: refresh.follow(spark, str(landing), str(table), str(tmp_path / "c"), buckets=8).awaitTermination()
    put(0, [{"filename": f"f{i}", "version": 1} for i in range(100)])
    run()
    for n in (1, 2, 3):
        put(n, [{"filename": "f7", "latitude": 10.0 + n, "version": 1 + n}])
        run()
    folders = lambda n: sorted(p.name for p in (table / f"batch={n}").glob("bucket=*"))
    assert len(folders(0)) == 7 and folders(1) == [] and len(folders(2)) == len(folders(3)) == 1
    rows = {r["filename"]: r["latitude"] for r in refresh.current(spark, str(table)).collect()}
    assert len(rows) == 100 and rows["f7"] == 13.0 and rows["f8"] == 1.0
    assert refresh.current(spark, str(tmp_path / "none")).collect() == []


def test_windows_of_any_size_on_small_and_gappy_rasters(spark):
    import numpy as np

    from verdure.operators import zonal

    a = np.arange(12, dtype=float).reshape(3, 4)
    rows = [(1, y, x, float(a[y, x])) for y in range(3) for x in range(4) if (y, x) != (1, 2)]
    px = spark.createDataFrame(rows, "image_id long, y long, x long, b1 double")
    a[1, 2] = np.nan
    centres = px.select("image_id", "y", "x")
    for border, mode in (("reflect", "reflect"), ("edge", "edge"), ("drop", None)):
        got = {(r["y"], r["x"]): [r[f"b1_w{i}"] for i in range(9)] for r in zonal.windows(px, centres, 3, ["b1"], border).collect()}
        padded = np.pad(a, 1, mode=mode) if mode else np.pad(a, 1, constant_values=np.nan)
        want = {(y, x): padded[y : y + 3, x : x + 3].ravel() for y in range(3) for x in range(4) if (y, x) != (1, 2)}
        want = {k: v for k, v in want.items() if border != "drop" or not np.isnan(v).any()}
        assert got.keys() == want.keys()
        assert all(np.array_equal(np.array(got[k], float), want[k], equal_nan=True) for k in want)
    plan = zonal.windows(px, centres, 5, ["b1"])._jdf.queryExecution().executedPlan().toString()
    strips = [line for line in plan.splitlines() if "Exchange" in line and "__to" in line]
    assert 1 <= len(strips) <= 3  # strips once, centres, and lines that have any


def test_holdout_cuts_by_counts(spark):
    import hashlib
    import math

    from verdure.operators import learn

    rows = [("a" if i % 5 else "b" if i % 2 else "c", i) for i in range(3000)] + [("single", 1)]
    out = learn.holdout(spark.createDataFrame(rows, "label string, k long"), 0.2, 7, "k").collect()
    for label in "abc":
        own = sorted(((hashlib.md5(f"7|{k}".encode()).hexdigest(), k) for x, k in rows if x == label))
        want = {k for _, k in own[: math.ceil(len(own) * 0.2)]}
        assert {r["k"] for r in out if r["label"] == label and r["held"]} == want
    assert not any(r["held"] for r in out if r["label"] == "single") and len(out) == len(rows)


def test_models_survive_saving(spark, tmp_path):
    from verdure.operators import learn

    rows = spark.range(60).select((F.col("id") % 2 * 10 + F.col("id") / 100).alias("b1"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("label"))
    model = learn.fit(rows, ["b1"], "forest", numTrees=3)
    learn.save(model, str(tmp_path / "m"), ["b1"], {"note": 1}, spark)
    again, names, meta = learn.load(str(tmp_path / "m"), spark)
    assert names == ["b1"] and meta == {"note": 1} and learn.labels_of(again) == ["x", "y"]
    assert learn.overall_metrics(learn.predict(again, rows)).first()["accuracy"] == 1.0


@pytest.mark.parametrize("text,ok", [("b1+b2", True), ("b1**2", False), ("__import__('os')", False), ("b9", False), ("(b1>1) AND (b2<3)", True), ("b1>1 & b2>2", False), ("mean(b1)+max(b1,b2)", True), ("lambda: 1", False)])
def test_expressions_are_held_to_their_grammar(spark, text, ok):
    from verdure.functions import bands

    if ok:
        bands.parse(text, ["b1", "b2"])
    else:
        with pytest.raises((ValueError, SyntaxError)):
            bands.parse(text, ["b1", "b2"])


def test_nodata_specs(spark):
    from verdure.functions import bands

    assert bands.parse_nodata("{-9999; b1 < 5, -9999.0, junk, B2>=1e3}") == [-9999.0, "b1<5", "b2>=1e3"]
    rows = spark.createDataFrame([(0, -9999.0, 1.0), (1, -9989.1, 1.0), (2, -9990.0, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, None, 1.0), (6, 7.0, 1.0)], "k int, b1 double, b2 double")
    got = {r["k"]: r["m"] for r in rows.select("k", bands.is_nodata([-9999.0], ["b1", "b2"]).alias("m")).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 6: False} or got == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True, 6: False}


def test_encodings_and_previews(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name;n\ncaf\u00e9;1\nna\u00efve;2\n".encode("latin-1"))
    rows, n = files.preview_table(spark, str(tmp_path / "l.csv"))
    assert n == 2 and {r["name"] for r in rows.collect()} == {"caf\u00e9", "na\u00efve"}
    (tmp_path / "b.csv").write_text("a,b\n" + "".join(f"{i:06d},{i % 7:06d}\n" for i in range(4000)))
    rows, n = files.preview_table(spark, str(tmp_path / "b.csv"), big=1000, rows=50)
    assert rows.count() == 50 and abs(n - 4001) < 100


def test_tags_are_not_sent_whole_to_every_task(spark):
    rows = spark.createDataFrame([(1, "/d/a"), (2, "/d/b"), (3, None)], "file_id long, path string")
    exif = files.exif_rows(spark.createDataFrame([('[{"SourceFile":"/d/a","Number":7},{"SourceFile":"/d/z","Number":8}]',)], "value string"))
    out = files.with_exif(rows, exif)
    assert sorted((r["file_id"], r["tags"] and r["tags"]["Number"]) for r in out.collect()) == [(1, "7"), (2, None), (3, None)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
