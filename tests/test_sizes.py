"""Queries on tables with keys, counts and values that the smallest tables do not have."""

import duckdb
from pyspark.sql import functions as F

from verdure.plans.registry import ORACLE_SQL, QUERIES


def test_images_of_different_folders_may_share_a_name(spark, tmp_path):
    keys = [*range(0, 130, 7), *range(9990, 10025), *range(123400, 123410), 1234001]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, QUERIES["gps_json"](spark, str(tmp_path)).select("filename", "latitude", "longitude").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = sorted(con.execute(ORACLE_SQL["gps_json"]).fetchall())
    assert len(got) == len(keys) > len({r[0] for r in got})
    assert [r[0] for r in got] == [r[0] for r in want] and all(abs(a - b) < 1e-9 for r, w in zip(got, want) for a, b in zip(r[1:], map(float, w[1:])))


def test_holdout_sends_no_rows_by_label(spark, monkeypatch):
    from verdure.operators import learn

    plans, real = [], learn.written

    def spied(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(learn, "written", spied)
    rows = spark.range(2_000_000).select((F.col("id") % 3).cast("string").alias("label"), F.col("id").alias("k"))
    out = learn.holdout(rows, 0.2, 7, "k")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("BroadcastHashJoin" in p for p in plans) == 4 and not any("SortMergeJoin" in p for p in plans)
    assert {r["label"]: r["n"] for r in out.filter("held").groupBy("label").agg(F.count("*").alias("n")).collect()} == {"0": 133334, "1": 133334, "2": 133334}


def test_targets_of_one_place_are_asked_once(spark, monkeypatch):
    from verdure.operators import spatial

    states, real = [], spatial.written

    def spied(df):
        out = real(df)
        if "cells" in df.columns:
            states.append(out.count())
        return out

    monkeypatch.setattr(spatial, "written", spied)
    images = [(f"i{k:03d}", k * 37 % 100 / 4, k * 53 % 90 / 3) for k in range(200)]
    targets = [(k, k % 5 * 7.25, k % 5 * -3.5) for k in range(3000)]
    got = spatial.nearest(spark.createDataFrame(targets, "target_index long, latitude double, longitude double"), spark.createDataFrame(images, "filename string, latitude double, longitude double"))
    best = {t[1:]: min((((t[1] - a) ** 2 + (t[2] - b) ** 2), n)[::1] for n, a, b in images) for t in targets[:5]}
    assert {r["target_index"]: r["filename"] for r in got.collect()} == {t[0]: best[t[1:]][1] for t in targets}
    assert states and max(states) <= 5


def test_stacking_and_replay_read_what_was_written_once(spark, monkeypatch, tmp_path):
    from verdure.operators import edits, learn

    counts, real = {"learn": [], "edits": []}, learn.written

    def spied(name):
        def keep(df):
            counts[name].append(df.columns)
            return real(df)

        return keep

    monkeypatch.setattr(learn, "written", spied("learn"))
    rows = spark.range(80).select("id", (F.col("id") % 2 * 10 + F.col("id") / 100).alias("b1"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("label"))
    base, top, meta = learn.stack(rows, ["b1"], ["bayes"], ["id"], folds=2)
    assert learn.overall_metrics(learn.stacked_predictions(base, top, rows)).first()["accuracy"] == 1.0
    assert [*rows.columns, "__fold"] in counts["learn"] and ["label", *meta] in counts["learn"]
    monkeypatch.setattr(edits, "written", spied("edits"), raising=False)
    QUERIES["edited_rasters"](spark, "/root/testdata/sf0.001")
    assert len(counts["edits"]) == 1


def test_large_rasters_are_gathered_in_parts_by_their_size(spark):
    from verdure.operators import geometry

    sizes = spark.range(50).selectExpr("id as image_id", "4 as h", "4 as w", "4096 as new_h", "4096 as new_w")
    parts = geometry.parts_of(sizes)
    assert parts * geometry.CELLS >= 50 * 4096 * 4096 > (parts - 1) * geometry.CELLS
    assert geometry.parts_of(sizes.limit(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    pixels = spark.range(96).selectExpr("id div 16 as image_id", "(id % 16) div 4 as y", "id % 4 as x", "cast(id * id % 37 as double) as b1")
    small = sizes.filter("image_id < 6").selectExpr("image_id", "h", "w", "9 as new_h", "7 as new_w")
    for cubic in (False, True):
        rows = [sorted((r["image_id"], r["y"], r["x"], round(r["b1"], 9)) for r in geometry.enlarge(pixels, small, cubic, parts=n).collect()) for n in (None, 5)]
        assert rows[0] == rows[1] and len(rows[0]) == 6 * 9 * 7


def test_svm_passes_over_gathered_rows_with_its_classes_side_by_side(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    from verdure.operators import learn

    made, real = [], learn.OneVsRest
    monkeypatch.setattr(learn, "OneVsRest", lambda **how: made.append(real(**how)) or made[-1])
    b1, b2 = F.col("id") * 37 % 200, F.col("id") * 53 % 150
    rows = spark.range(0, 600, 1, 8).select(F.when(b1 + F.col("id") % 7 > 100, "x").when(b2 - F.col("id") % 11 > 60, "y").otherwise("z").alias("label"), b1.cast("double").alias("b1"), b2.cast("double").alias("b2"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("svm", "svm")
    model = learn.fit(rows, ["b1", "b2"], "svm", maxIter=4)
    spark.sparkContext.setJobGroup("", "")
    assert [m.getParallelism() for m in made] == [4]
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("svm")]
    assert len(jobs) > 30 and sum(len(j.stageIds) > 1 for j in jobs) < 10
    want = StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    want = VectorAssembler(inputCols=["b1", "b2"], outputCol="features").transform(want)
    want = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(want).transform(want)
    plain = OneVsRest(classifier=LinearSVC(featuresCol="scaled", labelCol="label_id", maxIter=4), featuresCol="scaled", labelCol="label_id").fit(want)
    for a, b in zip(model.stages[-1].stages[-1].models, plain.models, strict=True):
        assert all(abs(p - q) < 1e-6 for p, q in zip([*a.coefficients, a.intercept], [*b.coefficients, b.intercept]))
