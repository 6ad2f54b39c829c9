"""Queries over training tables, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as L
from ..session import shared_folder, written
from . import views as V
from .registry import query


@query("training_sample_per_polygon", V.with_sql("""SELECT poly_id, label, image_id, y, x FROM (SELECT i.poly_id, i.grp AS label, i.image_id, i.y, i.x, i.shape, row_number() OVER (PARTITION BY i.poly_id ORDER BY md5('12345|' || i.poly_id || '|' || i.y || '|' || i.x)) AS n
  FROM inside i JOIN pixels p ON p.image_id = i.image_id AND p.y = i.y AND p.x = i.x) WHERE n <= 5 OR shape IN ('point', 'pair')""", "pixels", "shapes", "inside"))
def training_sample_per_polygon(spark, sf_dir):
    rows, _ = L.training_table(V.pixels(spark, sf_dir), V.polygons(spark, sf_dir), ["b1"], per_polygon=5)
    return rows.select("poly_id", "label", "image_id", "y", "x")


@query("training_table_expressions", V.with_sql("""SELECT i.poly_id, i.grp AS label, g.image_id, g.y, g.x, g.b1, (g.b1 / nullif(g.b2 + g.b3, 0)) AS ratio FROM inside i JOIN gaps g ON g.image_id = i.image_id AND g.y = i.y AND g.x = i.x WHERE g.b1 IS NOT NULL AND g.b2 <> -9999 AND g.b2 + g.b3 <> 0""", "gaps", "shapes", "inside"))
def training_table_expressions(spark, sf_dir):
    rows, _ = L.training_table(V.pixels(spark, sf_dir, gaps=True), V.polygons(spark, sf_dir), ["b1"], {"ratio": "b1/(b2+b3)"}, missing=F.col("b2") == -9999)
    return rows.withColumn("ratio", F.col("ratio"))


@query("training_windows", V.with_sql("""SELECT poly_id, count(*) AS n, (avg(a)) AS upper_left FROM (SELECT i.poly_id, i.y, i.x, count(*) AS k, max(CASE WHEN n.y = i.y - 1 AND n.x = i.x - 1 THEN n.b1 END) AS a FROM inside i
  JOIN pixels n ON n.image_id = i.image_id AND abs(n.y - i.y) <= 1 AND abs(n.x - i.x) <= 1 JOIN pixels c ON c.image_id = i.image_id AND c.y = i.y AND c.x = i.x GROUP BY 1, 2, 3) WHERE k = 9 GROUP BY poly_id""", "pixels", "shapes", "inside"))
def training_windows(spark, sf_dir):
    rows, _ = L.training_table(V.pixels(spark, sf_dir), V.polygons(spark, sf_dir), ["b1"], window=3)
    return rows.groupBy("poly_id").agg(F.count("*").alias("n"), F.avg("b1_r-1c-1").alias("upper_left"))


_CLIP = "LEFT JOIN pixels n{k} ON n{k}.image_id = c.image_id AND n{k}.y = greatest(0, least(c.my, c.y + ({dy}))) AND n{k}.x = greatest(0, least(c.mx, c.x + ({dx})))"


@query("inference_windows", V.with_sql("SELECT c.image_id, c.y, c.x, n0.b1 AS first, n8.b1 AS last FROM (SELECT p.image_id, y, x, my, mx FROM pixels p JOIN (SELECT image_id, max(y) AS my, max(x) AS mx FROM pixels GROUP BY image_id) a ON a.image_id = p.image_id) c " + " ".join(_CLIP.format(k=k, dy=k // 3 - 1, dx=k % 3 - 1) for k in (0, 8)), "pixels"))
def inference_windows(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    return L.window_features(px, px.select("image_id", "y", "x"), ["b1"], 3, "edge").select("image_id", "y", "x", F.col("b1_r-1c-1").alias("first"), F.col("b1_r+1c+1").alias("last"))


_TRAIN = "SELECT DISTINCT l_returnflag AS label, l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem"


def _train(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), "l_orderkey", "l_partkey", "l_linenumber", "l_quantity").distinct()


@query("class_distribution", f"SELECT label, count(*) AS n FROM ({_TRAIN}) GROUP BY label")
def class_distribution(spark, sf_dir):
    return _train(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("label_ids", f"SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM ({_TRAIN}))")
def label_ids(spark, sf_dir):
    return L.label_ids(_train(spark, sf_dir)).withColumn("label_id", F.col("label_id").cast("long"))


@query("stratified_holdout", f"SELECT label, l_orderkey, l_partkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY label ORDER BY md5('12345|' || l_orderkey || '|' || l_partkey || '|' || l_linenumber)) <= ceil(count(*) OVER (PARTITION BY label) * 0.2) AS held FROM ({_TRAIN})")
def stratified_holdout(spark, sf_dir):
    return L.holdout(_train(spark, sf_dir), 0.2, L.SEED, "l_orderkey", "l_partkey", "l_linenumber")


_PRED = f"SELECT label, CASE WHEN l_orderkey % 3 = 0 THEN 'A' WHEN l_quantity > 20 THEN label ELSE 'N' END AS predicted FROM ({_TRAIN})"


def _predicted(spark, sf_dir):
    guess = F.when(F.col("l_orderkey") % 3 == 0, "A").when(F.col("l_quantity") > 20, F.col("label")).otherwise("N")
    return _train(spark, sf_dir).select("label", guess.alias("predicted"))


@query("confusion_matrix", f"SELECT label, predicted, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return L.confusion(_predicted(spark, sf_dir))


_CM = f"SELECT l.label, coalesce(h * 1.0 / g, 0) AS p, h * 1.0 / s AS r, s FROM (SELECT label, count(*) AS s, sum(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS h FROM ({_PRED}) GROUP BY 1) l LEFT JOIN (SELECT predicted, count(*) AS g FROM ({_PRED}) GROUP BY 1) q ON q.predicted = l.label"


@query("class_metrics", f"SELECT label, (p) AS precision, (r) AS recall, (CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f1, s AS support FROM ({_CM})")
def class_metrics(spark, sf_dir):
    rows = L.class_metrics(_predicted(spark, sf_dir))
    return rows.select("label", *[F.col(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("overall_metrics", f"SELECT (sum(r * s) / sum(s)) AS accuracy, (avg(r)) AS balanced_accuracy FROM ({_CM})")
def overall_metrics(spark, sf_dir):
    return L.overall_metrics(_predicted(spark, sf_dir)).select("accuracy", "balanced_accuracy")


def _separable(spark, sf_dir):
    px = V.pixels(spark, sf_dir)
    kind = F.when((F.col("b1") > 100) & (F.col("b2") > 75), "leaf").when(F.col("b1") > 100, "soil").otherwise("shade")
    return px, px.withColumn("label", kind)


def _model_query(kind, **params):
    def run(spark, sf_dir):
        _, rows = _separable(spark, sf_dir)
        held = written(L.holdout(rows.select("label", "image_id", "y", "x", "b1", "b2"), 0.2, L.SEED, "image_id", "y", "x"))
        model = L.fit(held.filter("not held"), ["b1", "b2"], kind, **params)
        out = L.predict(model, held.filter("held"))
        return L.class_metrics(out.select("label", "predicted")).withColumn("model", F.lit(kind))

    return run


query("model_forest")(_model_query("forest"))
query("model_boosting")(_model_query("boosting"))
query("model_logistic")(_model_query("logistic"))
query("model_svm")(_model_query("svm"))
query("model_bayes")(_model_query("bayes"))


@query("forest_importances")
def forest_importances(spark, sf_dir):
    _, rows = _separable(spark, sf_dir)
    model = L.fit(rows, ["b1", "b2", "b3"], "forest", numTrees=10, maxDepth=4)
    return L.importances(model, ["b1", "b2", "b3"], spark)


@query("forest_class_map")
def forest_class_map(spark, sf_dir):
    px, rows = _separable(spark, sf_dir)
    model = L.fit(rows, ["b1", "b2"], "forest", numTrees=10, maxDepth=5)
    return L.class_map(model, px, ["b1", "b2"], masked=F.col("b3") == 7, nodata=-9999.0)


@query("parameter_search")
def parameter_search(spark, sf_dir):
    """The whole grid by five folds."""
    _, rows = _separable(spark, sf_dir)
    _, found = L.search(rows.select("label", "b1", "b2"), ["b1", "b2"], "bayes")
    return rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("balanced_accuracy", F.lit(found["balanced_accuracy"]))


@query("random_parameter_search")
def random_parameter_search(spark, sf_dir):
    """Up to thirty seeded draws from the space by five folds."""
    _, rows = _separable(spark, sf_dir)
    _, found = L.search(rows.select("label", "b1", "b2"), ["b1", "b2"], "logistic", draws=30)
    return rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("balanced_accuracy", F.lit(found["balanced_accuracy"]))


@query("saved_model")
def saved_model(spark, sf_dir):
    """A model written to the shared folder and read again predicts what it did."""
    _, rows = _separable(spark, sf_dir)
    model = L.fit(rows, ["b1", "b2"], "bayes")
    path = shared_folder(spark)
    L.save(model, path, ["b1", "b2"], {}, spark)
    again = L.predict(L.load(path, spark)[0], rows).select("image_id", "y", "x", F.col("predicted").alias("again"))
    both = L.predict(model, rows).select("image_id", "y", "x", "predicted").join(again, ["image_id", "y", "x"])
    return both.groupBy("predicted", "again").agg(F.count("*").alias("n"))


@query("stacked_models")
def stacked_models(spark, sf_dir):
    _, rows = _separable(spark, sf_dir)
    rows = rows.select("label", "image_id", "y", "x", "b1", "b2")
    base, top, _ = L.stack(rows, ["b1", "b2"], ["bayes", "logistic"], ["image_id", "y", "x"])
    return L.class_metrics(L.stacked_predictions(base, top, rows).select("label", "predicted"))
