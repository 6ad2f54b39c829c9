"""Pixel classification: training tables, estimators, search, evaluation, stacking and class maps, on Spark ML."""

from __future__ import annotations

import json
import math
import random
from itertools import product

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import evaluate
from ..session import written
from .zonal import pixels_in, windows

SEED = 12345
#: Rows to a partition where a model passes over them hundreds of times.
PASSED_OVER = 2_000_000


def window_names(base: list[str], size: int) -> list[str]:
    """Names of a window's features: offsets row by row, and all base features at each."""
    half = size // 2
    if size == 1:
        return list(base)
    return [f"{b}_r{dr:+d}c{dc:+d}" for dr in range(-half, half + 1) for dc in range(-half, half + 1) for b in base]


def window_features(pixels: DataFrame, centres: DataFrame, base: list[str], size: int, border: str) -> DataFrame:
    """centres with the named window features of every base band."""
    if size == 1:
        return centres.join(pixels.select("image_id", "y", "x", *base), ["image_id", "y", "x"])
    half, keys = size // 2, centres.columns
    wide = windows(pixels, centres, size, base, border)
    cells = [(dr, dc) for dr in range(-half, half + 1) for dc in range(-half, half + 1)]
    named = [F.col(f"{b}_w{i}").alias(f"{b}_r{dr:+d}c{dc:+d}") for i, (dr, dc) in enumerate(cells) for b in base]
    return wide.select(*keys, *named)


def sampled_per_polygon(rows: DataFrame, n: int, key: str = "poly_id", points: Column | None = None, seed: int = SEED) -> DataFrame:
    """At most n pixels of each polygon, in the order of a hash of their place; pixels of point sets all stay."""
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (key, "y", "x")]).cast("binary"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(place)))
    keep = F.col("__n") <= n
    return rows.filter(keep if points is None else keep | points).drop("__n")


def training_table(pixels: DataFrame, polygons: DataFrame, bands: list[str], expressions: dict[str, str] | None = None, window: int = 1, per_polygon: int | None = None, missing: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Labelled pixels (label = the polygon's group) and their feature names.

    Missing pixels, windows that reach over the border and rows with a NULL feature are left out."""
    base = [*bands, *(expressions or {})]
    px = evaluate(pixels if missing is None else pixels.filter(~missing), expressions or {}, "preserve")
    found = pixels_in(px, polygons.withColumn("few", F.size("points") < 3), ("grp", "few"))
    centres = found.select("poly_id", "few", F.col("grp").alias("label"), "image_id", "y", "x")
    if per_polygon:
        centres = sampled_per_polygon(centres, per_polygon, points=F.col("few"))
    rows = window_features(px, centres.drop("few"), base, window, "drop")
    names = window_names(base, window)
    return rows.na.drop(subset=names), names


def estimator(kind: str, side_by_side: int = 1, **params) -> Estimator:
    """A classifier over ``features`` and ``label_id`` by name: forest, boosting, logistic, svm or bayes.

    An svm fits ``side_by_side`` of its classes at a time."""
    common = {"featuresCol": "features", "labelCol": "label_id"}
    scaled = {"featuresCol": "scaled", "labelCol": "label_id"}
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    if kind == "forest":
        return RandomForestClassifier(**{"numTrees": 100, "seed": 42, **common, **params})
    if kind == "boosting":
        return OneVsRest(classifier=GBTClassifier(**{"seed": 42, **common, **params}), **common)
    if kind == "logistic":
        return Pipeline(stages=[scaler, LogisticRegression(**{**scaled, **params})])
    if kind == "svm":
        return Pipeline(stages=[scaler, OneVsRest(classifier=LinearSVC(**{**scaled, **params}), parallelism=side_by_side, **scaled)])
    if kind == "bayes":
        return NaiveBayes(**{"modelType": "gaussian", **common, **params})
    raise ValueError(f"unknown model {kind!r}")


#: Search space of each model, as far as Spark ML has the parameters.
SPACES = {
    "forest": {"numTrees": [100, 200, 400], "maxDepth": [5, 10, 20], "minInstancesPerNode": [1, 2, 5]},
    "boosting": {"maxIter": [20, 50], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
    "logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "svm": {"regParam": [0.001, 0.01, 0.1]},
    "bayes": {"smoothing": [1e-9, 1e-6, 1.0]},
}


def gathered(rows: DataFrame) -> DataFrame:
    """rows written once and read in few partitions: of PASSED_OVER rows where these are half the cores at most, else one per core or more.

    A pass over small partitions costs its tasks and the stages that add up their sums, not its rows."""
    rows = written(rows)
    parts, cores = max(1, math.ceil(rows.count() / PASSED_OVER)), rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(parts if 2 * parts <= cores else max(parts, cores))


def fit(rows: DataFrame, names: list[str], kind: str, **params) -> PipelineModel:
    """Label index (in sorted order), assembled features and a classifier, as one model.

    An svm passes over its rows some hundred times for each class: rows are gathered for it, and up to four classes fitted at a time."""
    if kind == "svm":
        rows, params = gathered(rows.select("label", *names)), {"side_by_side": 4, **params}
    stages = [StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc", handleInvalid="keep"), VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip"), estimator(kind, **params)]
    return Pipeline(stages=stages).fit(rows)


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*labels_of(model), "__unknown"])
    return out.transform(model.transform(rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("string"))))


class BalancedAccuracy(Evaluator):
    """Mean recall over the labels that occur."""

    def _evaluate(self, dataset: DataFrame) -> float:
        by = dataset.groupBy("label_id").agg(F.avg((F.col("prediction") == F.col("label_id")).cast("double")).alias("r"))
        return float(by.agg(F.avg("r")).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def search(rows: DataFrame, names: list[str], kind: str, draws: int | None = None, folds: int = 5, seed: int = 42, space: dict | None = None, parallelism: int = 4) -> tuple[PipelineModel, dict]:
    """The best parameters of a model's space by cross-validated balanced accuracy: all of them, or some seeded draws."""
    space = SPACES[kind] if space is None else space
    every = [dict(zip(space, v)) for v in product(*space.values())]
    if draws and draws < len(every):
        every = random.Random(seed).sample(every, draws)
    indexed = StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    ready = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(indexed)
    ready = ready.select("features", "label_id").persist()
    whole = estimator(kind)
    inner = whole.getStages()[-1] if isinstance(whole, Pipeline) else whole
    inner = inner.getClassifier() if isinstance(inner, OneVsRest) else inner
    maps = [{inner.getParam(k): v for k, v in params.items()} for params in every]
    cv = CrossValidator(estimator=whole, estimatorParamMaps=maps, evaluator=BalancedAccuracy(), numFolds=folds, seed=seed, parallelism=parallelism)
    scored = cv.fit(ready).avgMetrics
    ready.unpersist()
    best = max(range(len(every)), key=scored.__getitem__)
    return fit(rows, names, kind, **every[best]), {"params": every[best], "balanced_accuracy": scored[best]}


def kth_place(rows: DataFrame, by: str, place: str, k: DataFrame, steps: tuple[int, ...] = (4, 8, 32)) -> DataFrame:
    """(by, cut): the kth least of the hex strings ``place`` in each group; k has the group and ``k`` (from 1).

    Counts of leading digits say in which bin it lies; each pass looks into that bin alone, with more digits. A pass is one
    aggregation, summed in each task before it travels, and at most 16 ** 4 running counts per group are ordered."""
    state = written(k.select(by, "k", F.lit("").alias("cut")))  # of known size, so that rows need not meet it by group
    for before, depth in zip((0, *steps), steps):
        inside = rows.select(F.col(by), F.col(place)).join(state, by).filter(F.substring(place, 1, before) == F.col("cut") if before else F.lit(True))
        counts = inside.groupBy(by, "k", F.substring(place, 1, depth).alias("cut")).agg(F.count("*").alias("n"))
        so_far = F.sum("n").over(Window.partitionBy(by).orderBy("cut"))
        bins = counts.withColumn("before", so_far - F.col("n")).filter((F.col("before") < F.col("k")) & (F.col("before") + F.col("n") >= F.col("k")))
        state = written(bins.select(by, (F.col("k") - F.col("before")).alias("k"), "cut"))  # a row per group
    return state.select(by, "cut")


def holdout(rows: DataFrame, share: float = 0.2, seed: int = SEED, *key: str) -> DataFrame:
    """rows with ``held``: the first share of each label in the order of a hash of the key columns.

    Labels with a single row are not held out. Where the share ends follows from counts of hashes, so that no task holds a
    label's rows; rows that agree in their key stay together. Rows are written once and read by each pass."""
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary"))
    placed = written(rows).withColumn("__place", place)
    sizes = placed.groupBy("label").agg(F.count("*").alias("n")).filter("n >= 2").select("label", F.ceil(F.col("n") * share).alias("k"))
    cuts = kth_place(placed, "label", "__place", sizes).select(F.col("label").alias("__label"), "cut")
    out = placed.join(cuts, F.col("label") == F.col("__label"), "left")
    return out.withColumn("held", F.coalesce(F.col("__place") <= F.col("cut"), F.lit(False))).select(*rows.columns, "held")


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each label that occurs."""
    c = confusion(rows, label, predicted)
    by_label = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    by_guess = c.groupBy(F.col("predicted").alias("__p")).agg(F.sum("n").alias("guessed"))
    j = by_label.join(by_guess, F.col("label") == F.col("__p"), "left").na.fill(0, ["guessed"])
    precision = F.when(F.col("guessed") > 0, F.col("hits") / F.nullif("guessed", F.lit(0))).otherwise(F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).otherwise(F.lit(0.0))
    return j.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def overall_metrics(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Accuracy and balanced accuracy, one row."""
    m = class_metrics(rows, label, predicted)
    return m.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))


def importances(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """(feature, importance) of a forest, most important first."""
    values = model.stages[-1].featureImportances
    return spark.createDataFrame([(n, float(values[i])) for i, n in enumerate(names)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _votes(model: PipelineModel, rows: DataFrame, prefix: str, n: int) -> tuple[DataFrame, list[str]]:
    """rows with a column per class: probabilities where a model has them, else its decision as 0 or 1."""
    out = model.transform(rows)
    names = [f"{prefix}_{i}" for i in range(n)]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        cols = {c: F.coalesce(F.get(p, i), F.lit(0.0)) for i, c in enumerate(names)}
    else:
        cols = {c: (F.col("prediction") == i).cast("double") for i, c in enumerate(names)}
    return out.withColumns(cols).select(*rows.columns, *names), names


def stack(rows: DataFrame, names: list[str], kinds: list[str], key: list[str], folds: int = 5, seed: int = SEED) -> tuple[dict, PipelineModel, list[str]]:
    """Base models, and a logistic regression over their out-of-fold votes. Folds come from a hash of the key columns.

    Every fit passes over its rows many times, so that rows and votes are written once and read from there."""
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = written(rows.withColumn("__fold", place % folds))
    n = rows.select("label").distinct().count()
    parts = []
    for f in range(folds):
        train, rest = rows.filter(F.col("__fold") != f), rows.filter(F.col("__fold") == f)
        meta: list[str] = []
        for kind in kinds:
            rest, more = _votes(fit(train, names, kind), rest, kind, n)
            meta += more
        parts.append(rest)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    base = {kind: fit(rows, names, kind) for kind in kinds}
    return base, fit(written(every.select("label", *meta)), meta, "logistic"), meta


def stacked_predictions(base: dict, top: PipelineModel, rows: DataFrame) -> DataFrame:
    n = len(labels_of(next(iter(base.values()))))
    for kind, model in base.items():
        rows, _ = _votes(model, rows, kind, n)
    return predict(top, rows)


def class_map(model: PipelineModel, pixels: DataFrame, bands: list[str], expressions: dict[str, str] | None = None, window: int = 1, masked: Column | None = None, nodata: float | None = None) -> DataFrame:
    """(image_id, y, x, class_id) of every pixel; windows repeat the edge; masked pixels get the NoData value, or NULL."""
    base = [*bands, *(expressions or {})]
    px = evaluate(pixels, expressions or {}, "preserve").withColumn("__m", F.lit(False) if masked is None else masked)
    if window == 1:  # every pixel is its own window
        rows = px.select("image_id", "y", "x", "__m", *base).na.fill(0.0)
    else:
        rows = window_features(px.drop("__m"), px.select("image_id", "y", "x", "__m"), base, window, "edge").na.fill(0.0)
    out = model.transform(rows.withColumn("label", F.lit(None).cast("string")))
    return out.select("image_id", "y", "x", F.when(F.col("__m"), F.lit(nodata).cast("double")).otherwise(F.col("prediction")).alias("class_id"))


def label_ids(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_id): labels numbered from 0 in sorted order; a row per label."""
    return rows.select(F.col(label).alias("label")).distinct().withColumn("label_id", F.row_number().over(Window.orderBy("label")) - 1)


def save(model: PipelineModel, path: str, names: list[str], meta: dict, spark) -> None:
    """The model beside a one-row table of its feature names, labels and notes."""
    model.write().overwrite().save(f"{path}/model")
    row = (json.dumps(names), json.dumps(labels_of(model)), json.dumps(meta))
    spark.createDataFrame([row], "features string, labels string, meta string").write.mode("overwrite").json(f"{path}/about")


def load(path: str, spark) -> tuple[PipelineModel, list[str], dict]:
    about = spark.read.schema("features string, labels string, meta string").json(f"{path}/about").first()
    return PipelineModel.load(f"{path}/model"), json.loads(about["features"]), json.loads(about["meta"])
