"""Image features from pixel tables, and similarity of feature rows to a few reference rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import shrink

EPS = 1e-6
#: Default weight of each scalar feature.
WEIGHTS = {
    "mean_L": 3.0, "std_L": 2.0, "mean_a": 1.5, "mean_b": 1.5, "ratio_rg": 2.0, "ratio_rb": 1.5, "ratio_gb": 1.5, "spatial_variance": 2.5,
    "entropy": 1.5, "glcm_contrast": 1.0, "glcm_homogeneity": 1.5, "glcm_energy": 1.0, "glcm_correlation": 0.5, "coeff_variation": 2.0,
}
MOST_REFERENCES = 3


def lab(r: Column, g: Column, b: Column) -> Column:
    """Struct L, a, b (0..255) of 8-bit sRGB values: CIE Lab for D65, lightness scaled to bytes, colours shifted by 128."""
    linear = lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(v).cast("int")))
    return F.struct(byte(light * 255 / 100).alias("L"), byte(500 * (f(x) - f(y)) + 128).alias("a"), byte(200 * (f(y) - f(z)) + 128).alias("b"))


def colour_statistics(pixels: DataFrame) -> DataFrame:
    """Lightness and colour statistics per image over b1, b2, b3 as R, G, B bytes."""
    rows = pixels.withColumn("__lab", lab(F.col("b1"), F.col("b2"), F.col("b3")))
    means = rows.groupBy("image_id").agg(
        F.avg("__lab.L").alias("mean_L"), F.stddev_pop("__lab.L").alias("std_L"), F.avg("__lab.a").alias("mean_a"), F.avg("__lab.b").alias("mean_b"),
        *[(F.avg(b) + EPS).alias(n) for b, n in (("b1", "__r"), ("b2", "__g"), ("b3", "__b"))],
    )
    ratios = {"ratio_rg": F.col("__r") / F.col("__g"), "ratio_rb": F.col("__r") / F.col("__b"), "ratio_gb": F.col("__g") / F.col("__b")}
    return means.withColumns(ratios).drop("__r", "__g", "__b")


def _counts(pixels: DataFrame, level: Column) -> DataFrame:
    return pixels.groupBy("image_id", level.cast("int").alias("bin")).agg(F.count("*").alias("c"))


def histogram(pixels: DataFrame, level: str, bins: int = 32) -> DataFrame:
    """(image_id, hist): shares of ``bins`` equal ranges of a byte level, empty ones included."""
    width = 256 // bins
    counts = _counts(pixels, F.floor(F.col(level) / width))
    by = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("n"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0)) / (F.col("n") + EPS))
    return by.select("image_id", shares.alias("hist"))


def entropy(pixels: DataFrame, level: str) -> DataFrame:
    counts = _counts(pixels, F.col(level)).withColumn("n", F.sum("c").over(Window.partitionBy("image_id")))  # 256 rows at most
    p = F.col("c") / (F.col("n") + EPS)
    return counts.groupBy("image_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def block_homogeneity(pixels: DataFrame, level: str, blocks: int = 8) -> DataFrame:
    """Variance and relative deviation of an image's block means; NULL for images of less than ``blocks`` a side. pixels has h and w."""
    rows = pixels.filter((F.col("h") >= blocks) & (F.col("w") >= blocks)).select("image_id", "y", "x", "h", "w", F.col(level).alias("b1"))
    means = shrink(rows, F.lit(blocks), F.lit(blocks)).withColumn("b1", F.rint("b1"))
    return means.groupBy("image_id").agg(F.var_pop("b1").alias("spatial_variance"), (F.stddev_pop("b1") / (F.avg("b1") + EPS)).alias("coeff_variation"))


def texture(pixels: DataFrame, level: str, levels: int = 32) -> DataFrame:
    """Co-occurrence contrast, homogeneity, energy and correlation per image, pooled over four directions."""
    q = F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(F.col(level) * levels / 256.0).cast("int")))
    rows = pixels.select("image_id", "y", "x", q.alias("q"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1))])
    a = rows.withColumn("s", F.explode(steps)).select(F.col("image_id").alias("ia"), (F.col("y") + F.col("s.dy")).alias("ya"), (F.col("x") + F.col("s.dx")).alias("xa"), F.col("q").alias("i"))
    pairs = a.join(rows, (F.col("ia") == F.col("image_id")) & (F.col("ya") == F.col("y")) & (F.col("xa") == F.col("x"))).groupBy("image_id", "i", F.col("q").alias("j")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("image_id"))  # levels * levels rows at most
    d = F.col("i") - F.col("j")
    m = pairs.withColumn("p", p).groupBy("image_id").agg(
        F.sum(F.col("p") * d * d).alias("glcm_contrast"), F.sum(F.col("p") / (1 + F.abs(d))).alias("glcm_homogeneity"), F.sum(F.col("p") * F.col("p")).alias("glcm_energy"),
        F.sum(F.col("p") * F.col("i")).alias("mi"), F.sum(F.col("p") * F.col("j")).alias("mj"), F.sum(F.col("p") * F.col("i") * F.col("i")).alias("ii"), F.sum(F.col("p") * F.col("j") * F.col("j")).alias("jj"), F.sum(F.col("p") * F.col("i") * F.col("j")).alias("ij"),
    )
    si, sj = F.sqrt(F.greatest(F.lit(0.0), F.col("ii") - F.col("mi") * F.col("mi"))), F.sqrt(F.greatest(F.lit(0.0), F.col("jj") - F.col("mj") * F.col("mj")))
    correlation = F.when((si > 1e-10) & (sj > 1e-10), (F.col("ij") - F.col("mi") * F.col("mj")) / (si * sj)).otherwise(F.lit(0.0))
    return m.withColumn("glcm_correlation", correlation).drop("mi", "mj", "ii", "jj", "ij")


def features(pixels: DataFrame) -> DataFrame:
    """All features of each image (R, G, B bytes in b1..b3; h and w its size), one row per image."""
    rows = pixels.withColumn("L", lab(F.col("b1"), F.col("b2"), F.col("b3"))["L"])
    out = colour_statistics(pixels)
    for part in (histogram(rows, "L"), entropy(rows, "L"), block_homogeneity(rows, "L"), texture(rows, "L")):
        out = out.join(part, "image_id", "left")
    return out


def hist_distance(p: Column, q: Column) -> Column:
    """Bhattacharyya distance of two histograms, with the coefficient held in 1e-10..1."""
    total = F.aggregate(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, v: s + v)
    return -F.log(F.greatest(F.lit(1e-10), F.least(F.lit(1.0), total)))


def scores(candidates: DataFrame, references: DataFrame, weights: dict[str, float] | None = None, hist_weight: float = 0.3, sigma: float = 2.0) -> DataFrame:
    """(ref_id, image_id, score) of every candidate against each of MOST_REFERENCES references at most; more are refused.

    Features are standardised over the candidates and the reference row, which counts even if it is a candidate too.
    The candidates' sums are one aggregation; references and sums are a few rows, sent to all tasks."""
    weights = WEIGHTS if weights is None else weights
    names = list(weights)
    sums = candidates.agg(F.count("*").alias("__n"), *[f.alias(f"{k}_{n}") for n in names for k, f in (("__s", F.sum(n)), ("__q", F.sum(F.col(n) * F.col(n))))])
    if references.limit(MOST_REFERENCES + 1).count() > MOST_REFERENCES:
        raise ValueError(f"at most {MOST_REFERENCES} references")
    refs = references.select(F.col("image_id").alias("ref_id"), F.col("hist").alias("__hist"), *[F.col(n).alias(f"__r_{n}") for n in names])
    side = refs.join(F.broadcast(sums), F.lit(True))
    rows = candidates.join(F.broadcast(side), F.lit(True))
    terms = []
    for n, w in weights.items():
        count, r = F.col("__n") + 1, F.col(f"__r_{n}")
        mean = (F.col(f"__s_{n}") + r) / count
        std = F.sqrt(F.greatest(F.lit(0.0), (F.col(f"__q_{n}") + r * r) / count - mean * mean))
        diff = (r - F.col(n)) / F.when(std > 1e-10, std).otherwise(F.lit(1.0))
        terms.append(diff * diff * w)
    d = (1 - hist_weight) * F.sqrt(reduce(lambda a, b: a + b, terms)) + hist_weight * hist_distance(F.col("__hist"), F.col("hist"))
    return rows.select("ref_id", "image_id", F.exp(-d / sigma).alias("score"))


def best_score(scored: DataFrame) -> DataFrame:
    """The highest score of each image over the references."""
    return scored.groupBy("image_id").agg(F.max("score").alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "image_id").limit(k)


def split_at(scored: DataFrame, threshold: float = 0.85) -> DataFrame:
    return scored.withColumn("selected", F.col("score") >= threshold)


def score_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, n) over equal bins from the least to the highest score, the last one closed."""
    ends = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = scored.join(F.broadcast(ends), F.lit(True))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins).cast("int"))).otherwise(F.lit(bins // 2))
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def summary_by(scored: DataFrame, category: str) -> DataFrame:
    return scored.groupBy(category).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.count("*").alias("n"))
