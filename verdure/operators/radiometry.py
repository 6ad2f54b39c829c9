"""Radiometric operators: statistics and histograms of bands, matching to a reference, stretching to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import wide_quantiles

REFERENCE_BINS, MATCH_BINS = 1024, 2048
#: Points of a curve whose length is a column.
MOST_POINTS = 1 << 20


def mean_std(pixels: DataFrame, bands: list[str], image: str = "image_id", masked: Column | None = None) -> DataFrame:
    """(image, m_<band>, s_<band>) over unmasked pixels; deviations under 1e-6 count as 1."""
    keep = F.lit(True) if masked is None else ~masked
    stats = pixels.groupBy(image).agg(*[f(F.when(keep, F.col(b))).alias(f"{n}_{b}") for b in bands for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    safe = {f"s_{b}": F.when(F.col(f"s_{b}") >= 1e-6, F.col(f"s_{b}")).otherwise(F.lit(1.0)) for b in bands}
    return stats.withColumns(safe)


def match_mean_std(pixels: DataFrame, reference: dict[str, tuple[float, float]], masked: Column | None = None) -> DataFrame:
    """Bands with a reference (mean, std) are moved to it by their image's statistics; masked pixels keep their values."""
    stats = mean_std(pixels, list(reference), masked=masked)
    rows = pixels.join(stats, "image_id")
    out = {}
    for b, (mean, std) in reference.items():
        new = (F.col(b) - F.col(f"m_{b}")) * (F.lit(std) / F.col(f"s_{b}")) + mean
        out[b] = new if masked is None else F.when(masked, F.col(b)).otherwise(new)
    return rows.withColumns(out).select(*pixels.columns)


def reference_cdf(pixels: DataFrame, band: str, bins: int = REFERENCE_BINS) -> DataFrame:
    """(bin, x, y, lo, hi): the cumulative histogram of a band between its 0.01 and 99.99 percentiles, x scaled to 0..1."""
    v = F.col(band).cast("double")
    cuts = wide_quantiles(pixels, [], {"v": [band]}, {"a": 0.0001, "z": 0.9999}).select(F.col("a_v").alias("a"), F.col("z_v").alias("z"))
    ends = pixels.agg(F.min(v).alias("l"), F.max(v).alias("h"), F.count(v).alias("n")).join(F.broadcast(cuts), F.lit(True), "left")  # one row each
    tight, wide = F.col("z") > F.col("a"), F.col("h") > F.col("l")
    ends = ends.select(F.when(tight, F.col("a")).when(wide, F.col("l")).otherwise(F.lit(0.0)).alias("lo"), F.when(tight, F.col("z")).when(wide, F.col("h")).otherwise(F.lit(1.0)).alias("hi"), "n")
    inside = pixels.select(v.alias("v")).join(F.broadcast(ends), (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))  # one row is sent
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, "bin", "left")
    total = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("bin"))  # as many rows as bins
    return every.select("bin", ((F.col("bin") + 0.5) / bins).alias("x"), (total / F.greatest("n", F.lit(1))).alias("y"), "lo", "hi")


def interpolated(v: Column, ys: Column, xs: Column, n: int | Column) -> Column:
    """x at value v on rising points (ys, xs): a binary search in arrays of n points; of equal ys the last counts."""
    steps = max(1, n).bit_length() if isinstance(n, int) else MOST_POINTS.bit_length()
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        mid = half(s)
        go = (s["hi"] - s["lo"] > 1) & (ys[mid] <= v)
        return F.struct(F.when(go, mid).otherwise(s["lo"]).alias("lo"), F.when(go | (s["hi"] - s["lo"] <= 1), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), (F.lit(n) if isinstance(n, int) else n).alias("hi"))

    def finish(s: Column) -> Column:
        j = s["lo"]
        y0, y1, x0, x1 = ys[j], F.get(ys, j + 1), xs[j], F.get(xs, j + 1)
        return F.when(v < ys[0], xs[0]).when(y1.isNull() | (y1 <= y0), x0).otherwise(x0 + (v - y0) / F.nullif(y1 - y0, F.lit(0.0)) * (x1 - x0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, finish)


def match_cdf(pixels: DataFrame, band: str, reference: DataFrame, bins: int = MATCH_BINS, points: int = REFERENCE_BINS, masked: Column | None = None) -> DataFrame:
    """A band's values moved so that its image's cumulative histogram follows the reference's.

    A look-up table per image and bin is made from counts and joined back; the reference is one row of two arrays."""
    ref = reference.agg(F.sort_array(F.collect_list(F.struct("bin", "x", "y"))).alias("r"), F.first("lo").alias("lo"), F.first("hi").alias("hi0"))
    ref = ref.select("lo", F.when(F.col("hi0") > F.col("lo"), F.col("hi0")).otherwise(F.col("lo") + 1).alias("hi"), F.transform("r", lambda s: s["x"]).alias("xs"), F.transform("r", lambda s: s["y"]).alias("ys"))
    rows = pixels.join(F.broadcast(ref.select("lo", "hi")), F.lit(True))
    z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(band) - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    rows = rows.withColumns({"__bin": (z * (bins - 1)).cast("int"), "__m": F.lit(False) if masked is None else masked})
    counts = rows.filter(~F.col("__m") & F.col("__bin").isNotNull()).groupBy("image_id", "__bin").agg(F.count("*").alias("c"))
    so_far = Window.partitionBy("image_id").orderBy("__bin")  # at most ``bins`` rows
    share = F.sum("c").over(so_far) / F.sum("c").over(Window.partitionBy("image_id"))
    table = counts.withColumn("share", share).join(F.broadcast(ref), F.lit(True))
    new = interpolated(F.col("share"), F.col("ys"), F.col("xs"), points) * (F.col("hi") - F.col("lo")) + F.col("lo")
    table = table.select("image_id", "__bin", new.alias("__new"))
    out = F.when(F.col("__m"), F.col(band)).otherwise(F.col("__new"))
    return rows.join(table, ["image_id", "__bin"], "left").withColumn(band, out).select(*pixels.columns)


def _bytes(v: Column, lo: Column, hi: Column) -> Column:
    share = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / F.nullif(hi - lo, F.lit(0.0))))).otherwise(F.lit(0.5))
    return (share * 255).cast("int")


def stretch(pixels: DataFrame, bands: list[str], low: float = 0.5, high: float = 99.5, pooled: bool = False) -> DataFrame:
    """Bands of each image between two exact percentiles as bytes; pooled: the same limits for all bands of an image."""
    sides = {"all": bands} if pooled else {b: [b] for b in bands}
    limits = wide_quantiles(pixels, ["image_id"], sides, {"lo": low / 100, "hi": high / 100})
    ends = {b: ("lo_all", "hi_all") if pooled else (f"lo_{b}", f"hi_{b}") for b in bands}
    rows = pixels.filter("image_id is not null").join(limits, "image_id", "left")
    return rows.withColumns({b: _bytes(F.col(b), F.col(a), F.col(z)) for b, (a, z) in ends.items()}).select(*pixels.columns)


def min_max_bytes(pixels: DataFrame, bands: list[str]) -> DataFrame:
    limits = pixels.groupBy("image_id").agg(*[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("lo", F.min), ("hi", F.max))])
    rows = pixels.join(limits, "image_id")
    return rows.withColumns({b: _bytes(F.col(b), F.col(f"lo_{b}"), F.col(f"hi_{b}")) for b in bands}).select(*pixels.columns)


def sampled(pixels: DataFrame, side: int, most: int, seed: int = 42, masked: Column | None = None) -> DataFrame:
    """Pixels on a stride grid, then at most ``most`` per image in the order of a hash of their place; masked ones first leave."""
    area = pixels.groupBy("image_id").agg(((F.max("y") + 1) * (F.max("x") + 1)).alias("__a"))
    stride = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("__a") / float(side * side))).cast("int"))
    rows = (pixels if masked is None else pixels.filter(~masked)).join(area, "image_id").filter((F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("image_id", "y", "x")]).cast("binary"))
    n = F.row_number().over(Window.partitionBy("image_id").orderBy(place))
    return rows.withColumn("__n", n).filter(F.col("__n") <= most).select(*pixels.columns)
