"""Rasters as strips: a row per (image, line) with an array per band, so that work along a line needs no shuffle.

A strip has ``image_id``, ``y``, an array of doubles for each band, and ``mask``: for each pixel 1.0 if it is masked and 0.0 if
not. NULL values stay NULL and make what is interpolated from them NULL, as a missing number would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import _cubic
from .zonal import band_names

DOUBLES = "array<double>"


def strips(pixels: DataFrame, masked: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Strips of whole lines: one exchange by (image, line). ``keep`` are columns that all pixels of an image agree in."""
    bands = band_names(pixels)
    mask = F.coalesce((F.lit(False) if masked is None else masked).cast("double"), F.lit(0.0)).alias("mask")
    cells = F.sort_array(F.collect_list(F.struct("x", *[F.col(b).cast("double").alias(b) for b in bands], mask)))
    rows = pixels.groupBy("image_id", "y").agg(cells.alias("__c"), *[F.any_value(c).alias(c) for c in keep])
    return rows.select("image_id", "y", *keep, *[F.col(f"__c.{b}").alias(b) for b in (*bands, "mask")])


def pixels_of(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per pixel again, with ``masked``."""
    bands = band_names(rows)
    cells = F.arrays_zip(*[F.col(b) for b in (*bands, "mask")])
    out = rows.select("image_id", "y", *keep, F.posexplode(cells).alias("x", "__c"))
    return out.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *keep, *[F.col(f"__c.{b}").alias(b) for b in bands], (F.col("__c.mask") > 0).alias("masked"))


def _zero() -> Column:
    """Zero that may become NULL on the way of a sum."""
    return F.get(F.array(F.lit(0.0)), F.lit(0))


def _whole(c: Column) -> Column:
    return c.cast("int")


def taps(kind: Column, n: Column, m: Column) -> tuple[Callable, Callable]:
    """For a side of n pixels that becomes m: functions (t) to the first and last source place of a target, and (t, p) to the
    weight of place p in it. ``kind`` is area, linear or cubic; places may lie outside, where the edge stands for them."""
    at = lambda t: (t + 0.5) * n / m - 0.5
    step = n / m
    area, cubic = kind == "area", kind == "cubic"

    def first(t: Column) -> Column:
        return _whole(F.when(area, F.floor(t * step + 1e-9)).otherwise(F.floor(at(t)) - F.when(cubic, 1).otherwise(0)))

    def last(t: Column) -> Column:
        return _whole(F.when(area, F.least(F.ceil((t + 1) * step - 1e-9), n) - 1).otherwise(F.floor(at(t)) + F.when(cubic, 2).otherwise(1)))

    def weight(t: Column, p: Column) -> Column:
        overlap = (F.least(p + 1.0, (t + 1) * step) - F.greatest(p * 1.0, t * step)) / step
        return F.when(area, overlap).when(cubic, _cubic(at(t) - p)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(at(t) - p)))

    return first, last, weight


def _clamped(p: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(p, _whole(n) - 1))


def across(values: Column, n: Column, m: Column, kind: Column, absolute: bool = False) -> Column:
    """An array of n values as one of m. ``absolute``: with the weights' absolute values, for masks."""
    first, last, weight = taps(kind, n, m)

    def target(t: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            w = weight(t, p)
            w = F.when(F.abs(w) > 1e-12, F.abs(w) if absolute else w).otherwise(F.lit(0.0))
            # a place without weight adds nothing, whatever its value
            return F.when(w != 0, acc + w * F.get(values, _clamped(p, n))).otherwise(acc)

        return F.aggregate(F.sequence(first(t), last(t)), _zero(), add)

    return F.transform(F.sequence(F.lit(0), _whole(m) - 1), target)


def down(rows: DataFrame, n: str, m: str, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Strips of n lines as strips of m: a strip is sent to the few lines that it has a weight in, and these are summed."""
    bands = [*band_names(rows), "mask"]
    n_, m_, k_ = F.col(n), F.col(m), F.col(kind)
    first, last, weight = taps(k_, n_, m_)
    # lines whose taps may reach y: a margin of taps on both sides, the whole rest at the edges
    reach = F.when(k_ == "area", 1).otherwise(3)
    low = F.when(F.col("y") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), _whole(F.floor((F.col("y") - reach) * m_ / n_)) - 1))
    high = F.when(F.col("y") == n_ - 1, _whole(m_) - 1).otherwise(F.least(_whole(m_) - 1, _whole(F.ceil((F.col("y") + 1 + reach) * m_ / n_)) + 1))

    def total(t: Column) -> Column:
        add = lambda acc, p: acc + F.when(_clamped(p, n_) == F.col("y"), weight(t, p)).otherwise(F.lit(0.0))
        return F.aggregate(F.sequence(first(t), last(t)), F.lit(0.0), add)

    places = F.filter(F.transform(F.sequence(low, high), lambda t: F.struct(t.alias("t"), total(t).alias("w"))), lambda s: F.abs(s["w"]) > 1e-12)
    sent = rows.withColumn("__s", F.explode(places)).select("image_id", F.col("__s.t").alias("y"), F.col("__s.w").alias("__w"), *keep, *bands)
    gathered = sent.groupBy("image_id", "y").agg(F.collect_list(F.struct("__w", *bands)).alias("__l"), *[F.any_value(c).alias(c) for c in keep])

    def summed(b: str) -> Column:
        size = F.size(F.element_at(F.col("__l"), 1)[b])
        w = lambda s: F.abs(s["__w"]) if b == "mask" else s["__w"]
        return F.aggregate("__l", F.array_repeat(_zero(), size).cast(DOUBLES), lambda acc, s: F.zip_with(acc, s[b], lambda a, v: a + w(s) * v))

    return gathered.select("image_id", "y", *keep, *[summed(b).alias(b) for b in bands])


def resized(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Strips on rasters of other sizes. rows has ``h``, ``w``, ``new_h``, ``new_w``, ``kind`` (NULL: unchanged) and ``restore``.

    Lines are shortened before they are sent to others and lengthened after, so that the one exchange moves the lesser
    width; strips of unchanged images do not move. Masks are interpolated beside the bands: a target in which a masked
    pixel has a weight gets the restore value, whatever the method, and is not masked any more unless that value is."""
    bands = band_names(rows)
    sizes = ("h", "w", "new_h", "new_w", "kind", "restore")
    carried = tuple(dict.fromkeys((*sizes, *keep)))
    every = (*bands, "mask")
    move = lambda b, now: F.when(now, across(F.col(b), F.col("w"), F.col("new_w"), F.col("kind"), b == "mask")).otherwise(F.col(b))
    shorter = F.col("new_w") < F.col("w")
    some = rows.filter("kind is not null")
    some = some.select("image_id", "y", *carried, *[move(b, shorter).alias(b) for b in every])
    some = down(some, "h", "new_h", "kind", carried)
    some = some.select("image_id", "y", *carried, *[move(b, ~shorter).alias(b) for b in every])
    held = lambda b: F.zip_with(b, "mask", lambda v, k: F.when(k > 0, F.col("restore")).otherwise(v))
    some = some.select("image_id", "y", *carried, *[held(b).alias(b) for b in bands], "mask")
    same = rows.filter("kind is null").select("image_id", "y", *carried, *every)
    return same.unionByName(some.withColumn("y", F.col("y").cast(dict(same.dtypes)["y"]))).select("image_id", "y", F.col("new_h").alias("h"), F.col("new_w").alias("w"), "restore", *[k for k in keep if k not in sizes], *every)
