"""Geometry on pixel tables: turning, cropping, resampling and warping as coordinate expressions and one join.

Sizes come as columns or as a table (image_id, h, w, ...), one row per image, and are joined by image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .zonal import band_names


def turned(y: Column, x: Column, h: Column, w: Column, degrees: Column) -> tuple[Column, Column]:
    """Row and column after a clockwise turn by 90, 180 or 270 degrees; other angles change nothing."""
    ny = F.when(degrees == 90, x).when(degrees == 180, h - 1 - y).when(degrees == 270, w - 1 - x).otherwise(y)
    nx = F.when(degrees == 90, h - 1 - y).when(degrees == 180, w - 1 - x).when(degrees == 270, y).otherwise(x)
    return ny, nx


def rotate(pixels: DataFrame, h: Column, w: Column, degrees: Column) -> DataFrame:
    ny, nx = turned(F.col("y"), F.col("x"), h, w, degrees)
    return pixels.withColumns({"y": ny, "x": nx})


def crop_box(h: Column, w: Column) -> Column:
    """Struct x0, y0, x1, y1 of the recipe's crop (columns crop_*, ref_*) on an h by w raster; all of it if that is empty."""
    by = lambda v, ref, n: F.rint(v * n / F.when(ref > 0, ref).otherwise(n)).cast("int")
    fit = lambda v, n: F.greatest(F.lit(0), F.least(v, n))
    x, y = by(F.col("crop_x"), F.col("ref_w"), w), by(F.col("crop_y"), F.col("ref_h"), h)
    x0, x1 = fit(x, w), fit(x + by(F.col("crop_w"), F.col("ref_w"), w), w)
    y0, y1 = fit(y, h), fit(y + by(F.col("crop_h"), F.col("ref_h"), h), h)
    full = F.coalesce((x1 <= x0) | (y1 <= y0), F.lit(True))
    pick = lambda a, b: F.when(full, b).otherwise(a)
    return F.struct(pick(x0, F.lit(0)).alias("x0"), pick(y0, F.lit(0)).alias("y0"), pick(x1, w).alias("x1"), pick(y1, h).alias("y1"))


def crop(pixels: DataFrame, h: Column, w: Column) -> DataFrame:
    """pixels (with the recipe's crop columns) inside the crop, shifted to it."""
    rows = pixels.withColumn("__b", crop_box(h, w))
    inside = (F.col("x") >= F.col("__b.x0")) & (F.col("x") < F.col("__b.x1")) & (F.col("y") >= F.col("__b.y0")) & (F.col("y") < F.col("__b.y1"))
    return rows.filter(inside).withColumns({"x": F.col("x") - F.col("__b.x0"), "y": F.col("y") - F.col("__b.y0")}).drop("__b")


def crop_first(h: Column, w: Column) -> Column:
    """Whether a recipe crops before it turns: its reference size is the raw one and differs from the turned one."""
    raw = (F.col("ref_w") == w) & (F.col("ref_h") == h)
    return F.coalesce(raw & F.col("rotate").isin(90, 180, 270), F.lit(False))


def replay(pixels: DataFrame, recipes: DataFrame, h: int, w: int) -> DataFrame:
    """Turn and crop of each image's recipe in its own order, as one projection; images without a recipe stay.

    The result carries the size after both as columns h and w."""
    rows = pixels.join(recipes, "image_id", "left")
    raw_h, raw_w, deg = F.lit(h), F.lit(w), F.coalesce("rotate", F.lit(0))
    swap = deg.isin(90, 270)
    first = crop_first(raw_h, raw_w)
    turn_h, turn_w = F.when(swap, raw_w).otherwise(raw_h), F.when(swap, raw_h).otherwise(raw_w)
    y1, x1 = turned(F.col("y"), F.col("x"), raw_h, raw_w, deg)
    rows = rows.withColumns({"__first": first, "__y": F.when(first, F.col("y")).otherwise(y1), "__x": F.when(first, F.col("x")).otherwise(x1), "__deg": deg, "__swap": swap})
    rows = rows.withColumn("__b", crop_box(F.when(first, raw_h).otherwise(turn_h), F.when(first, raw_w).otherwise(turn_w)))
    b = lambda k: F.col(f"__b.{k}")
    rows = rows.filter((F.col("__x") >= b("x0")) & (F.col("__x") < b("x1")) & (F.col("__y") >= b("y0")) & (F.col("__y") < b("y1")))
    cy, cx, ch, cw = F.col("__y") - b("y0"), F.col("__x") - b("x0"), b("y1") - b("y0"), b("x1") - b("x0")
    ty, tx = turned(cy, cx, ch, cw, F.col("__deg"))
    late = F.col("__first")
    out_h, out_w = F.when(late & F.col("__swap"), cw).otherwise(ch), F.when(late & F.col("__swap"), ch).otherwise(cw)
    return rows.select("image_id", F.when(late, ty).otherwise(cy).alias("y"), F.when(late, tx).otherwise(cx).alias("x"), *band_names(pixels), out_h.alias("h"), out_w.alias("w"))


def shrink(pixels: DataFrame, new_h: Column, new_w: Column, masked: Column | None = None, restore: float | None = None) -> DataFrame:
    """Area averages on a smaller raster; pixels carry their image's size as h and w.

    A source pixel goes to the few target cells that it overlaps, weighed by the overlap. A target that a masked pixel
    touches gets the restore value."""
    bands = band_names(pixels)

    def cells(v: Column, n: Column, m: Column) -> Column:
        step = n / m
        low, high = F.floor(v / step).cast("long"), F.least(F.ceil((v + 1) / step) - 1, m - 1).cast("long")
        return F.transform(F.sequence(low, F.greatest(low, high)), lambda t: F.struct(t.alias("t"), (F.least(v + 1.0, (t + 1) * step) - F.greatest(v * 1.0, t * step)).alias("o")))

    rows = pixels.withColumns({"__m": F.lit(False) if masked is None else masked, "__nh": new_h, "__nw": new_w})
    rows = rows.withColumn("__ty", F.explode(cells(F.col("y"), F.col("h"), F.col("__nh")))).withColumn("__tx", F.explode(cells(F.col("x"), F.col("w"), F.col("__nw"))))
    rows = rows.withColumn("__o", F.col("__ty.o") * F.col("__tx.o")).filter("__o > 1e-12")
    means = [F.sum(F.col(b) * F.col("__o")) / F.sum(F.when(F.col(b).isNotNull(), F.col("__o"))) for b in bands]
    if restore is not None:
        means = [F.when(F.bool_or("__m"), F.lit(restore)).otherwise(m) for m in means]
    return rows.groupBy("image_id", F.col("__ty.t").alias("y"), F.col("__tx.t").alias("x")).agg(*[m.alias(b) for m, b in zip(means, bands)])


def _cubic(d: Column, a: float = -0.75) -> Column:
    t = F.abs(d)
    near = (a + 2) * t * t * t - (a + 3) * t * t + 1
    far = a * t * t * t - 5 * a * t * t + 8 * a * t - 4 * a
    return F.when(t <= 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def _weights(at: Column, n: Column, taps: int, clamp: bool) -> Column:
    """Structs (p, w): source places around a coordinate and their weights."""
    base = F.floor(at).cast("long")
    weight = (lambda p: F.greatest(F.lit(0.0), 1 - F.abs(at - p))) if taps == 2 else (lambda p: _cubic(at - p))
    one = lambda p: F.struct((F.greatest(F.lit(0).cast("long"), F.least(p, n.cast("long") - 1)) if clamp else p).alias("p"), weight(p).alias("w"))
    return F.transform(F.sequence(base - (taps // 2 - 1), base + taps // 2), one)


def _touched(weight: Column, masked: str = "__m") -> Column:
    """Whether a masked source pixel has a weight in a target: the greatest mask among those that weigh anything."""
    return F.max(F.when(F.abs(weight) > 1e-12, F.col(masked)))


def _restored(rows: DataFrame, bands: list[str], restore: float | None) -> DataFrame:
    """Targets with ``__m`` get the restore value in every band."""
    value = F.lit(None if restore is None else float(restore)).cast("double")
    return rows.withColumns({b: F.when(F.col("__m") > 0, value).otherwise(F.col(b)) for b in bands})


def _gathered(grid: DataFrame, pixels: DataFrame, taps: int, clamp: bool, masked: Column | None = None, restore: float | None = None) -> DataFrame:
    """Weighted sums over source pixels for grid rows (image_id, y, x, sy, sx, h, w): one explode, one join, one sum."""
    bands = band_names(pixels)
    pixels = pixels.withColumn("__m", (F.lit(False) if masked is None else masked).cast("int"))
    rows = grid.withColumn("__a", F.explode(_weights(F.col("sy"), F.col("h"), taps, clamp))).withColumn("__b", F.explode(_weights(F.col("sx"), F.col("w"), taps, clamp)))
    rows = rows.select("image_id", "y", "x", F.col("__a.p").alias("__y"), F.col("__b.p").alias("__x"), (F.col("__a.w") * F.col("__b.w")).alias("__w"))
    source = pixels.select(F.col("image_id").alias("__i"), F.col("y").alias("__y2"), F.col("x").alias("__x2"), *bands, "__m")
    joined = rows.join(source, (F.col("image_id") == F.col("__i")) & (F.col("__y") == F.col("__y2")) & (F.col("__x") == F.col("__x2")), "left")
    value = (lambda b: F.sum(F.col("__w") * F.col(b))) if clamp else (lambda b: F.sum(F.col("__w") * F.coalesce(F.col(b), F.lit(0.0))))
    out = joined.groupBy("image_id", "y", "x").agg(*[value(b).alias(b) for b in bands], _touched(F.col("__w")).alias("__m"))
    return _restored(out, bands, restore).drop("__m")


def _grid(sizes: DataFrame) -> DataFrame:
    """Rows and columns of each image's target raster of new_h by new_w."""
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("new_h").cast("long") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("new_w").cast("long") - 1)))


#: Target pixels that one task gathers, where their number is known.
CELLS = 1 << 19


def parts_of(sizes: DataFrame) -> int:
    """How many tasks gather CELLS target pixels of all images each; at least as many as there are shuffle partitions."""
    cells = sizes.agg(F.sum(F.col("new_h").cast("long") * F.col("new_w"))).first()[0] or 0
    return max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // CELLS))


def enlarge(pixels: DataFrame, sizes: DataFrame, cubic: bool = False, masked: Column | None = None, restore: float | None = None, parts: int | None = None) -> DataFrame:
    """Bilinear or cubic values on a larger raster; sizes has image_id, h, w, new_h, new_w. Edges repeat. With ``parts`` (see
    :func:`parts_of`) so many tasks gather the pixels, and what one of them holds does not grow with the input.

    The weights are products, so that rows are interpolated first and columns then: 4 and 4 source values, not 16. A mask is
    carried beside the bands: a target in which a masked pixel has a weight gets the restore value."""
    bands, taps = band_names(pixels), 4 if cubic else 2

    def along(rows: DataFrame, axis: str, other: str, n: str, new: str) -> DataFrame:
        places = sizes.withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), F.col(new).cast("long") - 1)))
        at = (F.col("__t") + 0.5) * F.col(n) / F.col(new) - 0.5
        places = places.withColumn("__w", F.explode(_weights(at, F.col(n), taps, True))).select("image_id", "__t", F.col("__w.p").alias(axis), F.col("__w.w").alias("__w"))
        if parts:
            rows, places = rows.repartition(parts, "image_id", axis), places.repartition(parts, "image_id", axis)
        joined = rows.join(places, ["image_id", axis])
        return joined.groupBy("image_id", F.col("__t").alias(axis), other).agg(*[F.sum(F.col("__w") * F.col(b)).alias(b) for b in bands], _touched(F.col("__w")).alias("__m"))

    rows = pixels.withColumn("__m", (F.lit(False) if masked is None else masked).cast("int")).select("image_id", "y", "x", *bands, "__m")
    rows = along(along(rows, "y", "x", "h", "new_h"), "x", "y", "w", "new_w")
    return _restored(rows, bands, restore).select("image_id", "y", "x", *bands)


def resize(pixels: DataFrame, new_h: Column, new_w: Column, masked: Column | None = None, restore: float | None = None) -> DataFrame:
    """pixels (with their image's h and w) on rasters of another size, with the new size as h and w.

    By each image's factors: area averages if a side shrinks, bilinear values below double, cubic ones from there; an
    unchanged size passes. Wherever a masked pixel has a weight, whatever the method, the target gets the restore value."""
    bands = band_names(pixels)
    rows = pixels.withColumns({"__nh": new_h.cast("long"), "__nw": new_w.cast("long"), "__masked": F.lit(False) if masked is None else masked})
    masked, restore = (None, None) if masked is None else (F.col("__masked"), restore)
    small = (F.col("__nh") < F.col("h")) | (F.col("__nw") < F.col("w"))
    same = (F.col("__nh") == F.col("h")) & (F.col("__nw") == F.col("w"))
    most = F.greatest(F.col("__nh") / F.col("h"), F.col("__nw") / F.col("w"))
    keep = ["image_id", "y", "x", *bands]
    sizes = rows.select("image_id", "h", "w", F.col("__nh").alias("new_h"), F.col("__nw").alias("new_w"), small.alias("small"), same.alias("same"), most.alias("most")).distinct()
    less = shrink(rows.filter(small).drop("__nh", "__nw"), new_h, new_w, masked, restore)
    grown = [enlarge(rows.filter(~small & ~same & f(most)).select(*keep, "__masked"), sizes.filter(~F.col("small") & ~F.col("same") & f(F.col("most"))), cubic, masked, restore) for f, cubic in ((lambda c: c < 2, False), (lambda c: c >= 2, True))]
    out = rows.filter(same).select(*keep)
    for part in (less, *grown):
        out = out.unionByName(part.select(*keep))
    return out.join(sizes.select("image_id", F.col("new_h").alias("h"), F.col("new_w").alias("w")), "image_id")


def warp(pixels: DataFrame, sizes: DataFrame, matrix: list[Column], masked: Column | None = None, restore: float | None = None) -> DataFrame:
    """Bilinear values where a 3 by 3 matrix (nine Columns over sizes) maps each target pixel; zero outside. A target in which a
    masked pixel has a weight gets the restore value.

    sizes has image_id, h, w and, if the matrix was found at another size, calc_h and calc_w."""
    m = matrix
    kx = F.coalesce(F.col("calc_w") / F.col("w"), F.lit(1.0)) if "calc_w" in sizes.columns else F.lit(1.0)
    ky = F.coalesce(F.col("calc_h") / F.col("h"), F.lit(1.0)) if "calc_h" in sizes.columns else F.lit(1.0)
    grid = _grid(sizes.withColumns({"new_h": F.col("h"), "new_w": F.col("w")}))
    x, y = F.col("x") * kx, F.col("y") * ky
    below = m[6] * x + m[7] * y + m[8]
    sx, sy = (m[0] * x + m[1] * y + m[2]) / below / kx, (m[3] * x + m[4] * y + m[5]) / below / ky
    return _gathered(grid.withColumns({"sx": sx, "sy": sy}), pixels, 2, False, masked, restore)


def random_points(sizes: DataFrame, n: int, seed: int = 12345) -> DataFrame:
    """n points per image (columns image_id, h, w), uniform over the raster and the same in every run."""
    rows = sizes.withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(n))))
    unit = lambda axis: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{axis}"), F.col("image_id").cast("string"), F.col("point").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    return rows.select("image_id", "point", F.floor(unit("x") * F.col("w")).alias("x"), F.floor(unit("y") * F.col("h")).alias("y"))
