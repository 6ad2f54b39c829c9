"""Edit recipes as a whole: rectangles and points carried through them, masks by polygon name, and the full replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import append_band, parse
from ..session import written
from .catalog import resized
from .geometry import crop_first, replay, resize, shrink, warp
from .radiometry import match_mean_std, stretch
from .shapes import spans
from .zonal import band_names


def rotated_rect(x: Column, y: Column, w: Column, h: Column, ref_w: Column, ref_h: Column, degrees: Column) -> Column:
    """The bounding box of a rectangle's turned corners, clamped to the turned raster; an empty one is all zeros."""
    r = F.pmod(F.floor(degrees / 90), F.lit(4))
    x2, y2 = x + w, y + h
    left = F.when(r == 1, ref_h - 1 - y2).when(r == 2, ref_w - 1 - x2).when(r == 3, y).otherwise(x)
    right = F.when(r == 1, ref_h - 1 - y).when(r == 2, ref_w - 1 - x).when(r == 3, y2).otherwise(x2)
    top = F.when(r == 1, x).when(r == 2, ref_h - 1 - y2).when(r == 3, ref_w - 1 - x2).otherwise(y)
    bottom = F.when(r == 1, x2).when(r == 2, ref_h - 1 - y).when(r == 3, ref_w - 1 - x).otherwise(y2)
    new_w, new_h = F.when(r % 2 == 1, ref_h).otherwise(ref_w), F.when(r % 2 == 1, ref_w).otherwise(ref_h)
    a, b = F.greatest(F.lit(0), left), F.greatest(F.lit(0), top)
    empty = (w <= 0) | (h <= 0)
    value = lambda c: F.when(empty, F.lit(0)).otherwise(c).cast("int")
    return F.struct(
        value(a).alias("x"), value(b).alias("y"),
        value(F.greatest(F.lit(0), F.least(new_w, right) - a)).alias("width"), value(F.greatest(F.lit(0), F.least(new_h, bottom) - b)).alias("height"),
    )


def crop_basis(raw_w: Column, raw_h: Column, given: Column | None = None) -> Column:
    """Whether a crop is meant before or after the turn: as given, else by which size its reference has, else after."""
    swap = F.col("rotate") % 180 != 0
    turned_w, turned_h = F.when(swap, raw_h).otherwise(raw_w), F.when(swap, raw_w).otherwise(raw_h)
    after = (F.col("ref_w") == turned_w) & (F.col("ref_h") == turned_h)
    before = (F.col("ref_w") == raw_w) & (F.col("ref_h") == raw_h)
    found = F.when(F.coalesce(after, F.lit(False)), "after_rotate").when(F.coalesce(before, F.lit(False)), "pre_rotate").otherwise("after_rotate")
    return found if given is None else F.when(F.lower(given).isin("pre_rotate", "after_rotate"), F.lower(given)).otherwise(found)


def _turn(x: Column, y: Column, w: Column, h: Column, deg: Column) -> tuple[Column, Column]:
    nx = F.when(deg == 90, h - y).when(deg == 180, w - x).when(deg == 270, y).otherwise(x)
    ny = F.when(deg == 90, x).when(deg == 180, h - y).when(deg == 270, w - x).otherwise(y)
    return nx, ny


def _steps(raw_w: Column, raw_h: Column) -> dict[str, Column]:
    """Sizes and the crop's offset at each stage of a recipe, for continuous coordinates."""
    deg = F.col("rotate")
    swap = deg.isin(90, 270)
    first = crop_first(raw_h, raw_w)
    turned_w, turned_h = F.when(swap, raw_h).otherwise(raw_w), F.when(swap, raw_w).otherwise(raw_h)
    at_w, at_h = F.when(first, raw_w).otherwise(turned_w), F.when(first, raw_h).otherwise(turned_h)
    sx, sy = at_w / F.greatest(F.col("ref_w"), F.lit(1)), at_h / F.greatest(F.col("ref_h"), F.lit(1))
    crop_w, crop_h = F.greatest(F.lit(1.0), F.col("crop_w") * sx), F.greatest(F.lit(1.0), F.col("crop_h") * sy)
    end_w, end_h = F.when(first & swap, crop_h).otherwise(crop_w), F.when(first & swap, crop_w).otherwise(crop_h)
    size = resized(end_w, end_h, scale=F.col("scale"))
    return {
        "deg": deg, "first": first, "turned_w": turned_w, "turned_h": turned_h, "dx": F.col("crop_x") * sx, "dy": F.col("crop_y") * sy,
        "crop_w": crop_w, "crop_h": crop_h, "kx": size["width"] / end_w, "ky": size["height"] / end_h,
    }


def raw_to_edited(x: Column, y: Column, raw_w: Column, raw_h: Column) -> Column:
    """A point of the raw raster on the edited one (recipe columns beside it): turn and crop in their order, then resize."""
    s = _steps(raw_w, raw_h)
    tx, ty = _turn(x, y, raw_w, raw_h, s["deg"])
    cx, cy = _turn(x - s["dx"], y - s["dy"], s["crop_w"], s["crop_h"], s["deg"])
    px, py = F.when(s["first"], cx).otherwise(tx - s["dx"]), F.when(s["first"], cy).otherwise(ty - s["dy"])
    return F.struct((px * s["kx"]).alias("x"), (py * s["ky"]).alias("y"))


def edited_to_raw(x: Column, y: Column, raw_w: Column, raw_h: Column) -> Column:
    """The inverse of :func:`raw_to_edited`."""
    s = _steps(raw_w, raw_h)
    x, y = x / s["kx"], y / s["ky"]
    back = (360 - s["deg"]) % 360
    swap = s["deg"].isin(90, 270)
    late_w, late_h = F.when(swap, s["crop_h"]).otherwise(s["crop_w"]), F.when(swap, s["crop_w"]).otherwise(s["crop_h"])
    ax, ay = _turn(x, y, late_w, late_h, back)
    bx, by = _turn(x + s["dx"], y + s["dy"], s["turned_w"], s["turned_h"], back)
    return F.struct(F.when(s["first"], ax + s["dx"]).otherwise(bx).alias("x"), F.when(s["first"], ay + s["dy"]).otherwise(by).alias("y"))


def mask_polygons(polygons: DataFrame, wanted: DataFrame, key: str = "poly_id") -> DataFrame:
    """Polygons of three points or more whose name an image's mask list (image_id, names) holds; image keys match by case-folded text."""
    lists = wanted.select(F.lower(F.col("image_id").cast("string")).alias("__i"), "names")
    rows = polygons.join(lists, F.lower(F.col("image_id").cast("string")) == F.col("__i"))
    return rows.filter(F.array_contains("names", F.col("name")) & (F.size("points") >= 3)).select(*polygons.columns)


def combined_mask(pixels: DataFrame, missing: Column, polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """pixels with ``masked``: missing, or inside one of the polygons."""
    s = spans(polygons, key, ("image_id",))
    hit = s.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x")).distinct().withColumn("__in", F.lit(True))
    rows = pixels.join(hit, ["image_id", "y", "x"], "left")
    return rows.withColumn("masked", missing | F.coalesce("__in", F.lit(False))).drop("__in")


def feature_input(pixels: DataFrame, longest: int = 800, bytes_already: bool = False, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """R, G, B bytes for image features (pixels carry h and w): the first three bands, stretched between their pooled 1 and
    99 percentiles unless they are bytes; a single band stands for all three; a region y0, y1, x0, x1; and area averages
    where a side is over ``longest``."""
    bands = band_names(pixels)[:3]
    rows = pixels.select("image_id", "y", "x", "h", "w", *bands)
    if not bytes_already:
        rows = stretch(rows, bands, 1, 99, pooled=True)
    if len(bands) < 3:
        rows = rows.withColumns({b: F.col(bands[0]) for b in ("b1", "b2", "b3")})
    if roi:
        y0, y1, x0, x1 = roi
        rows = rows.filter(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0, "h": F.lit(y1 - y0), "w": F.lit(x1 - x0)})
    k = F.least(F.lit(1.0), longest / F.greatest("h", "w"))
    small = F.struct(F.greatest(F.lit(1), F.rint(F.col("h") * k)).cast("int").alias("h"), F.greatest(F.lit(1), F.rint(F.col("w") * k)).cast("int").alias("w"))
    out = shrink(rows, small["h"], small["w"])
    sizes = rows.select("image_id", small.alias("s")).distinct()
    return out.join(sizes, "image_id").select("image_id", "y", "x", *[F.rint(b).cast("int").alias(b) for b in ("b1", "b2", "b3")], "s.h", "s.w")


MATRIX = tuple(f"m{k}" for k in range(9))


def geometry_only(pixels: DataFrame, recipes: DataFrame, h: int, w: int, masked: Column | None = None, restore: float | None = None) -> DataFrame:
    """Turn, crop and resize of each image's recipe (column scale, in percent), one lazy plan."""
    return _resized(replay(pixels, recipes.select(*_turning(recipes)), h, w), recipes, masked, restore).drop("h", "w")


def _turning(recipes: DataFrame) -> list[str]:
    return [c for c in recipes.columns if c != "scale" and c not in MATRIX]


def _resized(rows: DataFrame, recipes: DataFrame, masked: Column | None, restore: float | None) -> DataFrame:
    rows = rows.join(recipes.select("image_id", F.col("scale").alias("__scale")), "image_id", "left")
    size = resized(F.col("w"), F.col("h"), scale=F.coalesce("__scale", F.lit(100.0)))
    sized = rows.withColumns({"__rh": size["height"], "__rw": size["width"]}).drop("__scale")
    return resize(sized, F.col("__rh"), F.col("__rw"), masked, restore)


def registered(rows: DataFrame, recipes: DataFrame) -> DataFrame:
    """rows (with h and w) warped by their image's matrix, the recipe columns m0 to m8; images without one stay as they are."""
    if MATRIX[0] not in recipes.columns:
        return rows
    have = recipes.filter(F.col(MATRIX[0]).isNotNull()).select("image_id", *MATRIX)
    sizes = rows.select("image_id", "h", "w").distinct().join(have, "image_id")
    moved = warp(rows.join(have.select("image_id"), "image_id", "left_semi").drop("h", "w"), sizes, [F.col(m) for m in MATRIX])
    moved = moved.join(sizes.select("image_id", "h", "w"), "image_id")
    return rows.join(have.select("image_id"), "image_id", "left_anti").unionByName(moved.select(*rows.columns))


def edited(
    pixels: DataFrame, recipes: DataFrame, h: int, w: int, reference: dict[str, tuple[float, float]] | None = None, expression: str | None = None,
    after_resize: bool = True, masked: Column | None = None, restore: float | None = None, model=None, model_bands: list[str] | None = None,
) -> DataFrame:
    """The whole replay: turn and crop, histogram match, resize, registration, then a derived band and a class band.

    The match comes before the resize, but behind it and the registration for images that shrink (``after_resize``), which
    changes results and so is a choice. What the crop leaves is written once, since matching and resizing read it many times.
    ``masked`` pixels give their target cells ``restore`` when an image shrinks. The
    class band is a model's class of each pixel, from ``model_bands``."""
    rows = written(replay(pixels, recipes.select(*_turning(recipes)), h, w))

    def matched(some: DataFrame) -> DataFrame:
        sizes = some.select("image_id", "h", "w").distinct()
        return match_mean_std(some.drop("h", "w"), reference).join(sizes, "image_id").select(*some.columns)

    def placed(some: DataFrame) -> DataFrame:
        return registered(_resized(some, recipes, masked, restore), recipes)

    if not reference:
        out = placed(rows)
    else:
        late = recipes.filter("scale < 100").select("image_id") if after_resize else recipes.filter("false").select("image_id")
        out = matched(placed(rows.join(late, "image_id", "left_semi"))).unionByName(placed(matched(rows.join(late, "image_id", "left_anti"))))
    out = out.drop("h", "w")
    if expression:
        out = append_band(out, parse(expression, band_names(out))[0])
    if model is not None:
        from .learn import class_map

        bands = band_names(out)
        classes = class_map(model, out, model_bands or bands).withColumnRenamed("class_id", f"b{len(bands) + 1}")
        out = out.join(classes, ["image_id", "y", "x"])
    return out
