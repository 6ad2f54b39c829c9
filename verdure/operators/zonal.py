"""Extraction and statistics of pixels in polygons: joins of row spans with pixels, and aggregations over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import quantiles as selected
from .shapes import spans


def band_names(pixels: DataFrame) -> list[str]:
    return sorted((c for c in pixels.columns if re.fullmatch(r"b\d+", c)), key=lambda c: int(c[1:]))


def pixels_in(pixels: DataFrame, polygons: DataFrame, keep: tuple[str, ...] = ("grp",), key: str = "poly_id", pairs: bool = True) -> DataFrame:
    """Pixels with the polygon that they lie in; a pixel in several polygons comes once for each.

    An equality join on (image, row) with the span as a residual test. Spans are small beside pixels, so the planner
    may send them to all tasks where their measured size allows; else both sides meet by key, with skewed keys split."""
    s = spans(polygons, key, ("image_id", *keep), pairs)
    on = (s["image_id"] == pixels["image_id"]) & (s["y"] == pixels["y"]) & pixels["x"].between(s["x0"], s["x1"])
    return pixels.join(s, on).select(s[key], *[s[k] for k in keep], *[pixels[c] for c in pixels.columns])


def zonal(pixels: DataFrame, polygons: DataFrame, aggregates: list[Column], missing: Column | None = None, keep: tuple[str, ...] = ("grp",), key: str = "poly_id") -> DataFrame:
    """Aggregates per polygon over its pixels that are not missing; polygons without any keep a row of NULLs."""
    found = pixels_in(pixels if missing is None else pixels.filter(~missing), polygons, (), key)
    stats = found.groupBy(key).agg(*aggregates)
    return polygons.select(key, "image_id", *keep).join(stats, key, "left")


def statistics(value: str, quantiles: tuple[float, ...] = (5, 25, 50, 75, 95), approximate: bool = False) -> list[Column]:
    """Mean, median, population deviation and quantiles of the finite values of a column, as aggregates.

    Quantiles up to 1 are fractions, others percents, clamped. The approximate form holds bounded sketches per group."""
    fractions = [min(1.0, max(0.0, q if q <= 1 else q / 100)) for q in quantiles]
    v = F.col(value)
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    q = (lambda f: F.percentile_approx(v, f, 10000)) if approximate else (lambda f: F.percentile(v, F.lit(f)))
    named = [q(f).alias(f"{value}_q{round(f * 100, 6):g}") for f in fractions]
    return [F.avg(v).alias(f"{value}_mean"), q(0.5).alias(f"{value}_median"), F.stddev_pop(v).alias(f"{value}_std"), *named]


def scene_statistics(pixels: DataFrame, value: str, quantiles: tuple[float, ...] = (5, 25, 50, 75, 95), image: str = "image_id") -> DataFrame:
    """The same for whole images, whose values no task holds: (image, mean, median, std and quantiles of the finite values)."""
    fractions = [min(1.0, max(0.0, q if q <= 1 else q / 100)) for q in quantiles]
    finite = pixels.filter(~F.isnan(value) & (F.abs(value) != float("inf")))
    plain = pixels.select(image).distinct().join(finite.groupBy(image).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std")), image, "left")
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("value")))
    named = [at(f).alias(f"{value}_q{round(f * 100, 6):g}") for f in fractions]
    cuts = selected(finite, [image], {value: [value]}, [0.5, *fractions]).groupBy(image).agg(at(0.5).alias(f"{value}_median"), *named)
    return plain.join(cuts, image, "left")


def class_counts(classified: DataFrame, polygons: DataFrame, classes: list[int], column: str = "class_id", key: str = "poly_id") -> DataFrame:
    """Pixels of each class per polygon, one column per class; polygons without pixels have zeros."""
    counts = [F.sum((F.col(column) == c).cast("long")).alias(f"class_{c}") for c in classes]
    rows = pixels_in(classified, polygons, (), key).groupBy(key).agg(*counts)
    return polygons.select(key).join(rows, key, "left").na.fill(0)


def windows(pixels: DataFrame, centres: DataFrame, size: int, bands: list[str], border: str = "reflect", image: str = "image_id") -> DataFrame:
    """centres (image, y, x and further columns) with each band's size x size neighbourhood as columns band_w0, band_w1, ...

    Border: 'reflect' mirrors without repeating the edge, 'edge' repeats it, 'drop' leaves out centres that reach over it or
    miss a pixel. Pixels are gathered to strips, a row per line; a strip is sent once to each line that sees it, and only to
    lines with a centre. There a window is ``size`` strips, and its cells are places in their arrays."""
    half = size // 2

    def within(v: Column, top: Column) -> Column:
        if border == "edge":
            return F.least(F.greatest(v, F.lit(0)), top)
        folded = F.abs(v)
        return v if border == "drop" else F.greatest(F.lit(0), F.when(folded > top, 2 * top - folded).otherwise(folded))

    lines = _lines(pixels, bands, image)
    # lines at most half a window away, and by which step each of them sees this one
    sees = F.flatten(
        F.transform(
            F.sequence(F.greatest(F.lit(0), F.col("y") - half).cast("int"), F.least(F.col("__my"), F.col("y") + half).cast("int")),
            lambda to: F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda dy: F.struct(to.alias("to"), dy.alias("dy"), within(to + dy, F.col("__my")).alias("line"))),
        )
    )
    sent = lines.withColumn("__s", F.explode(F.filter(sees, lambda t: t["line"] == F.col("y"))))
    sent = sent.select(F.col(image).alias("__i"), F.col("__s.to").cast("long").alias("__to"), F.col("__s.dy").alias("__dy"), "__mx", "__cells")
    wanted = centres.select(F.col(image).alias("__i"), F.col("y").cast("long").alias("__to")).distinct()
    sent = sent.join(wanted, ["__i", "__to"], "left_semi")
    stacked = sent.groupBy("__i", "__to").agg(F.any_value("__mx").alias("__mx"), F.map_from_entries(F.collect_list(F.struct("__dy", "__cells"))).alias("__stack"))
    stacked = stacked.select("__i", "__to", "__mx", F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda d: F.try_element_at("__stack", d)).alias("__stack"))
    rows = centres.join(stacked, (F.col(image) == F.col("__i")) & (F.col("y").cast("long") == F.col("__to")))

    def cell(i: int) -> Column:
        x = within(F.col("x") + (i % size - half), F.col("__mx")).cast("int")
        return F.when((x >= 0) & (x <= F.col("__mx")), F.get(F.get("__stack", i // size), x))

    rows = rows.withColumn("__w", F.array(*[cell(i) for i in range(size * size)]))
    if border == "drop":
        rows = rows.filter(~F.exists("__w", lambda c: c.isNull()))
    return rows.select(*centres.columns, *[F.get("__w", i)[b].alias(f"{b}_w{i}") for b in bands for i in range(size * size)])


def _lines(pixels: DataFrame, bands: list[str], image: str) -> DataFrame:
    """(image, y, __cells, __mx, __my): lines as arrays of structs of bands by x, NULL where a pixel is not there."""
    cell = F.struct(F.col("x").cast("int").alias("x"), F.struct(*bands).alias("v"))
    lines = pixels.groupBy(image, "y").agg(F.sort_array(F.collect_list(cell)).alias("__c"))
    area = pixels.groupBy(image).agg(F.max("y").alias("__my"), F.max("x").alias("__mx"))  # a row per image
    lines = lines.join(area, image)
    held = F.map_from_entries("__c")
    gaps = F.transform(F.sequence(F.lit(0), F.col("__mx").cast("int")), lambda x: F.try_element_at(held, x))
    return lines.select(image, "y", "__mx", "__my", F.when(F.size("__c") == F.col("__mx") + 1, F.col("__c.v")).otherwise(gaps).alias("__cells"))


def channel_layout(rows: DataFrame, n_bands: int, any_rgb: bool) -> DataFrame:
    """Band columns under export names: R, G, B, band_4.. if some image has three bands, else channel_1.."""
    names = {f"b{i}": ("RGB"[i - 1] if i <= 3 else f"band_{i}") if any_rgb else f"channel_{i}" for i in range(1, n_bands + 1)}
    return rows.select(*[c for c in rows.columns if c not in names], *[(F.col(b) if b in rows.columns else F.lit(None).cast("double")).alias(n) for b, n in names.items()])


def probe(pixels: DataFrame, points: DataFrame, missing: Column, value: Column) -> DataFrame:
    """Band values, a derived value and the missing flag at given (image_id, y, x) points; points off the raster get NULLs."""
    rows = pixels.withColumns({"value": value, "missing": missing})
    return points.join(rows, ["image_id", "y", "x"], "left")


def inventory(polygons: DataFrame) -> DataFrame:
    """Per group: polygons, point sets and dots, most first, and the two least image names as examples."""
    n, name = F.size("points"), F.col("image_id").cast("string")
    rows = polygons.select("grp", n.alias("n"), name.alias("image"))
    counts = rows.groupBy("grp").agg(
        F.count("*").alias("shapes"), F.sum((F.col("n") >= 3).cast("long")).alias("polygons"), F.sum((F.col("n") < 3).cast("long")).alias("point_sets"),
        F.sum(F.when(F.col("n") < 3, F.col("n")).otherwise(0)).cast("long").alias("dots"), F.min("image").alias("__first"),
    )
    # the least name above the least one: two aggregates of one value each, whatever a group's size
    firsts = counts.select(F.col("grp").alias("__g"), F.col("__first").alias("__f"))
    second = rows.join(firsts, F.col("grp").eqNullSafe(F.col("__g"))).filter("image > __f").groupBy("__g").agg(F.min("image").alias("__second"))
    out = counts.join(second, F.col("grp").eqNullSafe(F.col("__g")), "left")
    return out.select("grp", "shapes", "polygons", "point_sets", "dots", F.array_compact(F.array("__first", "__second")).alias("examples"))


def inventory_by_root(polygons: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root, labelled ``id (name)`` where roots (root, root_name) names it: shapes, polygons, point sets, dots, two examples."""
    named = polygons.join(roots, "root", "left")
    label = F.when(F.col("root").isNull(), "No Root ID").when(F.col("root_name").isNull(), F.col("root")).otherwise(F.concat("root", F.lit(" ("), "root_name", F.lit(")")))
    return inventory(named.withColumn("grp", label)).withColumnRenamed("grp", "label")


def chips(pixels: DataFrame, polygons: DataFrame, grow: float = 1.4, least: int = 16, key: str = "poly_id") -> DataFrame:
    """Pixels of each polygon's bounding box, grown and at least ``least`` wide, with chip-relative coordinates."""
    lo = lambda k: F.array_min(F.transform("points", lambda p: p[k]))
    hi = lambda k: F.array_max(F.transform("points", lambda p: p[k]))
    box = polygons.select(key, F.col("image_id").alias("__i"), *[f.alias(n) for n, f in (("__x0", lo("x")), ("__x1", hi("x")), ("__y0", lo("y")), ("__y1", hi("y")))])
    for k in "xy":
        mid = (F.col(f"__{k}0") + F.col(f"__{k}1")) / 2
        half = F.greatest((F.col(f"__{k}1") - F.col(f"__{k}0")) * grow, F.lit(float(least))) / 2
        box = box.withColumns({f"__{k}a": F.greatest(F.lit(0), F.floor(mid - half)).cast("long"), f"__{k}b": F.ceil(mid + half).cast("long")})
    # a row per polygon and raster row makes the join one of equal keys with a small range test
    rows = box.select(key, "__i", "__xa", "__xb", "__ya", F.explode(F.sequence("__ya", "__yb")).alias("__y"))
    joined = pixels.join(rows, (pixels["image_id"] == rows["__i"]) & (pixels["y"] == rows["__y"]) & pixels["x"].between(rows["__xa"], rows["__xb"]))
    bands = band_names(pixels)
    return joined.select(key, "image_id", (F.col("y") - F.col("__ya")).alias("chip_y"), (F.col("x") - F.col("__xa")).alias("chip_x"), *bands)
