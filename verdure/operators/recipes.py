"""Recipe documents from text to pixels: JSON read once into typed columns, sizes folded per image, and one replay for all.

A recipe is a JSON document with ``rotate``, ``crop_rect`` and ``crop_rect_ref_size``, ``resize``, ``hist_match``, ``registration``,
``band_expression``, ``nodata_values`` and flags ``rotate_enabled``, ``crop_enabled``, ``hist_enabled``, ``resize_enabled``,
``band_enabled``, ``nodata_enabled`` (true if absent). Documents that are no JSON objects, and images without one, change
nothing. Images of any sizes go through one plan: what a recipe asks for is data, not code, except formulas, of which each
distinct one is compiled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import append_band, finite, parse
from ..session import written
from . import strips as S
from .catalog import resized
from .geometry import crop_box, crop_first, turned, warp
from .radiometry import MATCH_BINS, interpolated
from .zonal import band_names

#: Distinct formulas that one replay compiles.
MOST_FORMULAS = 200
_RULE = r"^\s*b(\d+)\s*(<=|>=|==|!=|<|>)\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*$"
CDF = "array<struct<x:array<double>,y:array<double>,lo:double,hi:double>>"


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get(F.col("__v"), path, kind)


def _int(path: str) -> Column:
    return _get(path, "double").cast("int")


def _enabled(name: str) -> Column:
    return F.coalesce(_get(f"$.{name}_enabled", "boolean"), F.lit(True))


def typed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """bodies with a column ``recipe``: the document as a struct, parsed once. What a flag switches off is NULL."""
    nodata = F.transform(
        _get("$.nodata_values", "array<variant>"),
        lambda i: F.struct(F.when(F.schema_of_variant(i) != "STRING", F.try_variant_get(i, "$", "double")).alias("value"), F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")).alias("text")),
    )
    rule = lambda i, k: F.nullif(F.regexp_extract(i["text"], _RULE, k), F.lit(""))
    rules = F.transform(nodata, lambda i: F.struct(i["value"].alias("value"), rule(i, 1).cast("int").alias("band"), rule(i, 2).alias("op"), rule(i, 3).cast("double").alias("limit")))
    turn = F.pmod(F.coalesce(_int("$.rotate"), F.lit(0)), F.lit(360))
    crop = F.struct(*[F.coalesce(_int(f"$.crop_rect.{k}"), F.lit(0)).alias(n) for k, n in (("x", "crop_x"), ("y", "crop_y"), ("width", "crop_w"), ("height", "crop_h"))], *[_int(f"$.crop_rect_ref_size.{k}").alias(f"ref_{k}") for k in "wh"])
    size = F.struct(*[_int(f"$.resize.{k}").alias(n) for k, n in (("px_w", "px_w"), ("px_h", "px_h"), ("scale", "scale"), ("width", "pct_w"), ("height", "pct_h"))])
    mode = F.lower(F.coalesce(_get("$.hist_match.mode", "string"), F.lit("meanstd")))
    hist = F.struct(mode.alias("mode"), _get("$.hist_match.ref_stats", "array<struct<mean:double,std:double>>").alias("stats"), _get("$.hist_match.ref_cdf.per_band", CDF).alias("cdf"))
    m = _get("$.registration.matrix", "array<array<double>>")
    cell = lambda i, j: F.get(F.get(m, i), j)
    flat = F.array(*[cell(i, j) for i in range(3) for j in range(3)])
    reduced = F.array(cell(0, 0), cell(0, 1), cell(0, 3), cell(1, 0), cell(1, 1), cell(1, 3), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    matrix = F.when(F.size(m) == 3, flat).when(F.size(m) == 4, reduced)
    has = lambda path: F.coalesce(F.schema_of_variant(_get(path, "variant")).startswith("OBJECT"), F.lit(False))
    whole = F.struct(
        F.when(_enabled("rotate") & turn.isin(90, 180, 270), turn).otherwise(0).alias("rotate"),
        F.when(_enabled("crop") & has("$.crop_rect"), crop).alias("crop"),
        F.when(_enabled("resize") & has("$.resize"), size).alias("resize"),
        F.when(_enabled("hist") & has("$.hist_match") & ~mode.isin("none", ""), hist).alias("hist"),
        F.when(F.coalesce(_get("$.registration.enabled", "boolean"), F.lit(False)), matrix).alias("matrix"),
        F.when(F.coalesce(_get("$.registration.enabled", "boolean"), F.lit(False)), _get("$.registration.calc_shape", "array<double>")).alias("calc"),
        F.when(_enabled("band"), F.nullif(F.trim(_get("$.band_expression", "string")), F.lit(""))).alias("formula"),
        F.when(_enabled("nodata"), F.filter(rules, lambda i: i["value"].isNotNull() | i["limit"].isNotNull())).alias("nodata"),
    )
    rows = bodies.withColumn("__v", F.try_parse_json(F.col(body)))
    return rows.withColumn("recipe", F.when(F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False)), whole)).drop("__v")


def planned(images: DataFrame) -> DataFrame:
    """images (image_id, h, w, recipe) with every size that the replay goes through, without touching pixels.

    ``rotate``, ``first`` (crop before the turn), ``box`` (of the crop), ``cut_h`` and ``cut_w`` (after both), ``new_h`` and ``new_w``, ``kind`` of
    resampling (NULL: none), ``late`` (match after the resize) and ``restore``."""
    r = lambda k: F.col(f"recipe.{k}")
    rows = images.withColumns({"rotate": F.coalesce(r("rotate"), F.lit(0)), **{c: F.col(f"recipe.crop.{c}") for c in ("crop_x", "crop_y", "crop_w", "crop_h", "ref_w", "ref_h")}})
    swap = F.col("rotate").isin(90, 270)
    rows = rows.withColumn("first", crop_first(F.col("h"), F.col("w")) & r("crop").isNotNull())
    turned_h, turned_w = F.when(swap, F.col("w")).otherwise(F.col("h")), F.when(swap, F.col("h")).otherwise(F.col("w"))
    rows = rows.withColumns({"at_h": F.when(F.col("first"), F.col("h")).otherwise(turned_h), "at_w": F.when(F.col("first"), F.col("w")).otherwise(turned_w)})
    none = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("at_w").cast("int").alias("x1"), F.col("at_h").cast("int").alias("y1"))
    box = crop_box(F.col("at_h").cast("int"), F.col("at_w").cast("int"))
    rows = rows.withColumn("box", F.when(r("crop").isNotNull(), box).otherwise(none))
    box_h, box_w = F.col("box.y1") - F.col("box.y0"), F.col("box.x1") - F.col("box.x0")
    late_turn = F.col("first") & swap
    rows = rows.withColumns({"cut_h": F.when(late_turn, box_w).otherwise(box_h), "cut_w": F.when(late_turn, box_h).otherwise(box_w)})
    z = lambda k: F.col(f"recipe.resize.{k}")
    above = lambda k: F.when(z(k) > 0, z(k))
    scale = F.when(z("scale").isNotNull(), F.greatest(F.lit(1), z("scale")))
    by_pixels = z("px_w").isNotNull() | z("px_h").isNotNull()
    # a size in pixels, if one is named, rules out the others even if it is not above 0
    size = resized(F.col("cut_w"), F.col("cut_h"), F.when(~by_pixels, scale), above("px_w"), above("px_h"), F.when(~by_pixels, z("pct_w")), F.when(~by_pixels, z("pct_h")))
    rows = rows.withColumn("size", F.when(r("resize").isNotNull(), size)).withColumns({"new_h": F.coalesce("size.height", "cut_h"), "new_w": F.coalesce("size.width", "cut_w")})
    kh, kw = F.col("new_h") / F.col("cut_h"), F.col("new_w") / F.col("cut_w")
    same = (F.col("new_h") == F.col("cut_h")) & (F.col("new_w") == F.col("cut_w"))
    shrinks = (kh < 1) | (kw < 1)
    kind = F.when(same, F.lit(None)).when(shrinks, "area").when(F.greatest(kh, kw) < 2, "linear").otherwise("cubic")
    # an area average needs both sides to shrink; a side that grows repeats its pixels
    numbers = F.filter(r("nodata"), lambda i: i["value"].isNotNull())
    restore = F.coalesce(F.get(numbers, 0)["value"], F.lit(0.0))
    return rows.withColumns({"kind": kind, "late": shrinks, "restore": restore}).drop("size", "at_h", "at_w", "crop_x", "crop_y", "crop_w", "crop_h", "ref_w", "ref_h")


def _near(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size > 1e30, size * 0.01).when(size > 100, size * 0.001).otherwise(F.lit(0.01))


def missing(bands: list[str], nodata: Column) -> Column:
    """Whether a pixel is missing by its own image's rules (an array of structs): near a number in any band, by a rule on a
    band, or without a finite value where there are rules at all."""
    values = F.array(*[finite(F.col(b)) for b in bands])

    def holds(i: Column) -> Column:
        near = F.exists(values, lambda v: F.coalesce(F.abs(v - i["value"]) <= _near(i["value"]), F.lit(False)))
        c, limit, op = F.get(values, i["band"] - 1), i["limit"], i["op"]
        same = F.abs(c - limit) <= 1e-6
        by_rule = F.when(op == "<", c < limit).when(op == "<=", c <= limit).when(op == ">", c > limit).when(op == ">=", c >= limit).when(op == "==", same).otherwise(~same)
        return F.coalesce(F.when(i["value"].isNotNull(), near).otherwise(by_rule), F.lit(False))

    gaps = F.exists(values, lambda v: v.isNull())
    return F.coalesce((F.size(nodata) > 0) & (gaps | F.exists(nodata, holds)), F.lit(False))


def placed(pixels: DataFrame, plan: DataFrame) -> DataFrame:
    """Strips of turned and cropped pixels with their image's sizes: each pixel is read once and goes to one place."""
    bands = band_names(pixels)
    rows = pixels.select("image_id", "y", "x", *bands).join(plan.select("image_id", "h", "w", "rotate", "first", "box", F.col("recipe.nodata").alias("nodata")), "image_id")
    rows = rows.withColumn("masked", missing(bands, F.col("nodata")))
    b = lambda k: F.col(f"box.{k}")
    y1, x1 = turned(F.col("y"), F.col("x"), F.col("h"), F.col("w"), F.col("rotate"))
    rows = rows.withColumns({"__y": F.when(F.col("first"), F.col("y")).otherwise(y1), "__x": F.when(F.col("first"), F.col("x")).otherwise(x1)})
    rows = rows.filter((F.col("__x") >= b("x0")) & (F.col("__x") < b("x1")) & (F.col("__y") >= b("y0")) & (F.col("__y") < b("y1")))
    cy, cx = F.col("__y") - b("y0"), F.col("__x") - b("x0")
    ty, tx = turned(cy, cx, b("y1") - b("y0"), b("x1") - b("x0"), F.col("rotate"))
    out = rows.select("image_id", F.when(F.col("first"), ty).otherwise(cy).cast("long").alias("y"), F.when(F.col("first"), tx).otherwise(cx).cast("long").alias("x"), *bands, "masked")
    return S.strips(out, F.col("masked"))


def matched(rows: DataFrame, plan: DataFrame, late: bool) -> DataFrame:
    """Strips with bands moved to their image's reference: by mean and deviation, or along a cumulative histogram.

    Each image has a reference of its own. Only images whose match is due (``late``) are read for statistics; masked pixels take
    no part and keep their values. Statistics and look-up tables are a row per image."""
    bands = band_names(rows)
    due = plan.filter(F.col("recipe.hist").isNotNull() & (F.col("late") == late)).select("image_id", F.col("recipe.hist.mode").alias("__mode"), F.col("recipe.hist.stats").alias("__ref"), F.col("recipe.hist.cdf").alias("__cdf"))
    if due.isEmpty():
        return rows
    own = rows.join(due, "image_id")
    cells = own.select("image_id", "__mode", "__ref", "__cdf", F.explode(F.arrays_zip(*[F.col(b) for b in (*bands, "mask")])).alias("c")).filter("c.mask = 0")
    value = lambda b: F.col(f"c.{b}")
    stats = cells.filter("__mode = 'meanstd'").groupBy("image_id").agg(*[f(value(b)).alias(f"__{n}_{b}") for b in bands for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    # look-up tables: counts per image, band and bin; their running shares; the reference's value there
    by_band = F.array(*[F.struct(F.lit(i).alias("i"), value(b).alias("v"), F.get("__cdf", i).alias("r")) for i, b in enumerate(bands)])
    long = cells.filter("__mode != 'meanstd'").select("image_id", F.explode(by_band).alias("e")).filter("e.r is not null and e.v is not null").select("image_id", "e.i", "e.v", "e.r.lo", _high(F.col("e.r")).alias("hi"))
    counts = long.select("image_id", "i", _bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).groupBy("image_id", "i", "bin").agg(F.count("*").alias("n"))
    ref = due.select("image_id", F.posexplode("__cdf").alias("i", "r"))
    tables = counts.groupBy("image_id", "i").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h")).join(ref, ["image_id", "i"])  # at most MATCH_BINS counts
    tables = tables.withColumn("__all", F.aggregate("h", F.lit(0).cast("long"), lambda acc, s: acc + s["n"]))
    xs, ys = F.coalesce("r.x", F.array(F.lit(0.0), F.lit(1.0))), F.coalesce("r.y", F.array(F.lit(0.0), F.lit(1.0)))
    low, span = F.coalesce("r.lo", F.lit(0.0)), _high(F.col("r")) - F.coalesce("r.lo", F.lit(0.0))
    tables = tables.withColumns({"__xs": xs, "__ys": ys, "__low": low, "__span": span})
    step = lambda acc, s: F.struct((acc["n"] + s["n"]).alias("n"), F.concat(acc["e"], F.array(F.struct(s["bin"].alias("bin"), ((acc["n"] + s["n"]) / F.col("__all")).alias("v")))).alias("e"))
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<bin:int,v:double>>").alias("e"))
    shares = tables.withColumn("__e", F.aggregate("h", empty, step, lambda acc: acc["e"])).select("image_id", "i", "__xs", "__ys", "__low", "__span", F.explode("__e").alias("e"))
    moved = interpolated(F.col("e.v"), F.col("__ys"), F.col("__xs"), F.size("__ys")) * F.col("__span") + F.col("__low")
    lut = shares.groupBy("image_id", "i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("e.bin"), moved.alias("new")))).alias("t"))
    luts = lut.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "t"))).alias("__luts"))  # a table for each band
    known = due.join(stats, "image_id", "left").join(luts, "image_id", "left")
    out = rows.join(known, "image_id", "left")

    def new(b: str, i: int) -> Column:
        sd = F.when(F.col(f"__s_{b}") >= 1e-6, F.col(f"__s_{b}")).otherwise(F.lit(1.0))
        target, table, r = F.get("__ref", i), F.try_element_at("__luts", F.lit(i)), F.get("__cdf", i)
        mean = lambda v: (v - F.col(f"__m_{b}")) * (F.coalesce(target["std"], F.lit(1.0)) / sd) + F.coalesce(target["mean"], F.lit(0.0))
        along = lambda v: F.try_element_at(table, _bin(v, F.coalesce(r["lo"], F.lit(0.0)), _high(r)))
        change = lambda f: F.zip_with(b, "mask", lambda v, k: F.when(k > 0, v).otherwise(f(v)))
        by_mean = (F.col("__mode") == "meanstd") & target.isNotNull()
        return F.when(by_mean, change(mean)).when((F.col("__mode") != "meanstd") & table.isNotNull(), change(along)).otherwise(F.col(b))

    return out.withColumns({b: new(b, i) for i, b in enumerate(bands)}).select(*rows.columns)


def _high(r: Column) -> Column:
    lo, hi = F.coalesce(r["lo"], F.lit(0.0)), F.coalesce(r["hi"], F.lit(1.0))
    return F.when(hi > lo, hi).otherwise(lo + 1)


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))) * (MATCH_BINS - 1)).cast("int")


def derived(pixels: DataFrame, formulas: DataFrame) -> DataFrame:
    """pixels with one more band: each image's own formula (image_id, formula), NULL without a valid one.

    Distinct formulas are compiled once each, and rows pick theirs; whole-image reducers of all formulas are one aggregation."""
    bands = band_names(pixels)
    texts = [r["formula"] for r in formulas.select("formula").filter("formula is not null").distinct().limit(MOST_FORMULAS + 1).collect()]
    if len(texts) > MOST_FORMULAS:
        raise ValueError(f"more than {MOST_FORMULAS} distinct formulas; replay the images in parts")
    rows = pixels.join(formulas.select("image_id", F.col("formula").alias("__f")), "image_id", "left")
    value, aggregates = F.lit(None).cast("double"), {}
    for n, text in enumerate(sorted(texts)):
        try:
            own, more = parse(text, bands)
        except (ValueError, SyntaxError):
            continue
        if more:
            reduced = rows.filter(F.col("__f") == text).groupBy("image_id").agg(*more.values())
            names = {a: f"__{n}{a}" for a in more}
            aggregates[text] = reduced.withColumnsRenamed(names)
            rows = rows.join(aggregates[text], "image_id", "left")
            for a, b in names.items():
                rows = rows.withColumn(a, F.col(b))
            rows = rows.withColumn(f"__v{n}", F.when(F.col("__f") == text, own)).drop(*more, *names.values())
            own = F.col(f"__v{n}")
        value = F.when(F.col("__f") == text, own).otherwise(value)
    out = append_band(rows, value)
    return out.select(*pixels.columns, f"b{len(bands) + 1}")


def replayed(pixels: DataFrame, images: DataFrame, classes=None) -> DataFrame:
    """(image_id, y, x, bands, derived band): the whole replay of each image's recipe.

    images has image_id, h, w (the raw size) and ``recipe`` (of :func:`typed`), one row per image; pixels of other images are left
    out. In order: turn and crop, match, resize, registration, match of images that shrank, derived band. ``classes``, a
    function from pixels to (image_id, y, x, class_id), adds a class band."""
    plan = written(planned(images))
    rows = written(placed(pixels, plan))
    bands = band_names(rows)
    rows = matched(rows, plan, late=False)
    sizes = plan.select("image_id", F.col("cut_h").alias("h"), F.col("cut_w").alias("w"), "new_h", "new_w", "kind", "restore")
    rows = written(S.resized(rows.join(sizes, "image_id")))
    rows = registered(rows, plan, bands)
    rows = matched(rows, plan, late=True)
    out = S.pixels_of(rows).select("image_id", "y", "x", *bands)
    out = derived(out, plan.select("image_id", F.col("recipe.formula").alias("formula")))
    if classes is not None:
        last = f"b{len(bands) + 2}"
        out = out.join(classes(out).withColumnRenamed("class_id", last), ["image_id", "y", "x"], "left")
    return out


def registered(rows: DataFrame, plan: DataFrame, bands: list[str]) -> DataFrame:
    """Strips (with h, w and restore) warped by their image's matrix; strips of images without one do not move."""
    have = plan.filter("recipe.matrix is not null").select("image_id", F.col("recipe.matrix").alias("m"), F.col("recipe.calc").alias("calc"))
    if have.isEmpty():
        return rows
    own = rows.join(have.select("image_id"), "image_id", "left_semi")
    sizes = own.groupBy("image_id").agg(F.any_value("h").alias("h"), F.any_value("w").alias("w"), F.any_value("restore").alias("restore")).join(have, "image_id")
    sizes = sizes.withColumns({"calc_h": F.coalesce(F.get("calc", 0), F.col("h")), "calc_w": F.coalesce(F.get("calc", 1), F.col("w"))})
    # the mask goes along as one more band: whatever it gives a share to is restored
    flat = S.pixels_of(own)
    source = flat.withColumn(f"b{len(bands) + 1}", F.col("masked").cast("double")).drop("masked")
    moved = warp(source, sizes.drop("restore"), [F.get("m", k) for k in range(9)])
    touched = F.col(f"b{len(bands) + 1}") > 1e-12
    moved = moved.join(sizes.select("image_id", "restore"), "image_id")
    moved = moved.withColumns({b: F.when(touched, F.col("restore")).otherwise(F.col(b)) for b in bands})
    lines = S.strips(moved.select("image_id", "y", "x", *bands, touched.alias("__t")), F.col("__t"))
    lines = lines.join(sizes.select("image_id", "h", "w", "restore"), "image_id").select(*rows.columns)
    return rows.join(have.select("image_id"), "image_id", "left_anti").unionByName(lines)
