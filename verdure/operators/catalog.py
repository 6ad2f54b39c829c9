"""Catalog keys and look-ups: image kinds, roots, pairs of folders, name parsing and edit-recipe resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Trailing name tokens that mark a modality or channel.
KNOWN_SUFFIXES = (
    "radiance", "reflectance", "radiometric", "ir", "rgb", "thermal", "ms", "nir", "red", "green", "blue", "gray", "grey", "pan", "panchromatic",
    "undist", "undistorted", "ortho", "orthophoto", "orthomosaic", "sr", "dn", "index", "8b",
)
POLYGON_FILE = r"(?i)^(.+?)_(.+?)_polygons(?:_results)?\.json$"


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def image_kind(filename: Column, n_bands: Column, sixteen_bit: Column) -> Column:
    """rgb, thermal, multispectral, or NULL for other shapes."""
    infrared = sixteen_bit & F.upper(stem(filename)).endswith("_IR")
    return F.when(n_bands == 3, F.when(infrared, "thermal").otherwise("rgb")).when(n_bands == 1, F.when(infrared, "thermal").otherwise("multispectral"))


def root_key(filename: Column, always_two: bool = False) -> Column:
    """The part of a name that its images share: two tokens after IMG, else three; the whole name if it has one."""
    name = stem(filename)
    parts = F.split(name, "_")
    n = F.lit(2) if always_two else F.when(parts[0] == "IMG", 2).otherwise(3)
    return F.when(F.size(parts) < 2, name).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "_"))


def representatives(catalog: DataFrame, *keys: str) -> DataFrame:
    """The first file of each root (and further keys), by case-folded name."""
    return catalog.groupBy(*keys, root_key(F.col("filename")).alias("root")).agg(F.min_by("filename", F.struct(F.lower("filename"), F.col("filename"))).alias("filename"))


def tree_key(filename: Column) -> Column:
    return F.split(filename, "_")[0]


def files_by_tree(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("folder", tree_key(F.col("filename")).alias("tree")).agg(F.sort_array(F.collect_list("filename")).alias("files"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with a running number from 0 in the given order: sorted range by range, each range's offset added."""
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__own", own).join(sizes, "__part").select(*rows.columns, (F.col("__before") + F.col("__own")).alias(name))


def paired(left: DataFrame, right: DataFrame, offset: int) -> DataFrame:
    """Roots of two sorted lists (column root) paired by position: right position = left position + offset."""
    number = lambda df: numbered(df.select("root"), "i", "root")
    a, b = number(left), number(right).select(F.col("root").alias("paired"), (F.col("i") - offset).alias("i"))
    return a.join(b, "i", "left").select("root", "paired")


def natural_key(name: Column) -> Column:
    """A sort key by which digit runs compare as numbers and text without case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p))
    return F.array_join(padded, "\u0001")


def canonical_base(base: Column) -> Column:
    """A base name without trailing modality tokens; the name itself if nothing else is in it."""
    low = F.lower(base)
    bare = F.regexp_replace(low, "(?:(?:^|_)(?:" + "|".join(KNOWN_SUFFIXES) + "))+$", "")
    return F.when(bare == "", low).otherwise(bare)


def kind_of_group(group: Column, default: str = "RGB") -> Column:
    low = F.lower(F.coalesce(group, F.lit("")))
    return F.when(F.contains(low, F.lit("rgb")), "RGB").when(F.contains(low, F.lit("thermal")) | F.rlike(low, F.lit(r"(^|[\W_])ir($|[\W_])")), "thermal").otherwise(default)


def groups_by_image(polygons: DataFrame) -> DataFrame:
    return polygons.groupBy("image_id").agg(F.sort_array(F.collect_set("grp")).alias("groups"))


def parsed_polygon_file(name: Column) -> Column:
    """Struct of group and base of a polygon file's name; NULL if it is no such name."""
    return F.when(F.rlike(name, F.lit(POLYGON_FILE)), F.struct(F.regexp_extract(name, POLYGON_FILE, 1).alias("grp"), F.regexp_extract(name, POLYGON_FILE, 2).alias("base")))


def base_to_root(mapping: DataFrame) -> DataFrame:
    """The last root of each case-folded base; mapping has base, root_id and ordinal."""
    return mapping.groupBy(F.lower("base").alias("base")).agg(F.max_by("root_id", "ordinal").alias("root_id"))


def scaled_rect(x: Column, y: Column, w: Column, h: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """A rectangle carried from one image size to another, rounded half to even and clamped."""
    by = lambda v, a, b: F.rint(v * b / a).cast("int")
    x2 = F.greatest(F.lit(0), F.least(by(x, from_w, to_w), to_w))
    y2 = F.greatest(F.lit(0), F.least(by(y, from_h, to_h), to_h))
    return F.struct(
        x2.alias("x"), y2.alias("y"),
        F.greatest(F.lit(0), F.least(by(w, from_w, to_w), to_w - x2)).alias("width"),
        F.greatest(F.lit(0), F.least(by(h, from_h, to_h), to_h - y2)).alias("height"),
    )


def resized(w: Column, h: Column, scale: Column | None = None, px_w: Column | None = None, px_h: Column | None = None, pct_w: Column | None = None, pct_h: Column | None = None) -> Column:
    """Struct of the size after a resize: pixels first (keeping the aspect if one is given), then scale, then percents."""
    none = F.lit(None).cast("double")
    px_w, px_h, scale, pct_w, pct_h = (none if c is None else c.cast("double") for c in (px_w, px_h, scale, pct_w, pct_h))
    out_w = F.coalesce(px_w, F.rint(px_h * w / h), F.rint(w * scale / 100), F.when(pct_w.isNotNull() | pct_h.isNotNull(), F.rint(w * F.coalesce(pct_w, F.lit(100.0)) / 100)), w.cast("double"))
    out_h = F.coalesce(px_h, F.rint(px_w * h / w), F.rint(h * scale / 100), F.when(pct_w.isNotNull() | pct_h.isNotNull(), F.rint(h * F.coalesce(pct_h, F.lit(100.0)) / 100)), h.cast("double"))
    least = lambda c: F.greatest(F.lit(1), c.cast("int"))
    return F.struct(least(out_w).alias("width"), least(out_h).alias("height"))


def effective_size(recipes: DataFrame, width: Column, height: Column) -> DataFrame:
    """recipes with out_w and out_h: the size after crop, rotation and resize, without touching pixels."""
    swap = F.col("rotate") % 180 != 0
    ref_is_raw = (F.col("ref_w") == width) & (F.col("ref_h") == height)
    turned = swap & ~ref_is_raw
    base_w, base_h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    rect = scaled_rect(F.col("crop_x"), F.col("crop_y"), F.col("crop_w"), F.col("crop_h"), F.col("ref_w"), F.col("ref_h"), base_w, base_h)
    cut_w, cut_h = F.when(rect["width"] > 0, rect["width"]).otherwise(base_w), F.when(rect["height"] > 0, rect["height"]).otherwise(base_h)
    late = swap & ref_is_raw
    w, h = F.when(late, cut_h).otherwise(cut_w), F.when(late, cut_w).otherwise(cut_h)
    size = resized(w, h, scale=F.col("scale"))
    return recipes.withColumns({"out_w": size["width"], "out_h": size["height"]})


def resolved_recipes(catalog: DataFrame, recipes: DataFrame) -> DataFrame:
    """The recipe that holds for each file: the project's own, the project's global, the side file, the side global.

    recipes has scope ('project' or 'side'), base (NULL for a global one), folder (NULL for a project's) and body."""
    c = catalog.select("file_id", stem(F.col("filename")).alias("base"), "folder")
    r = recipes.select("scope", F.col("base").alias("r_base"), F.col("folder").alias("r_folder"), "body")
    priority = F.when(F.col("scope") == "project", 0).otherwise(2) + F.col("r_base").isNull().cast("int")
    r = r.withColumn("priority", priority)
    own = c.join(r.filter("r_base is not null"), (F.col("base") == F.col("r_base")) & ((F.col("scope") == "project") | (F.col("folder") == F.col("r_folder"))))
    wide = c.join(r.filter("r_base is null and scope = 'side'"), F.col("folder") == F.col("r_folder"))
    # one global recipe: the least, should there be several
    every = c.join(F.broadcast(r.filter("r_base is null and scope = 'project'").orderBy("body").limit(1)), F.lit(True))
    found = own.unionByName(wide).unionByName(every)
    best = found.groupBy("file_id").agg(F.min(F.struct("priority", "body")).alias("b"))
    return c.select("file_id").join(best, "file_id", "left").select("file_id", F.col("b.priority").alias("priority"), F.col("b.body").alias("body"))


def refreshed(cached: DataFrame, listed: DataFrame, key: str = "filename") -> dict[str, DataFrame]:
    """Which listed files are new, and which cached rows are still listed."""
    return {"missing": listed.join(cached, key, "left_anti"), "kept": cached.join(listed, key, "left_semi")}


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest order for each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])
