"""Objects and their chips: one numbering of an image's polygons, and square rasters cut around each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import strips as S
from .shapes import mean_point, spans
from .zonal import band_names

ZOOM, LEAST, SIDE = 1.4, 16, 200


def objects(polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """polygons with ``object_id``: their number in their image, from 1, in the order of the key. It is the label of :func:`labelled`
    and the first column of the object table."""
    return polygons.withColumn("object_id", F.row_number().over(Window.partitionBy("image_id").orderBy(key)))


def object_table(numbered: DataFrame, key: str = "poly_id") -> DataFrame:
    """(object_id, group_name, image_id, polygon_index, key): a row per object, also for those that no pixel shows."""
    return numbered.select("object_id", F.col("grp").alias("group_name"), "image_id", F.col("object_id").alias("polygon_index"), key)


def labelled(numbered: DataFrame) -> DataFrame:
    """(image_id, y, x, label): the object of each pixel, later ones over earlier ones. A set of one or two points marks the
    pixel at its rounded mean."""
    few = F.when(F.size("points") < 3, F.array(mean_point(F.col("points")))).otherwise(F.col("points"))
    s = spans(numbered.withColumn("points", few), "object_id", ("image_id",))
    px = s.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "object_id")
    return px.groupBy("image_id", "y", "x").agg(F.max("object_id").alias("label"))


def _side(axis: str, n: Column, zoom: float, least: int) -> tuple[Column, Column]:
    """Where a chip begins along an axis of n pixels, and how many pixels it has there."""
    values = F.transform("points", lambda p: p[axis])
    one = F.size("points") == 1
    alone = F.greatest(F.lit(0), F.least(n - 1, F.rint(F.get(values, 0)).cast("int")))
    whole = F.transform(values, lambda v: v.cast("int"))
    low = F.when(one, alone).otherwise(F.array_min(whole))
    size = F.when(one, 1).otherwise(F.array_max(whole) - F.array_min(whole) + 1)
    grown = F.greatest(F.lit(least), F.rint(size * zoom).cast("int"))
    start = F.rint(low + size / 2 - grown / 2).cast("int")
    start = F.greatest(F.lit(0), F.least(start, n - grown))
    return start, F.least(grown, n - start)


def chip_boxes(polygons: DataFrame, sizes: DataFrame, side: int = SIDE, zoom: float = ZOOM, least: int = LEAST) -> DataFrame:
    """polygons (with points) beside their chip: ``chip_x``, ``chip_y``, ``chip_w``, ``chip_h`` in the image, moved inside it, and
    ``vertices``, the points on a chip of side by side pixels. sizes has image_id, h and w."""
    rows = polygons.filter(F.size("points") > 0).join(sizes.select("image_id", F.col("h").alias("__h"), F.col("w").alias("__w")), "image_id")
    (x, w), (y, h) = _side("x", F.col("__w"), zoom, least), _side("y", F.col("__h"), zoom, least)
    rows = rows.withColumns({"chip_x": x, "chip_y": y, "chip_w": w, "chip_h": h}).drop("__h", "__w")
    to = lambda v, a, n: (v - F.col(a)) * side / F.col(n)
    return rows.withColumn("vertices", F.transform("points", lambda p: F.struct(to(p["x"], "chip_x", "chip_w").alias("x"), to(p["y"], "chip_y", "chip_h").alias("y"))))


def chip_rasters(pixels: DataFrame, boxes: DataFrame, side: int = SIDE, key: str = "poly_id") -> DataFrame:
    """(key, y, x, bands): each box of :func:`chip_boxes` as a raster of side by side pixels.

    Chips of any sizes share one plan: an image's lines are strips, a chip's line is a slice of one, and only slices are
    resampled, by area where both sides shrink and else by bilinear weights."""
    bands = band_names(pixels)
    lines = boxes.select(F.col(key).alias("__key"), "image_id", "chip_x", "chip_y", "chip_w", "chip_h", F.explode(F.sequence(F.col("chip_y"), F.col("chip_y") + F.col("chip_h") - 1)).alias("y"))
    rows = S.strips(pixels).withColumn("y", F.col("y").cast("int")).join(lines, ["image_id", "y"])
    small = (F.col("chip_h") >= side) & (F.col("chip_w") >= side)
    same = (F.col("chip_h") == side) & (F.col("chip_w") == side)
    cut = rows.select(
        F.col("__key").alias("image_id"), (F.col("y") - F.col("chip_y")).cast("long").alias("y"), F.col("chip_h").alias("h"), F.col("chip_w").alias("w"), F.lit(side).alias("new_h"), F.lit(side).alias("new_w"),
        F.when(same, F.lit(None)).when(small, "area").otherwise("linear").alias("kind"), F.lit(None).cast("double").alias("restore"),
        *[F.slice(b, F.col("chip_x") + 1, F.col("chip_w")).alias(b) for b in (*bands, "mask")],
    )
    return S.pixels_of(S.resized(cut)).select(F.col("image_id").alias(key), "y", "x", *bands)
