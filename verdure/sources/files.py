"""Readers and writers: images, catalogs, polygon and project JSON, positions, recipes, tables of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import parsed_polygon_file, stem
from ..operators.shapes import normalised

IMAGES = "*.{jpg,jpeg,png,tif,tiff,bmp,JPG,JPEG,PNG,TIF,TIFF,BMP}"
PROJECT_KEYS = ("all_polygons", "current_root_index", "root_offset", "root_coordinates")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixel rows (image_id, y, x, b1..b4) of 8-bit images of 1, 3 or 4 channels; b1 is red, b3 blue; absent bands are NULL.

    Images are decoded by Spark's image source; a worker turns an image's bytes into rows, in strips of bounded size."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for origin, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                if n >= 3:
                    px = px[:, :, [2, 1, 0, *range(3, n)]]
                step = max(1, (1 << 18) // max(1, w))
                for top in range(0, h, step):
                    part = px[top : top + step]
                    rows = part.shape[0]
                    y, x = np.repeat(np.arange(top, top + rows), w), np.tile(np.arange(w), rows)
                    bands = [pa.array(part[:, :, k].ravel().astype(float)) if k < n else pa.nulls(len(y), pa.float64()) for k in range(4)]
                    name = origin.rsplit("/", 1)[-1]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), pa.array(y), pa.array(x), *bands], ["image_id", "y", "x", "b1", "b2", "b3", "b4"])

    return raw.mapInArrow(unpack, "image_id string, y long, x long, b1 double, b2 double, b3 double, b4 double")


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Pixel tables laid out so that filters on image, row and column skip row groups."""
    pixels.repartition("image_id").sortWithinPartitions("image_id", "y", "x").write.mode("overwrite").parquet(path)


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, modified, length) of image files; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", True).load(path)
    return rows.select("path", base_name(F.col("path")).alias("filename"), F.col("modificationTime").alias("modified"), "length")


def _whole(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def polygon_record(v: Column) -> list[Column]:
    """Columns of one polygon record held as VARIANT."""
    get = lambda p, t: F.try_variant_get(v, p, t)
    return [
        get("$.name", "string").alias("name"), F.coalesce(get("$.type", "string"), F.lit("polygon")).alias("type"), F.coalesce(get("$.coord_space", "string"), F.lit("image")).alias("coord_space"),
        get("$.image_ref_size.w", "int").alias("ref_w"), get("$.image_ref_size.h", "int").alias("ref_h"), get("$.root", "string").alias("root"),
        get("$.coordinates.latitude", "double").alias("latitude"), get("$.coordinates.longitude", "double").alias("longitude"),
        normalised(F.to_json(get("$.points", "variant"))).alias("parts"),
    ]


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """One row per part of each polygon file: group and base from its name, fields from its record. Other files are left out."""
    rows = _whole(spark, path).withColumn("n", parsed_polygon_file(base_name(F.col("path")))).filter("n is not null")
    rows = rows.withColumn("v", F.try_parse_json("value")).filter("v is not null")
    rows = rows.select("path", "n.grp", "n.base", *polygon_record(F.col("v")))
    return rows.select("*", F.posexplode("parts").alias("part", "points")).drop("parts")


def read_projects(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(project, grp, image_path, record columns) of all project files that have every required key."""
    rows = _whole(spark, path, glob).withColumn("v", F.try_parse_json("value")).filter("v is not null")
    for k in PROJECT_KEYS:
        rows = rows.filter(F.expr(f"try_variant_get(v, '$.{k}', 'variant') is not null"))
    groups = spark.sql("select p.path as project, g.key as grp, g.value as g from {rows} p, lateral variant_explode(try_variant_get(p.v, '$.all_polygons', 'variant')) g", rows=rows)
    files = spark.sql("select project, grp, f.key as image_path, f.value as f from {groups}, lateral variant_explode(g) f", groups=groups)
    return files.select("project", "grp", "image_path", *polygon_record(F.col("f")))


def gps_rows(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(filename, latitude, longitude) of JSON texts (column value): lists of records or of triples, or records by name.

    Latitude and longitude go by any of their usual names; of one base name the first entry of its text stays, of several
    texts' first ones the least. ``folder`` names a column of the texts' folders: images of different folders may share a
    name, so that the rule then holds within each folder, and rows carry it."""
    by = [] if folder is None else [folder]
    rows = documents.sparkSession.sql("select d.*, e.pos, e.key, e.value as v from {docs} d, lateral variant_explode(try_parse_json(d.value)) e", docs=documents.select("value", *by))
    get = lambda *names, t="string": F.coalesce(*[F.try_variant_get("v", p, t) for p in names])
    out = rows.select(
        *by, "pos", base_name(F.coalesce(get("$.filename", "$.file", "$.path", "$.SourceFile", "$[0]"), F.col("key"))).alias("filename"),
        get("$.latitude", "$.lat", "$.GPSLatitude", "$[1]", t="double").alias("latitude"), get("$.longitude", "$.lon", "$.lng", "$.GPSLongitude", "$[2]", t="double").alias("longitude"),
    )
    out = out.filter("filename is not null and latitude is not null and longitude is not null")
    return out.groupBy(*by, "filename").agg(F.min_by(F.struct("latitude", "longitude"), F.struct("pos", "latitude", "longitude")).alias("p")).select(*by, "filename", "p.latitude", "p.longitude")


def target_rows(documents: DataFrame) -> DataFrame:
    """(source, target_index, latitude, longitude) of JSON texts (source, value), numbered from 1.

    A text's own coordinates come first, else the mean of each polygon, else each point; bad entries are left out."""
    v = F.try_parse_json("value")
    rows = documents.withColumns({
        "own": F.try_variant_get(v, "$.coordinates", "struct<latitude double, longitude double>"),
        "polys": F.try_variant_get(v, "$.polygons", "array<array<array<double>>>"),
        "pts": F.try_variant_get(v, "$.points", "array<array<double>>"),
    })
    mean = lambda p, k: F.aggregate(p, F.lit(0.0), lambda a, q: a + q[k]) / F.size(p)
    good = lambda q: (F.size(q) >= 2) & F.get(q, 0).isNotNull() & F.get(q, 1).isNotNull()
    of_poly = F.transform(F.filter("polys", lambda p: (F.size(p) > 0) & F.forall(p, good)), lambda p: F.struct(mean(p, 0).alias("latitude"), mean(p, 1).alias("longitude")))
    of_points = F.transform(F.filter("pts", good), lambda q: F.struct(q[0].alias("latitude"), q[1].alias("longitude")))
    own = F.when(F.col("own.latitude").isNotNull() & F.col("own.longitude").isNotNull(), F.array("own"))
    rows = rows.select("source", F.posexplode(F.coalesce(own, of_poly, of_points)).alias("i", "p"))
    return rows.select("source", (F.col("i") + 1).alias("target_index"), "p.latitude", "p.longitude")


def root_mapping_rows(documents: DataFrame) -> DataFrame:
    """(root_id, base, ordinal) of root mappings held as JSON text: files of both folders, then the RGB and thermal ones."""
    rows = documents.sparkSession.sql("select e.key as root_id, e.value as v from {docs}, lateral variant_explode(try_parse_json(value)) e", docs=documents.select("value"))
    files = lambda p: F.coalesce(F.try_variant_get("v", p, "array<string>"), F.array().cast("array<string>"))
    singles = F.array(F.try_variant_get("v", "$.RGB", "string"), F.try_variant_get("v", "$.thermal", "string"))
    every = F.filter(F.concat(files("$.folder1.files"), files("$.folder2.files"), singles), lambda f: f.isNotNull() & (f != ""))
    rows = rows.select("root_id", F.posexplode(every).alias("ordinal", "file"))
    return rows.select("root_id", stem(base_name(F.col("file"))).alias("base"), F.col("ordinal").cast("long").alias("ordinal"))


def exif_rows(documents: DataFrame) -> DataFrame:
    """(path, tags) of metadata listings held as JSON arrays of records; tags is a map of text by name."""
    rows = documents.sparkSession.sql("select e.value as v from {docs}, lateral variant_explode(try_parse_json(value)) e", docs=documents.select("value"))
    tags = F.from_json(F.to_json("v"), "map<string,string>")
    return rows.select(F.try_variant_get("v", "$.SourceFile", "string").alias("path"), F.map_filter(tags, lambda k, v: k != "SourceFile").alias("tags")).filter("path is not null")


def with_exif(rows: DataFrame, exif: DataFrame, path: str = "path") -> DataFrame:
    """rows with their file's tags, where there are any. What parsing yields is far larger than the files it is planned by, so
    that both sides are sorted and no task holds all tags."""
    return rows.join(exif.select(F.col("path").alias("__p"), "tags").hint("merge"), F.col(path) == F.col("__p"), "left").drop("__p")


def preview_table(spark: SparkSession, path: str, big: int = 2 << 20, rows: int = 1000) -> tuple[DataFrame, int]:
    """A table's rows, or a sample of ``rows`` where its files are over ``big`` bytes; and its row count, estimated from the
    mean length of sampled lines where it is big."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    encoding = text_encoding(spark, path)
    if size <= big:
        whole = read_table(spark, path, encoding=encoding)
        return whole, whole.count()
    mean = spark.read.text(path).select(F.octet_length("value").alias("n")).limit(rows).agg(F.avg("n")).first()[0]
    return read_table(spark, path, sample=rows, encoding=encoding), int(size / (mean + 1))


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, or Latin-1 where some line is not valid UTF-8."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def read_table(spark: SparkSession, path: str, header: bool = True, sample: int | None = None, seed: int = 7, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with its delimiter found on the first line; with ``sample``, that many uniformly chosen rows.

    ``encoding`` names the text's encoding, such as ISO-8859-1 for Latin-1."""
    first = spark.read.option("header", False).option("sep", "\x00").option("quote", "").option("encoding", encoding).csv(path).limit(1).first()
    line = (first[0] if first else "").lstrip("﻿")
    sep = max(",;\t|", key=line.count)
    rows = spark.read.option("header", header).option("sep", sep).option("encoding", encoding).csv(path)
    if header and rows.columns and rows.columns[0].startswith("﻿"):
        rows = rows.withColumnRenamed(rows.columns[0], rows.columns[0].lstrip("﻿"))
    if sample is None:
        return rows
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{c}`") for c in rows.columns]).cast("binary"))).limit(sample)


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_matches(matches: DataFrame, path: str) -> None:
    """One folder of JSON records per source."""
    matches.write.mode("overwrite").partitionBy("source").json(path)


def write_polygons(polygons: DataFrame, path: str) -> None:
    """One JSON record per polygon, in a folder per group."""
    body = F.to_json(F.struct(*[c for c in polygons.columns if c != "grp"]))
    polygons.select("grp", body.alias("value")).write.mode("overwrite").partitionBy("grp").text(path)
