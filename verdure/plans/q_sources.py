"""Queries that read JSON texts, made from table columns, through the readers' parsing steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files, rasters
from . import views as V
from .registry import query


@query("gps_json", V.with_sql("SELECT filename, (latitude) AS latitude, (longitude) AS longitude FROM gps", "gps"))
def gps_json(spark, sf_dir):
    """A text per folder and kind. Numbers over four digits share names: those that do lie in different folders, told by the digits cut off."""
    number = F.col("number").cast("string")
    folder = F.concat_ws("/", F.length(number), F.substring(number, 5, 20), F.floor(F.substring(number, 1, 4).cast("int") / 64))
    g = V.gps(spark, sf_dir).withColumns({"k": F.col("number") % 3, "folder": folder})
    path = F.concat(F.lit("/data/x/"), F.col("filename"))
    records = g.filter("k = 0").groupBy("folder").agg(F.to_json(F.collect_list(F.struct(path.alias("filename"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))).alias("value"))
    exif = g.filter("k = 1").groupBy("folder").agg(F.to_json(F.collect_list(F.struct(path.alias("SourceFile"), F.col("latitude").alias("GPSLatitude"), F.col("longitude").alias("GPSLongitude")))).alias("value"))
    named = g.filter("k = 2").groupBy("folder").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("filename", F.struct("latitude", "longitude"))))).alias("value"))
    rows = files.gps_rows(records.unionByName(exif).unionByName(named), "folder")
    return rows.select("filename", "latitude", "longitude")


@query("target_json", """SELECT CAST(c_custkey AS VARCHAR) AS source, i AS target_index, CASE c_custkey % 3 WHEN 0 THEN 10.5 WHEN 1 THEN 2.0 ELSE i * 1.0 END AS latitude, CASE c_custkey % 3 WHEN 0 THEN c_custkey * 1.0 WHEN 1 THEN 3.0 ELSE 5.0 END AS longitude
  FROM customer, range(1, 3) t(i) WHERE c_custkey % 3 = 2 OR i = 1""")
def target_json(spark, sf_dir):
    k = F.col("c_custkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit('{"points":[[0,0]],"coordinates":{"latitude":10.5,"longitude":'), k.cast("string"), F.lit("}}")))
        .when(k % 3 == 1, F.lit('{"polygons":[[[1,2],[3,4]]],"points":[[9,9]]}'))
        .otherwise(F.lit('{"points":[[1,5],["x",2],[2,5]]}'))
    )
    docs = V.table(spark, sf_dir, "customer").select(k.cast("string").alias("source"), text.alias("value"))
    return files.target_rows(docs).withColumn("target_index", F.col("target_index").cast("long"))


@query("root_mapping_json", "SELECT CAST(n_nationkey AS VARCHAR) AS root_id, 'IMG_' || n_nationkey || t.s AS base, t.o AS ordinal FROM nation, (VALUES ('a', 0), ('b', 1), ('ir', 2)) t(s, o)")
def root_mapping_json(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    file = lambda s: F.concat(F.lit("/d/IMG_"), k, F.lit(s))
    entry = F.struct(F.struct(F.array(file("a.tif")).alias("files")).alias("folder1"), F.struct(F.array(file("b.tif")).alias("files")).alias("folder2"), file("ir.tif").alias("thermal"))
    docs = V.table(spark, sf_dir, "nation").select(F.to_json(F.map_from_arrays(F.array(k), F.array(entry))).alias("value"))
    return files.root_mapping_rows(docs)


@query("exif_tags", "SELECT url AS path, CAST(page_id AS VARCHAR) AS number, 'cam' || (page_id % 3) AS model FROM pages")
def exif_tags(spark, sf_dir):
    rows = V.table(spark, sf_dir, "pages").select(F.col("url").alias("SourceFile"), F.col("page_id").alias("Number"), F.concat(F.lit("cam"), (F.col("page_id") % 3).cast("string")).alias("Model"))
    docs = rows.select(F.concat(F.lit("["), F.to_json(F.struct("SourceFile", "Number", "Model")), F.lit("]")).alias("value"))
    return files.exif_rows(docs).select("path", F.col("tags")["Number"].alias("number"), F.col("tags")["Model"].alias("model"))


@query("exif_attached", V.with_sql("SELECT file_id, CASE WHEN file_id % 2 = 0 THEN CAST(file_id AS VARCHAR) END AS number FROM catalog", "catalog"))
def exif_attached(spark, sf_dir):
    rows = V.catalog(spark, sf_dir).select("file_id", F.concat(F.lit("/d/"), F.col("file_id").cast("string")).alias("path"))
    listed = rows.filter("file_id % 2 = 0").select(F.concat(F.lit("["), F.to_json(F.struct(F.col("path").alias("SourceFile"), F.col("file_id").alias("Number"))), F.lit("]")).alias("value"))
    return files.with_exif(rows, files.exif_rows(listed)).select("file_id", F.col("tags")["Number"].alias("number"))


@query("pixel_table", V.with_sql("SELECT image_id, y, x, b1, b2, b3, b4 FROM pixels WHERE y BETWEEN 4 AND 20", "pixels"))
def pixel_table(spark, sf_dir):
    path = shared_folder(spark)
    files.write_pixels(V.pixels(spark, sf_dir), path)
    return spark.read.parquet(path).filter("y between 4 and 20")


@query("delimited_table", V.with_sql("SELECT file_id, filename, folder, width FROM catalog", "catalog"))
def delimited_table(spark, sf_dir):
    path = shared_folder(spark)
    files.write_table(V.catalog(spark, sf_dir).select("file_id", "filename", "folder", "width"), path, ";")
    return files.read_table(spark, path).select(F.col("file_id").cast("long").alias("file_id"), "filename", "folder", F.col("width").cast("long").alias("width"))


@query("match_records", "SELECT 's' || (c_custkey % 5) AS source, c_custkey AS target_index, 'IMG_' || c_custkey AS closest_image, c_custkey / 8 AS distance_meters FROM customer")
def match_records(spark, sf_dir):
    path, k = shared_folder(spark), F.col("c_custkey")
    rows = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), (k % 5).cast("string")).alias("source"), k.alias("target_index"), F.concat(F.lit("IMG_"), k.cast("string")).alias("closest_image"), (k / 8).alias("distance_meters"))
    files.write_matches(rows, path)
    return spark.read.schema("target_index long, closest_image string, distance_meters double, source string").json(path)


@query("polygon_records", V.with_sql(f"SELECT poly_id, grp, name, 'image' AS coord_space, CAST({V.FIRST[0]} AS DOUBLE) AS x, CAST({V.FIRST[1]} AS DOUBLE) AS y, CAST(CASE WHEN shape = 'pair' THEN 2 ELSE 1 END AS INT) AS parts FROM shapes", "shapes"))
def polygon_records(spark, sf_dir):
    path = shared_folder(spark)
    files.write_polygons(V.polygons(spark, sf_dir).select("grp", "poly_id", "name", "points"), path)
    rows = spark.read.text(path).withColumn("v", F.try_parse_json("value"))
    out = rows.select("grp", F.try_variant_get("v", "$.poly_id", "long").alias("poly_id"), *files.polygon_record(F.col("v")))
    first = F.col("parts")[0][0]
    return out.select("poly_id", "grp", "name", "coord_space", first["x"].alias("x"), first["y"].alias("y"), F.size("parts").alias("parts"))


@query("project_polygons", V.with_sql(f"SELECT grp, '/d/' || poly_id || '.tif' AS image_path, name, CAST({V.FIRST[0]} AS DOUBLE) AS x FROM shapes", "shapes"))
def project_polygons(spark, sf_dir):
    """A project text per group, each with all that its group has, written and scanned."""
    path = shared_folder(spark)
    rows = V.polygons(spark, sf_dir).select("grp", F.floor(F.col("poly_id") / 64).alias("part"), F.concat(F.lit("/d/"), F.col("poly_id").cast("string"), F.lit(".tif")).alias("p"), F.struct("name", "points").alias("r"))
    by_image = rows.groupBy("grp", "part").agg(F.map_from_entries(F.collect_list(F.struct("p", "r"))).alias("m"))
    whole = F.struct(F.map_from_arrays(F.array("grp"), F.array("m")).alias("all_polygons"), F.lit(0).alias("current_root_index"), F.lit(0).alias("root_offset"), F.lit("{}").alias("root_coordinates"))
    by_image.select("grp", "part", F.to_json(whole).alias("value")).write.partitionBy("grp", "part").text(path)  # a file per project
    found = files.read_projects(spark, f"{path}/*/*", "*.txt")
    return found.select("grp", "image_path", "name", F.col("parts")[0][0]["x"].alias("x"))


_BYTE = "CAST(greatest(0, least(255, round_even(coalesce({c}, 0), 0))) AS INT)"
_FRAME = "SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY image_id"


def _bitmaps(spark, sf_dir):
    """A new shared folder with a bitmap of each image: red, green and blue from the first three bands."""
    folder = shared_folder(spark)
    px = V.pixels(spark, sf_dir).withColumn("b2", F.col("b2") / 10)
    rasters.write_bitmaps(px.select("image_id", "y", "x", "b1", "b2", "b3"), folder)
    return folder


@query("bitmap_pixels", V.with_sql(f"SELECT CAST(f.image_id AS VARCHAR) AS image_id, r.y AS y, c.x AS x, {_BYTE.format(c='p.b1')} AS b1, {_BYTE.format(c='p.b2 / 10')} AS b2, {_BYTE.format(c='p.b3')} AS b3 FROM ({_FRAME}) f JOIN range(0, 32) r(y) ON r.y < f.h JOIN range(0, 32) c(x) ON c.x < f.w LEFT JOIN pixels p ON p.image_id = f.image_id AND p.y = r.y AND p.x = c.x", "pixels"))
def bitmap_pixels(spark, sf_dir):
    """Given pixels written as bitmaps by the registered writer and read again by the reader."""
    return rasters.read_bitmaps(spark, _bitmaps(spark, sf_dir))


@query("bitmap_images", V.with_sql(f"SELECT CAST(f.image_id AS VARCHAR) || '.bmp' AS image_id, r.y AS y, c.x AS x, CAST({_BYTE.format(c='p.b1')} AS DOUBLE) AS b1, CAST({_BYTE.format(c='p.b3')} AS DOUBLE) AS b3 FROM ({_FRAME}) f JOIN range(0, 32) r(y) ON r.y < f.h JOIN range(0, 32) c(x) ON c.x < f.w LEFT JOIN pixels p ON p.image_id = f.image_id AND p.y = r.y AND p.x = c.x", "pixels"))
def bitmap_images(spark, sf_dir):
    """The same files through the image scan, which decodes them by other means."""
    return files.read_images(spark, _bitmaps(spark, sf_dir)).select("image_id", "y", "x", "b1", "b3")


@query("bitmap_listing", V.with_sql(f"SELECT CAST(image_id AS VARCHAR) || '.bmp' AS filename, 54 + h * ((3 * w + 3) // 4 * 4) AS length FROM ({_FRAME})", "pixels"))
def bitmap_listing(spark, sf_dir):
    """The catalog scan over the written images: names and lengths."""
    return files.list_images(spark, _bitmaps(spark, sf_dir)).select("filename", "length")
