"""Queries over file names, recipes and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from . import views as V
from .registry import query

_STEM = "regexp_replace(filename, '[.][^.]*$', '')"
_PART = f"string_split({_STEM}, '_')"
_ROOT = f"CASE WHEN {_PART}[1] = 'IMG' THEN {_PART}[1] || '_' || {_PART}[2] ELSE {_PART}[1] || '_' || {_PART}[2] || '_' || {_PART}[3] END"


@query("image_kind", V.with_sql(f"SELECT file_id, CASE WHEN n_bands = 3 THEN CASE WHEN sixteen_bit AND upper({_STEM}) LIKE '%\\_IR' ESCAPE '\\' THEN 'thermal' ELSE 'rgb' END WHEN n_bands = 1 THEN CASE WHEN sixteen_bit AND upper({_STEM}) LIKE '%\\_IR' ESCAPE '\\' THEN 'thermal' ELSE 'multispectral' END END AS kind FROM catalog", "catalog"))
def image_kind(spark, sf_dir):
    return V.catalog(spark, sf_dir).select("file_id", C.image_kind(F.col("filename"), F.col("n_bands"), F.col("sixteen_bit")).alias("kind"))


@query("root_key", V.with_sql(f"SELECT file_id, {_ROOT} AS root FROM catalog", "catalog"))
def root_key(spark, sf_dir):
    return V.catalog(spark, sf_dir).select("file_id", C.root_key(F.col("filename")).alias("root"))


@query("root_representatives", V.with_sql(f"SELECT folder, {_ROOT} AS root, min(filename) AS filename FROM catalog GROUP BY 1, 2", "catalog"))
def root_representatives(spark, sf_dir):
    return C.representatives(V.catalog(spark, sf_dir), "folder")


@query("files_by_tree", V.with_sql("SELECT folder, string_split(filename, '_')[1] AS tree, md5(string_agg(filename, ',' ORDER BY filename)) AS files FROM catalog GROUP BY 1, 2", "catalog"))
def files_by_tree(spark, sf_dir):
    return C.files_by_tree(V.catalog(spark, sf_dir)).withColumn("files", F.md5(F.array_join("files", ",").cast("binary")))


@query("paired_roots", V.with_sql(f"""SELECT a.root, b.root AS paired FROM (SELECT root, row_number() OVER (ORDER BY root) AS i FROM (SELECT DISTINCT {_ROOT} AS root FROM catalog WHERE n_bands <> 3)) a LEFT JOIN
  (SELECT root, row_number() OVER (ORDER BY root) - 2 AS i FROM (SELECT DISTINCT {_ROOT} AS root FROM catalog WHERE n_bands = 3)) b ON a.i = b.i""", "catalog"))
def paired_roots(spark, sf_dir):
    rows = V.catalog(spark, sf_dir).withColumn("root", C.root_key(F.col("filename")))
    return C.paired(rows.filter("n_bands != 3").select("root").distinct(), rows.filter("n_bands = 3").select("root").distinct(), 2)


@query("natural_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier")
def natural_order(spark, sf_dir):
    rows = V.table(spark, sf_dir, "supplier").select("s_suppkey", C.natural_key(F.concat(F.lit("Tile "), F.col("s_suppkey").cast("string"), F.lit(".TIF"))).alias("k"))
    return C.numbered(rows, "n", "k").select("s_suppkey", (F.col("n") + 1).cast("long").alias("place"))


@query("canonical_base", V.with_sql(f"SELECT file_id, regexp_replace(lower({_STEM}), '(_(radiance|ir))+$', '') AS base FROM catalog", "catalog"))
def canonical_base(spark, sf_dir):
    return V.catalog(spark, sf_dir).select("file_id", C.canonical_base(C.stem(F.col("filename"))).alias("base"))


@query("kind_of_group", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%rgb%' THEN 'RGB' WHEN lower(p_name) LIKE '%thermal%' OR p_partkey % 3 = 0 THEN 'thermal' ELSE 'RGB' END AS kind FROM part")
def kind_of_group(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("_IR-2"))).otherwise(F.concat("p_name", F.lit(" firs")))
    return V.table(spark, sf_dir, "part").select("p_partkey", C.kind_of_group(name).alias("kind"))


@query("groups_by_image", V.with_sql("SELECT image_id, array_to_string(list_sort(list(DISTINCT grp)), ',') AS groups FROM shapes GROUP BY image_id", "shapes"))
def groups_by_image(spark, sf_dir):
    return C.groups_by_image(V.polygons(spark, sf_dir)).withColumn("groups", F.array_join("groups", ","))


@query("polygon_file_names", V.with_sql(f"SELECT file_id, 'g' || (file_id % 5) AS grp, {_STEM} AS base FROM catalog WHERE file_id % 4 <> 0", "catalog"))
def polygon_file_names(spark, sf_dir):
    k = F.col("file_id")
    end = F.when(k % 4 == 0, "_shapes.json").when(k % 4 == 1, "_polygons.json").when(k % 4 == 2, "_POLYGONS.JSON").otherwise("_polygons_results.json")
    name = F.concat(F.lit("g"), (k % 5).cast("string"), F.lit("_"), C.stem(F.col("filename")), end)
    rows = V.catalog(spark, sf_dir).select("file_id", C.parsed_polygon_file(name).alias("p"))
    return rows.filter("p is not null").select("file_id", "p.grp", "p.base")


@query("base_to_root", V.with_sql(f"SELECT lower({_STEM}) AS base, max_by(file_id % 10, file_id) AS root_id FROM catalog GROUP BY 1", "catalog"))
def base_to_root(spark, sf_dir):
    rows = V.catalog(spark, sf_dir)
    return C.base_to_root(rows.select(C.stem(F.col("filename")).alias("base"), (F.col("file_id") % 10).alias("root_id"), F.col("file_id").alias("ordinal")))


@query("effective_size", V.with_sql("""SELECT image_id, CAST(greatest(1, round_even((CASE WHEN rotate % 180 <> 0 THEN ch ELSE cw END) * scale / 100, 0)) AS INT) AS out_w, CAST(greatest(1, round_even((CASE WHEN rotate % 180 <> 0 THEN cw ELSE ch END) * scale / 100, 0)) AS INT) AS out_h
  FROM (SELECT *, least(crop_w, 32 - crop_x) AS cw, least(crop_h, 32 - crop_y) AS ch FROM recipes)""", "recipes"))
def effective_size(spark, sf_dir):
    return C.effective_size(V.recipes(spark, sf_dir), F.lit(V.SIDE), F.lit(V.SIDE)).select("image_id", "out_w", "out_h")


@query("resolved_recipes", V.with_sql(f"""SELECT file_id, CASE WHEN own THEN 0 ELSE 1 END AS priority, CASE WHEN own THEN 'own' ELSE 'global' END AS body FROM (SELECT file_id, {_STEM} IN (SELECT {_STEM} FROM catalog WHERE file_id % 5 = 0) AS own FROM catalog)""", "catalog"))
def resolved_recipes(spark, sf_dir):
    rows = V.catalog(spark, sf_dir)
    base = C.stem(F.col("filename"))
    none = F.lit(None).cast("string")
    own = rows.filter("file_id % 5 = 0").select(F.lit("project").alias("scope"), base.alias("base"), none.alias("folder"), F.lit("own").alias("body")).distinct()
    side = rows.filter("file_id % 2 = 0").select(F.lit("side").alias("scope"), base.alias("base"), "folder", F.lit("side").alias("body")).distinct()
    wide = spark.createDataFrame([("project", None, None, "global"), ("side", None, "folder1", "side global")], "scope string, base string, folder string, body string")
    return C.resolved_recipes(rows, own.unionByName(side).unionByName(wide))


@query("catalog_refresh", V.with_sql(f"SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'new' ELSE 'kept' END AS state FROM catalog WHERE file_id % 4 <> 1", "catalog"))
def catalog_refresh(spark, sf_dir):
    rows = V.catalog(spark, sf_dir).select("file_id")
    parts = C.refreshed(rows.filter("file_id % 3 != 0"), rows.filter("file_id % 4 != 1"), "file_id")
    return parts["missing"].withColumn("state", F.lit("new")).unionByName(parts["kept"].withColumn("state", F.lit("kept")))


@query("last_write_wins", V.with_sql("SELECT filename, max_by(folder, file_id) AS folder, max(file_id) AS file_id FROM catalog GROUP BY filename", "catalog"))
def last_write_wins(spark, sf_dir):
    return C.last_wins(V.catalog(spark, sf_dir).select("filename", "folder", "file_id"), "filename", "file_id")
