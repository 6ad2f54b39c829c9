"""A catalog that follows a folder of position records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import last_wins

SCHEMA = "filename string, latitude double, longitude double, version long"


#: Buckets of file names: a batch rewrites only those that it touches.
BUCKETS = 64


def follow(spark: SparkSession, landing: str, table: str, checkpoint: str, schema: str = SCHEMA, buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts all records that arrived since the last run into a Parquet table, the highest version of a file name winning.

    The table is dealt to buckets by a hash of the name. A batch joins and rewrites only the buckets of its names, into a
    folder of its own (``batch=N/bucket=B``); the newest folder of a bucket holds, and of the older ones that before it is
    kept for readers, while the rest is dropped. A repeated batch reads what held before it and writes the same folder
    again, so readers never see half a table. Files already seen are known from the checkpoint."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.withColumn("bucket", _bucket(buckets))
        touched = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
        known = _folders(session, table)
        held = [max((n, path) for n, path in known[b] if n < number)[1] for b in touched if any(n < number for n, _ in known.get(b, ()))]
        if held:
            old = session.read.schema(batch.schema).parquet(*held)
            rows = rows.unionByName(old.withColumn("bucket", _bucket(buckets)))
        newest = last_wins(rows, "filename", "version").select(*batch.columns, "bucket")
        newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")
        for b in touched:
            for _, path in sorted(x for x in known.get(b, ()) if x[0] < number)[:-1]:
                _path(session, path)[0].delete(_path(session, path)[1], True)

    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("filename"), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, table: str) -> dict[int, list[tuple[int, str]]]:
    """For each bucket, its versions as (batch, folder). Batches that are not finished have no marker file and do not count."""
    fs, root = _path(spark, table)
    out: dict[int, list[tuple[int, str]]] = {}
    for batch in fs.listStatus(root) if fs.exists(root) else []:
        name = batch.getPath().getName()
        if name.startswith("batch=") and fs.exists(_path(spark, f"{table}/{name}/_SUCCESS")[1]):
            for part in fs.listStatus(batch.getPath()):
                bucket = part.getPath().getName()
                if bucket.startswith("bucket="):
                    out.setdefault(int(bucket[7:]), []).append((int(name[6:]), f"{table}/{name}/{bucket}"))
    return out


def current(spark: SparkSession, table: str, batch: int | None = None, schema: str = SCHEMA) -> DataFrame:
    """The table after a batch (of which buckets may have been dropped since), or as it is now."""
    held = [max(v)[1] for versions in _folders(spark, table).values() if (v := [x for x in versions if batch is None or x[0] <= batch])]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def recent_means(stream: DataFrame, by: str, value: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed means of a value by a key over event time ``ts``, for live monitoring; later rows than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
