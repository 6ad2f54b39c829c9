"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of most contracts: everything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Pieces that :func:`along` gathers at once.
RUN = 128
#: Stands for a NULL id: ordered behind all others.
NO_ID = (1 << 63) - 1


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda variable is bound, where a repeated expression would not be."""
    return F.transform(F.array(value), body)[0]


def along(size: Column, kind: str, piece: Callable[[Column, Column], Column]) -> Column:
    """An array of ``kind`` built from left to right over 0..size-1. piece(acc, i) gives the next struct of ``at`` (an int,
    from 0) and ``out`` (the array so far).

    Appending copies what is there, so that pieces are gathered in runs of RUN and the runs put together at the end."""
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def run(at: Column, k: Column) -> Column:
        return F.aggregate(F.sequence(k * RUN, F.least((k + 1) * RUN, size) - 1), F.struct(at.alias("at"), none.alias("out")), piece)

    def add(acc: Column, k: Column) -> Column:
        return let(run(acc["at"], k), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    runs = F.sequence(F.lit(0), F.floor((size - 1) / RUN).cast("int"))
    built = F.aggregate(runs, F.struct(F.lit(0).alias("at"), nested.alias("out")), add, lambda acc: acc["out"])
    return F.when(size > 0, F.flatten(built)).otherwise(none)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for NULL or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder that the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/verdure-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later jobs start from the files."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """rows with ``name``: their places in an order, from 0. Ranges are sorted apart, and each is told how many rows stand before
    it; of the numbers, one per partition passes through the driver."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at))
    ranges = placed.groupBy(F.shiftright("__at", 33).alias("__range")).count().orderBy("__range").collect()
    before, known = 0, []
    for r in ranges:
        known.append((r["__range"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(known, "__range long, __before long"))
    numbered = placed.withColumn("__range", F.shiftright("__at", 33)).join(offsets, "__range")
    return numbered.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__range", "__before", "__at")


def identified(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, __key, __sub, text) of docs, NULL texts empty, and the bytes of all texts.

    ``__key`` is the id, or NO_ID for NULL. ``__sub`` tells apart several texts of one key: a 64-bit digest of the text
    where the id is NULL or stands in several rows, else 0. So rows agree in both only if they are the same document seen
    again. Ids that repeat are counted first; only if there are any, docs are joined with them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b"))
    several, size = counted.agg(F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.sum("b")).first()
    rows, alone = docs.select("doc_id", text.alias("text")), F.col("doc_id").isNotNull()
    if (several or 0) > 1:
        many = docs.groupBy(F.col("doc_id").alias("__many")).count().filter("count > 1 and __many is not null").select("__many")
        rows, alone = rows.join(many, F.col("doc_id") == F.col("__many"), "left"), alone & F.col("__many").isNull()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    sub = F.when(alone, F.lit(0).cast("long")).otherwise(F.xxhash64("text"))
    return rows.select("doc_id", key.alias("__key"), sub.alias("__sub"), "text"), size or 0


def spread(size: int, each: int, docs: DataFrame) -> int:
    """How many buckets of about ``each`` bytes hold ``size`` bytes; at least as many as there are shuffle partitions."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}


def by_text(docs: DataFrame, keep: list[str], fields: str, make: Callable[[], Callable[[list], list[tuple]]], at_once: int | None = None) -> DataFrame:
    """keep columns of docs beside new ``fields`` (Arrow batches; DDL of plain types) made from each batch's texts.

    ``make`` is called once in each task and gives a function from texts to rows, of at most ``at_once`` texts. Kept columns pass through as they are,
    so that NULL and large ids stay exact."""
    names = [f.split()[0] for f in fields.split(", ")]
    types = [_ARROW[f.split()[1]] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once or max(1, b.num_rows))):
            rows = rows_of(batch.column(batch.num_columns - 1).to_pylist())
            columns = list(zip(*rows)) if rows else [()] * len(names)
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{kept}{fields}")
