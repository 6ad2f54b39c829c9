"""Pixel tables as image files and back, through Spark's Python data source API: ``spark.read.format("bmp")`` and ``df.write.format("bmp")``.

Files are uncompressed 24-bit bitmaps of bytes b1 (red), b2 and b3 (blue), one per image, named ``<image_id>.bmp``. Folders are
those that Arrow's file systems reach, named by URI or path; on a cluster they must be shared. A reader's partitions are
runs of files, so that many small files share a task; a file is decoded in strips. A writer wants its rows sorted by
image, row and column within partitions and an image in one of them (:func:`write_bitmaps` sees to that). Files are written under
another name and moved when a job commits; those of failed tasks are removed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BANDS = ("b1", "b2", "b3")
SCHEMA = "image_id string, y long, x long, b1 int, b2 int, b3 int"
HEADER = 54
#: Bytes of files to a partition, and pixels to a batch.
RUN, STRIP = 32 << 20, 1 << 18


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _header(h: int, w: int) -> bytes:
    size = (3 * w + 3) // 4 * 4 * h
    return struct.pack("<2sIHHI", b"BM", HEADER + size, 0, 0, HEADER) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 2835, 2835, 0, 0)


def decoded(data: bytes) -> tuple[int, int, int, int]:
    """(height, width, where rows begin, bytes of a row) of a 24-bit bitmap; a negative height means that rows run downwards."""
    magic, start = data[:2], struct.unpack_from("<I", data, 10)[0]
    _, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if magic != b"BM" or bits != 24 or packing:
        raise ValueError("not an uncompressed 24-bit bitmap")
    return h, w, start, (3 * w + 3) // 4 * 4


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, root = _store(self.path)
        files = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".bmp"))
        runs, size = [], RUN
        for path, n in files:
            if size + n > RUN:
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += n
        return [Files(tuple(r)) for r in runs]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        import numpy as np

        store, _ = _store(self.path)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for path in partition.paths if partition else ():
            with store.open_input_stream(path) as f:
                data = f.read()
            h, w, start, row = decoded(data)
            px = np.frombuffer(data, np.uint8, abs(h) * row, start).reshape(abs(h), row)[:, : 3 * w].reshape(abs(h), w, 3)
            px = px[::-1] if h > 0 else px
            name = path.rsplit("/", 1)[-1].removesuffix(".bmp")
            step = max(1, STRIP // max(1, w))
            for top in range(0, abs(h), step):
                part = px[top : top + step]
                n = part.shape[0] * w
                y, x = np.repeat(np.arange(top, top + part.shape[0]), w), np.tile(np.arange(w), part.shape[0])
                bands = [pa.array(part[:, :, 2 - k].ravel().astype(np.int32)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(y, pa.int64()), pa.array(x, pa.int64()), *bands], names)


@dataclass
class Written(WriterCommitMessage):
    moves: tuple[tuple[str, str], ...]


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        """Rows of (image_id, y, x, b1, b2, b3), an image after the other. Absent pixels are black."""
        import numpy as np

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        moves, now, held = [], None, []

        def put() -> None:
            cells = np.array(held, np.int64)
            h, w = int(cells[:, 0].max()) + 1, int(cells[:, 1].max()) + 1
            px = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
            for k in range(3):  # blue comes first
                px[h - 1 - cells[:, 0], 3 * cells[:, 1] + k] = np.clip(cells[:, 4 - k], 0, 255)
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(_header(h, w) + px.tobytes())
            moves.append((hidden, f"{root}/{now}.bmp"))

        for r in rows:
            if r["image_id"] != now:
                if held:
                    put()
                now, held = r["image_id"], []
            held.append((r["y"], r["x"], *(r[b] or 0 for b in BANDS)))
        if held:
            put()
        return Written(tuple(moves))

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for hidden, path in m.moves if m else ():
                store.move(hidden, path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for hidden, _ in m.moves if m else ():
                store.delete_file(hidden)


class Bitmaps(DataSource):
    """Bitmaps of one folder (option ``path``)."""

    @classmethod
    def name(cls) -> str:
        return "bmp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    """Makes the format ``bmp`` known to a session."""
    spark.dataSource.register(Bitmaps)
    return spark


def write_bitmaps(pixels: DataFrame, path: str) -> None:
    """One file per image, of bands b1, b2 and b3 as bytes (rounded and held in 0 to 255; NULL is 0)."""
    register(pixels.sparkSession)
    byte = lambda b: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.coalesce(b, F.lit(0)))))
    rows = pixels.select(F.col("image_id").cast("string").alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[byte(b).cast("int").alias(b) for b in BANDS])
    rows.repartition("image_id").sortWithinPartitions("image_id", "y", "x").write.format("bmp").mode("append").save(path)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return register(spark).read.format("bmp").load(path)
