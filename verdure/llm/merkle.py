"""Merkle manifest of a dataset by time-forward processing.

Each row is a leaf: the SHA-256 of its fields. The leaves of a tree value (a source) ascend by key; ``FAN`` consecutive nodes
have a parent, level by level, until one is left, the subroot. Subroots in the order of their tree values have the root.

Nodes of a block (``FAN ** LEVELS`` consecutive leaves) are labelled by the last leaf below them and their level, so that
each comes behind all its children. The forward sweep goes through a block by label: a priority queue ordered by label holds
the digests sent to parents, and delivers them when the sweep comes to the parent. Between blocks Spark's sorted exchange
is that queue, on disk: block roots are sent to the next round's blocks. The reversed sweep goes from the root's round to the
leaves' by descending label: a node sends each child the path above it (siblings to the left and right, level by level), so
that leaves get whole proofs. A sweep holds one block and at most ``FAN * LEVELS`` messages; no tree is in one task.

Leaves are numbered range by range: rows are sorted by (tree value, key, leaf) into ranges, and each range is told how many
rows and trees stand before it (one row per partition passes through the driver, whatever the number of rows or trees).

NULL fields are ``-``; a NULL tree value is a tree of its own and comes first; NULL keys come first in their tree. Rows of
one tree and key are ordered by their leaf, so that repeated rows, which are leaves each, get defined places. A lone leaf is
its subroot, a lone subroot the root. An empty table gives no rows. Extra columns are ignored. A row must fit in a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 16, 2
HEX = 64
PATH = "array<struct<left:binary,right:binary>>"


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length in bytes."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, fields)), 256)


def tampered_rows(key: Column) -> Column:
    """Rows whose decimal key has a CRC-32 that 5 divides; none without a key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (key, tree_value, leaf, found) with ``tree`` and ``idx``: places of the tree value and of the leaf in its tree, from 0."""
    order = ["tree_value", "key", "leaf", "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows take any order among themselves, but need not share a range: tie deals them out
    tied = cut(rows.withColumn("tie", F.monotonically_increasing_id()))
    sorted_rows = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, last = -1, 0, None
        for batch in batches:
            runs, ats = [], []
            for value in batch.column("tree_value").to_pylist():
                if run < 0 or value != last:
                    run, at, last = run + 1, 0, value
                runs.append(run)
                ats.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64()), pa.array(ats, pa.int64())], [*batch.schema.names, "run", "at"])

    sorted_rows = sorted_rows.drop("tie")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    placed = cut(sorted_rows.mapInArrow(places, f"{schema}, run long, at long"))
    runs = placed.groupBy("range", "run").agg(F.count("*").alias("n"), F.first("tree_value").alias("value"))
    ends = lambda f, name: f(F.struct("value", "n"), F.col("run")).alias(name)
    ranges = runs.groupBy("range").agg((F.max("run") + 1).alias("runs"), ends(F.min_by, "first"), ends(F.max_by, "last")).orderBy("range").collect()
    carried, trees, before, value = [], 0, 0, None
    for r in ranges:  # one for each partition
        goes_on = trees > 0 and r["first"]["value"] == value
        carried.append((r["range"], trees - goes_on, before if goes_on else 0))
        trees += r["runs"] - goes_on
        before = r["last"]["n"] + (before if goes_on and r["runs"] == 1 else 0)
        value = r["last"]["value"]
    known = F.broadcast(rows.sparkSession.createDataFrame(carried, "range int, trees long, before long"))
    idx = F.col("at") + F.when(F.col("run") == 0, F.col("before")).otherwise(0)
    return placed.join(known, "range").select("key", "leaf", "found", (F.col("trees") + F.col("run")).alias("tree"), idx.alias("idx"))


def forward(digests: list[bytes], first: bool, levels: int = LEVELS) -> list[tuple]:
    """Inner nodes of a block in the order of their labels: (end, level, index, digest, children's digests as one).

    The first block of a tree, if it is not full, is a whole tree and ends with its root; others go up all levels."""
    n = len(digests)
    top = levels
    if first and n < FAN**levels:
        top = next(k for k in range(levels + 1) if FAN**k >= n)
    label = lambda level, i: (min((i + 1) * FAN**level, n) - 1, level)
    queue: list[tuple] = []  # (label of the addressee, its index, the sender's place, digest)
    nodes = []
    for at, digest in enumerate(digests if top else []):
        heapq.heappush(queue, (label(1, at // FAN), at // FAN, at, digest))
        while queue and queue[0][0][0] == at:
            (end, level), index = queue[0][:2]
            children = b""
            while queue and queue[0][0] == (end, level):
                children += heapq.heappop(queue)[3]
            own = sha256(children).hexdigest().encode()
            nodes.append((end, level, index, own, children))
            if level < top:
                heapq.heappush(queue, (label(level + 1, index // FAN), index // FAN, index, own))
    return nodes


_SWEPT = "tree long, block long, end int, level int, index int, digest binary, children binary, is_root boolean"
_SWEPT_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]


def climbed(nodes: DataFrame) -> DataFrame:
    """One round of the forward sweep over (tree, idx, digest): the inner nodes of all blocks; a block that is one node is its
    own root, without children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def finished() -> list[tuple]:
            inner = forward(held, key[1] == 0)
            if not inner:
                return [(*key, 0, 0, 0, held[0], None, True)]
            return [(*key, *node, node is inner[-1]) for node in inner]

        for batch in batches:
            out = []
            for tree, block, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "digest"))):
                if (tree, block) != key:
                    if held:
                        out += finished()
                    key, held = (tree, block), []
                held.append(digest)
            if out:
                yield _batch(out)
        if held:
            yield _batch(finished())

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in _SWEPT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SWEPT_ARROW)], names)

    dealt = nodes.select("tree", F.expr(f"idx div {FAN**LEVELS}").alias("block"), "idx", "digest")
    return cut(dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(run, _SWEPT))


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of the forward sweep until every tree has one node; each is written to the shared folder."""
    out = [climbed(nodes)]
    while not out[-1].filter("block > 0").isEmpty():
        out.append(climbed(_roots(out[-1]).select("tree", F.col("block").alias("idx"), "digest")))
    return out


def _roots(swept: DataFrame) -> DataFrame:
    return swept.filter("is_root")


class Backward:
    """The reversed sweep through rows of a task, sorted by block and descending label."""

    def __init__(self):
        self.queue: list[tuple] = []
        self.outer: tuple | None = None

    def message(self, path: list[dict]) -> None:
        """A block begins: the path above its root."""
        above: tuple | None = None
        for step in reversed(path):
            above = ((step["left"], step["right"]), above)
        self.queue, self.outer = [], (above,)

    def path(self, end: int, level: int) -> tuple | None:
        """The path delivered to the node of this label. A path is a linked list of (left, right) from the node upwards."""
        if self.outer is not None:
            (above,), self.outer = self.outer, None
            return above
        label, above = heapq.heappop(self.queue)
        assert label == (-end, -level)
        return above

    def inner(self, end: int, level: int, index: int, children: bytes) -> None:
        """An inner node: sends each child its siblings and the path above."""
        above, n = self.path(end, level), len(children) // HEX
        for j in range(n):
            last = end if j == n - 1 else (index * FAN + j + 1) * FAN ** (level - 1) - 1
            beside = (children[: j * HEX], children[(j + 1) * HEX :])
            heapq.heappush(self.queue, ((-last, 1 - level), (beside, above)))


def folded(digest: bytes, path: tuple | None) -> str:
    """The digest carried up along the path."""
    while path is not None:
        (left, right), path = path
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest.decode()


def proof(path: tuple | None) -> str:
    """SHA-256 of all siblings along the path."""
    h = sha256()
    while path is not None:
        (left, right), path = path
        h.update(left)
        h.update(right)
    return h.hexdigest()


def descended(swept: DataFrame, paths: DataFrame, leaves: DataFrame, fields: str, made) -> DataFrame:
    """One round of the reversed sweep: all columns of leaves (of which tree, idx and digest are known) beside ``fields``.

    paths: (tree, block, path, subroot, root). made(path, digest, found, subroot, root) gives the values of fields."""
    size = FAN**LEVELS
    kept = [c for c in leaves.columns if c not in ("tree", "idx")]
    void = {f.name: F.lit(None).cast(f.dataType) for f in leaves.schema.fields}
    block = F.expr(f"idx div {size}").alias("block")
    at = (F.col("idx") % size).cast("int").alias("end")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    bottom = leaves.select("tree", block, at, F.lit(0).alias("level"), none("int", "index"), none("binary", "children"), none(PATH, "path"), none("string", "subroot"), none("string", "root"), *kept)
    inner = swept.filter("children is not null").select("tree", "block", "end", "level", "index", "children", none(PATH, "path"), none("string", "subroot"), none("string", "root"), *[void[c].alias(c) for c in kept])
    begin = paths.select("tree", "block", F.lit(size).alias("end"), F.lit(LEVELS + 1).alias("level"), none("int", "index"), none("binary", "children"), "path", "subroot", "root", *[void[c].alias(c) for c in kept])
    rows = begin.unionByName(inner).unionByName(bottom).repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("end"), F.desc("level"))
    names = [f.split()[0] for f in fields.split(", ")]
    types = [pa.string() if f.split()[1] == "string" else pa.bool_() if f.split()[1] == "boolean" else pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())])) for f in fields.split(", ")]
    taken = ["tree", "block", "end", *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, subroot, root = Backward(), None, None
        for batch in batches:
            found = batch.column("found").to_pylist() if "found" in kept else [None] * len(batch)
            columns = [batch.column(c).to_pylist() for c in ("end", "level", "index", "children", "path", "subroot", "root", "digest")]
            places, out = [], []
            for i, (end, level, index, children, path, sub, whole, digest) in enumerate(zip(*columns)):
                if path is not None:
                    subroot, root = sub, whole
                    sweep.message(path)
                elif children is not None:
                    sweep.inner(end, level, index, children)
                else:
                    places.append(i)
                    out.append(made(sweep.path(end, level), digest, found[i], subroot, root))
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([*batch.select(taken).take(pa.array(places)).columns, *arrays], [*taken, *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in taken)
    return rows.mapInArrow(run, f"{schema}, {fields}").withColumn("idx", F.col("block") * size + F.col("end")).drop("block", "end")


def _steps(path: tuple | None) -> list[dict]:
    out = []
    while path is not None:
        (left, right), path = path
        out.append({"left": left, "right": right})
    return out


def _delivered(swept: list[DataFrame], bottom: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths for the blocks of the lowest round: from the highest to the second, each round tells the one below."""
    for above, below in zip(reversed(swept[1:]), reversed(swept[:-1])):
        leaves = _roots(below).select("tree", F.col("block").alias("idx"), "digest")
        told = descended(above, paths, leaves, f"path {PATH}, subroot string, root string", lambda path, digest, found, sub, root: (_steps(path), sub, root))
        paths = cut(told.select("tree", F.col("idx").alias("block"), "path", "subroot", "root"))
    return paths


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", key: str = "doc_id", tampered=None) -> DataFrame:
    """A row per document: key, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``tampered`` (a function from the fields' Columns by name to the Column of a changed leaf digest, NULL where unchanged)
    makes an audit: folded_root carries that leaf up with the siblings of the manifest, and verified says whether the root results."""
    columns = {f: F.col(f) for f in fields}
    changed = tampered(columns) if tampered else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("key"), F.col(tree).alias("tree_value"), leaf_digest(list(columns.values())).alias("leaf"), changed.alias("found"))
    # digests travel as bytes of their hex text
    leaves = cut(numbered(rows).select("key", "tree", "idx", F.col("leaf").cast("binary").alias("digest"), F.col("found").cast("binary").alias("found")))
    lower = rounds(leaves.select("tree", "idx", "digest"))
    subroots = _roots(lower[-1]).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    upper = rounds(subroots)
    top = _roots(upper[-1]).select("tree", "block", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").cast("string").alias("root"))
    told = _delivered(upper, subroots, top)
    whole = descended(upper[0], told, subroots, f"path {PATH}, subroot string, root string", lambda path, digest, found, sub, root: (_steps(path), digest.decode(), root))
    paths = cut(whole.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "subroot", "root"))
    paths = _delivered(lower, leaves, paths)

    def audited(path, digest, found, subroot, root):
        carried = folded(found or digest, path)
        return subroot, root, proof(path), carried, carried == root

    out = descended(lower[0], paths, leaves, "subroot string, root string, proof_sha256 string, folded_root string, verified boolean", audited)
    return out.select(F.col("key").alias(key), F.col("digest").cast("string").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents, audited against a copy in which some texts have lost their upper-case letters."""

    def lowered(columns: dict[str, Column]) -> Column:
        fields = {**columns, "text": ascii_lower(columns["text"])}
        return F.when(tampered_rows(columns["doc_id"]), leaf_digest(list(fields.values())))

    return manifest(docs, tampered=lowered)
