"""Ranked lexical search, a term at a time with limited accumulators.

Documents are dealt to segments; a segment holds, for each term that some query has, the documents with the term and how
often they hold it. A query is run on a segment a term at a time, the rarest first: documents with the term get
accumulators, to which the term's parts of the score are added. Once the greatest parts that all remaining terms can give
are together less than the kth partial score, no document without an accumulator can come among the first k: from there on
no accumulator is created, and those that exist are still updated exactly. A segment gives its k best for each query; the k
best of all segments are the result.

Segments are built and searched where the documents are read, so that nothing but counts and winners travels. Queries come
in blocks of about ``BLOCK`` distinct terms at most, whose terms and document counts each task gets; a larger set of queries
takes as many passes as it has blocks. Sizes, weights and counts are those of the whole table.

NULL and blank texts have no terms: they are not counted and never found. Every row of documents is a document of its own,
so repeated rows are each found; equal scores are ordered by id, NULL last. Queries that agree in id and text are one. Empty
tables give no rows. Extra columns are ignored. A document, and a query, must fit in a task.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 20
#: Terms of a block of queries, documents and postings of a segment.
BLOCK, DOCUMENTS, POSTINGS = 200_000, 16_384, 500_000
#: Bytes that belong to no term become blanks, A-Z lower case.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
SEGMENT = "docs binary, sizes binary, terms binary, counts binary, places binary, times binary"


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a whole text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


class Segment:
    """Documents being gathered: rows of (document's place, term, times)."""

    def __init__(self):
        self.docs, self.sizes, self.places, self.terms, self.times = (array(t) for t in "qqiii")

    def add(self, doc: int, size: int, held: list[tuple[int, int]]) -> None:
        place = len(self.docs)
        self.docs.append(doc)
        self.sizes.append(size)
        for term, times in held:
            self.places.append(place)
            self.terms.append(term)
            self.times.append(times)

    def packed(self) -> list[bytes]:
        """Columns of SEGMENT: postings by term, in each term by document."""
        import numpy as np

        terms = np.array(self.terms, np.int32)
        order = np.argsort(terms, kind="stable")
        distinct, counts = np.unique(terms, return_counts=True)
        arrays = (np.array(self.docs, np.int64), np.array(self.sizes, np.int64), distinct, counts.astype(np.int32), np.array(self.places, np.int32)[order], np.array(self.times, np.int32)[order])
        return [a.tobytes() for a in arrays]


def indexed(docs: DataFrame, vocabulary) -> DataFrame:
    """Segments of docs (doc, text) with the terms of the vocabulary (a broadcast dict from term to number); ``sizes`` are of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, segment = vocabulary.value, Segment()
        names = [f.split()[0] for f in SEGMENT.split(", ")]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in segment.packed()], names)
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if words:
                    segment.add(doc, len(words), [(known[w], n) for w, n in Counter(words).items() if w in known])
                if len(segment.docs) >= DOCUMENTS or len(segment.terms) >= POSTINGS:
                    yield pack()
                    segment = Segment()
        if segment.docs:
            yield pack()

    return docs.mapInArrow(run, SEGMENT)


def document_counts(segments: DataFrame) -> DataFrame:
    """(term, df) over all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int32)), pa.array(np.frombuffer(counts, np.int32).astype(np.int64))], ["term", "df"])

    return segments.select("terms", "counts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def totals(segments: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sizes = [np.frombuffer(s, np.int64) for s in batch.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], ["n", "l"])

    found = segments.select("sizes").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return found[0] or 0, found[1] or 0


def best(postings: list[tuple], size: int, k: int = K):
    """The k best documents of a segment: (scores, places), and how many accumulators were created.

    postings: for each term of the query (places, parts of the score, times that the query has the term); rarest term first.
    Parts are whole numbers, so that sums are exact in any order. Fewer places may have a score above 0."""
    import numpy as np

    bounds = [int(parts.max(initial=0)) * n for _, parts, n in postings]
    rest, score, created = sum(bounds), np.zeros(size, np.int64), np.zeros(size, bool)
    survivors = None
    for (places, parts, n), bound in zip(postings, bounds):
        rest -= bound
        if survivors is not None:
            alive = created[places]
            score[places[alive]] += parts[alive] * n
            continue
        score[places] += parts * n
        created[places] = True
        now = score[created]
        if len(now) >= k and rest < np.partition(now, len(now) - k)[len(now) - k]:
            survivors = len(now)
    at = np.flatnonzero(score)
    if len(at) > k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]  # ties with the last place are all kept: ids decide later
    return score[at], at, int(created.sum()) if survivors is None else survivors


def searched(segments: DataFrame, asked, n: int, length: int, k: int = K) -> DataFrame:
    """(query, doc, score): at least the k best of each segment. asked (a broadcast): for each query its number and terms as
    (term, weight, times), rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in zip(*(batch.column(f.split()[0]).to_pylist() for f in SEGMENT.split(", "))):
                docs, sizes, terms, counts, places, times = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)))
                times = times.astype(np.int64)
                norm = 100 - 25 + (25 * sizes * n) // length
                parts = (1_000_000_000 * times) // (1000 * times + 12 * norm[places])
                ends = np.cumsum(counts)
                here = {t: (e - c, e) for t, e, c in zip(terms.tolist(), ends.tolist(), counts.tolist())}
                out = []
                for query, wanted in asked.value:
                    found = [(places[slice(*here[t])], parts[slice(*here[t])] * w, times_) for t, w, times_ in wanted if t in here]
                    score, at, _ = best(found, len(docs), k)
                    if len(at):
                        # one of a document's own ties beyond k is enough: the least ids
                        order = np.lexsort((docs[at], -score))[:k]
                        out.append((np.full(len(order), query), docs[at[order]], score[order]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query", "doc", "score"])

    return segments.mapInArrow(run, "query long, doc long, score long")


def _blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """Distinct queries (id, text) with the number of their block, by hash, and the number of blocks."""
    rows = queries.filter("text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK)))  # a term takes four characters or so, or is found in several queries
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), blocks


def search(docs: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", query_key: str = "item_id") -> DataFrame:
    """(query_key, rank, key, score): the k documents of highest score above 0 of each query, fewer if there are fewer.

    Both tables have a key, a whole number, and ``text``."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[key], dict(queries.dtypes)[query_key]
    no_id = (1 << 63) - 1  # stands for NULL, ordered last
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(no_id)).alias("doc"), "text")
    dealt, blocks = _blocks(queries.select(F.col(query_key).cast("long").alias("id"), "text"))
    dealt = cut(dealt) if blocks > 1 else dealt
    parts = []
    for b in range(blocks):
        items = sorted(dealt.filter(F.col("block") == b).select("id", "text").collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))
        counted = [Counter(terms_of(r["text"])) for r in items]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        segments = cut(indexed(rows, spark.sparkContext.broadcast(vocabulary)))
        n, length = totals(segments)
        df = dict(map(tuple, document_counts(segments).collect()))  # at most the block's terms
        asked = []
        for q, counts in enumerate(counted):
            wanted = sorted((df[i], i, times) for t, times in counts.items() if (i := vocabulary[t]) in df)
            asked.append((q, [(i, w, times) for d, i, times in wanted if (w := weight(n, d)) > 0]))
        found = searched(segments, spark.sparkContext.broadcast(asked), n, length, k)
        names = spark.createDataFrame([(q, r["id"]) for q, r in enumerate(items)], "query long, id long")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
        first = found.withColumn("rank", place).filter(F.col("rank") <= k)
        parts.append(first.join(F.broadcast(names), "query").select("id", "rank", "doc", "score"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    doc = F.when(F.col("doc") != no_id, F.col("doc"))
    return out.select(F.col("id").cast(kinds[1]).alias(query_key), "rank", doc.cast(kinds[0]).alias(key), "score")
