"""Substring dedup over word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash among its ``MINIMISER``-word grams; consecutive
windows that share it travel as one packed string to the minimiser's bucket, so equal windows always meet. In a bucket all
windows are sorted by a 64-bit hash; windows of equal hash are compared word for word, and each that is not the first (by
document id, then place) is repeated. The same settling runs on each slice of the input before anything travels: a
slice sends a repeated window once, so that copies do not pile up in a bucket, and a bucket is settled in bounded parts of
which only first occurrences are carried on. Buckets are as many as the texts' bytes ask for. A bucket that holds more than
``HELD`` bytes of different windows all the same (windows around one frequent phrase) is dealt again, each window by a hash
of its own, so that no task holds more.

Words are runs without ASCII white space, unchanged; NULL texts have none. A NULL id counts as the largest one. Different
texts of one id, or without id, are different documents, ordered by a digest of the text: of their common windows the first
stays. Rows of the same id and text are one document seen twice: they remove nothing from each other and all get the same
result. Extra columns are ignored by :func:`deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, spread

WINDOW, MINIMISER = 20, 3
#: Bytes of text in a slice of the input, and in a part of a bucket.
SLICE, PART = 4 << 20, 4 << 20
#: Bytes of text to a bucket, and bytes of different windows that a bucket holds at once before it is dealt again.
BUCKET, HELD = 2 << 20, 8 << 20
#: A packed string has this many windows at most.
LONGEST = 4096
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    found = _kept.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        found = _kept[base] = np.cumprod(found, dtype=np.uint64)
    return found[:n]


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of values[lo:hi], all at once from running sums."""
    n = len(values)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * _powers(base, n), dtype=np.uint64)])
    return (total[hi] - total[lo]) * _powers(pow(base, -1, 1 << 64), n + 1)[lo]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words, in steps of about 1 MB so that the running sums stay small."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20))))
        lo, hi = int(starts[at]), int(ends[to - 1])
        out[at:to] = _sums(data[lo:hi], starts[at:to] - lo, ends[at:to] - lo, _BASE)
        at = to
    return _mixed(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Units:
    """Stretches of documents: words each followed by one space, and where a stretch begins. Sorted by (doc, sub, start)."""

    data: np.ndarray  # uint8
    words: np.ndarray  # words of each stretch
    doc: np.ndarray
    sub: np.ndarray  # tells texts of one id apart
    start: np.ndarray

    @staticmethod
    def of_texts(texts: list[bytes], docs: np.ndarray, subs: np.ndarray | None = None) -> Units:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[raw]
        before = np.concatenate([[True], space[:-1]])
        keep = ~(space & before)
        data = np.where(space, np.uint8(32), raw)[keep]
        ends = np.cumsum([len(t) + 1 for t in texts])
        seen = np.cumsum(space & ~before)
        words = np.diff(np.concatenate([[0], seen[ends - 1]])) if len(texts) else np.zeros(0, np.int64)
        return Units(data, words, docs, np.zeros(len(texts), np.int64) if subs is None else subs, np.zeros(len(texts), np.int64))

    @staticmethod
    def joined(parts: list[Units]) -> Units:
        """All stretches, in order of document and place."""
        doc, sub, start, words, data = (np.concatenate([getattr(p, k) for p in parts]) for k in ("doc", "sub", "start", "words", "data"))
        order = np.lexsort((start, sub, doc))
        if (order[1:] > order[:-1]).all():
            return Units(data, words, doc, sub, start)
        ends = np.flatnonzero(data == 32)
        last = ends[np.cumsum(words) - 1] + 1
        first = np.concatenate([[0], last[:-1]])
        raw = data.tobytes()
        data = np.frombuffer(b"".join([raw[a:b] for a, b in zip(first[order].tolist(), last[order].tolist())]), np.uint8)
        return Units(data, words[order], doc[order], sub[order], start[order])

    def pack(self) -> bytes:
        import zstandard

        some = bool(self.sub.any())
        head = np.array([len(self.words), some], np.int64)
        # stretches are sorted by document, so that steps between ids are small; a stretch has LONGEST + WINDOW words at most
        parts = [np.diff(self.doc, prepend=0), *[self.sub] * some, self.start.astype(np.int32), self.words.astype(np.uint16), self.data]
        body = b"".join([head.tobytes(), *[x.tobytes() for x in parts]])
        return zstandard.ZstdCompressor(level=3).compress(body)

    @staticmethod
    def unpack(packed: bytes) -> Units:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(packed)
        n, some = np.frombuffer(body, np.int64, 2).tolist()
        doc = np.cumsum(np.frombuffer(body, np.int64, n, 16))
        sub = np.frombuffer(body, np.int64, n, 16 + 8 * n) if some else np.zeros(n, np.int64)
        at = 16 + 8 * n * (1 + some)
        start, words = np.frombuffer(body, np.int32, n, at).astype(np.int64), np.frombuffer(body, np.uint16, n, at + 4 * n).astype(np.int64)
        return Units(np.frombuffer(body, np.uint8, -1, at + 6 * n), words, doc, sub, start)


@dataclass
class Settled:
    """Windows of some units: which are repeated, and what is needed to pack those that go on."""

    units: Units
    ends: np.ndarray  # of each word's space in the data
    unit: np.ndarray  # of each word
    at: np.ndarray  # a word's place in its document
    word_hash: np.ndarray
    first: np.ndarray  # the first word of each window
    repeated: np.ndarray  # flag of each window
    settled: np.ndarray  # flag of each window that need not go on: it is repeated, or stands here for the same document twice
    keys: np.ndarray  # hash of each window

    def _runs(self, chosen: np.ndarray, also: np.ndarray | None = None, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first window's first word, last window's first word) of consecutive chosen windows within a unit that agree in ``also``."""
        at = self.first[chosen]
        if not len(at):
            return at, at
        new = (np.diff(at) != 1) | (np.diff(self.unit[at]) != 0)
        if also is not None:
            new |= also[1:] != also[:-1]
        bounds = np.flatnonzero(np.concatenate([[True], new, [True]]))
        if longest:
            sizes = np.diff(bounds)
            if (sizes > longest).any():
                bounds = np.unique(np.concatenate([np.arange(a, b, longest) for a, b in zip(bounds[:-1], bounds[1:])] + [bounds[-1:]]))
        return at[bounds[:-1]], at[bounds[1:] - 1]

    def repeats(self) -> np.ndarray:
        """Rows of (doc, sub, from, to): words that repeated windows cover."""
        a, b = self._runs(self.repeated)
        of = self.unit[a]
        return np.stack([self.units.doc[of], self.units.sub[of], self.at[a], self.at[b] + WINDOW], 1).astype(np.int64)

    def _stretches(self, a: np.ndarray, b: np.ndarray) -> Units:
        lo = np.where(a > 0, self.ends[a - 1] + 1, 0)
        hi = self.ends[b + WINDOW - 1] + 1
        raw, of = self.units.data.tobytes(), self.unit[a]
        data = np.frombuffer(b"".join([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())]), np.uint8)
        return Units(data, b - a + WINDOW, self.units.doc[of], self.units.sub[of], self.at[a])

    def carried(self) -> Units:
        """Stretches with all windows that go on."""
        return self._stretches(*self._runs(~self.settled, longest=LONGEST))

    def dealt(self, buckets: int, alone: bool = False) -> Iterator[tuple[int, Units]]:
        """Super-k-mers of the windows that go on, by bucket; or each window by its own hash."""
        n, chosen = len(self.ends), ~self.settled
        if not chosen.any():
            return
        if alone:
            least = self.keys[chosen]
        else:
            lo = np.arange(n - MINIMISER + 1)
            grams = _mixed(_sums(self.word_hash, lo, lo + MINIMISER, _STEP))
            width, least, have = WINDOW - MINIMISER + 1, grams, 1
            while have < width:  # minimum over a window's grams, by doubling
                step = min(have, width - have)
                least = np.minimum(least[: len(least) - step], least[step:])
                have += step
            least = least[self.first[chosen]]
        a, b = self._runs(chosen, least, LONGEST)
        at = np.searchsorted(self.first[chosen], a)
        bucket = (_mixed(least[at]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
        for x, y in zip(bounds[:-1], bounds[1:]):
            some = order[x:y]
            yield int(bucket[some[0]]), self._stretches(a[some], b[some])


def settle(units: Units) -> Settled:
    """Finds every window of the units that has an equal one earlier, exactly."""
    ends = np.flatnonzero(units.data == 32)
    unit = np.repeat(np.arange(len(units.words)), units.words)
    unit_first = np.cumsum(units.words) - units.words
    inside = np.arange(len(ends)) - unit_first[unit]
    at = inside + units.start[unit]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    hashes = _word_hashes(units.data, starts, ends)
    first = np.flatnonzero(inside <= units.words[unit] - WINDOW)
    repeated, settled = np.zeros(len(first), bool), np.zeros(len(first), bool)
    keys = _sums(hashes, first, first + WINDOW, _STEP) if len(first) else np.zeros(0, np.uint64)
    out = Settled(units, ends, unit, at, hashes, first, repeated, settled, keys)
    if len(first) < 2:
        return out
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    bounds = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([bounds, [len(order)]]))
    if sizes.max() == 1:
        return out
    several = np.repeat(sizes > 1, sizes)
    keepers = np.repeat(np.minimum.reduceat(order, bounds), sizes)[several]  # units are sorted: the least index comes first
    members = order[several]
    pairs = members != keepers
    members, keepers = members[pairs], keepers[pairs]
    by_place = np.argsort(members)
    members, keepers = members[by_place], keepers[by_place]
    odd = _differing(units.data, starts, ends, first, unit, members, keepers)
    repeated[members] = True
    if odd:  # different windows of equal hash: decide their groups by the words themselves
        raw = units.data.tobytes()
        for k in {int(keys[m]) for m in odd}:
            seen: dict[bytes, int] = {}
            for m in np.flatnonzero(keys == np.uint64(k)).tolist():
                text = raw[starts[first[m]] : ends[first[m] + WINDOW - 1]]
                repeated[m] = text in seen
                seen.setdefault(text, m)
    settled |= repeated
    # a document that is there twice is no earlier than itself, and what is found for one of its rows holds for all
    of, to = unit[first[members]], unit[first[keepers]]
    same = (units.doc[of] == units.doc[to]) & (units.sub[of] == units.sub[to]) & (at[first[members]] == at[first[keepers]])
    for m, k in zip(members[same].tolist(), keepers[same].tolist()):
        repeated[m] = repeated[k]
    return out


def _differing(data, starts, ends, first, unit, members, keepers) -> list[int]:
    """Members whose words are not their keeper's. Runs of members whose keepers run along are compared as one string."""
    raw, odd = data.tobytes(), []
    a, b = first[members], first[keepers]
    new = np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1) | (np.diff(unit[a]) != 0) | (np.diff(unit[b]) != 0)])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(a)]]) - 1
    last = ends[a[hi] + WINDOW - 1], ends[b[hi] + WINDOW - 1]
    for n, (p, q, r, s) in enumerate(zip(starts[a[lo]].tolist(), last[0].tolist(), starts[b[lo]].tolist(), last[1].tolist())):
        if raw[p:q] != raw[r:s]:
            odd += members[lo[n] : hi[n] + 1].tolist()
    return odd


def _slices(batch: pd.DataFrame) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts with their keys and subkeys, in slices of about SLICE bytes."""
    texts, docs, size = [], [], 0
    for key, sub, text in zip(batch["__key"].tolist(), batch["__sub"].tolist(), batch["text"]):
        data = text.encode("utf-8")
        if size and size + len(data) > SLICE:
            yield texts, *np.array(docs, np.int64).T
            texts, docs, size = [], [], 0
        texts.append(data)
        docs.append((key, sub))
        size += len(data)
    if texts:
        yield texts, *np.array(docs, np.int64).T


def _sorted_units(texts: list[bytes], docs: np.ndarray, subs: np.ndarray) -> Units:
    order = np.lexsort((subs, docs))
    return Units.of_texts([texts[i] for i in order], docs[order], subs[order])


PACKED = "bucket long, kind int, packed binary"
#: What a packed row holds.
TEXT, SPANS = 0, 1


def packed_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "packed"])


def packed_spans(spans: np.ndarray) -> bytes:
    """Rows of (doc, sub, from, to), column by column."""
    import zstandard

    parts = [np.diff(spans[:, 0], prepend=0), *(np.ascontiguousarray(spans[:, k]) for k in (1, 2, 3))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([x.tobytes() for x in parts]))


FOUND = "__key long, __sub long, span long"


def spans_of(packed) -> pd.DataFrame:
    """A row per stretch; ``span`` holds where it begins in its upper half and where it ends in its lower half."""
    import zstandard

    doc, sub, lo, hi = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(packed)), np.int64).reshape(4, -1)
    return pd.DataFrame({"__key": np.cumsum(doc), "__sub": sub, "span": lo << 32 | hi})


def ends_of(spans: list[int]) -> tuple[np.ndarray, np.ndarray]:
    some = np.array(spans, np.int64)
    return some >> 32, some & (1 << 32) - 1


def repeats(docs: DataFrame, buckets: int, held_most: int = HELD) -> DataFrame:
    """(__key, __sub, span): stretches of words that repeated windows cover. docs has ``__key``, ``__sub`` and ``text``."""
    n = buckets

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts, keys, subs in _slices(batch):
                found = settle(_sorted_units(texts, keys, subs))
                rows = [(b, TEXT, u.pack()) for b, u in found.dealt(n)]
                spans = found.repeats()
                if len(spans):
                    rows.append((int(keys[0]) % n, SPANS, packed_spans(spans)))
                if rows:
                    yield packed_rows(rows)

    def bucket_parts(batches: Iterator[pd.DataFrame], most: int | None) -> Iterator[list[tuple]]:
        """Settles bucket by bucket in parts. Beyond ``most`` bytes of different windows, a bucket's windows are dealt again."""
        now, held, size, step, over = None, [], 0, PART, False

        def out() -> tuple[list[tuple], Units | None]:
            found = settle(Units.joined(held))
            spans = found.repeats()
            rows = [(int(now) * 31 % n, SPANS, packed_spans(spans))] if len(spans) else []
            kept = found.carried()
            if over or most is not None and len(kept.data) > most:
                return rows + [(b, TEXT, u.pack()) for b, u in found.dealt(n, alone=True)], None
            return rows, kept

        for batch in batches:
            for bucket, kind, packed in zip(batch["bucket"].tolist(), batch["kind"].tolist(), batch["packed"]):
                if kind == SPANS:
                    yield [(bucket, kind, packed)]
                    continue
                if bucket != now or size > step:
                    kept = None
                    if held:
                        rows, kept = out()
                        over = kept is None
                        yield rows
                    if bucket != now:
                        kept, over = None, False
                    held = [kept] if kept is not None else []
                    # steps grow with what is carried on, so that a bucket of unequal windows is not settled again and again
                    now, size, step = bucket, 0, max(PART, sum(len(u.data) for u in held))
                held.append(Units.unpack(bytes(packed)))
                size += len(held[-1].data)
        if held:
            yield out()[0]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in bucket_parts(batches, held_most):
            if rows:
                yield packed_rows(rows)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in bucket_parts(batches, None):
            for _, _, packed in rows:
                yield spans_of(packed)

    gathered = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    dealt = gathered(docs.select("__key", "__sub", "text").mapInPandas(deal, PACKED))
    return gathered(dealt.mapInPandas(meet, PACKED)).mapInPandas(end, FOUND)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans): each document beside the distinct stretches that were found in it, NULL for none."""
    found = spans.groupBy(F.col("__key").alias("__k"), F.col("__sub").alias("__s")).agg(F.collect_set("span").alias("spans"))
    return docs.join(found, (F.col("__key") == F.col("__k")) & (F.col("__sub") == F.col("__s")), "left").select("doc_id", "text", "spans")


def deduplicated(docs: DataFrame, buckets: int | None = None, held_most: int = HELD) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_sha256."""
    keyed, size = identified(docs)
    rows = with_spans(keyed, repeats(keyed, buckets or spread(size, BUCKET, docs), held_most))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = text.encode("utf-8").split()  # bytes split at ASCII white space
                kept = words
                if found:
                    edges = np.zeros(len(words) + 1, np.int64)
                    lo, hi = ends_of(found)
                    np.add.at(edges, lo, 1)
                    np.add.at(edges, hi, -1)
                    kept = [w for w, n in zip(words, np.cumsum(edges[:-1]).tolist()) if not n]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(keep, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")
