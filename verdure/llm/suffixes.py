"""Suffix-array dedup of byte strings by distributed prefix doubling.

Positions are ranked by ever longer prefixes: 16 bytes, then 33, then the threshold of 50. A longer rank is the pair of a
position's rank and the rank 17 bytes further on; Spark sorts the pairs, and a position whose pair stands in one document
only is unique and leaves.

A row for every byte would move many times the input, so that only sampled positions are ranked, which loses nothing: in
each 50-byte string the 16-byte prefix of least rank is its anchor, and equal strings have equal anchors at equal places.

* 16 bytes: a document's distinct anchors meet those of others in buckets (packed arrays, as there are most of them here).
* 33 bytes: each anchor that is left gives two rows of (rank, document), the pairs of ranks at offset 17 that begin at the
  anchor and that end with it. A 50-byte string reaches 17 bytes beyond its anchor at one side at least. Strings stay
  whose pairs on the sides that they reach are found in two documents or more.
* 50 bytes: text around what is left travels to its anchor's bucket; there all positions are sorted by the pair of
  33-byte ranks at offset 17, and equal ranks are compared byte for byte.

Slices of the input and parts of a bucket are settled in bounded pieces; of a string only the first document's occurrences
are carried on, so copies do not pile up. Buckets are as many as the texts' bytes ask for; one that holds more than
``HELD`` bytes of different strings all the same is dealt again, each string by a rank of its own.

Texts are UTF-8 bytes, NULL counts as empty, matches stay within a document. A NULL id counts as the largest. Different
texts of one id, or without id, are different documents, ordered by a digest of the text: of their common strings the first
one's stay. Rows of the same id and text are one document seen twice: they remove nothing from each other and all get the
same result. Extra columns are ignored by :func:`deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, spread
from .substrings import FOUND, LONGEST, PACKED, PART, SPANS, TEXT, _mixed, _slices, ends_of, packed_rows, packed_spans, spans_of, with_spans

#: Bytes of a string, of an anchor, and the offset at which ranks are paired: 16 + 17 = 33, 33 + 17 = 50.
LENGTH, ANCHOR, OFFSET = 50, 16, 17
#: Bytes of text to a bucket, and bytes of different strings that a bucket holds at once before it is dealt again.
BUCKET, HELD = 4 << 20, 8 << 20
#: Positions that are ranked at once.
BLOCK = 1 << 15
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of longer prefixes: each position's rank paired with the rank further on."""
    return _mixed(a * _A + b * _B)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one number: exact ranks of 8-byte prefixes."""
    n = len(data) - 7
    out = np.zeros(n, np.uint64)
    for k in range(min(8, n)):
        out[k::8] = data[k : k + (len(data) - k) // 8 * 8].view(">u8")
    return out


def _blocks(values: np.ndarray, reach: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``of`` gives for each position with ``reach`` values ahead, made in blocks that stay in a processor's cache."""
    n = len(values) - reach + 1
    out = np.zeros(max(n, 0), np.uint64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        out[lo:hi] = of(values[lo : hi + reach - 1])
    return out


@dataclass
class Stretches:
    """Stretches of documents' bytes. Sorted by (doc, sub, start)."""

    data: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    sub: np.ndarray  # tells texts of one id apart
    start: np.ndarray

    @staticmethod
    def of_texts(texts: list[bytes], docs: np.ndarray, subs: np.ndarray | None = None) -> Stretches:
        subs = np.zeros(len(texts), np.int64) if subs is None else subs
        order = np.lexsort((subs, docs))
        data = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
        return Stretches(data, np.array([len(texts[i]) for i in order], np.int64), docs[order], subs[order], np.zeros(len(texts), np.int64))

    @staticmethod
    def joined(parts: list[Stretches]) -> Stretches:
        doc, sub, start, size = (np.concatenate([getattr(p, k) for p in parts]) for k in ("doc", "sub", "start", "size"))
        raw = b"".join([p.data.tobytes() for p in parts])
        order = np.lexsort((start, sub, doc))
        ends = np.cumsum(size)
        lo, hi = (ends - size)[order].tolist(), ends[order].tolist()
        return Stretches(np.frombuffer(b"".join([raw[a:b] for a, b in zip(lo, hi)]), np.uint8), size[order], doc[order], sub[order], start[order])

    def pack(self) -> bytes:
        import zstandard

        some = bool(self.sub.any())
        # stretches are sorted by document, so that steps between ids are small; a stretch has LONGEST + LENGTH bytes at most
        head = [np.array([len(self.size), some], np.int64), np.diff(self.doc, prepend=0), *[self.sub] * some, self.start.astype(np.int32), self.size.astype(np.uint16), self.data]
        return zstandard.ZstdCompressor(level=3).compress(b"".join([x.tobytes() for x in head]))

    @staticmethod
    def unpack(packed: bytes) -> Stretches:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(packed)
        n, some = np.frombuffer(body, np.int64, 2).tolist()
        doc = np.cumsum(np.frombuffer(body, np.int64, n, 16))
        sub = np.frombuffer(body, np.int64, n, 16 + 8 * n) if some else np.zeros(n, np.int64)
        at = 16 + 8 * n * (1 + some)
        start, size = np.frombuffer(body, np.int32, n, at).astype(np.int64), np.frombuffer(body, np.uint16, n, at + 4 * n).astype(np.int64)
        return Stretches(np.frombuffer(body, np.uint8, -1, at + 6 * n), size, doc, sub, start)

    def documents(self) -> np.ndarray:
        """A running number of each stretch's document; larger ones are later in order."""
        return np.cumsum(np.concatenate([[False], (np.diff(self.doc) != 0) | (np.diff(self.sub) != 0)])[: len(self.doc)])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which LENGTH bytes of one stretch begin, and the stretch of each."""
        room = np.maximum(self.size - LENGTH + 1, 0)
        owner = np.repeat(np.arange(len(room)), room)
        first = np.cumsum(self.size) - self.size
        return np.arange(len(owner)) - (np.cumsum(room) - room)[owner] + first[owner], owner

    def ranks(self) -> np.ndarray:
        """The 16-byte rank of each position, from the ranks of eight bytes."""

        def of(data: np.ndarray) -> np.ndarray:
            eights = _eights(data)
            return _pair(eights[:-8], eights[8:])

        return _blocks(self.data, ANCHOR, of)

    def cut(self, a: np.ndarray, b: np.ndarray, owner: np.ndarray) -> Stretches:
        """Stretches from positions a to the ends of the strings that begin at b."""
        raw = self.data.tobytes()
        data = np.frombuffer(b"".join([raw[x:y] for x, y in zip(a.tolist(), (b + LENGTH).tolist())]), np.uint8)
        first = (np.cumsum(self.size) - self.size)[owner]
        return Stretches(data, b - a + LENGTH, self.doc[owner], self.sub[owner], self.start[owner] + a - first)


def anchors(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the first least of its 16-byte ranks stands in each of the strings that begin at these positions.

    The rank's upper half and the position make one number, of which a minimum is taken by doubling."""
    width, low = LENGTH - ANCHOR + 1, np.uint64((1 << 32) - 1)

    def of(some: np.ndarray) -> np.ndarray:
        have, place = 1, np.arange(len(some), dtype=np.uint64)
        least = some & ~low | place
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        return (least & low) - place[: len(least)]

    return at + _blocks(ranks, width, of)[at].astype(np.int64)


def _runs(at: np.ndarray, owner: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
    """Bounds of runs of consecutive positions of one stretch, of equal ``also``, and of bounded length."""
    if not len(at):
        return np.zeros(1, np.int64)
    new = (np.diff(at) != 1) | (np.diff(owner) != 0)
    if also is not None:
        new |= also[1:] != also[:-1]
    bounds = np.flatnonzero(np.concatenate([[True], new, [True]]))
    if (np.diff(bounds) > LONGEST).any():
        bounds = np.unique(np.concatenate([np.arange(x, y, LONGEST) for x, y in zip(bounds[:-1], bounds[1:])] + [bounds[-1:]]))
    return bounds


def repeated(s: Stretches, at: np.ndarray, owner: np.ndarray, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which strings also begin in an earlier document among the stretches, exactly; and which need not go on.

    The latter are the former, and strings that stand here for a document that is there twice.
    16-byte ranks are paired to 33 and then to 50 bytes; equal ranks stand together after a sort."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out, out
    ranks, doc = full_ranks(s.ranks() if ranks is None else ranks, at), s.documents()
    order = np.argsort(ranks)
    bounds = np.flatnonzero(np.concatenate([[True], ranks[order][1:] != ranks[order][:-1]]))
    sizes = np.diff(np.concatenate([bounds, [len(order)]]))
    if sizes.max() == 1:
        return out, out
    several = np.repeat(sizes > 1, sizes)
    keepers = np.repeat(np.minimum.reduceat(order, bounds), sizes)[several]  # sorted stretches: least index, least document
    members = order[several]
    pairs = doc[owner[members]] != doc[owner[keepers]]
    settled = _again(s, at, owner, doc)
    members, keepers = members[pairs], keepers[pairs]
    if not len(members):
        return out, settled
    by_place = np.argsort(members)
    members, keepers = members[by_place], keepers[by_place]
    out[members] = True
    raw, a, b = s.data.tobytes(), at[members], at[keepers]
    lo = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)]))
    hi = np.concatenate([lo[1:], [len(a)]]) - 1
    wrong = [n for n, (p, q, x, y) in enumerate(zip(a[lo].tolist(), a[hi].tolist(), b[lo].tolist(), b[hi].tolist())) if raw[p : q + LENGTH] != raw[x : y + LENGTH]]
    if wrong:  # different strings of equal rank: decide their groups by the bytes themselves
        for r in {int(ranks[m]) for n in wrong for m in members[lo[n] : hi[n] + 1]}:
            least: dict[bytes, int] = {}
            for m in np.flatnonzero(ranks == np.uint64(r)).tolist():
                text, of = raw[at[m] : at[m] + LENGTH], int(doc[owner[m]])
                out[m] = of > least.setdefault(text, of)
    return out, settled | out


def _again(s: Stretches, at: np.ndarray, owner: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which positions of a document stand among the stretches before."""
    if not (np.diff(doc) == 0).any():
        return np.zeros(len(at), bool)
    place = s.start[owner] + at - (np.cumsum(s.size) - s.size)[owner]
    order = np.lexsort((np.arange(len(at)), place, doc[owner]))
    out = np.zeros(len(at), bool)
    out[order] = ~_new(doc[owner][order], place[order])
    return out


def full_ranks(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ranks of the LENGTH bytes at positions, by pairs of ranks at growing offsets."""
    a, b, c = ranks[at], ranks[at + OFFSET], ranks[at + 2 * OFFSET]
    return _pair(_pair(a, b), _pair(b, c))


def _spans(s: Stretches, at: np.ndarray, owner: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Rows of (doc, sub, from, to): bytes that flagged strings cover."""
    at, owner = at[flags], owner[flags]
    bounds = _runs(at, owner)
    a, b, o = at[bounds[:-1]], at[bounds[1:] - 1], owner[bounds[:-1]]
    first = (np.cumsum(s.size) - s.size)[o]
    return np.stack([s.doc[o], s.sub[o], s.start[o] + a - first, s.start[o] + b - first + LENGTH], 1).astype(np.int64)


def _names(ranks: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket and 32 more bits of an anchor's rank as one number. Chance equals only keep more than is needed."""
    return (ranks % np.uint64(buckets) << np.uint64(32) | ranks >> np.uint64(32)).astype(np.int64)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Flags of rows that differ from the one before."""
    flags = np.ones(len(columns[0]), bool)
    if len(flags):
        flags[1:] = False
        for c in columns:
            flags[1:] |= c[1:] != c[:-1]
    return flags


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the indices of its rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
    for x, y in zip(ends[:-1], ends[1:]):
        yield int(bucket[order[x]]), order[x:y]


def shared_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(__k, __s, value): the anchors of each document that at least one more document has, shortened."""

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for texts, keys, subs in _slices(batch):
                s = Stretches.of_texts(texts, keys, subs)
                at, owner = s.windows()
                if not len(at):
                    continue
                ranks = s.ranks()
                place = anchors(ranks, at)
                first = _new(place)
                names, of = _names(ranks[place[first]], buckets), s.documents()[owner[first]]
                order = np.lexsort((names & 0xFFFFFFFF, of, names >> 32))
                order = order[_new(names[order], of[order])]
                names, of = names[order], of[order]
                heads = np.flatnonzero(_new(s.documents()))
                rows = []
                for bucket, some in _by_bucket(names >> 32):
                    doc, sub = s.doc[heads[of[some]]], s.sub[heads[of[some]]]
                    many = bool(sub.any())
                    parts = [np.array([len(some), many], np.int64), np.diff(doc, prepend=0), *[sub] * many, (names[some] & 0xFFFFFFFF).astype(np.uint32)]
                    rows.append((bucket, pack(b"".join([x.tobytes() for x in parts]))))
                yield pd.DataFrame(rows, columns=["bucket", "packed"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        def settle(held) -> tuple[pd.DataFrame, tuple]:
            """Documents of names that two have; of each name, the first document and whether it was told are carried on."""
            name, doc, sub, told = (np.concatenate([h[k] for h in held]) for k in range(4))
            order = np.lexsort((~told, sub, doc, name))
            name, doc, sub, told = name[order], doc[order], sub[order], told[order]
            bounds = np.flatnonzero(_new(name))
            sizes = np.diff(np.concatenate([bounds, [len(name)]]))
            many = np.add.reduceat(_new(name, doc, sub).astype(np.int64), bounds) > 1
            known = np.logical_or.reduceat(told, bounds)
            tell = np.repeat(many | known, sizes) & ~told
            out = pd.DataFrame({"__k": doc[tell], "__s": sub[tell], "value": _short(name[tell])})
            return out, (name[bounds], doc[bounds], sub[bounds], many | known)

        now, held, size, step = None, [], 0, PART // 8
        for batch in batches:
            for bucket, packed in zip(batch["bucket"].tolist(), batch["packed"]):
                if bucket != now or size > step:
                    if held:
                        out, carried = settle(held)
                        yield out
                        held = [carried] if bucket == now else []
                    now, size, step = bucket, 0, max(PART // 8, sum(len(h[0]) for h in held))
                body = zstandard.ZstdDecompressor().decompress(bytes(packed))
                n, many = np.frombuffer(body, np.int64, 2).tolist()
                doc = np.cumsum(np.frombuffer(body, np.int64, n, 16))
                sub = np.frombuffer(body, np.int64, n, 16 + 8 * n) if many else np.zeros(n, np.int64)
                held.append((np.frombuffer(body, np.uint32, n, 16 + 8 * n * (1 + many)).astype(np.int64) | bucket << 32, doc, sub, np.zeros(n, bool)))
                size += n
        if held:
            yield settle(held)[0]

    sampled = docs.select("__key", "__sub", "text").mapInPandas(sample, "bucket long, packed binary")
    return sampled.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(meet, "__k long, __s long, value int")


def _beside(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs that have values in ``found`` (__k, __s, value), each beside the array of its values."""
    lists = found.groupBy("__k", "__s").agg(F.collect_set("value").alias("values"))
    return docs.join(lists, (F.col("__key") == F.col("__k")) & (F.col("__sub") == F.col("__s"))).drop("__k", "__s")


def _kept(s: Stretches, values: dict, owner: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``of`` (values beside the stretch of each, in order of stretches) are among their document's values."""
    stay = np.zeros(len(of), bool)
    bounds = np.searchsorted(owner, np.arange(len(s.size) + 1))
    for i, key in enumerate(zip(s.doc.tolist(), s.sub.tolist())):
        x, y = bounds[i], bounds[i + 1]
        if y > x:
            some = np.sort(values[key])
            stay[x:y] = some[np.minimum(np.searchsorted(some, of[x:y]), len(some) - 1)] == of[x:y]
    return stay


def _sides(s: Stretches, ranks: np.ndarray, place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """33-byte ranks that begin at anchors, and those that end with them; and whether the stretch has room for each."""
    ends, last = np.cumsum(s.size), max(len(ranks) - 1, 0)
    right, left = place + ANCHOR + OFFSET <= ends[owner], place - OFFSET >= (ends - s.size)[owner]
    here = ranks[place]
    after, before = _pair(here, ranks[np.minimum(place + OFFSET, last)]), _pair(ranks[np.maximum(place - OFFSET, 0)], here)
    return after.astype(np.int64) & ~1, before.astype(np.int64) | 1, right, left


def _short(ranks: np.ndarray) -> np.ndarray:
    """Ranks for telling those of one document apart: chance equals only keep more than is needed."""
    return ranks.astype(np.uint64).astype(np.uint32).view(np.int32)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Stretches, dict]]:
    """Slices of documents, and the values beside each document."""
    for batch in batches:
        values = {(k, s): np.asarray(v, np.int32) for k, s, v in zip(batch["__key"].tolist(), batch["__sub"].tolist(), batch["values"])}
        for texts, keys, subs in _slices(batch):
            yield Stretches.of_texts(texts, keys, subs), values


def shared_pairs(docs: DataFrame, names: DataFrame, buckets: int) -> DataFrame:
    """(__k, __s, value): 33-byte ranks beside anchors that stand in at least two documents, shortened."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s, values in _batches(batches):
            at, owner = s.windows()
            if not len(at):
                continue
            ranks = s.ranks()
            place = anchors(ranks, at)
            first = np.flatnonzero(_new(place))
            most, least = (place - at)[first], (place - at)[np.concatenate([first[1:], [len(at)]]) - 1]  # bytes of strings before their anchor
            place, owner = place[first], owner[first]
            stay = _kept(s, values, owner, _short(_names(ranks[place], buckets)))
            place, owner = place[stay], owner[stay]
            after, before, right, left = _sides(s, ranks, place, owner)
            right &= least[stay] <= OFFSET
            left &= most[stay] >= OFFSET
            rank, of = np.concatenate([after[right], before[left]]), np.concatenate([owner[right], owner[left]])
            order = np.lexsort((rank, of))
            rank, of = rank[order], of[order]
            new = _new(rank, of)
            rank, of = rank[new], of[new]
            yield pd.DataFrame({"rank": rank, "__k": s.doc[of], "__s": s.sub[of]})

    def several(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of ranks that two documents have. Rows come sorted; of the last rank the first row is carried on."""
        held = None
        for batch in batches:
            rank, doc, sub = (batch[c].to_numpy(np.int64) for c in ("rank", "__k", "__s"))
            told = np.zeros(len(rank), bool)
            if held is not None:
                rank, doc, sub, told = (np.concatenate(x) for x in zip(held, (rank, doc, sub, told)))
            if not len(rank):
                continue
            bounds = np.flatnonzero(_new(rank))
            many = (np.add.reduceat(_new(rank, doc, sub).astype(np.int64), bounds) > 1) | np.logical_or.reduceat(told, bounds)
            tell = np.repeat(many, np.diff(np.concatenate([bounds, [len(rank)]]))) & ~told
            yield pd.DataFrame({"__k": doc[tell], "__s": sub[tell], "value": _short(rank[tell])})
            last = slice(bounds[-1], bounds[-1] + 1)
            held = rank[last], doc[last], sub[last], many[-1:]

    # all columns of docs go in, so that every join by key starts from one and the same shuffle
    ranked = _beside(docs, names).mapInPandas(pairs, "rank long, __k long, __s long").repartition("rank").sortWithinPartitions("rank", "__k", "__s")
    return ranked.mapInPandas(several, "__k long, __s long, value int")


def repeats(docs: DataFrame, buckets: int, held_most: int = HELD) -> DataFrame:
    """(__key, __sub, span): stretches of bytes that repeated strings cover. docs has ``__key``, ``__sub``, ``text`` and maybe more.

    All of docs goes through the joins by key, so that a caller that joins docs by key again shares their shuffle."""
    n = buckets
    ranked = shared_pairs(docs, shared_anchors(docs, n), n)

    def packed(s: Stretches, at: np.ndarray, owner: np.ndarray, bucket: np.ndarray, also: np.ndarray) -> list[tuple]:
        """Strings that go on, as stretches of one ``also``, by bucket."""
        if not len(at):
            return []
        bounds = _runs(at, owner, also)
        a, b, o = at[bounds[:-1]], at[bounds[1:] - 1], owner[bounds[:-1]]
        return [(k, TEXT, s.cut(a[some], b[some], o[some]).pack()) for k, some in _by_bucket(bucket[bounds[:-1]])]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s, values in _batches(batches):
            at, owner = s.windows()
            if not len(at):
                continue
            ranks = s.ranks()
            place = anchors(ranks, at)
            first = _new(place)
            of, heads, home = np.cumsum(first) - 1, place[first], owner[first]
            after, before, right, left = _sides(s, ranks, heads, home)
            right &= _kept(s, values, home, _short(after))
            left &= _kept(s, values, home, _short(before))
            reach = place - at  # bytes of the string before its anchor; LENGTH - ANCHOR - reach are behind it
            stay = (right[of] | (reach > OFFSET)) & (left[of] | (reach < OFFSET))
            at, owner, place = at[stay], owner[stay], place[stay]
            if not len(at):
                continue
            flags, settled = repeated(s, at, owner, ranks)
            rows = [(int(s.doc[0]) % n, SPANS, packed_spans(_spans(s, at, owner, flags)))] if flags.any() else []
            at, owner, place = at[~settled], owner[~settled], place[~settled]
            yield packed_rows(rows + packed(s, at, owner, (ranks[place] % np.uint64(n)).astype(np.int64), place))

    def bucket_parts(batches: Iterator[pd.DataFrame], most: int | None) -> Iterator[list[tuple]]:
        """Settles bucket by bucket in parts. Beyond ``most`` bytes of different strings, a bucket's strings are dealt again."""
        now, held, size, step, over = None, [], 0, PART // 2, False

        def out() -> tuple[list[tuple], Stretches | None]:
            s = Stretches.joined(held)
            at, owner = s.windows()
            flags, settled = repeated(s, at, owner)
            rows = [(int(now) * 31 % n, SPANS, packed_spans(_spans(s, at, owner, flags)))] if flags.any() else []
            at, owner = at[~settled], owner[~settled]
            bounds = _runs(at, owner)
            kept = s.cut(at[bounds[:-1]], at[bounds[1:] - 1], owner[bounds[:-1]])
            if over or most is not None and len(kept.data) > most:
                own = full_ranks(s.ranks(), at)
                return rows + packed(s, at, owner, (_mixed(own) % np.uint64(n)).astype(np.int64), own), None
            return rows, kept

        for batch in batches:
            for bucket, kind, body in zip(batch["bucket"].tolist(), batch["kind"].tolist(), batch["packed"]):
                if kind == SPANS:
                    yield [(bucket, kind, body)]
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
                    now, size, step = bucket, 0, max(PART // 2, sum(len(h.data) for h in held))
                held.append(Stretches.unpack(bytes(body)))
                size += len(held[-1].data)
        if held:
            yield out()[0]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in bucket_parts(batches, held_most):
            if rows:
                yield packed_rows(rows)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in bucket_parts(batches, None):
            for _, _, body in rows:
                yield spans_of(body)

    gathered = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    dealt = gathered(_beside(docs, ranked).mapInPandas(deal, PACKED))
    return gathered(dealt.mapInPandas(meet, PACKED)).mapInPandas(end, FOUND)


def deduplicated(docs: DataFrame, buckets: int | None = None, held_most: int = HELD) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    keyed, size = identified(docs)
    rows = with_spans(keyed, repeats(keyed, buckets or spread(size, BUCKET, docs), held_most))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode("utf-8")
                kept, removed, runs = data, 0, 0
                if found:
                    edges = np.zeros(len(data) + 1, np.int32)
                    lo, hi = ends_of(found)
                    np.add.at(edges, lo, 1)
                    np.add.at(edges, hi, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    removed, runs = int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(keep, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
