"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set where over half of the text's shingle hashes have it set. Candidates are compared as vertical
bit planes: carry-save counters add the differing bits of many lanes at once, and a block of lanes is abandoned once all
exceed the radius. A bucket of candidates that is large is searched from one to the next among those not yet reached, so
that dense groups take near-linear time and give a tree of links, not all pairs.

:func:`components` links 64-bit fingerprints at ``RADIUS`` or fewer differing bits. They are dealt to buckets by every pair
of six bit blocks: two that differ in at most four bits agree in two blocks at least, so each link meets in some bucket
and none is lost.

:func:`deduplicated` links texts whose sets of ``WIDTH``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.
A text gets ten 64-bit fingerprints and meets others in a bucket for each of their forty 16-bit bands. In buckets of up to
``SMALL`` texts all pairs within ``SPAN`` bits of the first two fingerprints are candidates. Texts of larger buckets get
``WIDE`` fingerprints: there, all pairs within ``LIKELY`` of their bits are candidates, and only a text within ``SURE`` bits,
probably similar, need not be compared with further ones. Candidates are compared by their whole shingle sets. Where such a
text turns out not to be similar after all, it is compared with its whole bucket again: with the four nearest texts of each other
component first, and with further ones (32 times as many in each turn) only of those that it is still not linked to. At a similarity
of 0.8 a pair meets in one bucket at least with a chance of about 0.95, at 0.9 of over 0.99, whatever the bucket's size.
Large groups whose texts are alike just below the limit (0.74 to 0.8) are compared pair by pair. Texts of the same words are
one text.

NULL and blank texts have fingerprint zero and are linked as any other. Rows with a NULL id take part, but are never a
component's id unless no row of it has one (then the id is NULL; the largest 64-bit number counts as none). Repeated rows
repeat their result; extra columns are ignored by :func:`components` and kept by :func:`deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, by_text, cut
from .graph import connected

SHINGLE, RADIUS, SEED = 4, 4, 42
#: For texts that are alike: words to a shingle, similarity, 64-bit fingerprints, bits that two of these may differ in.
WIDTH, SIMILARITY, PRINTS, SPAN = 5, 0.8, 10, 30
#: In large buckets: 64-bit fingerprints, bits in which texts of a similarity of 0.8 differ on average, and hardly ever more.
WIDE, SURE, LIKELY = 32, 310, 345
#: Bit blocks (shift, width); every pair of blocks is one way to deal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Buckets up to this size compare all their pairs; larger ones are searched.
SMALL = 16
LANES = 1 << 13
#: Characters of text that are hashed at once.
SLICE = 1 << 21
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as a signed number."""
    import numpy as np
    import xxhash

    data = (text or "").encode("utf-8").translate(bytes.maketrans(_UPPER, _LOWER))
    words = data.split()  # bytes split at the six ASCII white-space characters
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        part = slice(at, at + (1 << 16))
        hashes = np.array([digest(norm[a:b], SEED) for a, b in zip(first[part], last[part])], np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): a row per document."""

    return by_text(docs, ["doc_id"], "fp long", lambda: lambda texts: [(fingerprint(t),) for t in texts])


def planes(values):
    """Bit planes of rows of 64-bit values: plane k holds bit k of all rows, eight lanes to a byte."""
    import numpy as np

    rows = np.ascontiguousarray((values if values.ndim == 2 else values[:, None]).astype(np.uint64))
    bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), 8 * rows.shape[1]), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def within(differing, lanes: int, radius: int = RADIUS):
    """Which lanes have at most ``radius`` bits set over all planes; blocks beyond it are abandoned early.

    A plane is added to the counters of ones, twos, fours and so on by carry-save steps; ``over`` remembers an overflow."""
    import numpy as np

    counters = [np.zeros(differing.shape[1], np.uint8) for _ in range(radius.bit_length())]
    over = np.zeros(differing.shape[1], np.uint8)

    def exceeding():
        more, same = over.copy(), np.full(len(over), 255, np.uint8)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return more

    unused = np.packbits(np.arange(differing.shape[1] * 8) >= lanes, bitorder="little")
    for n, carry in enumerate(differing, 1):
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
        over |= carry
        if n % 8 == 0 and n > radius and n < len(differing) and ((exceeding() | unused) == 255).all():
            return np.zeros(lanes, bool)
    return np.unpackbits(~exceeding(), bitorder="little", count=lanes).astype(bool)


def links_of_small(keys, values, radius: int = RADIUS):
    """Index pairs that are linked inside runs of equal keys, all of at most SMALL rows: neighbours at each distance."""
    import numpy as np

    found = []
    for step in range(1, SMALL):
        at = np.flatnonzero(keys[:-step] == keys[step:]) if len(keys) > step else np.array([], np.int64)
        if not len(at):
            break
        for s in range(0, len(at), LANES):
            i = at[s : s + LANES]
            hit = i[within(planes(values[i] ^ values[i + step]), len(i), radius)]
            if len(hit):
                found.append(np.stack([hit, hit + step], 1))
    return found


def links_of_large(values, radius: int = RADIUS):
    """Index pairs that are a tree of links for each group: every row is once compared with all that are not yet reached."""
    import numpy as np

    rest, found = np.arange(len(values)), []
    full = np.array([0, 255], np.uint8)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        vertical = planes(values[rest])  # made anew only when rows leave
        while queue and len(rest):
            q = queue.pop()
            own = np.ascontiguousarray(values[q : q + 1].astype(np.uint64)).view(np.uint8).reshape(-1)
            flips = full[np.unpackbits(own, bitorder="little")][:, None]
            hit = np.zeros(len(rest), bool)
            for s in range(0, len(rest), LANES):
                n = min(LANES, len(rest) - s)
                hit[s : s + n] = within(vertical[:, s // 8 : (s + n + 7) // 8] ^ flips, n, radius)
            if hit.any():
                found.append(np.stack([np.full(hit.sum(), q), rest[hit]], 1))
                queue += list(rest[hit])
                rest = rest[~hit]
                vertical = planes(values[rest])
    return found


def links_of_wide(values, likely: int, sure: int):
    """Index pairs of wide rows within ``likely`` bits. Every row is once compared with all that are not yet reached; only rows
    within ``sure`` bits are reached. Rows have too many planes for few lanes: their bits are counted word by word."""
    import numpy as np

    rest, found = np.arange(len(values)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        held = values[rest]
        while queue and len(rest):
            q = queue.pop()
            away = np.bitwise_count(held ^ values[q]).sum(1, dtype=np.int64)
            hit = away <= likely
            if not hit.any():
                continue
            found.append(np.stack([np.full(hit.sum(), q), rest[hit]], 1))
            near = away <= sure
            if near.any():
                queue += list(rest[near])
                rest, held = rest[~near], held[~near]
    return found


NODE = ("id", "x", "y")
#: Key of rows that are pairs of nodes; other rows say that a node (twice) is in the large bucket of that key.
PAIR = -1


def met(dealt: DataFrame, words: list[str], radius: int, crowds: bool = False) -> DataFrame:
    """(key, a, b): nodes that meet in a bucket within the radius; in large buckets a tree of them, or only the nodes (``crowds``).

    dealt has ``key`` (from 0), the node's columns ``id``, ``x``, ``y`` (64-bit numbers) and 64-bit ``words`` to compare."""
    import numpy as np

    names = [*words, *NODE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # rows of the last key so far

        def solve() -> Iterator[pd.DataFrame]:
            keys = np.concatenate([k for k, _ in held])
            rows = np.concatenate([r for _, r in held])
            held.clear()
            values = rows[:, : len(words)].view(np.uint64)
            bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(bounds)
            small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
            found = [small[p] for p in links_of_small(keys[small], values[small], radius)]
            kinds = [np.full(len(p), PAIR) for p in found]
            for g in np.flatnonzero(sizes > SMALL):
                if crowds:
                    found.append(np.repeat(np.arange(bounds[g], bounds[g + 1])[:, None], 2, 1))
                    kinds.append(keys[bounds[g] : bounds[g + 1]])
                    continue
                linked = [p + bounds[g] for p in links_of_large(values[bounds[g] : bounds[g + 1]], radius)]
                found += linked
                kinds += [np.full(len(p), PAIR) for p in linked]
            if found:
                pairs, nodes = np.concatenate(found), rows[:, len(words) :]
                both = np.concatenate([np.concatenate(kinds)[:, None], nodes[pairs[:, 0]], nodes[pairs[:, 1]]], 1)
                yield pd.DataFrame(both, columns=["key", *(f"{side}{c}" for side in "ab" for c in NODE)]).drop_duplicates()

        for batch in batches:
            if not len(batch):
                continue
            keys, rows = batch["key"].to_numpy(np.int64), np.stack([batch[c].to_numpy(np.int64) for c in names], 1)
            last = int(np.searchsorted(keys, keys[-1]))  # rows come sorted by key; the last run may go on
            if last or held and held[-1][0][-1] != keys[-1]:
                held.append((keys[:last], rows[:last]))
                yield from solve()
            held.append((keys[last:], rows[last:]))
        if held:
            yield from solve()

    pairs = dealt.select("key", *names).repartition("key").sortWithinPartitions("key", *NODE).mapInPandas(run, f"key long, {_SIDES}")
    return pairs.select("key", *_ordered()).distinct()


_SIDES = ", ".join(f"{side}{c} long" for side in "ab" for c in NODE)


def _ordered() -> list:
    a, b = (F.struct(*[F.col(f"{side}{c}").alias(c) for c in NODE]) for side in "ab")
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (columns id, fp) that connect all that are within the radius."""
    ways = [F.struct(*[F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias(f"k{i}") for i, (s, w) in enumerate(pair)]) for pair in combinations(BLOCKS, 2)]
    coded = F.array(*[F.lit(n << 22).cast("long") + F.shiftleft(k["k0"], 11) + k["k1"] for n, k in enumerate(ways)])
    dealt = distinct.select(F.explode(coded).alias("key"), "fp", "id", F.col("fp").alias("x"), F.lit(0).cast("long").alias("y"))
    return met(dealt, ["fp"], RADIUS).select("a", "b")


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id."""
    fps = cut(fingerprints(docs))
    # nodes are ordered by their least id, so that a component's root has the component's id
    distinct = cut(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id").cast("long"), F.lit(NO_ID)).alias("id")))
    roots = connected(links(distinct)).select(F.col("node.x").alias("__fp"), F.col("root.id").alias("__root"))
    known = distinct.join(roots, F.col("fp") == F.col("__fp"), "left").select("fp", F.coalesce("__root", "id").alias("__id"))
    own = F.when(F.col("__id") != NO_ID, F.col("__id")).cast(dict(docs.dtypes)["doc_id"])
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))


def shingles(texts: list[str | None], width: int = WIDTH) -> Iterator[tuple]:
    """For each text, the bytes of its words joined by one space, and its distinct shingle hashes in order (64-bit).

    Texts are hashed in slices of about SLICE characters; a text of fewer words is one shingle, one without words none."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > SLICE:
            yield from _shingles(part, width)
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield from _shingles(part, width)


def _shingles(texts: list[str | None], width: int) -> list[tuple]:
    """Words and shingles of all texts at once."""
    import numpy as np

    from .substrings import _STEP, Units, _mixed, _sums, _word_hashes

    lower = bytes.maketrans(_UPPER, _LOWER)
    units = Units.of_texts([(t or "").encode("utf-8").translate(lower) for t in texts], np.arange(len(texts)))
    ends = np.flatnonzero(units.data == 32)
    hashes = _word_hashes(units.data, np.concatenate([[0], ends[:-1] + 1]), ends) if len(ends) else np.zeros(0, np.uint64)
    raw, stop = units.data.tobytes(), np.cumsum(units.words)
    out = []
    for n, last in zip(units.words.tolist(), stop.tolist()):
        if not n:
            out.append((b"", np.zeros(0, np.uint64)))
            continue
        first = last - n
        lo = np.arange(first, max(first + 1, last - width + 1))
        grams = _mixed(_sums(hashes[first:last], lo - first, np.minimum(lo + width, last) - first, _STEP))
        out.append((raw[ends[first - 1] + 1 if first else 0 : ends[last - 1]], np.unique(grams)))
    return out


def prints(grams, count: int = PRINTS) -> list[int]:
    """Fingerprints of a text's shingle hashes, each by another mixing of them, as signed numbers."""
    import numpy as np

    from .substrings import _mixed

    keys = _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    set_bits = np.zeros(64 * count, np.int64)
    for at in range(0, len(grams), 1 << 12):
        words = _mixed(grams[at : at + (1 << 12), None] ^ keys)
        set_bits += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * set_bits > len(grams), bitorder="little").view(np.int64).tolist()


def similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """A table of distinct texts (id, x, y and the digest of a row that holds it), and (a, b) links between their nodes.

    docs has ``__id``, ``__digest`` and ``text``. x and y are 128 bits of the text's words; id and digest are the least ones."""

    def make():
        import xxhash

        def rows(texts):
            out = []
            for words, grams in shingles(texts, width):
                h = xxhash.xxh3_128_intdigest(words)
                x, y = (n - (1 << 64) if n >> 63 else n for n in (h >> 64, h & (1 << 64) - 1))
                out.append((x, y, *(prints(grams) if len(grams) else [None] * PRINTS)))
            return out

        return rows

    fields = ", ".join(["x long", "y long", *(f"p{k} long" for k in range(PRINTS))])
    rows = by_text(docs.select("__id", "__digest", "text"), ["__id", "__digest"], fields, make)
    texts = cut(rows.groupBy("x", "y").agg(F.min(F.struct("__id", "__digest")).alias("row"), *[F.first(f"p{k}").alias(f"p{k}") for k in range(PRINTS)]))
    nodes = texts.select(F.col("row.__id").alias("id"), "x", "y", F.col("row.__digest").alias("digest"))
    bands = [F.shiftrightunsigned(f"p{k}", 16 * b).bitwiseAND(0xFFFF) + F.lit((4 * k + b) << 16).cast("long") for k in range(PRINTS) for b in range(4)]
    dealt = texts.filter("p0 is not null").select(F.explode(F.array(*bands)).alias("key"), "p0", "p1", F.col("row.__id").alias("id"), "x", "y")
    found = cut(met(dealt, ["p0", "p1"], SPAN, crowds=True))
    near, crowds = found.filter(F.col("key") == PAIR).select("a", "b"), found.filter(F.col("key") != PAIR).select("key", F.col("a").alias("node"))
    asked = near.select(F.col("a").alias("node")).union(near.select("b")).union(crowds.select("node")).distinct()
    known = cut(_known(asked, crowds.select("node").distinct(), nodes, docs, width))
    links = _alike(near, known, similarity)
    if crowds.isEmpty():
        return nodes, links
    links = cut(links.unionByName(_in_crowds(crowds, known, similarity)))
    return nodes, links


def _in_crowds(crowds: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Verified links of large buckets. crowds has ``key`` and ``node``."""
    first = cut(_searched(crowds.join(known.select("node", "wide"), "node")))
    links = cut(_alike(first.select("a", "b").distinct(), known, similarity))
    # a text that was passed over for one that it is not similar to is compared with its whole buckets
    asks = first.filter("sure").join(links, ["a", "b"], "left_anti").select("key", F.explode(F.array("a", "b")).alias("node")).distinct()
    asks, tried, nearest, roots = cut(asks), first.select("a", "b").distinct(), 4, None
    while not asks.isEmpty():
        roots = connected(links) if roots is None else roots
        rows = crowds.join(asks.select("key").distinct(), "key", "left_semi").join(asks.withColumn("asks", F.lit(True)), ["key", "node"], "left").join(roots, "node", "left")
        rows = rows.select("key", "node", F.coalesce("asks", F.lit(False)).alias("asks"), F.coalesce("root", "node").alias("root"))
        found = cut(_asked(rows.join(known.select("node", "wide"), "node"), nearest))
        more = cut(found.select(*_ordered()).distinct().join(tried, ["a", "b"], "left_anti"))
        linked, tried = cut(_alike(more, known, similarity)), tried.unionByName(more)
        if not linked.isEmpty():
            links, roots = links.unionByName(linked), None
        asks, nearest = cut(found.filter("more").select("key", F.struct(*[F.col(f"a{c}").alias(c) for c in NODE]).alias("node")).distinct()), 32 * nearest
    return links


def _searched(rows: DataFrame) -> DataFrame:
    """(key, a, b, sure): candidates in large buckets. rows has ``key``, ``node`` and ``wide``, a text's WIDE fingerprints."""
    import numpy as np

    def solve(nodes, values, _) -> dict:
        found = links_of_wide(values, LIKELY, SURE)
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        away = np.bitwise_count(values[pairs[:, 0]] ^ values[pairs[:, 1]]).sum(1, dtype=np.int64)
        return _sides(nodes, pairs) | {"sure": away <= SURE}

    return _by_bucket(rows.select("key", "node.*", "wide"), solve, "sure").select("key", *_ordered(), "sure")


def _asked(rows: DataFrame, nearest: int) -> DataFrame:
    """(key, a's and b's columns, more): for each text a that asks, the ``nearest`` candidates b in each other component of its bucket, as
    one link to a component is enough; ``more`` says that one had others. rows has ``key``, ``node``, ``root``, ``asks`` and ``wide``."""
    import numpy as np

    def solve(nodes, values, rest) -> dict:
        asks, part = rest[:, 0], np.unique(rest[:, 1:], axis=0, return_inverse=True)[1].reshape(-1)
        pairs, cut_off = [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)]
        for q in np.flatnonzero(asks):
            away = np.bitwise_count(values ^ values[q]).sum(1, dtype=np.int64)
            hit = np.flatnonzero((away <= LIKELY) & (part != part[q]))
            hit = hit[np.lexsort((hit, away[hit], part[hit]))]
            start = np.concatenate([[True], part[hit[1:]] != part[hit[:-1]]]) if len(hit) else np.zeros(0, bool)
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0)) if len(hit) else hit
            kept = place < nearest
            full = np.isin(part[hit[kept]], part[hit[~kept]])
            pairs.append(np.stack([np.full(kept.sum(), q), hit[kept]], 1))
            cut_off.append(full)
        return _sides(nodes, np.concatenate(pairs)) | {"more": np.concatenate(cut_off)}

    root = [F.col(f"root.{c}").alias(f"r{c}") for c in NODE]
    return _by_bucket(rows.select("key", "node.*", "wide", F.col("asks").cast("long").alias("asks"), *root), solve, "more")


def _sides(nodes, pairs) -> dict:
    return {f"{side}{c}": nodes[pairs[:, k], i] for k, side in enumerate("ab") for i, c in enumerate(NODE)}


def _by_bucket(rows: DataFrame, solve, flag: str) -> DataFrame:
    """What solve(nodes, values, other columns) gives for each bucket of rows (``key``, the node's columns, ``wide``, others: long)."""
    import numpy as np
    import pyarrow as pa

    others = [c for c in rows.columns if c not in ("key", *NODE, "wide")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        schema = pa.schema([("key", pa.int64()), *((f"{side}{c}", pa.int64()) for side in "ab" for c in NODE), (flag, pa.bool_())])

        def out() -> Iterator[pa.RecordBatch]:
            values = np.frombuffer(b"".join(h[0] for h in held), np.uint64).reshape(len(held), WIDE)
            longs = np.array([h[1:] for h in held], np.int64)
            found = solve(longs[:, : len(NODE)], values, longs[:, len(NODE) :])
            for at in range(0, len(found[flag]), LANES):
                part = {c: v[at : at + LANES] for c, v in found.items()}
                yield pa.RecordBatch.from_pydict({"key": np.full(len(part[flag]), now), **part}, schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "wide", *NODE, *others))):
                if row[0] != now:
                    if held:
                        yield from out()
                    now, held = row[0], []
                held.append(row[1:])
        if held:
            yield from out()

    dealt = rows.repartition("key").sortWithinPartitions("key", *NODE)
    return dealt.mapInArrow(run, f"key long, {_SIDES}, {flag} boolean")


def _known(asked: DataFrame, crowded: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, grams, wide): the shingle hashes of texts that are asked for, each read once; WIDE fingerprints of those in large buckets."""
    import pyarrow as pa

    flags = asked.join(crowded.withColumn("crowded", F.lit(True)), "node", "left").select(*[F.col(f"node.{c}").alias(c) for c in NODE], F.coalesce("crowded", F.lit(False)).alias("crowded"))
    rows = nodes.join(flags, list(NODE)).select(F.col("id").alias("__i"), F.col("digest").alias("__d"), F.struct(*NODE).alias("node"), "crowded")
    held = docs.join(rows, (F.col("__id") == F.col("__i")) & (F.col("__digest") == F.col("__d"))).select("node", "crowded", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            crowded, grams, wide = batch.column("crowded").to_pylist(), [], []
            for c, (_, g) in zip(crowded, shingles((t.as_py() for t in batch.column("text")), width)):
                grams.append(g.tobytes())
                wide.append(np.array(prints(g, WIDE), np.int64).tobytes() if c else None)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(grams, pa.binary()), pa.array(wide, pa.binary())], ["node", "grams", "wide"])

    return held.mapInArrow(sets, "node struct<id:long,x:long,y:long>, grams binary, wide binary").dropDuplicates(["node"])


def _alike(near: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Pairs of near whose shingle sets are that similar."""
    import pyarrow as pa

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keep = []
            for one, other in zip(batch.column("g"), batch.column("h")):  # read where they lie
                a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = near.join(known.select(F.col("node").alias("a"), F.col("grams").alias("g")), "a").join(known.select(F.col("node").alias("b"), F.col("grams").alias("h")), "b")
    node = "struct<id:long,x:long,y:long>"
    return pairs.select("a", "b", "g", "h").mapInArrow(alike, f"a {node}, b {node}")


def deduplicated(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, that of least id (NULL last), then of least text digest.

    Of rows that agree in id and text, any one stays."""
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__digest": F.coalesce(F.sha2("text", 256), F.lit(""))})
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():  # of repeated rows each task sends one
        rows = rows.dropDuplicates(["__id", "__digest"])
    nodes, edges = similar(rows.select("__id", "__digest", "text"), width, similarity)
    others = connected(edges).select("node.*")
    first = nodes.join(others, list(NODE), "left_anti").select(F.col("id").alias("__i"), F.col("digest").alias("__d"))
    kept = rows.join(first, (F.col("__id") == F.col("__i")) & (F.col("__digest") == F.col("__d")), "left_semi")
    return kept.select(*docs.columns)
