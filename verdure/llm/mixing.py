"""Mixing sources to target weights by fixed-length token blocks.

The words of a source, in a fixed order of its documents, are packed into blocks of a fixed number of words (the last may be
shorter). Output shards have a fixed number of slots. Each shard draws how many of its slots each source gets from a
multinomial over the sources' shares. Sources are dealt to groups of ``GROUP``: a shard draws counts of groups first, and
the count of a group among its sources then, which is the same multinomial, and no list of all sources stands in a row. A
source's slots are numbered over all shards, and a pseudorandom permutation of its block indices, a new one each round, maps
slots to blocks; blocks are joined by index.

Sources are ordered by code point, NULL last, and weigh 1, 2, 3, repeating; targets share all words and stop at 3 times a
source's words, the excess going to the others by weight. A slot drawn beyond 3 rounds of a source stays empty, so that no
block is taken more than 3 times. What a source gives differs from its target by the draws: a share p of n slots has a
standard deviation of sqrt(n p (1 - p)) blocks. Blocks are as long as gives about ``DRAWS`` slots (``block_of``), so that this is
0.6 % of the target for a source of 2.5 % of the words, at any size from some millions of words on; smaller inputs
have blocks of ``SHORTEST`` words and more noise. At the cap, half of it is cut off.

Documents of one source lie in hashed chunks of about ``CHUNK`` documents, so that offsets come from sums per chunk and no
task orders a whole source. Rows that agree in id, source and text are counted first and numbered, and are dealt to chunks
by their numbers too. Sources are ordered by ranges, and the level to which targets fill is found by sums over all of them.

NULL and blank texts have size 0 and take nothing. Rows with a NULL id are ordered by a digest of the text; repeated rows
(same id, source and text) share one running order and each takes its own words. Extra columns are ignored by
:func:`shares` and :func:`packed` and kept by :func:`mixed`. Given the same rows, every run gives the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_order, let

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (1, 2, 3), 3
SLOTS, CHUNK, SEED = 1024, 500, 11
#: Slots that the mix should have, and words of a block at least and at most.
DRAWS, SHORTEST, LONGEST = 1 << 20, 4, 1024
#: Sources that are drawn together, and equal rows that one task numbers.
GROUP, COPIES = 4096, 1000
#: Products of two indices below 2**31 stay in a signed 64-bit number; larger ones are decimals.
_NARROW, _HASH = 1 << 31, (1 << 62) - 1
#: Chunks or shards that are summed at once for a running number, and shards that one row of the draw stands for.
PART, DRAWN = 1024, 64


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, copies): words, a digest of the text, and how many rows agree in all of these."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    rows = docs.select("doc_id", "source", words.cast("long").alias("size"), F.xxhash64("text").alias("digest"))
    return rows.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies"))


def _numbered_copies(sizes: DataFrame) -> DataFrame:
    """A row for each document, equal ones with ``copy`` from 0. Large groups are dealt out before they are numbered."""
    few = sizes.filter(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}")))
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = sizes.filter(F.col("copies") > COPIES).withColumn("part", part).repartition(tasks, "doc_id", "digest", "part")
    last = F.least(F.col("part") * COPIES + COPIES, F.col("copies")) - 1
    many = many.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last))).drop("part")
    return few.unionByName(many).drop("copies")


def block_of(plan: DataFrame) -> int:
    """Words of a block, such that the mix has about DRAWS slots."""
    return min(LONGEST, max(SHORTEST, (plan.agg(F.sum("source_size")).first()[0] or 0) // DRAWS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, rank, documents, source_size, target): one row per source.

    The level to which uncapped sources fill rises as others stop at their caps: it is found from sums over all sources, until
    no more of them stop."""
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("documents"))
    rows = in_order(by, F.col("source").asc_nulls_last(), name="rank")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = cut(rows.withColumn("w", w).withColumn("cap", cap * F.col("source_size")))
    total, all_w = rows.agg(F.sum("source_size"), F.sum("w")).first()
    level, stopped = 0.0, -1
    while total:
        over = F.col("cap") < F.lit(level) * F.col("w") if stopped >= 0 else F.lit(False)
        n, caps, ws = rows.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(over, F.col("w")))).first()
        if n == stopped or all_w == (ws or 0):
            break
        stopped, level = n, (total - (caps or 0)) / (all_w - (ws or 0))
    target = F.when(F.col("cap") < F.lit(level) * F.col("w"), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w"))
    return rows.select("source", "rank", "documents", "source_size", target.alias("target"))


def _hashed(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(_HASH)


def _primes(count: int = 16) -> list[int]:
    """The largest primes below 2**31."""
    out, n = [], (1 << 31) - 1
    while len(out) < count:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            out.append(n)
        n -= 2
    return out


PRIMES = _primes()


def permutation_keys(size: Column, *key: Column, rounds: int = 3) -> Column:
    """What :func:`permuted` needs for one size and key: an array of (factor, shift, part), made once per source and round.

    An affine step permutes if its factor has no common divisor with the size, as a product of primes that do not divide it."""
    n = F.greatest(size, F.lit(1)).cast("long")
    primes = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: n % p != 0)

    def one(keyed: Column) -> Column:
        p, r = keyed["p"], keyed["r"]
        pick = lambda k: F.get(p, (_hashed(*key, r, F.lit(k)) % F.size(p)).cast("int")) % n
        factor = (pick(1).cast("decimal(38,0)") * pick(2)) % n
        return F.struct(factor.cast("long").alias("factor"), (_hashed(*key, r, F.lit(3)) % n).alias("shift"), (_hashed(*key, r, F.lit(4)) % n).alias("part"))

    return F.transform(F.array(*[F.struct(primes.alias("p"), F.lit(r).alias("r")) for r in range(rounds)]), one)


def permuted(index: Column, size: Column, keys: Column, rounds: int = 3) -> Column:
    """A pseudorandom permutation of 0..size-1: rounds of an affine step and a reversal of one part."""
    x = index
    for r in range(rounds):
        k = keys[r]
        wide = (x.cast("decimal(38,0)") * k["factor"] + k["shift"]) % size
        x = _reversed(F.when(size < _NARROW, (x * k["factor"] + k["shift"]) % size).otherwise(wide.cast("long")), k["part"])
    return x


def _reversed(x: Column, part: Column) -> Column:
    return let(x, lambda v: F.when(v < part, part - 1 - v).otherwise(v))


def placed(sizes: DataFrame, plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each document with ``rank`` and ``start``: its source, and where its words begin in the source's stream."""
    of = plan.select(F.col("source").alias("s1"), "rank", F.ceil(F.col("documents") / chunk).alias("chunks"))
    rows = _numbered_copies(sizes).join(of, F.col("source").eqNullSafe(F.col("s1")))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "digest", "copy"), F.col("chunks"))).drop("s1", "chunks")
    sums = rows.groupBy("rank", "chunk").agg(F.sum("size").alias("chunk_words"))
    offsets = _before(sums, "chunk", "chunk_words").select("rank", "chunk", F.col("before").alias("offset"))
    inside = Window.partitionBy("rank", "chunk").orderBy("doc_id", "digest", "copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(offsets, ["rank", "chunk"]).select("doc_id", "source", "size", "digest", "copy", "rank", (F.col("offset") + F.col("inside")).alias("start"))


def _before(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows (rank, order, value) with ``before``: the sum of all earlier values of the rank. Sums of PART first, then within them."""
    rows = rows.withColumn("__part", F.floor(F.col(order) / PART))
    earlier = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("rank", "__part").agg(F.sum(value).alias("__sum"))
    parts = parts.select("rank", "__part", F.coalesce(F.sum("__sum").over(earlier(Window.partitionBy("rank"), "__part")), F.lit(0)).alias("__first"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("rank", "__part"), order)), F.lit(0))
    return rows.withColumn("__inside", inside).join(parts, ["rank", "__part"]).withColumn("before", F.col("__first") + F.col("__inside")).drop("__part", "__first", "__inside")


def draws(plan: DataFrame, block: int, per_shard: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, rank, drawn, places): how many slots each source gets in each shard, and which ones.

    A source expects as many slots as its target has of its blocks' mean length; shards share them alike."""
    import numpy as np

    mean_blocks = F.col("target") * F.ceil(F.col("source_size") / block) / F.col("source_size")
    wants = plan.filter("source_size > 0 and target > 0").select("rank", mean_blocks.alias("want"), F.expr(f"rank div {GROUP}").alias("group"))
    groups = wants.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("rank", "want"))).alias("s"), F.sum("want").alias("want"))
    groups = cut(groups)
    one = groups.agg(F.sort_array(F.collect_list(F.struct("group", "want"))).alias("g"), F.sum("want").alias("n"))
    one = one.filter("n > 0").withColumn("slots", F.ceil("n").cast("long"))
    parts = F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {per_shard * DRAWN}"))
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that few rows are still dealt out
    dealt = one.select(F.explode(parts).alias("part"), "slots", "g").repartition(tasks, "part")

    def draw_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, slots, g in zip(batch["part"].tolist(), batch["slots"].tolist(), batch["g"]):
                group, want = np.array([x["group"] for x in g]), np.array([x["want"] for x in g], float)
                for shard in range(part * DRAWN, min((part + 1) * DRAWN, -(-slots // per_shard))):
                    here = min(per_shard, slots - shard * per_shard)
                    rng = np.random.default_rng([seed, shard])
                    drawn = rng.multinomial(here, want / want.sum())
                    places = np.split(rng.permutation(here).astype(np.int32), np.cumsum(drawn)[:-1])
                    yield pd.DataFrame({"shard": shard, "group": group, "places": places})[drawn > 0]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, group, places, s in zip(batch["shard"].tolist(), batch["group"].tolist(), batch["places"], batch["s"]):
                rank, want = np.array([x["rank"] for x in s]), np.array([x["want"] for x in s], float)
                drawn = np.random.default_rng([seed, shard, 1 + group]).multinomial(len(places), want / want.sum())
                yield pd.DataFrame({"shard": shard, "rank": rank, "drawn": drawn, "places": np.split(np.asarray(places), np.cumsum(drawn)[:-1])})[drawn > 0]

    by_group = dealt.mapInPandas(draw_groups, "shard long, group long, places array<int>")
    return by_group.join(groups.select("group", "s"), "group").mapInPandas(draw, "shard long, rank long, drawn long, places array<int>")


def slots(plan: DataFrame, block: int, per_shard: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(rank, shard, slot, round, index, lo, hi): the block that each output slot takes, as a stretch of its source's stream."""
    counts = cut(draws(plan, block, per_shard, seed))  # as files, so that the planner knows their size
    counts = _before(counts, "shard", "drawn").withColumnRenamed("before", "first")

    sources = plan.select("rank", "source_size", F.ceil(F.col("source_size") / block).cast("long").alias("blocks")).filter("blocks > 0")
    key = lambda e: permutation_keys(F.col("blocks"), F.col("rank"), e, F.lit(seed))
    sources = sources.withColumn("keys", F.transform(F.sequence(F.lit(0), F.lit(CAP - 1)), key))
    rows = counts.join(sources, "rank").filter(F.col("first") < CAP * F.col("blocks"))
    rows = rows.select("rank", "shard", "first", "blocks", "keys", "source_size", F.posexplode("places").alias("n", "slot"))
    rows = rows.withColumn("ordinal", F.col("first") + F.col("n")).filter(F.col("ordinal") < CAP * F.col("blocks"))
    rounds, within = F.expr("ordinal div blocks"), F.col("ordinal") % F.col("blocks")
    rows = rows.select("rank", "shard", "slot", rounds.alias("round"), permuted(within, F.col("blocks"), F.get("keys", rounds.cast("int"))).alias("index"), "source_size")
    lo = F.col("index") * block
    return rows.select("rank", "shard", "slot", "round", "index", lo.alias("lo"), F.least(lo + block, F.col("source_size")).alias("hi"))


def pieces(docs_placed: DataFrame, plan: DataFrame, block: int, seed: int = SEED, per_shard: int = SLOTS) -> DataFrame:
    """docs_placed with (shard, slot, round, place, begin, end): words begin..end of a document that one slot takes, at a place in it.

    Documents and slots meet by (source, block index): a document is dealt to the blocks that it touches."""
    rows = docs_placed.filter("size > 0").withColumn("index", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    rows = rows.join(cut(slots(plan, block, per_shard, seed)), ["rank", "index"])
    begin, end = F.greatest("lo", "start"), F.least(F.col("hi"), F.col("start") + F.col("size"))
    return rows.select(*docs_placed.columns, "shard", "slot", "round", (begin - F.col("lo")).alias("place"), (begin - F.col("start")).alias("begin"), (end - F.col("start")).alias("end"))


def _planned(docs: DataFrame, block: int | None, chunk: int) -> tuple[DataFrame, DataFrame, int]:
    sizes = cut(sized(docs))
    plan = cut(targets(sizes))
    return cut(placed(sizes, plan, chunk)), plan, block or block_of(plan)


def shares(docs: DataFrame, block: int | None = None, seed: int = SEED, chunk: int = CHUNK, per_shard: int = SLOTS) -> DataFrame:
    """One row per document: size, source_size, target and taken."""
    at, plan, block = _planned(docs, block, chunk)
    got = pieces(at, plan, block, seed, per_shard).groupBy(F.col("rank").alias("r4"), F.col("start").alias("t4")).agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    # a document with words is known by its place in its source's stream
    rows = at.join(got, (F.col("rank") == F.col("r4")) & (F.col("start") == F.col("t4")) & (F.col("size") > 0), "left")
    rows = rows.join(plan.select("rank", "source_size", "target"), "rank")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _with_takes(docs: DataFrame, block: int | None, seed: int, chunk: int, per_shard: int) -> DataFrame:
    """docs with words that the mix takes, each with ``__takes``: structs of round, begin, end, shard, slot and place."""
    at, plan, block = _planned(docs, block, chunk)
    got = pieces(at, plan, block, seed, per_shard).groupBy("doc_id", "rank", "digest", "copy")
    got = got.agg(F.sort_array(F.collect_list(F.struct("round", "begin", "end", "shard", "slot", "place"))).alias("__takes"))
    got = got.join(plan.select("rank", "source"), "rank").select(*[F.col(c).alias(f"__{c}2") for c in ("doc_id", "source", "digest", "copy")], "__takes")
    rows = docs.withColumn("__digest", F.xxhash64("text")).filter(F.rlike(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)))
    if not at.filter("copy > 0").isEmpty():
        # equal rows are alike: it does not matter which of them has which number. They are numbered without their texts, in parts
        # of the table first, and each part is told how many stand before it
        key = ["doc_id", "source", "__digest"]
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        ids = cut(rows.select(*key, "__row", F.shiftright("__row", 33).alias("__part")))
        parts = ids.groupBy(*key, "__part").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in (*key, "__part")], before.alias("__first"))
        same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*key, "__part")]
        inside = F.row_number().over(Window.partitionBy(*key, "__part").orderBy("__row")) - 1
        copies = ids.withColumn("__inside", inside).join(parts, same).select(F.col("__row").alias("__r"), (F.col("__first") + F.col("__inside")).alias("__copy"))
        rows = rows.join(copies, F.col("__row") == F.col("__r"))
    else:
        rows = rows.withColumn("__copy", F.lit(0).cast("long"))
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id2")) & F.col("source").eqNullSafe(F.col("__source2")) & (F.col("__digest") == F.col("__digest2")) & (F.col("__copy") == F.col("__copy2"))
    return rows.join(got, on).select(*docs.columns, "__takes")


def packed(docs: DataFrame, block: int | None = None, seed: int = SEED, chunk: int = CHUNK, per_shard: int = SLOTS) -> DataFrame:
    """The mix as blocks: (shard, slot, source, n_words, text), a row per slot that is filled."""
    rows = _with_takes(docs.select("doc_id", "source", "text"), block, seed, chunk, per_shard).select("source", "text", "__takes")

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, text, takes in zip(*[c.to_pylist() for c in batch.columns]):
                words = re.findall(WORD, text)
                out += [(t["shard"], t["slot"], source, t["place"], t["end"] - t["begin"], " ".join(words[t["begin"] : t["end"]])) for t in takes]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ["shard", "slot", "source", "place", "n", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds, strict=True)], names)

    parts = rows.mapInArrow(cut_blocks, "shard long, slot long, source string, place long, n long, piece string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), " ")
    return parts.groupBy("shard", "slot").agg(F.first("source").alias("source"), F.sum("n").alias("n_words"), joined.alias("text"))


def mixed(docs: DataFrame, block: int | None = None, seed: int = SEED, chunk: int = CHUNK, per_shard: int = SLOTS) -> DataFrame:
    """The mix as documents: for each round in which some of a document's words are taken, a row with these words as its
    text (the text unchanged if all are) and with the document's other columns."""
    rows = _with_takes(docs, block, seed, chunk, per_shard)
    chars, names = "n_chars" in docs.columns, docs.columns

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).finditer
        for batch in batches:
            at, texts = [], []
            for n, (text, takes) in enumerate(zip(batch.column("text").to_pylist(), batch.column("__takes").to_pylist())):
                spans = [m.span() for m in find(text)]
                by_round: dict[int, list[list[int]]] = {}
                for t in takes:
                    own = by_round.setdefault(t["round"], [])
                    if own and own[-1][1] == t["begin"]:
                        own[-1][1] = t["end"]
                    else:
                        own.append([t["begin"], t["end"]])
                for own in by_round.values():
                    at.append(n)
                    texts.append(text if own == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in own))
            out = pa.RecordBatch.from_arrays(batch.columns[:-1], names).take(pa.array(at, pa.int64()))
            made = {"text": pa.array(texts, pa.string()), **({"n_chars": pa.array([len(t) for t in texts], pa.int64())} if chars else {})}
            yield pa.RecordBatch.from_arrays([made[n].cast(out.column(n).type) if n in made else out.column(n) for n in names], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(cut_texts, fields)
