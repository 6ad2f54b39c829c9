import re
from collections import defaultdict

from corpus import documents, frame, result
from pyspark.sql import functions as F

from verdure.llm import mixing


def want_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        target.update({s: 3.0 * sizes[s] for s in over} if over else share)
        open_ = open_ - over if over else set()
    return target


def rows(n=600):
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 50 else "tiny"
        out.append((i, " ".join(f"d{i}w{k}" for k in range((i * 37) % 190)), "en", source, 0))
    return out + [(9000 + i, "x y z", "en", None, 0) for i in range(5)]


def check(got, docs):
    sizes, by = defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(re.findall(mixing.WORD, d[1] or ""))
    target, total = want_targets(sizes), sum(sizes.values())
    source = {(d[0]): d[3] for d in docs}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 * max(1, target[source[r["doc_id"]]])
        by[source[r["doc_id"]]] += r["taken"]
    for s, t in target.items():
        # five standard deviations of the draws, and two blocks
        block = max(mixing.SHORTEST, total // mixing.DRAWS)
        assert abs(by[s] - t) <= 2 * block + 5 * block * (t / block) ** 0.5, (s, by[s], t)


def test_taken_words_come_near_targets(spark):
    docs = rows()
    got = result(mixing.shares(frame(spark, docs)))
    assert len(got) == len(docs)
    check(got, docs)
    assert got == result(mixing.shares(frame(spark, docs[::-1])))


def test_hard_rows(spark):
    got = result(mixing.shares(frame(spark)))
    assert len(got) == len(documents())
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.shares(frame(spark, [])).count() == 0
    assert [r["taken"] for r in result(mixing.shares(frame(spark, [(1, None, None, None, None)])))] == [0]


def test_shards_draw_from_the_multinomial(spark, monkeypatch):
    sizes = mixing.sized(frame(spark, rows()))
    plan = mixing.targets(sizes)
    want = {r["rank"]: r["target"] * -(-r["source_size"] // 8) / r["source_size"] for r in plan.collect()}
    total = sum(want.values())
    for group in (mixing.GROUP, 2):  # counts of all sources at once, and of groups first
        monkeypatch.setattr(mixing, "GROUP", group)
        drawn = mixing.draws(plan, 8, per_shard=64).collect()
        by = {(r["shard"], r["rank"]): r["drawn"] for r in drawn}
        full = sorted({s for s, _ in by})[:-1]
        assert all(sum(by.get((s, k), 0) for k in want) == 64 for s in full)
        for s in full[:5]:
            assert sorted(p for r in drawn if r["shard"] == s for p in r["places"]) == list(range(64))
        for k, w in want.items():  # mean and spread over shards are those of the multinomial
            p, got = w / total, [by.get((s, k), 0) for s in full]
            sd = (64 * p * (1 - p)) ** 0.5
            mean = sum(got) / len(got)
            assert abs(mean - 64 * p) <= 5 * sd / len(got) ** 0.5
            if len(full) > 50 and p > 0.05:
                assert 0.6 < (sum((x - mean) ** 2 for x in got) / len(got)) ** 0.5 / sd < 1.5
        assert {(r["shard"], r["rank"]): r["drawn"] for r in mixing.draws(plan, 8, per_shard=64, seed=5).collect()} != by
        filled = {r["rank"]: r["n"] for r in mixing.slots(plan, 8, 64).groupBy("rank").agg(F.count("*").alias("n")).collect()}
        blocks = {r["rank"]: -(-r["source_size"] // 8) for r in plan.collect()}
        assert filled == {k: min(3 * blocks[k], sum(v for (_, x), v in by.items() if x == k)) for k in filled}


def test_taken_follows_from_the_draws(spark):
    """Words that each document gives, from the drawn counts, the permutations and the documents' places alone."""
    docs = frame(spark, rows(200))
    sizes = mixing.sized(docs)
    plan = mixing.targets(sizes)
    block = 8
    at = mixing.placed(sizes, plan).collect()
    stream = defaultdict(dict)
    for r in at:
        for k in range(r["size"]):
            stream[r["rank"]][r["start"] + k] = r["doc_id"]
    size = {r["rank"]: r["source_size"] for r in plan.collect()}
    assert all(sorted(stream[k]) == list(range(n)) for k, n in size.items())
    drawn = sorted(mixing.draws(plan, block, per_shard=64).collect(), key=lambda r: r["shard"])
    count = defaultdict(int)
    for r in drawn:
        count[r["rank"]] += r["drawn"]
    taken = defaultdict(int)
    for rank, n in count.items():
        blocks = -(-size[rank] // block)
        for e in range(3):
            here = min(max(n - e * blocks, 0), blocks)
            keys = mixing.permutation_keys(F.lit(blocks), F.lit(rank).cast("long"), F.lit(e), F.lit(mixing.SEED))
            for r in spark.range(here).select(mixing.permuted(F.col("id"), F.lit(blocks), keys).alias("x")).collect():
                for w in range(r["x"] * block, min((r["x"] + 1) * block, size[rank])):
                    taken[stream[rank][w]] += 1
    got = {r["doc_id"]: r["taken"] for r in mixing.shares(docs, block=block, per_shard=64).collect()}
    assert {k: v for k, v in got.items() if v} == taken


def test_equal_rows_are_dealt_to_chunks(spark):
    docs = [(None, "one two three", "en", "a", 0)] * 20_000 + [(i, "x " * (i % 7), "en", "b", 0) for i in range(50)]
    sizes = mixing.sized(frame(spark, docs))
    plan = mixing.targets(sizes)
    rows_ = mixing._numbered_copies(sizes)
    assert rows_.filter("doc_id is null").select("copy").distinct().count() == 20_000
    at = mixing.placed(sizes, plan)
    assert at.filter("doc_id is null").select("start").distinct().count() == 20_000
    chunk = F.pmod(F.xxhash64("doc_id", "digest", "copy"), F.lit(40))
    largest = at.filter("doc_id is null").groupBy(chunk).count().agg(F.max("count")).first()[0]
    assert largest < 700
    taken = mixing.shares(frame(spark, docs))
    assert taken.count() == len(docs)
    out = mixing.mixed(frame(spark, docs))
    assert out.agg(F.sum(F.size(F.filter(F.split("text", "\\s+"), lambda x: x != "")))).first()[0] == taken.agg(F.sum("taken")).first()[0]


def test_targets_of_many_sources(spark):
    docs = [(i, "w " * (1 + i * i % 97), "en", f"s{i:04}" if i % 11 else None, 0) for i in range(700)]
    sizes = defaultdict(int)
    for _, t, _, s, _ in docs:
        sizes[s] += len(t.split())
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.sized(frame(spark, docs))).collect()}
    want = want_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_slots_are_whole_blocks_in_their_place(spark):
    docs = rows(300)
    out = mixing.packed(frame(spark, docs), block=8, per_shard=64).collect()
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out) and all(0 <= r["slot"] < 64 for r in out)
    words = defaultdict(set)
    for d in docs:
        words[d[3]] |= set(d[1].split())
    assert all(len(r["text"].split()) == r["n_words"] <= 8 and set(r["text"].split()) <= words[r["source"]] for r in out)
    short = sum(r["n_words"] < 8 for r in out)
    assert short <= 3 * len(words)
    taken = sum(r["taken"] for r in mixing.shares(frame(spark, docs), block=8, per_shard=64).collect())
    assert sum(r["n_words"] for r in out) == taken
    for r in out:  # a block is consecutive words of the source's stream: within a document they run on
        w = r["text"].split()
        for x, y in zip(w, w[1:]):
            if x.startswith("d") and x.split("w")[0] == y.split("w")[0]:
                assert int(y.split("w")[1]) == int(x.split("w")[1]) + 1
    orders = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["shard"], r["slot"])):
        orders[r["shard"]].append(r["source"])
    assert any(o != sorted(o, key=str) for o in orders.values())


def test_ids_that_are_missing_or_repeat(spark):
    docs = [(None, f"a{i} " * 40, "en", "x", 0) for i in range(30)] + [(7, f"b{i} " * 40, "en", "x", 0) for i in range(30)] + [(7, "same " * 50, "en", "y", 0)] * 5
    got = result(mixing.shares(frame(spark, docs)))
    assert len(got) == 65 and got == result(mixing.shares(frame(spark, docs[::-1])))
    out = mixing.mixed(frame(spark, docs)).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in got)


def test_wide_permutations_stay_in_range(spark):
    n = (1 << 40) + 7
    df = spark.range(2000).select(mixing.permuted(F.col("id") * F.lit(549755813), F.lit(n), mixing.permutation_keys(F.lit(n), F.lit(5), F.lit(1))).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert len(set(got)) == 2000 and all(0 <= x < n for x in got)


def test_permutations_are_whole(spark):
    for n in (1, 2, 7, 64, 999, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), mixing.permutation_keys(F.lit(n), F.lit(5), F.lit(1))).alias("x"))
        got = [r["x"] for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def test_mixed_documents_hold_what_was_taken(spark):
    docs = frame(spark, rows(200))
    taken = {r["doc_id"]: r["taken"] for r in mixing.shares(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words, text = defaultdict(list), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        words[r["doc_id"]] += re.findall(mixing.WORD, r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {k: len(v) for k, v in words.items()} == {k: v for k, v in taken.items() if v}
    assert all(set(v) <= set(text[k].split()) for k, v in words.items())
