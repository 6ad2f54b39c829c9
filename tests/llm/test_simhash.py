import random

import numpy as np
import xxhash
from corpus import documents, frame, result

from verdure.llm import graph, simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_fingerprints_and_components_equal_brute_force(spark):
    got = result(simhash.components(frame(spark)))
    docs = documents()
    fps = [brute_fingerprint(d[1]) for d in docs]
    roots = brute_components(fps)
    want = []
    for d, f in zip(docs, fps, strict=True):
        same = [e[0] for e, g in zip(docs, fps) if roots[g] == roots[f] and e[0] is not None]
        want.append((d[0], f"{f:016x}", min(same, default=None)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)
    assert simhash.components(frame(spark, [])).count() == 0


def test_links_lose_nothing_in_dense_and_sparse_buckets(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in [rng.getrandbits(64) for _ in range(3)] + [0]:
        fps.add(center)
        fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(150)}
    signed = [(int(np.uint64(f).astype(np.int64)), n) for n, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, id long"))
    assert all(bin((r["a"]["x"] ^ r["b"]["x"]) & (1 << 64) - 1).count("1") <= 4 for r in edges.collect())
    roots = {r["node"]["x"]: r["root"]["x"] for r in graph.connected(edges).collect()}
    want = brute_components(fps)
    groups = {}
    for f in fps:
        s = int(np.uint64(f).astype(np.int64))
        groups.setdefault(want[f], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_counters_equal_popcounts():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 1001, dtype=np.uint64) & rng.integers(0, 2**63, 1001, dtype=np.uint64) & rng.integers(0, 2**63, 1001, dtype=np.uint64) & rng.integers(0, 2**63, 1001, dtype=np.uint64)
    want = np.array([bin(int(v)).count("1") <= 4 for v in values])
    assert (simhash.within(simhash.planes(values), len(values)) == want).all() and want.any() and not want.all()
    pairs = rng.integers(0, 2**63, (1001, 2), dtype=np.uint64) & rng.integers(0, 2**63, (1001, 2), dtype=np.uint64)
    for radius in (0, 25, 30, 31, 32, 40):
        want = np.array([sum(bin(int(x)).count("1") for x in v) <= radius for v in pairs])
        assert (simhash.within(simhash.planes(pairs), len(pairs), radius) == want).all()


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([((i * 7919) % 10007, ((i + 1) * 7919) % 10007) for i in range(n)], "a long, b long")
    assert {r["root"] for r in graph.connected(edges).collect()} == {min((i * 7919) % 10007 for i in range(n + 1))}


def grams(text, width=5):
    w = brute_words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [x for x in low.split(" ") if x]


def brute_kept(rows):
    """Rows that stay: the least of each component of texts that are alike by 0.8 over sets of five-word shingles."""
    texts = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    sets = [grams(t) for *_, t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if brute_words(texts[i][2]) == brute_words(texts[j][2]) or a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [t for i, t in enumerate(texts) if root(i) == i]


def test_one_document_of_each_group_stays(spark):
    docs = frame(spark)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    want = brute_kept(documents())
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()]
    assert sorted(x[:2] for x in got) == sorted(x[:2] for x in want)
    assert simhash.deduplicated(frame(spark, [])).count() == 0


def copies(seed, groups=60, words=200):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.randint(words // 4, words))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), "en", "a", 0))
    return rows


def test_recall_of_similar_texts(spark):
    """Of pairs alike by 0.8 or more, over nine in ten end in one group; texts below it are only linked through others."""
    rows = copies(3, groups=90)
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, rows)).collect()}
    want = {t[1] for t in brute_kept(rows)}
    missed = kept - want
    assert want <= kept and len(missed) <= 0.1 * (len(rows) - len(want)) and len(rows) - len(want) > 50


def test_twins_in_a_dense_group_are_found(spark):
    """Texts of one template (mutual similarity about 0.68) of which two by two are twins (about 0.93): all share large buckets."""
    rng = random.Random(4)
    base = [f"t{k}" for k in range(400)]
    rows, pairs = [], 150
    for g in range(pairs):
        one = list(base)
        for k in rng.sample(range(400), 8):
            one[k] = f"g{g}x{k}"
        two = list(one)
        for k in rng.sample(range(400), 2):
            two[k] = f"h{g}x{k}"
        rows += [(2 * g, " ".join(one), "en", "a", 0), (2 * g + 1, " ".join(two), "en", "a", 0)]
    sets = [grams(r[1]) for r in rows]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 0.6 < sum(jaccard(2 * g, (2 * g + 7) % (2 * pairs)) for g in range(50)) / 50 < 0.75
    assert 0.9 < sum(jaccard(2 * g, 2 * g + 1) for g in range(50)) / 50 < 0.97
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, rows)).collect()}
    want = {t[1] for t in brute_kept(rows)}
    assert want <= kept and len(kept - want) <= 0.01 * pairs


def test_a_text_passed_over_in_vain_is_compared_again(spark, monkeypatch):
    """With a bound for sure pairs that is far too wide, failed ones are searched for again."""
    monkeypatch.setattr(simhash, "SURE", simhash.LIKELY + 120)
    monkeypatch.setattr(simhash, "LIKELY", simhash.LIKELY + 120)
    rows = copies(6, groups=1, words=300)[:1]
    base = rows[0][1].split()
    for g in range(25):
        one = [w if (k * 7 + g) % 13 else f"g{g}x{k}" for k, w in enumerate(base)]
        rows += [(2 * g + 1, " ".join(one), "en", "a", 0), (2 * g + 2, " ".join(one[:-1] + ["end"]), "en", "a", 0)]
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, rows)).collect()}
    assert kept == {t[1] for t in brute_kept(rows)}


def test_texts_around_a_dense_group_are_not_paired_with_all_of_it(spark, monkeypatch):
    """Texts about as near to a group of copies as the limit are passed over in vain, but one link to the group is enough for each."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(300)]
    rows, copies, around = [], 250, 60
    for i in range(copies + around):
        w = list(base)
        for k in rng.sample(range(300), 1 if i < copies else 6):
            w[k] = f"n{i}x{k}"
        rows.append((i, " ".join(w), "en", "a", 0))
    compared, alike = [], simhash._alike

    def counted(near, *others):
        compared.append(near.count())
        return alike(near, *others)

    monkeypatch.setattr(simhash, "_alike", counted)
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, rows)).collect()}
    want = {t[1] for t in brute_kept(rows)}
    assert want <= kept and len(kept - want) <= 1
    assert sum(compared[2:]) < 0.1 * copies * around


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(300)] = f"n{i}x{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "en", "a", 0))
    assert [r["doc_id"] for r in simhash.deduplicated(frame(spark, rows)).collect()] == [0]


def test_very_long_text(spark):
    long = " ".join(f"q{k * k % 9973}" for k in range(80_000))
    rows = [(2, long, "en", "a", 0), (1, long + " end", "en", "a", 0), (3, "a " * 200_000, "en", "a", 0), (4, "x" * 900_000, "en", "a", 0)]
    assert sorted(r["doc_id"] for r in simhash.deduplicated(frame(spark, rows)).collect()) == [1, 3, 4]
    got = result(simhash.components(frame(spark, rows)))
    assert [r["fingerprint"] for r in got] == [f"{brute_fingerprint(t):016x}" for _, t, *_ in sorted(rows)]


def test_a_row_of_each_component_stays_whatever_its_id(spark):
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(60))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (9, text(2)), (7, None), (None, ""), (None, None)]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash.deduplicated(docs).collect())
    assert got == sorted([("None", text(0)), ("None", text(1)), ("9", text(2)), ("5", text(3)), ("5", text(4)), ("7", "")])
