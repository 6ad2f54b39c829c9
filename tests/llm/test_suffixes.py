import hashlib
import random

import numpy as np
from corpus import documents, frame, order_of, result

from verdure.llm import suffixes


def brute(rows):
    order = order_of(rows)
    least, out = {}, {}
    for key, text in sorted({(k, r[1] or "") for k, r in zip(order, rows)}):
        data = text.encode()
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - 49):
            if least.setdefault(data[i : i + 50], key) < key:
                gone[i] += 1
                gone[i + 50] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[key] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return [(r[0], *out[k]) for k, r in zip(order, rows)]


def same(spark, rows, **options):
    got = result(suffixes.deduplicated(frame(spark, rows).repartition(5), **options))
    key = lambda r: (r[0] is None, *(x or 0 for x in r[:-1]), r[-1])
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got], key=key) == sorted(brute(rows), key=key)
    return got


def test_hard_documents(spark):
    got = {r["doc_id"]: r for r in same(spark, documents())}
    assert got[2]["n_removed"] == got[2]["n_bytes"] and got[8]["n_removed"] == 0 and got[15]["n_removed"] == 0
    assert suffixes.deduplicated(frame(spark, [])).count() == 0


def test_random_passages(spark):
    rng = random.Random(4)
    passage = ["".join(rng.choice("ab é") for _ in range(rng.randint(30, 140))) for _ in range(14)]
    rows = []
    for i in range(160):
        parts = [rng.choice(passage) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 70))) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3 % 161, "".join(parts), "en", "a", 0))
    same(spark, rows, buckets=7)
    same(spark, rows, buckets=2, held_most=0)  # every bucket is dealt again
    same(spark, [(None if r[0] % 3 else r[0] % 4, *r[1:]) for r in rows], buckets=7)
    same(spark, [(None if r[0] % 3 else r[0] % 4, *r[1:]) for r in rows], buckets=2, held_most=300)


def test_very_long_texts(spark):
    long = "".join(f"q{k * k % 9973} " for k in range(60_000))
    same(spark, [(2, long, "en", "a", 0), (1, long[100_000:200_030], "en", "a", 0), (3, "a" * 200_000, "en", "a", 0), (4, "ab" * 50_000 + "a" * 70, "en", "a", 0)])


def test_anchors_are_leftmost_minima():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    s = suffixes.Stretches(data, np.array([3000]), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))
    at, _ = s.windows()
    ranks = s.ranks()
    top = (ranks >> np.uint64(32)).tolist()
    assert suffixes.anchors(ranks, at).tolist() == [min(range(i, i + 35), key=lambda p: (top[p], p)) for i in at.tolist()]


def test_small_slices_and_parts(spark, monkeypatch):
    line = "".join(chr(97 + k * k % 26) for k in range(130))
    units = [suffixes.Stretches.of_texts([f"x{i} {line} y{i} {line}".encode()], np.array([i])) for i in range(20)]
    covered = lambda rows: {(d, k) for d, _, lo, hi in rows for k in range(lo, hi)}

    def settle(held):
        s = suffixes.Stretches.joined(held)
        at, owner = s.windows()
        flags, settled = suffixes.repeated(s, at, owner)
        spans = suffixes._spans(s, at, owner, flags).tolist()
        at, owner = at[~settled], owner[~settled]
        bounds = suffixes._runs(at, owner)
        return spans, s.cut(at[bounds[:-1]], at[bounds[1:] - 1], owner[bounds[:-1]])

    spans, held = [], []
    for u in units[::-1]:
        found, kept = settle([*held, u])
        spans += found
        held = [suffixes.Stretches.unpack(kept.pack())]
    assert covered(spans) == covered(settle(units)[0]) and len(covered(spans)) > 19 * 260


def test_equal_ranks_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffixes, "_mixed", lambda x: x & np.uint64(0))
    texts = [b"a" * 25 + b"b" * 25, b"c" * 50, b"a" * 25 + b"b" * 25]
    s = suffixes.Stretches.of_texts(texts, np.arange(3))
    assert suffixes.repeated(s, *s.windows())[0].tolist() == [False, False, True]
