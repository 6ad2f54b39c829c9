import hashlib
import random
import re

import numpy as np
from corpus import documents, frame, order_of, result

from verdure.llm import substrings


def brute(rows):
    order = order_of(rows)
    seen, removed = set(), {}
    for key, text in sorted({(k, r[1] or "") for k, r in zip(order, rows)}):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        removed[key] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return [(r[0], *removed[k]) for k, r in zip(order, rows)]


def same(spark, rows, **options):
    got = result(substrings.deduplicated(frame(spark, rows).repartition(5), **options))
    key = lambda r: (r[0] is None, *(x or 0 for x in r[:-1]), r[-1])
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=key) == sorted(brute(rows), key=key)
    return got


def test_hard_documents(spark):
    got = {r["doc_id"]: r for r in same(spark, documents())}
    assert got[2]["n_removed"] == 120 and got[1]["n_removed"] < 120 and got[15]["n_removed"] == 0
    assert substrings.deduplicated(frame(spark, [])).count() == 0


def test_random_passages(spark):
    rng = random.Random(8)
    passage = [[f"p{k}w{rng.randrange(9)}" for _ in range(rng.randint(15, 60))] for k in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passage) if rng.random() < 0.5 else [f"u{rng.randrange(40)}" for _ in range(rng.randint(1, 30))]
        rows.append((i * 3 % 151, rng.choice([" ", "\n", "  "]).join(w), "en", "a", 0))
    same(spark, rows, buckets=7)
    same(spark, rows, buckets=2, held_most=0)  # every bucket is dealt again
    same(spark, [(None if r[0] % 3 else r[0] % 4, *r[1:]) for r in rows], buckets=7)
    same(spark, [(None if r[0] % 3 else r[0] % 4, *r[1:]) for r in rows], buckets=2, held_most=300)


def test_very_long_texts(spark):
    long = " ".join(f"q{k * k % 9973}" for k in range(60_000))
    same(spark, [(2, long, "en", "a", 0), (1, long[:200_000], "en", "a", 0), (3, "a " * 200_000, "en", "a", 0), (4, "x" * 900_000, "en", "a", 0)])


def test_bucket_in_parts_and_slices(spark, monkeypatch):
    line = " ".join(f"l{k}" for k in range(45))
    units = [substrings.Units.of_texts([f"x{i} {line} y{i}".encode()], np.array([i])) for i in range(30)]
    whole = substrings.settle(substrings.Units.joined(units[::-1]))
    held, spans = [], []
    for u in units[::-1]:
        held.append(u)
        found = substrings.settle(substrings.Units.joined(held))
        spans += found.repeats().tolist()
        held = [found.carried()]
    covered = lambda some: {(d, k) for d, _, lo, hi in some for k in range(lo, hi)}
    assert covered(spans) == covered(whole.repeats().tolist()) and len(covered(spans)) == 29 * 45
    packed = substrings.Units.unpack(whole.carried().pack())
    assert packed.data.tobytes() == whole.carried().data.tobytes() and (packed.words == whole.carried().words).all()


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "_mixed", lambda x: x & np.uint64(0))
    texts = [" ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20)), " ".join(f"a{k}" for k in range(20))]
    found = substrings.settle(substrings.Units.of_texts([t.encode() for t in texts], np.arange(3)))
    assert found.repeated.tolist() == [False, False, True]
