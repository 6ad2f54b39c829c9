"""Operator 13 against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import documents, frame

from verdure.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=20):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scored.append((-s, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(x for x in scored if x[0])[:k], 1)]
    return sorted(out, key=str)


def queries(spark, items):
    return spark.createDataFrame(items, "item_id int, text string")


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)], [(q, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for q in range(30)]


@pytest.fixture
def small(monkeypatch):
    """Segments of few documents, so that one table has many."""
    for name, value in (("DOCUMENTS", 64), ("POSTINGS", 1500)):
        monkeypatch.setattr(ranking, name, value)


def test_random_texts(spark, small):
    docs, items = corpus(3, 1500)
    rows = [(d, t, "en", "a", 1) for d, t in docs]
    assert got(ranking.search(frame(spark, rows), queries(spark, items))) == expected(docs, items)


def test_hard_cases(spark):
    docs = [(r[0], r[1]) for r in documents()]
    items = [(1, "the quick BROWN fox, w3x9 w3x9 other"), (2, None), (3, ""), (4, "日本語 テスト naïve café"), (5, "n41 n41 z7 token"), (None, "apache license"), (6, "nowhere-found"), (7, " -- ")]
    assert got(ranking.search(frame(spark), queries(spark, items))) == expected(docs, items)


def test_ties_go_by_id_and_repeated_rows_are_found_each(spark, small):
    docs = [(i, "same words here") for i in range(300)] + [(7, "same words here")] * 3 + [(None, "same words here")]
    items = [(1, "same"), (1, "same"), (2, "words here here")]
    rows = [(d, t, "en", "a", 1) for d, t in docs[::-1]]
    docs.append((999, "filler"))
    assert got(ranking.search(frame(spark, [*rows, (999, "filler", "en", "a", 1)]), queries(spark, items))) == expected(docs, items[1:])


def test_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 100)
    docs, items = corpus(5, 400)
    assert got(ranking.search(frame(spark, [(d, t, "en", "a", 1) for d, t in docs]), queries(spark, items))) == expected(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    import pyspark.sql.functions as F

    docs, items = corpus(6, 50)
    rows = [(d, t, "en", "a", 1) for d, t in docs]
    assert got(ranking.search(frame(spark, []), queries(spark, items))) == []
    assert got(ranking.search(frame(spark, rows), queries(spark, []))) == []
    extra = {c: F.lit("x") for c in ("doc", "score", "rank", "query", "terms", "id", "block", "n")}
    assert got(ranking.search(frame(spark, rows).withColumns(extra), queries(spark, items).withColumns(extra))) == expected(docs, items)


def test_accumulators_stop_and_survivors_are_exact():
    """A frequent term of small weight comes last: it creates no accumulators, but adds to those that there are."""
    rare = (np.arange(30), np.full(30, 100) + np.arange(30), 5)
    common = (np.arange(0, 1000, 2), np.full(500, 3), 1)
    score, at, created = ranking.best([rare, common], 1000, 20)
    assert created == 30
    full = np.zeros(1000, int)
    for places, parts, n in (rare, common):
        full[places] += parts * n
    want = sorted(full, reverse=True)[:20]
    assert sorted(score, reverse=True)[:20] == want and all(full[at] == score)


@pytest.mark.parametrize("seed", range(20))
def test_best_equals_all_scores(seed):
    rng = np.random.default_rng(seed)
    postings, size = [], 200
    for _ in range(rng.integers(1, 12)):
        places = np.flatnonzero(rng.random(size) < rng.random() ** 2)
        postings.append((places, rng.integers(0, 50, len(places)), int(rng.integers(1, 4))))
    postings.sort(key=lambda p: len(p[0]))
    full = np.zeros(size, int)
    for places, parts, n in postings:
        full[places] += parts * n
    score, at, _ = ranking.best(postings, size, 10)
    assert sorted(score, reverse=True)[:10] == sorted(full[full > 0], reverse=True)[:10] and all(full[at] == score)
