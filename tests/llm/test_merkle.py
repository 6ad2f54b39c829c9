"""Operator 11 against a plain version that builds each tree in memory."""

import random
import zlib
from hashlib import sha256

import pytest
from corpus import documents, frame, result

from verdure.llm import merkle

H = lambda *parts: sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        yield run[: i % 16], run[i % 16 + 1 :]
        i //= 16


def expected(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    items = [((d, s, lang, n, t), d, s, t) for d, t, lang, s, n in rows]
    sources = sorted({s for _, _, s, _ in items}, key=lambda s: (s is not None, (s or "").encode()))
    trees, places = [], []
    for s in sources:
        own = sorted((r for r in items if r[2] == s), key=lambda r: (r[1] is not None, r[1] or 0, leaf(r[0])))
        places.append(own)
        trees.append(levels([leaf(r[0]) for r in own]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (tree, own) in enumerate(zip(trees, places)):
        for i, (fields, d, _, text) in enumerate(own):
            path = [*siblings(tree, i), *siblings(top, k)]
            now = leaf(fields)
            if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and text is not None:
                now = leaf((*fields[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
            for left, right in path:
                now = H(*left, now, *right)
            proof = H(*[x for left, right in path for x in (*left, *right)])
            out.append({"doc_id": d, "leaf": leaf(fields), "subroot": tree[-1][0], "root": top[-1][0], "proof_sha256": proof, "folded_root": now, "verified": now == top[-1][0]})
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_hard_cases(spark):
    assert result(merkle.audited(frame(spark))) == expected(documents())


@pytest.mark.parametrize("sizes", [(1,), (16, 17, 1), (256, 257, 255), (4500, 2, 300), (1,) * 300 + (40,)])
def test_sizes_of_trees(spark, sizes):
    """Lone leaves, whole and partial runs, trees of one block and of many, more sources than a block holds."""
    rng = random.Random(sum(sizes))
    rows = [(k * 10_000 + i, f"Text {rng.random()}", "en", f"s{k:03}", 7) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert result(merkle.audited(frame(spark, rows))) == expected(rows)


def test_equal_rows_are_leaves_each(spark):
    rows = [(None, "Same", "en", "a", 4)] * 700 + [(3, None, None, None, None)] * 5 + [(2, "é" * 90_000, "fr", None, 90_000)]
    assert result(merkle.audited(frame(spark, rows))) == expected(rows)


def test_empty_table_and_clashing_columns(spark):
    assert merkle.audited(frame(spark, [])).collect() == []
    import pyspark.sql.functions as F

    rows = documents()
    extra = frame(spark, rows).withColumns({c: F.lit("x") for c in ("tree", "idx", "leaf", "key", "root", "path", "found", "range", "run", "at", "digest")})
    assert result(merkle.audited(extra)) == expected(rows)


def test_untampered_manifest_verifies(spark):
    rows = documents()
    assert all(r["verified"] for r in merkle.manifest(frame(spark, rows)).collect())


def test_messages_waiting_stay_few():
    """The forward sweep gives every inner node once, children before parents."""
    for n, first in ((1, False), (37, True), (256, True), (200, False)):
        nodes = merkle.forward([b"%064d" % i for i in range(n)], first)
        labels = [(end, level) for end, level, *_ in nodes]
        assert labels == sorted(labels) and len(set(labels)) == len(labels)
        assert sum(len(c) // 64 for *_, c in nodes) == n + len(nodes) - 1
