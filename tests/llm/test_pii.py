"""Operator 12: base kinds against plain patterns, the field against sums over all labellings and on held-out sentences."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from corpus import documents, frame, result

from verdure.llm import pii, pii_labels

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def expected(text):
    return [(k, m.start(), m.end()) for k, (kind, rx) in enumerate(PLAIN.items()) for m in re.finditer(rx, text or "") if good(kind, m.group())]


@pytest.fixture(scope="module")
def field():
    return pii.train_field([pii.tagged(t, m) for t, m in pii_labels.sentences(6)], epochs=60)


CASES = [
    "a.b+c@x-y.example.com, @no.where a@b a@b.c.d@e.f x@@y.z é@a.b aé.b@c.de.",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 1.2.3 .1.2.3.4. 999999999999999999999.1.2.3",
    "4111 1111 1111 1111; 4111-1111-1111-1111 4111111111111112 41111111111111111111 4111  1111 1111 1111 79927398713 6304000000000000000",
    "+1 (743) 555-3824 +49 30 123456 +1 +12345678 +1234567890123456 ++1 2 3 4 5 6 7 8 9 +1.2.3.4.5.6.7.8) +44 (0)",
    "152.143.123.131### 4785380592391139$$$ 1.2.3.4111111111111111 12 34.56.78.90",
    "",
]


@pytest.mark.parametrize("text", CASES)
def test_base_kinds(text):
    assert pii.base_spans(text) == expected(text)


@pytest.mark.parametrize("seed", range(30))
def test_base_kinds_of_random_texts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices("0123456789" * 3 + "4111. -@+()ab\né", k=4000))
    assert pii.base_spans(text) == expected(text)


def test_runs_that_match_nothing_are_read_once():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 500_000 + "x", "1 " * 500_000, "+" * 500_000, "a@" * 300_000, "+1" * 300_000):
        pii.base_spans(text)


def paths(score, moves):
    n = len(pii.LABELS)
    for path in itertools.product(range(n), repeat=len(score)):
        if pii.LABELS[path[0]][0] != "I" and all(pii.ALLOWED[a, b] for a, b in zip(path, path[1:])):
            yield path, sum(score[i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))


def test_sums_and_best_path_equal_those_over_all_labellings():
    rng = np.random.default_rng(1)
    sizes = np.array([2, 4, 1, 3])
    first = np.cumsum(sizes) - sizes
    score, moves = rng.normal(size=(10, len(pii.LABELS))), rng.normal(size=(len(pii.LABELS),) * 2)
    marginal, moved = pii._expected(score, moves, first, sizes)
    best = pii.viterbi(score, moves, first, sizes, np.zeros(4, bool))
    want_moved = np.zeros_like(moves)
    for f, s in zip(first, sizes):
        all_paths = list(paths(score[f : f + s], moves))
        weight = np.exp([v for _, v in all_paths])
        weight /= weight.sum()
        want = np.zeros((s, len(pii.LABELS)))
        for (path, _), w in zip(all_paths, weight):
            want[np.arange(s), path] += w
            for a, b in zip(path, path[1:]):
                want_moved[a, b] += w
        assert np.allclose(marginal[f : f + s], want)
        assert tuple(best[f : f + s]) == max(all_paths, key=lambda p: p[1])[0]
    assert np.allclose(moved, want_moved)


def test_held_out_sentences(field):
    held = pii_labels.sentences(3, seed=99)
    both = found = marked = 0
    for (text, marks), got in zip(held, pii.field_spans(field, [t for t, _ in held])):
        want = {(len(pii.BASE) + pii.KINDS.index(k), a, b) for k, a, b in marks}
        both, found, marked = both + len(want & set(got)), found + len(got), marked + len(want)
    assert both / found > 0.9 and both / marked > 0.85


def test_lines_passed_over_have_no_stretch(field):
    """What is skipped as certain, and what is decoded in one go, are as decoding line by line gives them."""
    texts = [t for t, _ in pii_labels.sentences(1, seed=5)] + ["Name: Anna Keller " * 40]
    for text in texts:
        tokens = pii.Tokens.of(pii._codes(text))
        score = pii.emissions(field, tokens)
        score[:, 0] += pii.CAUTION
        first, sizes, goes_on = pii._lines(tokens)
        whole = pii.viterbi(score, field.moves, first, sizes, goes_on)
        assert (np.flatnonzero(whole) == np.flatnonzero(pii.labelled_by(field, tokens))).all()
    alone = [pii.field_spans(field, [t])[0] for t in texts]
    assert pii.field_spans(field, texts) == alone


def test_tokens():
    text = "Ab  cd12,\n É日本 +x_"
    tokens = pii.Tokens.of(pii._codes(text))
    assert [text[a:b] for a, b in zip(tokens.start, tokens.end)] == ["Ab", "cd", "12", ",", "É日本", "+", "x", "_"]
    assert tokens.line.tolist() == [True, False, False, False, True, False, False, False]
    assert (tokens.shape >= pii.SHAPES).tolist() == [False, False, True, True, False, False, True, True]


def test_pieces_hold_the_whole_text(monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 50)
    text = "word " * 30 + "\n" + "x" * 130 + "\nName: Anna Keller\n"
    pieces = list(pii._pieces(text))
    assert "".join(p for _, p in pieces) == text and all(text[a : a + len(p)] == p for a, p in pieces)


def test_query_on_hard_cases(spark):
    more = [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(CASES)] + [(200, "My name is John Smith, mail j@x.org, DOB: 1980-01-02.", "en", "a", 1)]
    rows = documents() + more
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    out = pii.scan(frame(spark, rows))
    got = result(out)
    assert len(got) == len(rows)
    for r in got:
        bases = [expected(t) for t in texts[r["doc_id"]]]
        digest = [hashlib.sha256(pii.listed(b).encode()).hexdigest() for b in bases]
        base = bases[digest.index(r["base_sha256"])]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(b[0] == k for b in base) for k in range(4)]
        assert set(filter(None, pii.listed(base).split(","))) <= set(r["spans"].split(","))
    assert next(r for r in got if r["doc_id"] == 200)["spans"] == "email:28:35,person:11:21,birth:42:52"


def test_empty_tables_and_clashing_columns(spark):
    import pyspark.sql.functions as F

    assert pii.scan(frame(spark, [])).collect() == []
    none = pii.labelled_rows(spark).limit(0)
    extra = frame(spark).withColumns({c: F.lit("x") for c in ("spans", "n_email", "__text")})
    assert len(pii.scan(extra, none).collect()) == len(documents())
    masked = {r["doc_id"]: r for r in pii.masked(frame(spark, [(1, "mail a@b.cd or +49 30 123456", "en", "a", 9), (2, None, "en", "a", 0)]), none).collect()}
    assert masked[1]["text"] == "mail [email] or [phone]" and masked[2]["text"] is None
