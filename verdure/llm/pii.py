"""Personal data by base patterns and a linear-chain conditional random field over word-shape features.

Base kinds (email, ip, card, phone) are leftmost matches of their patterns. Other kinds (``KINDS``) are found by the field: a
text is read as tokens (runs of letters, runs of digits, single other characters); a token's features are its shape (case,
length, digits, whether it is glued to the one before) and, if the labelled table has it often, its lower-case word, each
at the token and at two tokens on either side. Labels are outside, or first or further token of a kind. Weights and
transitions are trained together on the likelihood of the labelled table, by forward and backward sums in numpy; texts are
decoded by Viterbi in batches of lines. ``CAUTION`` is added to the score of the outside label: a stretch must be that much
likelier than none.

A line is decoded as a whole up to ``LINE`` tokens; the labels of longer ones are chosen in parts of that many tokens, with
features from across the border, and a stretch may go on across it. A text of more than ``PIECE`` characters is read in
pieces that end at a line's end, or else at a blank. Lines that are certain to have no stretch are not decoded: there, each
token's best label is worse than outside by more than all transitions can make up for.

The field learns from at most ``sample`` sentences of the labelled table, which may be given; its size is fixed by them.
NULL and empty texts have no spans; repeated rows repeat their result; extra columns are ignored by :func:`scan` and kept by
:func:`masked`. Empty tables give no rows; without labelled sentences only base kinds are found.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_labels
from .common import by_text
from .substrings import _BASE, _mixed, _sums

#: Base kinds in their order, then the field's.
BASE = ("email", "ip", "card", "phone")
KINDS = ("person", "street", "birth", "account")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
OFFSETS = (-2, -1, 0, 1, 2)
CAUTION, SAMPLE, LEAST, LINE, PIECE = 1.5, 20_000, 8, 128, 1 << 20
EPOCHS, RATE, DECAY = 100, 1.0, 1e-5
#: Shapes: letters by case and length, digits by length, other characters; the second half is for tokens glued to the one before.
SHAPES, PAD = 24, 23

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: Every ip and card lies in one of these, and each starts where a run of digits does.
_NUMBERS = re.compile(r"[0-9][0-9\x20.-]*[0-9]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    """From each @ back to where its local part starts, so that long runs without @ are read once."""
    last, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and (c := text[lo - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            lo -= 1
        domain = _DOMAIN.match(text, at + 1) if lo < at else None
        if domain:
            yield lo, domain.end()
        last = domain.end() if domain else at + 1
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base spans, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for number in _NUMBERS.finditer(text):
        size = number.end() - number.start()
        if size >= 7:
            for m in _IP.finditer(text, number.start(), number.end()):
                if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                    out.append((1, *m.span()))
        if size >= 16:
            for m in _CARD.finditer(text, number.start(), number.end()):
                if m.end() - m.start() >= 16:
                    digits = _NO_DIGIT.sub("", m.group())
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return sorted(out)


def _classes() -> np.ndarray:
    """0 blank, 1 lower or other letter, 2 upper, 3 digit, 4 other, for code points below 256; those above are 1, or 0 if blank."""
    out = np.ones(256, np.uint8)
    for c in range(256):
        ch = chr(c)
        out[c] = 0 if ch.isspace() else 2 if ch.isupper() else 3 if "0" <= ch <= "9" else 1 if ch.isalpha() else 4
    return out


_CLASS = _classes()
_BLANKS = np.array([c for c in range(256, 1 << 16) if chr(c).isspace()], np.uint32)


@dataclass
class Tokens:
    """Tokens of one text: where they start and end, shape, hash of the lower-case word, and whether a line begins."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    line: np.ndarray

    @staticmethod
    def of(codes: np.ndarray) -> Tokens:
        low = np.minimum(codes, 255)
        kind = np.where(codes < 256, _CLASS[low], np.where(np.isin(codes, _BLANKS), 0, 1)).astype(np.uint8)
        family = np.where(kind == 2, 1, kind)
        first = np.flatnonzero((family > 0) & (np.concatenate([[True], family[1:] != family[:-1]]) | (family == 4)))
        none = np.zeros(0, np.int64)
        if not len(first):
            return Tokens(none, none, none, none.astype(np.uint64), none.astype(bool))
        changes = np.flatnonzero(np.concatenate([family[1:] != family[:-1], [True]])) + 1
        end = np.where(family[first] == 4, first + 1, changes[np.searchsorted(changes, first, side="right")])
        size, upper = end - first, np.concatenate([[0], np.cumsum(kind == 2)])
        n_upper, case = upper[end] - upper[first], kind[first]
        length = np.where(size == 1, 0, np.where(size <= 3, 1, 2))
        style = np.where(n_upper == 0, 0, np.where(n_upper == size, 2, np.where((n_upper == 1) & (case == 2), 1, 3)))
        letters = np.where((style == 1) & (size > 1), 2 + length, np.where(style == 0, length, np.where(style == 2, 5 + length, 8)))
        digits = 9 + np.minimum(np.searchsorted([2, 3, 4, 5, 9], size, side="right"), 5)
        other = np.full(len(first), 15)
        for n, ch in enumerate(".,-/:@+", 16):
            other[codes[first] == ord(ch)] = n
        shape = np.where(family[first] == 1, letters, np.where(family[first] == 3, digits, other))
        glued = np.concatenate([[False], first[1:] == end[:-1]])
        # lower-case words by hash; capitals of Latin-1 stand 32 below their small letters
        folded = np.where(kind == 2, codes + 32, codes).astype(np.uint64)
        line_ends = np.cumsum(codes == 10)
        line = np.concatenate([[True], line_ends[first[1:]] != line_ends[first[:-1]]])
        return Tokens(first, end, shape + SHAPES * glued, _mixed(_sums(folded, first, end, _BASE)), line)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Field:
    """A trained field: lexicon of word hashes (sorted), emission tables by offset, transitions with start and end."""

    lexicon: np.ndarray
    words: np.ndarray  # (offsets, 1 + lexicon, labels); row 0 for words that are not in it
    shapes: np.ndarray  # (offsets, 2 * SHAPES, labels)
    moves: np.ndarray  # (labels, labels)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.lexicon.tobytes(), self.words.tobytes(), self.shapes.tobytes(), self.moves.tobytes()

    @staticmethod
    def unpack(lexicon: bytes, words: bytes, shapes: bytes, moves: bytes) -> Field:
        n = len(LABELS)
        lex = np.frombuffer(lexicon, np.uint64)
        table = lambda b, k: np.frombuffer(b, np.float64).reshape(len(OFFSETS), k, n)
        return Field(lex, table(words, len(lex) + 1), table(shapes, 2 * SHAPES), np.frombuffer(moves, np.float64).reshape(n, n))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at + 1, 0)


def _padded(tokens: Tokens) -> np.ndarray:
    """Places of tokens in an array in which two empty ones stand before each line, and two at the end."""
    return np.arange(len(tokens.start)) + 2 * np.cumsum(tokens.line)


def _around(tokens: Tokens, word: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each offset, the word numbers and shapes that tokens see there."""
    place = _padded(tokens)
    size = int(place[-1]) + 3
    words, shapes = np.zeros(size, np.int64), np.full(size, PAD)
    words[place], shapes[place] = word, tokens.shape
    return [words[place + o] for o in OFFSETS], [shapes[place + o] for o in OFFSETS]


#: Moves that labels allow: a further token only behind a token of its kind.
ALLOWED = np.array([[b[0] != "I" or a[1:] == b[1:] for b in LABELS] for a in LABELS])


def emissions(field: Field, tokens: Tokens) -> np.ndarray:
    words, shapes = _around(tokens, field.known(tokens.word))
    out = np.zeros((len(tokens.start), len(LABELS)))
    for o in range(len(OFFSETS)):
        out += field.words[o][words[o]]
        out += field.shapes[o][shapes[o]]
    return out


def train_field(rows: list[tuple[Tokens, np.ndarray]], epochs: int = EPOCHS) -> Field:
    """Trains on sentences (tokens, labels) by gradient steps on their likelihood, all at once in each epoch."""
    n, hashes = len(LABELS), np.concatenate([t.word for t, _ in rows])
    distinct, counts = np.unique(hashes, return_counts=True)
    lexicon = distinct[counts >= LEAST]
    field = Field(lexicon, np.zeros((len(OFFSETS), len(lexicon) + 1, n)), np.zeros((len(OFFSETS), 2 * SHAPES, n)), np.zeros((n, n)))
    seen = [_around(t, field.known(t.word)) for t, _ in rows]
    words = [np.concatenate([s[0][o] for s in seen]) for o in range(len(OFFSETS))]
    shapes = [np.concatenate([s[1][o] for s in seen]) for o in range(len(OFFSETS))]
    gold = np.concatenate([y for _, y in rows])
    sizes = np.array([len(y) for _, y in rows])
    first = np.cumsum(sizes) - sizes
    pairs = np.setdiff1d(np.arange(len(gold)), first)  # tokens that follow another
    gold_moves = np.zeros((n, n))
    np.add.at(gold_moves, (gold[pairs - 1], gold[pairs]), 1)
    params = [field.words, field.shapes, field.moves]
    squares = [np.full(p.shape, 1e-2) for p in params]
    for _ in range(epochs):
        score = sum(field.words[o][words[o]] + field.shapes[o][shapes[o]] for o in range(len(OFFSETS)))
        marginal, moved = _expected(score, field.moves, first, sizes)
        away = marginal
        away[np.arange(len(gold)), gold] -= 1
        grads = [np.zeros_like(p) for p in params]
        for o in range(len(OFFSETS)):
            for label in range(n):
                grads[0][o, :, label] = np.bincount(words[o], away[:, label], len(lexicon) + 1)
                grads[1][o, :, label] = np.bincount(shapes[o], away[:, label], 2 * SHAPES)
        grads[2] = moved - gold_moves
        for p, g, s in zip(params, grads, squares):
            g += DECAY * len(rows) * p
            s += g * g
            p -= RATE * g / np.sqrt(s)
    return field


def _expected(score: np.ndarray, moves: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels (a row for each token) and expected counts of moves, by forward and backward sums over all sentences."""
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    allowed = np.where(ALLOWED, moves, -1e9)
    begin = np.where([x[0] == "I" for x in LABELS], -1e9, 0.0)
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]) + 1)]  # sentences longer than t
    log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[first] = score[first] + begin
    for t in range(1, int(sizes[0])):
        at = first[: alive[t]] + t
        alpha[at] = score[at] + log_sum(alpha[at - 1][:, :, None] + allowed, 1)
    total = log_sum(alpha[first + sizes - 1], 1)
    moved = np.zeros_like(moves)
    for t in range(int(sizes[0]) - 1, 0, -1):
        at = first[: alive[t]] + t
        step = allowed + (score[at] + beta[at])[:, None, :]
        moved += np.exp(alpha[at - 1][:, :, None] + step - total[: alive[t], None, None]).sum(0)
        beta[at - 1] = log_sum(step, 2)
    whole = np.empty(len(score))
    whole[np.concatenate([f + np.arange(s) for f, s in zip(first, sizes)])] = np.repeat(total, sizes)
    return np.exp(alpha + beta - whole[:, None]), moved


def viterbi(score: np.ndarray, moves: np.ndarray, first: np.ndarray, sizes: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """The best labels of sequences, a step at a time for all of them. One that goes on may start within a stretch."""
    order = np.argsort(-sizes, kind="stable")
    first, sizes, goes_on = first[order], sizes[order], goes_on[order]
    allowed = np.where(ALLOWED, moves, -np.inf)
    begin = np.where([x[0] == "I" for x in LABELS], -np.inf, 0.0)
    labels = np.zeros(len(score), np.int64)
    if not len(first):
        return labels
    longest = int(sizes[0])
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]
    best = score[first] + np.where(goes_on[:, None], 0.0, begin)
    back = []
    for t in range(1, longest):
        n = alive[t]
        through = best[:n, :, None] + allowed
        back.append(through.argmax(1).astype(np.uint8))
        best[:n] = through.max(1) + score[first[:n] + t]
    now = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        labels[first[:n] + t] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return labels


def _lines(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences: first token, size, and whether it goes on the line before. Lines are cut after LINE tokens."""
    start = np.flatnonzero(tokens.line)
    within = np.arange(len(tokens.start)) - np.repeat(start, np.diff(np.concatenate([start, [len(tokens.start)]])))
    first = np.flatnonzero(within % LINE == 0)
    return first, np.diff(np.concatenate([first, [len(tokens.start)]])), within[first] > 0


def labelled_by(field: Field, tokens: Tokens, caution: float = CAUTION) -> np.ndarray:
    """The label of each token."""
    labels = np.zeros(len(tokens.start), np.int64)
    if not len(labels):
        return labels
    score = emissions(field, tokens)
    score[:, 0] += caution
    first, sizes, goes_on = _lines(tokens)
    gain = max(0.0, float((field.moves - field.moves[0, 0])[ALLOWED].max()))
    likely = score[:, 1:].max(1) - score[:, 0] + 2 * gain >= 0
    some = np.logical_or.reduceat(likely, first)
    # a part that goes on is decoded along with what it follows
    kept = some | np.concatenate([some[1:] & goes_on[1:], [False]]) | (goes_on & np.concatenate([[False], some[:-1]]))
    labels = viterbi(score, field.moves, first[kept], sizes[kept], goes_on[kept])
    # a further token needs one of its kind before it, also across the border of parts
    further = (labels > 0) & (labels % 2 == 0)
    for i in np.flatnonzero(further & np.concatenate([[True], (labels[1:] - labels[:-1] != 0) & (labels[1:] - labels[:-1] != 1)])).tolist():
        labels[i] -= 1
    return labels


def stretches(labels: np.ndarray, tokens: Tokens, shift: int = 0) -> list[tuple[int, int, int]]:
    """(kind, start, end) in characters, kinds numbered after the base ones."""
    first = np.flatnonzero(labels % 2 == 1)
    out = []
    for i in first.tolist():
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        out.append((len(BASE) + int(labels[i]) // 2, int(tokens.start[i]) + shift, int(tokens.end[j - 1]) + shift))
    return out


def _pieces(text: str):
    """(shift, piece) of a text, each of PIECE characters at most unless it has no blank."""
    at = 0
    while len(text) - at > PIECE:
        cut_at = max(text.rfind("\n", at, at + PIECE) + 1, 0)
        if cut_at <= at:
            cut_at = text.rfind(" ", at, at + PIECE) + 1
        if cut_at <= at:
            cut_at = at + PIECE
        yield at, text[at:cut_at]
        at = cut_at
    yield at, text[at:]


def field_spans(field: Field, texts: list[str], caution: float = CAUTION) -> list[list[tuple[int, int, int]]]:
    """The field's spans in each text. Texts are tokenised together, in runs of PIECE characters or so; each begins a line."""
    out: list[list] = [[] for _ in texts]
    run: list[tuple[int, int, str]] = []

    def solve() -> None:
        codes = _codes("\n".join(p for _, _, p in run))
        tokens = Tokens.of(codes)
        labels = labelled_by(field, tokens, caution)
        begin = np.cumsum([0] + [len(p) + 1 for _, _, p in run])
        for kind, a, b in stretches(labels, tokens):
            k = int(np.searchsorted(begin, a, side="right")) - 1
            owner, shift, _ = run[k]
            out[owner].append((kind, a - int(begin[k]) + shift, b - int(begin[k]) + shift))
        run.clear()

    size = 0
    for n, text in enumerate(texts):
        for shift, piece in _pieces(text):
            if run and size + len(piece) > PIECE:
                solve()
                size = 0
            run.append((n, shift, piece))
            size += len(piece)
    if run:
        solve()
    return out


def found_spans(field: Field | None, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
    """All spans of each text by kind and start: base ones, and those of the field that touch no base span."""
    whole = [t or "" for t in texts]
    more = field_spans(field, whole) if field else [[]] * len(whole)
    out = []
    for text, extra in zip(whole, more):
        spans = base_spans(text)
        extra = [e for e in extra if not any(a < e[2] and e[1] < b for _, a, b in spans)]
        out.append(sorted([*spans, *extra]))
    return out


def labelled_rows(spark) -> DataFrame:
    """The small labelled table: sentence, text, and marks as structs of kind, start and end."""
    rows = [(n, text, marks) for n, (text, marks) in enumerate(pii_labels.sentences())]
    return spark.createDataFrame(rows, "sentence long, text string, marks array<struct<kind:string,start:int,end:int>>")


def tagged(text: str, marks: list[tuple[str, int, int]]) -> tuple[Tokens, np.ndarray]:
    tokens = Tokens.of(_codes(text))
    labels = np.zeros(len(tokens.start), np.int64)
    for kind, start, end in marks:
        inside = np.flatnonzero((tokens.start >= start) & (tokens.end <= end))
        if len(inside) and kind in KINDS:
            labels[inside] = 2 * KINDS.index(kind) + 2
            labels[inside[0]] -= 1
    return tokens, labels


def train(labelled: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """A DataFrame of one row with the field, fitted by one task on at most ``sample`` labelled sentences (those of least hash); no
    row without any."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["sentence", "text"])
        rows = [tagged(t, [(m["kind"], m["start"], m["end"]) for m in ms]) for t, ms in zip(batch["text"], batch["marks"])]
        rows = [r for r in rows if len(r[1])]
        if not rows:
            return pd.DataFrame({c: [] for c in ("lexicon", "words", "shapes", "moves")})
        return pd.DataFrame([train_field(rows, epochs).pack()], columns=["lexicon", "words", "shapes", "moves"])

    marks = F.coalesce("marks", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    rows = labelled.filter("text is not null").select("sentence", "text", marks.alias("marks")).orderBy(F.xxhash64("sentence", "text")).limit(sample)
    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "lexicon binary, words binary, shapes binary, moves binary")


def _finder(docs: DataFrame, labelled: DataFrame | None):
    """A function for tasks from texts to their spans; the field, of bounded size, is sent to all."""
    spark = docs.sparkSession
    model = train(labelled if labelled is not None else labelled_rows(spark)).collect()
    shared = spark.sparkContext.broadcast(tuple(map(bytes, model[0])) if model else None)

    def make():
        field = Field.unpack(*shared.value) if shared.value else None
        return lambda texts: found_spans(field, texts)

    return make


def listed(spans: list[tuple[int, int, int]]) -> str:
    names = (*BASE, *KINDS)
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    find = _finder(docs, labelled)

    def make():
        spans_of = find()

        def rows(texts):
            out = []
            for spans in spans_of(texts):
                base = [s for s in spans if s[0] < len(BASE)]
                counts = [sum(s[0] == k for s in base) for k in range(len(BASE))]
                out.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            return out

        return rows

    fields = ", ".join([*(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string"])
    return by_text(docs, ["doc_id"], fields, make)


def masked(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets, as in ``[email]``; of spans that overlap the earlier, then longer one counts."""
    find, names = _finder(docs, labelled), (*BASE, *KINDS)

    def make():
        spans_of = find()

        def rows(texts):
            out = []
            for text, spans in zip(texts, spans_of(texts)):
                parts, at = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
                    if a >= at:
                        parts += [text[at:a], f"[{names[kind]}]"]
                        at = b
                out.append((None if text is None else "".join([*parts, text[at:]]),))
            return out

        return rows

    kept = [c for c in docs.columns if c != "text"]
    return by_text(docs, kept, "text string", make).select(*docs.columns)
