"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with borders) and itself, hashed into a fixed number of buckets; a bucket has
an embedding. A text is read in segments of ``SEGMENT`` words; a segment's vector is the average over its words of their
averaged n-gram embeddings, and a linear softmax scores it. A text scores as its highest segment does, so that length
does not dilute a few words. Embeddings and softmax are trained together by gradient steps on that segment.

The classifier is fitted on at most ``sample`` labelled rows of each class (a documented bound); every text is scored
whole. A model has a fixed size, whatever the data. NULL and empty texts are one segment without words and get the bias
score. Labels that are NULL, or whose document is missing, are not learned from; repeated rows repeat their score; extra
columns are ignored. Without any label of one class the scores are the bias of an untrained model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text

BUCKETS, DIMS, SEGMENT, LEAST, GRAMS = 1 << 16, 8, 32, 12, (3, 4, 5)
SAMPLE, EPOCHS, RATE, SEED = 1200, 6, 0.5, 7
#: Distinct words remembered by a worker.
REMEMBERED = 500_000


def words(text: str | None) -> list[str]:
    return [w.strip(".,;:!?\"'()[]") for w in (text or "").lower().split()]


def subwords(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and the index of each one's word: ids, owner. Repeats count.

    All words are hashed at once, as one array of code points; n-grams that would cross a border are left out."""
    codes = np.frombuffer("".join([f"<{w}>" for w in some]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in some], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(some)), size)
    left = (start + size)[owner] - np.arange(len(codes))  # code points from here to the word's end
    mix = lambda h, n: ((h ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS
    ids, owners, h, n = [], [], codes.copy(), 1
    while n < max(GRAMS):
        h = h[:-1] * np.uint64(1_000_003) + codes[n:]
        n += 1
        if n in GRAMS:
            whole = left[: len(h)] >= n
            ids.append(mix(h[whole], n))
            owners.append(owner[: len(h)][whole])
    power = np.uint64(1_000_003) ** (np.arange(len(codes)) - start[owner]).astype(np.uint64)
    ids.append(mix(np.add.reduceat(codes * power, start), 99))
    owners.append(np.arange(len(some)))
    return np.concatenate(ids), np.concatenate(owners)


def segments(text: str | None) -> list[list[str]]:
    """Distinct words of each SEGMENT consecutive words."""
    w = words(text)
    return [list(dict.fromkeys(w[i : i + SEGMENT])) for i in range(0, len(w), SEGMENT)]


class Bags:
    """Sparse rows: for a segment, buckets and weights. A segment of few distinct words is filled up with empty ones."""

    def __init__(self, vocabulary: list[str]):
        ids, owner = subwords(vocabulary)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(vocabulary)))
        self.parts = dict(zip(vocabulary, np.split(ids[order], ends[:-1]), strict=True))

    def segment(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.parts[w] for w in some]
        ids, at = np.unique(np.concatenate(parts), return_inverse=True)
        each = np.concatenate([np.full(len(p), 1 / len(p)) for p in parts])
        return ids, np.bincount(at, each) / max(len(some), LEAST)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Trains embeddings and softmax jointly; returns the arrays of the model."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS))
    soft = rng.normal(0, 0.1, (DIMS, 2))
    bias = np.zeros(2)
    g_emb, g_soft = np.full(BUCKETS, 1e-3), 1e-3
    rows = [segments(t) for t in texts]
    vocabulary = list(dict.fromkeys(w for segs in rows for s in segs for w in s))
    bags = Bags(vocabulary) if vocabulary else None
    for epoch in range(epochs if len(set(labels)) == 2 else 0):
        # a text's segment is chosen by the model as the epoch begins, from one score per word
        diff = emb @ (soft[:, 1] - soft[:, 0])
        value = {w: diff[ids].mean() for w, ids in bags.parts.items()} if epoch and bags else {}
        chosen = [max(segs, key=lambda s: sum(map(value.__getitem__, s)) / max(len(s), LEAST), default=None) if epoch else None for segs in rows]
        for i in rng.permutation(len(rows)):
            segs = rows[i]
            if not segs:
                continue
            # the first epoch sees all segments, so that every n-gram has met both labels before segments are chosen
            for s in segs if epoch == 0 else [chosen[i]]:
                ids, weight = bags.segment(s)
                vec = emb[ids]
                h = weight @ vec  # the segment's average embedding
                z = h @ soft + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                scale = 1.0 / len(segs) if epoch == 0 else 1.0
                grad_h = soft @ p * scale
                step = np.outer(weight, grad_h)
                g_emb[ids] += (step**2).mean(1)
                grad_s = np.outer(h, p) * scale
                g_soft += float((grad_s**2).mean())
                emb[ids] = vec - RATE * step / np.sqrt(g_emb[ids])[:, None]
                soft -= RATE * grad_s / np.sqrt(g_soft)
                bias -= 0.02 * p * scale
    return {"emb": emb, "soft": soft, "bias": bias}


def bucket_values(model: dict) -> tuple[np.ndarray, float]:
    """The model for two classes, folded: one number per bucket, and the bias."""
    diff = model["soft"][:, 1] - model["soft"][:, 0]
    return (model["emb"] @ diff).astype(np.float64), float(model["bias"][1] - model["bias"][0])


class Scorer:
    """Scores texts by the folded model; remembers words, for a batch at least."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias
        self.known: dict[str, float] = {}

    def learn(self, some: list[str]) -> None:
        if len(self.known) + len(some) > REMEMBERED:
            self.known.clear()
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            ids, owner = subwords(part)
            means = np.bincount(owner, self.values[ids], len(part)) / np.bincount(owner, minlength=len(part))
            self.known.update(zip(part, means.tolist(), strict=True))

    def __call__(self, text: str | None) -> float:
        segs = segments(text)
        new = {w for s in segs for w in s if w not in self.known}
        if new:
            self.learn(list(new if len(self.known) + len(new) <= REMEMBERED else {w for s in segs for w in s}))
        get = self.known.__getitem__
        best = max((sum(map(get, s)) / max(len(s), LEAST) for s in segs), default=0.0)
        return float(1 / (1 + np.exp(-np.clip(best + self.bias, -60, 60))))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most ``sample`` labelled documents per class: those of the least hash of doc_id outside the
    held-out fifth. Of several texts of an id the least is learned from, of several labels the greater."""
    open_rows = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = open_rows.join(docs.select("doc_id"), "doc_id", "left_semi")  # ids alone
    parts = [there.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * sample rows: small enough to be sent to all
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """A one-row DataFrame (values, bias): the model fitted by one task on the bounded sample."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["doc_id", "toxic"])
        values, bias = bucket_values(fit(batch["text"].tolist(), batch["toxic"].astype(int).tolist(), epochs))
        return pd.DataFrame({"values": [values.tobytes()], "bias": [bias]})

    rows = training_rows(docs, labels, sample)
    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "values binary, bias double")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted."""
    model = train(docs, labels, sample, epochs).collect()  # one row of fixed size, or none without any label
    values = np.frombuffer(model[0]["values"], np.float64) if model else np.zeros(BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast((values, model[0]["bias"] if model else 0.0))

    def make():
        scorer = Scorer(*shared.value)
        return lambda texts: [(scorer(t),) for t in texts]

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = by_text(docs.select("doc_id", held.alias("held_out"), "text"), ["doc_id", "held_out"], "score double", make)
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
