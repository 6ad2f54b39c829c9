import random
import zlib

from corpus import documents, frame

from verdure.llm import toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def made(n=260):
    rng = random.Random(3)
    plain = ["river", "stone", "garden", "window", "letter", "morning", "teacher", "bridge", "yellow", "summer", "paper", "music"]
    rude = ["dreadfulfool", "blockhead", "nitwit"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 90))]
        toxic = i % 2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(rude)
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_misspellings(spark):
    rows, labels = made()
    rows += [(1000, "river stone dreadfullfool garden letter", "en", "a", 0), (1001, "river stones garden bridges letter", "en", "a", 0)]
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    out = [i for i, _, _ in labels if held(i)]
    assert all(got[i]["held_out"] == held(i) for i, _, _ in labels)
    assert sum(got[i]["predicted"] == i % 2 for i in out) / len(out) > 0.9
    assert got[1000]["score"] > got[1001]["score"] and got[1000]["predicted"] == 1 and got[1001]["predicted"] == 0
    again = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-12 for i in again)


def test_hard_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark), none).collect()
    assert len(got) == len(documents()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(frame(spark, []), none).count() == 0
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(frame(spark), odd).count() == len(documents())


def test_subwords_are_the_same_alone_and_in_a_batch():
    some = ["straße", "a", "", "loser", "日本語"]
    ids, owner = toxicity.subwords(some)
    for n, w in enumerate(some):
        one, _ = toxicity.subwords([w])
        assert sorted(ids[owner == n]) == sorted(one)
