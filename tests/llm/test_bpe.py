import base64
import hashlib

import pytest
from corpus import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from verdure.llm import bpe, common

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text):
    e = bpe.codec(PATH, public_tokenizers.PATTERN).encode(text)
    return [int.from_bytes(e[i : i + 4], "little") for i in range(0, len(e), 4)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeinorst '\n", max_size=80)))
def test_same_ids_as_merging(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))} if not hasattr(test_same_ids_as_merging, "enc") else None
    if ranks:
        test_same_ids_as_merging.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = ids(text)
    assert got == test_same_ids_as_merging.enc.encode_ordinary(text)
    assert bpe.codec(PATH, public_tokenizers.PATTERN).decode(got) == text.encode()


def test_long_runs_are_linear_and_right(reference):
    for text in ("a" * 50_000, "xyz" * 20_000, " " * 3000 + "x", "0123456789" * 3000):
        assert ids(text) == reference.encode_ordinary(text)


def test_digests_of_documents(spark, reference):
    got = bpe.digests(frame(spark), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, *_ in documents():
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in got)


def test_encoded_keeps_columns_and_empty_table(spark):
    docs = frame(spark)
    assert bpe.encoded(docs, PATH, public_tokenizers.PATTERN).columns == [*docs.columns, "ids", "decoded"]
    rows = bpe.encoded(docs, PATH, public_tokenizers.PATTERN).filter("doc_id = 9").collect()
    assert bytes(rows[0]["decoded"]).decode() == rows[0]["text"]
    assert bpe.digests(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_what_a_task_remembers_goes_with_it(spark, monkeypatch):
    made = []
    monkeypatch.setattr(bpe, "by_text", lambda docs, keep, fields, make, *more: made.append(make))
    for query in (bpe.encoded, bpe.digests):
        query(frame(spark), PATH, public_tokenizers.PATTERN)
    held = bpe.codec(PATH, public_tokenizers.PATTERN)
    before = len(held.known), len(held.fits)
    for make in made:
        assert make()(["quixotry zyxwvutsrq jvkqxz"])
    assert (len(held.known), len(held.fits)) == before


def test_batches_are_cut(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "'en' AS lang").coalesce(1)
    rows = bpe.encoded(docs, PATH, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows} == {i: f"word {i}" for i in range(1000)}
    sizes = common.by_text(docs, ["doc_id"], "n long", lambda: lambda texts: [(len(texts),)] * len(texts), 300).groupBy("n").count()
    assert sorted(map(tuple, sizes.collect())) == [(100, 100), (300, 900)]
