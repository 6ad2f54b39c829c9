"""Ids that are large, NULL or of rows with clashing extra columns stay exact through every operator."""

import pytest
from pyspark.sql import functions as F

from verdure.llm import bpe, licenses, media, mixing, quality, secrets, simhash, substrings, suffixes, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BIG = (1 << 62) + 1
OPERATORS = {
    "substrings": substrings.deduplicated, "licenses": licenses.scan, "secrets": secrets.scan, "media": media.documents_as_media, "quality": quality.score,
    "mixing": mixing.shares, "simhash": simhash.components, "suffixes": suffixes.deduplicated,
    "bpe": lambda d: bpe.digests(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "toxicity": lambda d: toxicity.score(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_exact(spark, name):
    rows = [(BIG, "some words here", "en", "a", 15), (None, "other words there", None, None, None), (-5, None, "en", "a", None), (BIG + 1, "x", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("score", "size", "digest", "bucket", "fp", "start", "key", "kept", "spans", "labels", "rank", "target", "ref_lang", "cand_id", "ids", "decoded", "page", "items", "common"))])
    got = OPERATORS[name](clash)
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == [-5, BIG, BIG + 1]
    assert got.count() == 4


def test_document_outputs_keep_clashing_columns(spark):
    rows = [(BIG + i, " ".join(f"w{i}of{k}" for k in range(60)), "en", "a", 3) for i in range(4)] + [(None, "a b c d", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("score", "size", "digest", "bucket", "fp", "start", "key", "kept", "spans", "labels", "rank", "target", "ref_lang", "cand_id", "ids", "decoded", "page", "items", "common"))])
    for run in (quality.kept_documents, simhash.deduplicated, secrets.redacted, mixing.mixed):
        out = run(clash)
        assert out.columns == clash.columns
        assert {r["doc_id"] for r in out.collect()} - {None} <= {BIG + i for i in range(4)}
