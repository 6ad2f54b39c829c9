import re
from collections import defaultdict

import numpy as np
import pytest
from test_quality import counts
from test_simhash import brute_kept

from verdure.llm import bpe, mixing, secrets

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402


def made():
    rows, common = [], "the house of the king and the river is in a valley for it was on that hill "
    for i in range(60):
        text = common + " ".join(f"word{i}of{k}" for k in range(60 + i))
        if i % 9 == 0:
            text += f" password=abcdef{i:06d}"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows.append((100, rows[5][1], "en", "s1", 0))
    rows.append((101, rows[7][1].replace("word7of3 ", "changed "), "en", "s2", 0))
    rows += [(102, "too short", "en", "s1", 9), (103, None, "en", "s1", None), (104, "same words here " * 80, "en", None, 0)]
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == columns
    want = [r for r in rows if not counts(r[1])["base_failed"]]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in want)
    one = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path))
    assert one.columns == columns
    stays = {t[1] for t in brute_kept(want)}
    least = {r[0]: r for r in want if r[0] in stays}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(least)
    masked = corpus_pipeline.secret_scans(spark, one, str(tmp_path))
    assert masked.columns == columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts == {r[0]: re.sub(secrets.RULES[0].regex, secrets.MASK, r[1]) for r in least.values()}
    mix = corpus_pipeline.source_mix(spark, masked, str(tmp_path))
    assert mix.columns == columns
    taken, words = {r["doc_id"]: r["taken"] for r in mixing.shares(masked).collect()}, defaultdict(int)
    mixed = mix.collect()
    for r in mixed:
        words[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
    assert dict(words) == {k: v for k, v in taken.items() if v}
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = corpus_pipeline.token_ids(spark, mix, str(tmp_path)).collect()
    decoded = sorted(codec.decode(np.frombuffer(r["ids"], "<u4").tolist()).decode() for r in out)
    assert decoded == sorted(r["text"] for r in mixed)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in final) == sorted((r["doc_id"], bytes(r["ids"])) for r in out)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
