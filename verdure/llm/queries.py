"""One query for each numbered operator: it applies the operator to the whole documents table."""

from __future__ import annotations

from . import bpe, licenses, media, merkle, mixing, pii, quality, ranking, secrets, simhash, sql, substrings, suffixes, toxicity

VOCABULARY = "byte_bpe_50k.tiktoken"


def _docs(spark, sf_dir, table="documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return substrings.deduplicated(_docs(spark, sf_dir))


def op2_license_scans(spark, sf_dir):
    return licenses.scan(_docs(spark, sf_dir))


def op3_secret_scans(spark, sf_dir):
    return secrets.scan(_docs(spark, sf_dir))


def op5_quality_rules(spark, sf_dir):
    return quality.score(_docs(spark, sf_dir))


def op4_media_columns(spark, sf_dir):
    return media.documents_as_media(_docs(spark, sf_dir))


def op6_source_mixing(spark, sf_dir):
    return mixing.shares(_docs(spark, sf_dir))


def op7_simhash(spark, sf_dir):
    return simhash.components(_docs(spark, sf_dir))


def op8_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(_docs(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_suffix_dedup(spark, sf_dir):
    return suffixes.deduplicated(_docs(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    return toxicity.score(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.audited(_docs(spark, sf_dir))


def op12_personal_data(spark, sf_dir):
    return pii.scan(_docs(spark, sf_dir))


def op13_ranked_search(spark, sf_dir):
    return ranking.search(_docs(spark, sf_dir), _docs(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scans": op2_license_scans,
    "op3_secret_scans": op3_secret_scans,
    "op4_media_columns": op4_media_columns,
    "op5_quality_rules": op5_quality_rules,
    "op6_source_mixing": op6_source_mixing,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_personal_data": op12_personal_data,
    "op13_ranked_search": op13_ranked_search,
}

#: DuckDB SQL, where SQL can express the rows.
ORACLE_SQL: dict = {
    "op1_substring_dedup": sql.SUBSTRINGS,
    "op5_quality_rules": sql.quality(),
    "op9_suffix_dedup": sql.SUFFIXES,
    "op11_merkle_manifest": sql.merkle(),
    "op13_ranked_search": sql.RANKING,
}
