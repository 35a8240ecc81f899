"""The operators' queries that SQL can express, against it; and what the contract fixes of the others."""

from __future__ import annotations

import pytest
from oracle import SF, check

from sentrylake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLE_SQL[name])


COLUMNS = {
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.select("doc_id").distinct().count() == docs
