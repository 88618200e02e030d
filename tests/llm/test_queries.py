"""The registered queries: one for each operator, equal to their SQL on the smallest table where there is any."""

import re

import pytest

import __spark_entry__ as entry_point
from barloom.llm import oracles, queries


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry_point.queries()
    assert set(oracles.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_queries_equal_their_sql(spark, sf, name):
    from oracle_check import compare, connect

    got = queries.QUERIES[name](spark, sf).toPandas()
    assert compare(got, connect(sf).execute(oracles.SQL[name]).fetchdf()) == ""


COLUMNS = {
    "op2_sentencepiece": {"doc_id", "n_tokens", "token_ids", "round_trip"},
    "op4_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op5_simhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op12_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op7_minhash_dedup": {"doc_id", "group_id", "group_size", "keep"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_a_document(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert COLUMNS[name] <= set(out.columns)
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_edits_are_nearer_than_other_documents(spark, sf):
    rows = queries.QUERIES["op5_simhash"](spark, sf).where("n_chars > 400").collect()
    assert sum(r.near_edited for r in rows) / len(rows) > sum(r.near_next for r in rows) / len(rows) + 0.08
    asked = [r for r in rows if r.doc_id % 50 == 0]
    assert asked and all(r.n_near >= r.n_exact >= 1 for r in asked)


def test_simhash_keeps_one_row_a_row_for_repeated_ids(spark, tmp_path):
    rows = [(50, "one text here"), (50, "another text of the same id"), (50, "a third one"), (51, "one text here"), (None, "x"), (100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op5_simhash"](spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    assert all((r.n_near is not None) == (r.doc_id is not None and r.doc_id % 50 == 0) for r in out)
    assert max(r.n_exact for r in out if r.n_exact) == 2
