"""The registered queries: those with SQL give its rows, the others the columns of their contract."""

import duckdb
import pytest

from postmill.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op9_kneser_ney": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    d = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        d.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    want = d.execute(SQL[name])
    order = [x[0] for x in want.description]
    assert sorted(order) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_whole(spark, name):
    got = QUERIES[name](spark, DIR)
    rows = got.count()
    if name == "op13_whitening":
        vectors = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and rows == 32 * vectors
    if name in COLUMNS:
        assert got.columns[: len(COLUMNS[name])] == COLUMNS[name] and rows == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert rows > 0


def test_languages_and_toxicity_beyond_the_training_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    n = got.count()
    assert got.where("lang = lang_pred").count() >= 0.97 * n > 0
