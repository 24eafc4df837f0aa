"""Every query that SQL can't express is held against something else here, and the pipeline keeps foreign columns."""

import ast
from pathlib import Path

from inkveil.llm import queries

#: The test of each query without SQL: a brute-force model, an exact round trip, or held-out rows.
TESTS = {
    "op2_toxicity": "test_toxicity_finds_mined_stems", "op4_backoff_lm": "test_backoff_reads_every_ngram", "op5_license_scan": "test_licenses",
    "op6_language_mixture": "test_language_mixture", "op7_best_fit_packing": "test_packing", "op8_arrow_sequences": "test_chunked_rows_and_sequences",
    "op9_winnowing": "test_winnowing", "op10_chunked_bpe": "test_chunked_rows_and_sequences", "op12_whitening": "test_whiten_matches_numpy",
}


def test_every_query_without_sql_has_a_test():
    names = set()
    for path in Path(__file__).parent.glob("test_*.py"):
        names |= {f.name for f in ast.parse(path.read_text()).body if isinstance(f, ast.FunctionDef) and f.name.startswith("test_")}
    assert set(queries.QUERIES) - set(queries.SQL) == set(TESTS)
    assert set(TESTS.values()) <= names


def test_pipeline_stages_keep_foreign_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(
        [(1, "the cat sat on the mat", "en", 7.5, "a"), (2, "123", "en", 1.5, "b")],
        "doc_id long, text string, lang string, score double, `a.b` string",
    )
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, "the cat sat on the mat", "en", 7.5, "a")]
    assert [tuple(r) for r in corpus_pipeline.deduplicated(spark, kept, "").collect()] == [(1, "the cat sat on the mat", "en", 7.5, "a")]
