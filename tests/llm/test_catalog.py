"""Which queries SQL cannot express, and the brute-force test of each."""

from pagetally.llm import catalog

TESTED_OTHERWISE = {
    "op2_simhash": "test_simhash_components, test_fingerprint_is_spark_xxhash64",
    "op3_katz": "test_katz",
    "op6_quality": "test_quality_accuracy, test_scorer_equals_model",
    "op9_passages": "test_passages, test_repeated_windows_are_covered",
    "op10_toxicity": "test_toxicity_accuracy",
    "pipeline": "test_pipeline",
}


def test_every_query_has_sql_or_a_plain_version():
    assert set(catalog.QUERIES) == set(catalog.SQL) | set(TESTED_OTHERWISE)
    assert not set(catalog.SQL) & set(TESTED_OTHERWISE)
