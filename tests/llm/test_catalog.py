"""The registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

from compare import compare, duck  # noqa: E402

from loomwork.llm.catalog import ORACLE, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    ok, message, rows = compare(spark, duck(FOLDER), QUERIES[name], ORACLE[name], FOLDER)
    assert ok, message
    assert rows > 0


def test_columns_of_the_others(spark):
    want = {
        "op1_quality_fm": ["doc_id", "held_out", "score", "predicted"], "op2_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op4_simhash": ["doc_id", "fingerprint", "component_id"], "op5_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op9_outliers": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]}
    for name, columns in want.items():
        df = QUERIES[name](spark, FOLDER)
        assert df.columns == columns and df.count() == 200, name
    assert sorted({*want, *ORACLE}) == sorted(QUERIES)
