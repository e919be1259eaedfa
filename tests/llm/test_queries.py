"""The queries of this part against their SQL, over the smallest tables, and their columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sqlcheck import connect, rows_of_spark, rows_of_sql  # noqa: E402

from plumbline.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4": "page_id url text n_chars",
    "op5": "doc_id start n_tokens ids_crc32",
    "op7": "doc_id held_out lang_pred score",
    "op8": "doc_id n_shingles component_id",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    found = QUERIES[name](spark, SF)
    op = name.split("_")[0]
    if op in COLUMNS:
        assert found.columns[: len(COLUMNS[op].split())] == COLUMNS[op].split()
        table = "pages" if op == "op4" else "documents"
        assert found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert found.count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 11))
