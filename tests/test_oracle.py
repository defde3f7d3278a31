"""Registered queries equal their SQL twins on the smallest tables (a spread of families)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import connect, table  # noqa: E402

from catalog import all_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = {q.name: q for q in all_queries()}
SOME = [
    "redact_documents_by_category", "redact_documents", "match_registry_inline", "resolve_occurrences_rows", "restore_json_detected",
    "detect_github_token", "detect_secret_assignment", "detect_credit_card", "gate_likely_secret", "structural_json_pairs",
    "load_dotenv", "flatten_leaves", "import_registry_rejects", "review_candidates", "stats_totals", "stats_by_label",
    "hash_chain", "retention_sweep", "detector_quality", "surrogate_fidelity", "mint_entity", "stream_restore_chunks",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    q = QUERIES[name]
    df = q.call(spark, SF)
    got = table(df.columns, df.collect())
    r = connect(SF).execute(q.sql)
    assert got == table([d[0] for d in r.description], r.fetchall())


def test_every_name_is_unique_and_most_have_sql():
    assert len(QUERIES) > 120
    assert sum(1 for q in QUERIES.values() if q.sql) / len(QUERIES) > 0.9
