import pytest

import __spark_entry__ as entry
from checks import compare

SF = "/root/testdata/sf0.001"
QUICK = ["constant_columns_events", "exact_marginals_events_nan", "pair_sample_orders", "evidence_orders", "constant_penalty_events",
         "discover_customer_nation", "search_level3_customer_nation", "dependency_scores_customer_nation", "violation_count_weak_order",
         "violating_rows_two_orders", "supersets_until_orders", "triage_examples", "log_sections", "join_dimension_twice", "bench_means", "violating_rows_three_orders",
         "violation_count_two_orders", "verify_discovered_customer_nation", "discover_file_order_conversations", "row_numbers_lineitem",
         "violation_classes_part", "typed_csv_rejects_orders", "set_support_customer_nation"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    ok, text = compare.compare(spark, compare.connect(SF), SF, name)
    assert ok, text


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["denial_constraint", "size", "score", "anchor", "sampled_pairs"]
