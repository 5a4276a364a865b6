import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 3
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50


def test_a_query_of_each_kind_runs_on_the_smallest_tables(spark):
    for name in ("bm25_search", "agg_mean", "evaluate_complete", "overlap_deciles", "dup_clusters", "confusion_profile"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").columns
