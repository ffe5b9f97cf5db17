import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == E.entry(spark).columns


def test_queries_cover_the_survey_groups():
    q = E.queries()
    for name in ["csv_scan", "ontology", "primary_agg", "corr_matrix", "box_stats", "histogram40", "context_window",
                 "status_fold", "run_script", "analysis_plan", "stream_status", "poll_timeout"]:
        assert name in q
