import __spark_entry__ as e


def test_entry_and_names(spark):
    assert e.entry(spark).count() > 0
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)
    assert "mode_gap_sessions" in names
