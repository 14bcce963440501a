import __spark_entry__ as E


def test_registry_has_oracles_for_sql_operators():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 65


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"row_id", "actual", "predicted", "margin", "phishing_confidence"}
    assert df.count() > 0
