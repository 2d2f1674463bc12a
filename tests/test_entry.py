"""Driver contract."""

import __spark_entry__ as E

ROWS_ONLY = {"lr_train_predict"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["interval_id", "interval_no", "n_events", "margin", "status"]


def test_every_query_has_an_oracle_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(q) - set(o) - set(E.LLM_QUERIES) == ROWS_ONLY
    assert set(o) <= set(q)
