"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as entry_module


def test_entry_runs_on_smoke_data(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["cause", "lines", "sellers", "revenue", "delay_days", "seller_days", "carrier_days"]
    assert df.count() == 6  # "unknown" is among the causes


def test_every_query_has_oracle_sql():
    from latebound.plans import QUERIES

    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) >= 26
