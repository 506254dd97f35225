import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and all(map(callable, names.values()))


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["segment", "customers", "orders", "revenue"] and rows.count() > 0
