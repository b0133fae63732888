import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).columns == ["oid", "copies", "first_doc", "size"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
