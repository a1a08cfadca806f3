import __spark_entry__


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0].n >= rows[-1].n
