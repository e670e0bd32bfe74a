import __spark_entry__


def test_registry():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
