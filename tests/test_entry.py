import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"lang", "bits", "bits_per_byte"} <= set(df.columns)
    assert df.count() > 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60
