import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 65


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["triad_idx", "k", "l", "kl", "f1", "f2", "f3", "region", "value"] and out.count() == 10
