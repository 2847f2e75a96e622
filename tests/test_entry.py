import __spark_entry__ as entry


def test_entry_and_registry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "score" in out.columns
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 90


def test_market_parts_read_the_lines_once(spark):
    from catalog.tracking import market_parts

    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in market_parts(spark, entry.SMOKE_DIR)]
    assert not any("l_orderkey" in p or "l_shipdate" in p for p in plans)
