"""Years reach the scan of orders, and the view of some years is that of all, cut to them."""

from __future__ import annotations

import pytest

from psephos.plans import ballots as B

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("years, pushed", [((1996, 1998), ["GreaterThanOrEqual(o_orderdate,1996-01-01", "LessThan(o_orderdate,1999-01-01"]), ((1997, None), ["GreaterThanOrEqual(o_orderdate,1997-01-01"]), ((None, 1996), ["LessThan(o_orderdate,1997-01-01"])])
def test_years_are_pushed_to_the_scan(spark, years, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # so that the plan shows its filters in full
    plan = B.popular(spark, DATA, years)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(p in plan for p in pushed)
    first, last = years
    whole = B.popular(spark, DATA).where(f"year between {first or 0} and {last or 9999}")
    assert sorted(map(tuple, B.popular(spark, DATA, years).collect())) == sorted(map(tuple, whole.collect())) != []


def test_the_view_of_some_years(spark):
    def rows(df):
        return sorted(map(str, df.collect()))

    assert rows(B.joined(spark, DATA, years=(1996, 1998))) == rows(B.joined(spark, DATA).where("year between 1996 and 1998")) != []


def test_years_without_orders(spark):
    assert B.joined(spark, DATA, years=(1890, 1892)).collect() == []
