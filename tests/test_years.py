"""The index of years has every year that orders have, and the check of counted votes looks at every row of the view."""

from __future__ import annotations

from pyspark.sql import functions as F

from psephos.plans import ballots as B
from psephos.plans import checks, queries

DATA = "/root/testdata/sf0.001"


def test_index_has_every_year_of_orders(spark):
    want = {r[0] for r in B.table(spark, DATA, "orders").select(F.year("o_orderdate")).distinct().collect()}
    assert {r["year"] for r in queries()["years"](spark, DATA).collect()} == want


def test_counted_against_status_looks_at_every_row(spark, monkeypatch):
    """With a wrong count in every row of the view, every row that has a count is a violation."""
    whole = B.joined(spark, DATA)
    wrong = whole.withColumn("president_electoral_votes_counted", F.col("president_electoral_votes_counted") + 1000)
    monkeypatch.setattr(checks.B, "joined", lambda *a, **k: wrong)
    got = checks.counted_against_status(spark, DATA)
    assert got.count() == whole.where("president_electoral_votes_counted is not null").count() > 0
    assert {r[0] for r in got.select("year").distinct().collect()} == {r[0] for r in whole.select("year").distinct().collect()}
