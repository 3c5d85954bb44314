"""Calendar, catalogs, rosters of a surface, licenses and the public roster, by hand."""

from __future__ import annotations

import pytest

from psephos.constraints import ConstraintError, violations
from psephos.operators import scope
from psephos.plans import scopes
from psephos.sources import pages


def years(df):
    return sorted(r["year"] for r in df.collect())


@pytest.mark.parametrize("latest, want", [(1788, []), (1789, [1789]), (1791, [1789]), (1792, [1789, 1792]), (1803, [1789, 1792, 1796, 1800])])
def test_calendar(spark, latest, want):
    assert years(scope.election_years(spark, latest)) == want


def test_scope(spark):
    kept = scope.ingest_years(scope.election_years(spark, 1840), 1824, [1832])
    assert years(kept) == [1824, 1828, 1836, 1840]
    rows, missing = scope.in_scope(spark.createDataFrame([(1824,), (1828,), (1832,), (1836,)], "year int"), kept)
    assert years(rows) == [1824, 1828, 1836] and years(missing.violations) == [1840]


def test_statuses():
    scope.check_statuses(["counted", "disputed"], "counted", ["disputed"])
    for values, uncounted in ((["counted", "disputed", "half"], ["disputed"]), (["counted"], ["counted"])):
        with pytest.raises(ValueError):
            scope.check_statuses(values, "counted", uncounted)


def test_overrides(spark):
    schema = "year int, state string, candidate string, count_status string, count_status_reason string"
    good = spark.createDataFrame([(1, "a", "x", "disputed", "why")], schema)
    assert violations(scope.overrides_well_formed(good)).count() == 0
    bad = spark.createDataFrame([(1, "a", "x", "typo", "why"), (1, "a", "x", "counted", None), (2, "a", "x", None, " ")], schema)
    told = {r["constraint"]: r["n_violations"] for r in violations(scope.overrides_well_formed(bad)).collect()}
    assert told == {"override_status_unknown": 2, "override_changes_nothing": 1, "override_without_reason": 2, "override_twice": 1}
    assert scope.unprinted_are_uncounted(spark.createDataFrame([(1, "a", "x"), (9, "a", "x")], "year int, state string, candidate string"), good).violations.count() == 1


def test_a_surface_is_measured_by_its_sources(spark):
    roster = spark.createDataFrame([("A", 1, "s", "popular_vote"), ("B", 1, "s", "legislature_chosen"), ("C", 1, "s", "popular_vote")], "source string, year int, state string, pv_status string")
    assert [tuple(r) for r in scope.agreeing_roster(roster, ["A", "C"]).collect()] == [(1, "s", "popular_vote")]
    with pytest.raises(ConstraintError):
        scope.agreeing_roster(roster)


def test_licenses(spark):
    rows = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "source string")
    found, broken = scope.licenses(rows, spark.createDataFrame([("A", "free"), ("C", "x")], "source string, license string"))
    assert sorted(map(tuple, found.collect())) == [("A", "free", 2), ("B", None, 1)] and [r["source"] for r in broken.violations.collect()] == ["B"]


def test_public_roster(spark):
    part = spark.createDataFrame([(1, "a", False), (1, "b", False), (1, None, True), (2, "a", False)], "year int, state string, is_total boolean")
    absent = spark.createDataFrame([(1, "b", "legislature_chosen", "prose")], "year int, state string, pv_status string, note string")
    one, three = (spark.createDataFrame([(y,)], "year int") for y in (1, 3))
    assert sorted(map(tuple, scope.public_roster(part, absent, one).collect())) == [(1, "a", "popular_vote"), (1, "b", "legislature_chosen")]
    with pytest.raises(ConstraintError) as told:
        scope.public_roster(part, absent.withColumn("state", scope.F.lit("z")), three)
    assert set(told.value.broken) == {"year_without_roster", "absence_not_in_spine"}


HEADS = {
    "stacked": "<tr><td>STATE<td>TOTAL VOTE<td colspan=3>Red<td colspan=3>Blue</tr><tr><td colspan=3>Ann<sup>2</sup><td colspan=3>Bob</tr><tr><td><td>Votes<td>%<td>EV<td>Votes<td>%<td>EV</tr>",
    "without spans": "<tr><td>STATES<td>TOTAL VOTES<td>Red<td>Blue</tr><tr><td>Ann<td>Bob</tr><tr><td>Votes<td>%<td>EV<td>Votes<td>%<td>EV</tr>",
    "three rows": "<tr><td>&nbsp;<td colspan=3>Ann<td colspan=3>Bob</tr><tr><td><td>TOTAL VOTES<td colspan=3>Red<td colspan=3>Blue</tr><tr><td>STATE<td>Votes<td>%<td>EV<td>Votes<td>%<td>EV</tr>",
    "names first": "<tr><td colspan=2><td colspan=3>Ann<td colspan=3>Bob</tr><tr><td>STATE<td>TOTAL VOTE<td colspan=3>Red<td colspan=3>Blue</tr><tr><td><td>Votes<td>%<td>EV<td>Votes<td>%<td>EV</tr>",
    "fused": "<tr><td colspan=2><td colspan=3>Ann<br>Red<td colspan=3>Bob<br>Blue</tr><tr><td>STATE<td>TOTAL<td>Votes<td>%<td>EV<td>Votes<td>%<td>EV</tr>",
}
BODY = "<tr><td>Ada *<td>12<td>7<td>58.3%<td>3<td>5<td>41.7%<td>-</tr><tr><td>Bern<td>9<td>9<td>100%<td>2<td>--<td>-<td>-</tr><tr><td>Totals<td>21<td>16<td>76.2%<td>5<td>5<td>23.8%<td>0</tr>"


@pytest.mark.parametrize("kind", list(HEADS))
def test_layouts_and_trailing_block(spark, kind):
    html = f"<table>{HEADS[kind]}{BODY}{scopes._BLOCK}"
    got = pages.popular_votes_of_pages(spark.createDataFrame([("1", html)], "page string, html string"))[0]
    assert sorted((r["label"], r["name"], r["votes"], r["percent"]) for r in got.collect()) == [("Ada", "Ann", 7, 58.3), ("Ada", "Bob", 5, 41.7), ("Bern", "Ann", 9, 100.0)]
    assert {r["name"]: r["party"] for r in got.collect()} == {"Ann": "Red", "Bob": "Blue"}
