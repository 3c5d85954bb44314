"""The first page family: what a page means, and each constraint broken once."""

from __future__ import annotations

import pytest

from psephos.constraints import ConstraintError
from psephos.plans import oracle_sql, queries
from psephos.sources import electoral_pages as E

STATES = ["Ada", "Bern", "Cork", "New Dale"]
PARTIES = "<table><tr><th>President</th><td>Ann B. Cole, Jr. * [D-R]</td></tr><tr><th>Main Opponent</th><td>Dan Eck [None] *</td></tr><tr><th>Votes</th><td>12</td></tr></table>"
HEAD = "<tr><th>State</th><th>Electors</th><th colspan={n}>For President</th><th colspan={n}>For Vice-President</th></tr>"
PEOPLE = "<tr><th></th><th></th><td>Ann B. Cole, Jr., of Bern</td><td>Dan<br>Eck,<br>of New Dale*</td><td>Others<sup>1</sup></td><td>V, of Ada</td></tr>"
ROWS = [
    "<tr><td>Ada<sup>3</sup></td><td>9</td><td>9</td><td>-</td><td>-</td><td>9</td></tr>",
    "<tr><td>Bern <sup>12</sup></td><td>8<sup>13</sup></td><td>5</td><td>(2)</td><td>1</td><td>x</td></tr>",
    "<tr></tr>",
    "<tr><td>New Dale *</td><td>-</td><td>-</td><td>-</td><td>-</td></tr>",
]
TOTAL = "<tr><th>Totals</th><td>17</td><td>14</td><td>2</td><td>1</td></tr>"
NOTES = "<tr><td colspan=6>Total votes: two of Bern were (not) counted 1 2 3</td></tr>"


def page(rows=None, total=TOTAL, parties=PARTIES, head=HEAD.format(n=3), people=PEOPLE):
    return f"<html><table><tr><td>menu</td></tr></table>{parties}<p>x</p><table>{head}{people}{''.join(ROWS if rows is None else rows)}{total}{NOTES}</table></html>"


def parsed(spark, *htmls):
    pages = spark.createDataFrame([(str(1800 + 4 * k), h) for k, h in enumerate(htmls)], "page string, html string")
    return E.electoral_pages(pages, spark.createDataFrame([(s,) for s in STATES], "state string"))


def record(spark, html):
    return E.year_records(parsed(spark, html)).collect()[0].asDict(recursive=True)


def broken(spark, html):
    with pytest.raises(ConstraintError) as told:
        E.year_records(parsed(spark, html))
    return set(told.value.broken)


def test_a_whole_page(spark):
    got = record(spark, page())
    assert got["year"] == 1800
    assert got["t1"] == [
        {"president_candidate_name": "Ann B. Cole Jr.", "president_candidate_party": "D-R"},
        {"president_candidate_name": "Dan Eck", "president_candidate_party": "None"},
    ]
    assert [tuple(c.values()) for c in got["t2"]["candidate_state"]] == [("Ann B. Cole Jr.", 1, "Bern"), ("Dan Eck", 2, "New Dale"), ("Others", 3, None)]
    assert [(r["state"], r["total_electoral_votes"], r["votes"]) for r in got["t2"]["votes_by_state"]] == [
        ("Ada", 9, {1: 9, 2: 0, 3: 0}), ("Bern", 8, {1: 5, 2: 2, 3: 1}), ("New Dale", 0, {1: 0, 2: 0, 3: 0}), ("Totals", 17, {1: 14, 2: 2, 3: 1}),
    ]
    assert got["t2"]["contested_cells"] == [{"state": "Bern", "col_ind": 2}]


@pytest.mark.parametrize("total", [
    "<tr><td>Total</td><td>17</td><td>14</td><td>2</td><td>1</td></tr>",
    "<tr><th>Totals (as read out) *</th><td>17</td><td>14</td><td>2</td><td>1</td></tr>",
    # Several: the one that its own state rows add up to.
    "<tr><th>Totals (without Bern)</th><td>9</td><td>9</td><td>0</td><td>0</td></tr><tr></tr><tr><th>Totals (with Bern)</th><td>17</td><td>14</td><td>2</td><td>1</td></tr>",
])
def test_totals_rows(spark, total):
    assert [(r["state"], r["votes"]) for r in record(spark, page(total=total))["t2"]["votes_by_state"]][-1:] == [("Totals", {1: 14, 2: 2, 3: 1})]


def test_a_single_totals_row_need_not_add_up(spark):
    got = record(spark, page(total="<tr><th>Total</th><td>20</td><td>14</td><td>2</td><td>1</td></tr>"))
    assert got["t2"]["votes_by_state"][-1]["total_electoral_votes"] == 20


def test_without_totals_row_and_with_one_column(spark):
    got = record(spark, page(rows=["<tr><td>Cork</td><td>3</td><td>3</td></tr>"], total="", head=HEAD.format(n=1), people="<tr><td>Ann, of Ada</td><td>V, of Cork</td></tr>"))
    assert got["t2"]["votes_by_state"] == [{"state": "Cork", "total_electoral_votes": 3, "votes": {1: 3}}] and got["t2"]["contested_cells"] == []


TWICE = "<tr><th>Totals (a)</th><td>{}</td><td>1</td><td>2</td><td>1</td></tr><tr><th>Totals (b)</th><td>{}</td><td>1</td><td>2</td><td>1</td></tr>"


@pytest.mark.parametrize("html, name", [
    (page(total=TWICE.format(17, 17)), {"totals_row_undecided"}),
    (page(total=TWICE.format(16, 18)), {"totals_row_undecided"}),
    (page(total=TWICE.format(17, 18).replace("<td>18</td><td>1</td><td>2</td><td>1</td>", "")), {"row_width_differs"}),
    (page(rows=["<tr><td>Ada</td><td>9</td><td>nine</td><td>-</td><td>-</td></tr>"]), {"vote_cell_unreadable"}),
    (page(rows=["<tr><td>Ada</td><td>176 (175)</td><td>1</td><td>-</td><td>-</td></tr>"]), {"vote_cell_unreadable"}),
    (page(rows=["<tr><td>Ada</td><td>9</td><td>9</td><td>-</td></tr>"]), {"row_width_differs"}),
    (page(people="<tr><td>Ann, of Ada</td></tr>"), {"columns_fewer_than_span"}),
    (page(people="<tr><td>Ann, of Ada</td><td>Dan</td><td>Other</td></tr>"), {"column_unreadable"}),
    (page(head="<tr><th>State</th><th>For President</th></tr>"), {"columns_without_span"}),
    (page(head="<tr><th>State</th><th colspan=3>For Premier</th></tr>"), {"not_one_votes_table"}),
    (page() + page(), {"not_one_votes_table"}),
    (page(parties=PARTIES.replace("Main Opponent", "Main Rival")), {"party_header_differs"}),
    (page(parties=PARTIES.replace("<th>President</th>", "")), {"party_header_differs"}),
    (page(parties=PARTIES.replace("[None]", "")), {"party_cell_unreadable"}),
    (page(parties="<table><tr><th>President</th><td>Ann [X]</td></tr></table>"), {"party_row_missing"}),
])
def test_broken_pages(spark, html, name):
    assert name <= broken(spark, html)


def test_several_pages(spark):
    got = {r["year"]: len(r["t2"]["votes_by_state"]) for r in E.year_records(parsed(spark, page(), page(total=""))).collect()}
    assert got == {1800: 4, 1804: 3}


@pytest.mark.parametrize("name", ["electoral_page_contested", "totals_rows_all_match", "totals_rows_none_matches"])
def test_queries_have_rows(spark, name):
    assert name in oracle_sql() and queries()[name](spark, "/root/testdata/sf0.001").count() > 0
