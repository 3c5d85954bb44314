"""Operators on small frames: known outcomes, unknown kept apart from 0, and every constraint broken once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from psephos import constraints as C
from psephos.functions import text as T
from psephos.operators import measures as M
from psephos.operators import reshape, resolution
from psephos.plans.serving import Snapshot, capped, year_window
from psephos.schemas import CSV_COLUMNS, JOINED_COLUMNS, MEASURE_COLUMNS, SUMMARY_COLUMNS, YEAR_RECORD
from psephos.sources import delimited, pages, publish


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def election(spark):
    """Two states of 6 and 4 electors, two candidates; the second state holds no popular vote."""
    votes = frame(
        spark, "year int, state string, is_total boolean, candidate_id int, total_electoral_votes int, president_electoral_votes int, president_electoral_votes_counted int, count_status string, count_status_reason string, president_electoral_rank int, took_office boolean",
        (1900, "A", False, 1, 6, 6, 6, "counted", None, 1, True), (1900, "A", False, 2, 6, 0, 0, "counted", None, 2, False),
        (1900, "B", False, 1, 4, 0, 0, "counted", None, 1, True), (1900, "B", False, 2, 4, 4, 4, "counted", None, 2, False), (1900, None, True, 1, 10, 6, 6, "counted", None, 1, True),
    )
    names = frame(spark, "candidate_id int, name string", (1, "Ann"), (2, "Bea"))
    pv = frame(spark, "source string, year int, state string, candidate string, party string, candidate_votes long, state_total_votes long, reliability string", ("S", 1900, "A", "Ann", "P", 40, 100, "exact"), ("S", 1900, "A", "Bea", "Q", 60, 100, "exact"))
    sources = frame(spark, "source string, precedence_rank int, redistributable boolean", ("S", 1, True))
    roster = frame(spark, "source string, year int, state string, pv_status string", ("S", 1900, "A", "popular_vote"), ("S", 1900, "B", "legislature_chosen"))
    return resolution.spine_join(votes, names, pv, sources), roster


def test_measures_and_summary(spark):
    joined, roster = election(spark)
    assert joined.columns == JOINED_COLUMNS and joined.count() == 4
    scores = M.measures(joined, roster)
    assert scores.columns == MEASURE_COLUMNS
    by = {r["candidate"]: r for r in scores.collect()}
    assert (by["Ann"]["ec_share_full"], by["Ann"]["pv_share"], by["Ann"]["pv_coverage"]) == (0.6, 0.4, 0.6)
    row = M.summary(scores).head()
    assert list(row.asDict()) == SUMMARY_COLUMNS
    assert (row["ec_winner"], row["pv_winner"], row["pv_flip"], row["ec_determinative"]) == ("Ann", "Bea", True, True)
    assert row["pv_margin"] == pytest.approx(20.0)
    inside = {r["candidate"]: r["ec_share_hybrid"] for r in M.measures(joined, roster, M.RESTRICTED).collect()}
    assert inside == {"Ann": 1.0, "Bea": 0.0}
    with pytest.raises(ValueError):
        M.measures(joined, roster, "other")


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_partitions_change_nothing(spark, parts):
    joined, roster = election(spark)
    one = M.summary(M.measures(joined.repartition(parts), roster.repartition(parts))).collect()
    assert one == M.summary(M.measures(joined, roster)).collect()


def test_unknown_is_not_zero(spark):
    joined, roster = election(spark)
    bare = joined.withColumn("candidate_votes", F.lit(None).cast("long")).withColumn("state_total_votes", F.lit(None).cast("long"))
    row = M.summary(M.measures(bare, roster)).head()
    assert row["pv_winner"] is None and row["pv_flip"] is None and row["pv_margin"] is None and row["ec_winner"] == "Ann"
    assert M.coverage(joined, roster.where("year = 1")).head()["pv_coverage"] is None
    assert M.coverage(joined, roster.where("state = 'B'")).head()["pv_coverage"] == 0.0


def test_precedence(spark):
    union = frame(spark, "year int, state string, candidate string, source string, n int", (2000, "A", "x", "OLD", 50), (2000, "A", "x", "NEW", 100), (1900, "A", "x", "OLD", 50), (2004, "A", "x", "NEW", 70))
    sources = frame(spark, "source string, precedence_rank int, redistributable boolean", ("NEW", 1, True), ("OLD", 2, False))
    assert sorted((r["year"], r["n"]) for r in resolution.preferred(union, sources).collect()) == [(1900, 50), (2000, 100), (2004, 70)]
    assert sorted((r["year"], r["n"]) for r in resolution.redistributable(union, sources).collect()) == [(2000, 100), (2004, 70)]


def test_constraints_name_what_breaks(spark):
    df = frame(spark, "k int, g string, v int, t int", (1, "a", 1, 3), (1, "a", 2, 3), (2, "b", 5, 4))
    C.check(C.sums_equal(df.where("k = 1"), ["k"], "v", "t"))
    broken = [C.unique(df, ["k"]), C.sums_within(df, ["k"], "v", "t"), C.in_domain(df, "g", ["a"]), C.references(df, frame(spark, "k int", (1,)), ["k"]), C.constant(df, ["k"], "v"), C.row_rule(df, F.col("v") < 5, "small")]
    with pytest.raises(C.ConstraintError) as e:
        C.check(*broken)
    assert set(e.value.broken) == {"unique", "sums_within", "in_domain", "references", "constant", "small"}
    tie = frame(spark, "y int, s double", (1, 0.5), (1, 0.5), (2, None))
    assert [r["y"] for r in C.no_tie_at_top(tie, ["y"], "s").violations.collect()] == [1]
    assert C.matches_once(frame(spark, "k int", (1,), (2,), (9,)), df, ["k"]).violations.count() == 2
    with pytest.raises(C.ConstraintError):
        C.check_columns(df, ["k"])


def test_overlays_and_totals(spark):
    df = frame(spark, "year int, state string, c string, v long", (1, "A", "x", 3), (1, "B", "x", None))
    out = resolution.overlay_add(resolution.overlay_set(df, frame(spark, "state string, value long", ("A", 7)), ["state"], "v"), frame(spark, "state string, value long", ("B", 2)), ["state"], "v")
    assert sorted((r["state"] or "", r["v"]) for r in resolution.with_totals(out, ["year", "c"], ["v"]).collect()) == [("", 9), ("A", 7), ("B", 2)]


def test_record_to_facts(spark):
    record = (1900, [("Ann", "P")], ([("Ann", 0, "A"), ("Bea", 1, None)], [("A", 6, {0: 6, 1: 0}), ("Totals", 6, {0: 6, 1: 0})], []))
    years = spark.createDataFrame([record], YEAR_RECORD)
    assert sorted(tuple(r) for r in reshape.votes_fact(years).collect()) == [(1900, "A", "Ann", 6, 6), (1900, "A", "Bea", 6, 0)]
    assert reshape.candidate_parties(years).count() == 1


def test_text(spark):
    df = frame(spark, "s string", ("José  Núñez",), ("Iowa *",), ("(9)",), ("--",), ("1,234",), (None,))
    out = [tuple(r) for r in df.select(T.slug(F.col("s")), T.clean_label(F.col("s")), T.electoral_cell(F.col("s")), T.popular_cell(F.col("s"))).collect()]
    assert out[0][0] == "jose-nunez" and out[1][1] == "Iowa" and out[2][2] == 9 and out[3][3] is None and out[4][3] == 1234 and out[5] == (None,) * 4
    name = frame(spark, "s string", ("Robert M. La Follette, Jr.",)).select(*[v.alias(k) for k, v in T.name_parts(F.col("s")).items()]).head()
    assert tuple(name) == ("Robert", "M.", "La Follette", "Jr.")
    cases = {"Joseph R. Biden Jr.": ("Joseph", "R.", "Biden", "Jr."), "Hillary Clinton": ("Hillary", None, "Clinton", None), "Faith Spotted Eagle": ("Faith", "Spotted", "Eagle", None), "Cher": ("Cher", None, None, None)}
    for full, parts in cases.items():
        assert tuple(frame(spark, "s string", (full,)).select(*[v.alias(k) for k, v in T.name_parts(F.col("s")).items()]).head()) == parts
    cells = frame(spark, "s string", ("9)",), ("(9",), ("176 (175)",), ("-",), ("12",)).select(T.electoral_cell_is_bad(F.col("s")))
    assert [r[0] for r in cells.collect()] == [True, True, True, False, False]


def csv_line(state, name, party, writein, votes, total, simple):
    return f'2016,{state},XX,1,1,1,"US PRESIDENT",{name},{party},{writein},{votes},{total},20210113,,{simple}'


def test_fusion_csv(spark, tmp_path):
    lines = [
        csv_line("NORTH", '"ROE, ""RAY"" A."', "DEMOCRAT", "FALSE", 50, 100, "DEMOCRAT"), csv_line("NORTH", '"ROE, ""RAY"" A."', "WORKING", "FALSE", 5, 100, "OTHER"),
        csv_line("NORTH", '"DOE, ANN"', "REPUBLICAN", "FALSE", 30, 100, "REPUBLICAN"), csv_line("NORTH", "", "", "TRUE", 4, 100, "OTHER"), csv_line("NORTH", '"POE, P."', "GREEN", "FALSE", 11, 100, "OTHER"),
    ]
    (tmp_path / "votes.csv").write_text("\n".join([",".join(f'"{c}"' for c in CSV_COLUMNS), *lines]))
    raw = delimited.read_csv(spark, str(tmp_path / "votes.csv"))
    names = raw.select(F.col("candidate").alias("native"), F.col("candidate").alias("canonical")).where("native is not null").distinct()
    states = raw.select(F.col("state").alias("native"), F.initcap("state").alias("canonical")).distinct()
    got = {r["candidate"]: (r["state"], r["candidate_votes"], r["party"], r["state_total_votes"]) for r in delimited.popular_votes(raw, "CSV", states, names).collect()}
    assert got == {'ROE, "RAY" A.': ("North", 55, "DEMOCRAT", 100), "DOE, ANN": ("North", 30, "REPUBLICAN", 100)}
    with pytest.raises(C.ConstraintError):
        delimited.popular_votes(raw, "CSV", states.limit(0), names)
    with pytest.raises(C.ConstraintError):
        delimited.popular_votes(raw.withColumn("candidatevotes", F.lit("many")), "CSV", states, names)


PAGE = """<html><body><table><tr><td>menu</table>
<table><tr><td rowspan=3>STATE<td rowspan=3>TOTAL VOTE<td colspan=3>Red Party<td colspan=3>Blue Party</tr>
<tr><td colspan=3>Ann Doe<sup>1</sup></td><td colspan=3>Others</td></tr>
<tr><td>Votes<td>%<td>EV<td>Votes<td>%<td>EV</tr>
<tr><td>Alpha *</td><td>1,000</td><td>600</td><td>60.0%</td><td>3</td><td>400</td><td>40.0%</td><td>\u00a0</td></tr>
<tr><td>Beta</td><td>50</td><td>50</td><td>100.0</td><td>2</td><td>--</td><td>-</td><td>\u00a0</td></tr>
<tr><td colspan=8>Some words over the whole width</td></tr>
<tr><td>Gamma</td><td colspan=7>Electors were chosen by the legislature</td></tr>
<tr><td>Totals</td><td>1,050</td><td>{total}</td><td>61.9</td><td>5</td><td>400</td><td>38.1</td><td>0</td></tr>
</table></body></html>"""


def test_pages(spark):
    good = frame(spark, "page string, html string", ("1900", PAGE.format(total=650)), ("empty", "<p>nothing"), ("none", None))
    with pytest.raises(C.ConstraintError) as e:
        pages.popular_votes_of_pages(good)
    assert set(e.value.broken) == {"page_without_results"}
    votes, status = pages.popular_votes_of_pages(good, ["empty", "none"])
    assert sorted(tuple(r) for r in votes.select("label", "name", "total_votes", "votes", "percent").collect()) == [("Alpha", "Ann Doe", 1000, 600, 60.0), ("Beta", "Ann Doe", 50, 50, 100.0)]
    assert [(r["label"], r["pv_status"]) for r in status.collect()] == [("Gamma", "legislature_chosen")]
    names = {r["col_ind"]: (r["name"], r["party"], r["is_other"]) for r in pages.candidate_names(pages.result_rows(pages.page_rows(good))).collect()}
    assert names == {1: ("Ann Doe", "Red Party", False), 2: ("Others", "Blue Party", True)}
    with pytest.raises(C.ConstraintError) as e:
        pages.popular_votes_of_pages(frame(spark, "page string, html string", ("1900", PAGE.format(total=651))))
    assert set(e.value.broken) == {"totals_row_differs"}
    links = frame(spark, "html string", ('<a href="/elections/1900">x</a><a href="/elections/1901">y</a><a href="/about">z</a>',))
    assert [tuple(r) for r in pages.page_links(links, [1900]).collect()] == [(1900, "/elections/1900")]


def test_publish_and_read(spark, tmp_path):
    joined, roster = election(spark)
    codes = frame(spark, "state string, state_usps string", ("A", "AA"), ("B", "BB"))
    rows = publish.snapshot_rows(joined, roster, codes, ["S"])
    meta = publish.publish(spark, str(tmp_path), rows, "2000-01-01")
    assert publish.publish(spark, str(tmp_path), rows.repartition(5), "2000-01-02")["version"] == meta["version"]
    snap = Snapshot.open(spark, str(tmp_path))
    assert snap.meta["row_count"] == 4 and [tuple(r) for r in snap.years().collect()] == [(1900, 2, True)]
    found, summary = snap.election(1900, "aa")
    assert found.count() == 2 and [r["candidate_slug"] for r in summary.collect()] == ["ann", "bea"]
    assert snap.candidate("ANN").count() == 2 and snap.state("bb").count() == 2
    with pytest.raises(KeyError):
        snap.summary(1)
    with pytest.raises(ValueError):
        year_window(snap.rows, 2, 1)
    with pytest.raises(OverflowError):
        capped(snap.rows, 3)
    with pytest.raises(C.ConstraintError):
        publish.snapshot_rows(joined, roster, codes, ["other"])
