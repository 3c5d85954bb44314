"""Corrections of a printed grid: order, derived totals, and the comparison with what was printed."""

from __future__ import annotations

import pytest

from psephos import constraints as C
from psephos.operators import corrections as K


def grid(spark, *, share=4, printed=10):
    """1872: column 1 is Ann's, column 2 a placeholder whose 10 votes go to Bea (2) and Cy (3); Dee (4) has none printed."""
    make = spark.createDataFrame
    cells = make([(1872, "A", 1, 6), (1872, "A", 2, 3), (1872, "B", 2, 7), (1872, "B", 4, 0), (1872, "Totals", 1, 6), (1872, "Totals", 2, printed), (1872, "Totals", 4, 0), (1876, "A", 1, 9), (1876, "Totals", 1, 9)], "year int, state string, col_ind int, votes int")
    allotments = make([(1872, "A", 9), (1872, "B", 10), (1872, "C", 0), (1872, "Totals", 19), (1876, "A", 9), (1876, "Totals", 9)], "year int, state string, electors int")
    columns = make([(1872, 1, "Ann", "A"), (1872, 2, "Others", None), (1872, 4, "Dee", "B"), (1876, 1, "Ann", "A")], "year int, col_ind int, name string, home string")
    catalog = K.Catalog(
        make([(1872, 2, "Bea", "A"), (1872, 3, "Cy", "B"), (2016, 2, "Eve", "A")], "year int, col_ind int, name string, home string"),
        make([(1872, "A", 2, 3), (1872, "B", 2, 3), (1872, "B", 3, share)], "year int, state string, col_ind int, votes int"),
        make([(1872, "B", "Dee", 3), (1872, "C", "Ann", 8)], "year int, state string, name string, votes int"),
        make([(1872, "C", 8)], "year int, state string, electors int"),
    )
    return cells, allotments, columns, catalog


def test_corrected_grid(spark):
    cells, allotments, columns, catalog = grid(spark)
    got = {(r["year"], r["state"], r["col_ind"]): r["votes"] for r in K.corrected_cells(cells, allotments, columns, catalog).collect()}
    assert got == {
        (1872, "A", 1): 6, (1872, "C", 1): 8, (1872, "Totals", 1): 14, (1872, "A", 2): 3, (1872, "B", 2): 3, (1872, "C", 2): 0, (1872, "Totals", 2): 6,
        (1872, "A", 3): 0, (1872, "B", 3): 4, (1872, "C", 3): 0, (1872, "Totals", 3): 4, (1872, "B", 4): 3, (1872, "Totals", 4): 3, (1876, "A", 1): 9, (1876, "Totals", 1): 9,
    }
    electors = {(r["year"], r["state"]): r["electors"] for r in K.corrected_allotments(allotments, catalog).collect()}
    assert electors == {(1872, "A"): 9, (1872, "B"): 10, (1872, "C"): 8, (1872, "Totals"): 27, (1876, "A"): 9, (1876, "Totals"): 9}
    names = {(r["year"], r["col_ind"]): r["name"] for r in K.named_columns(columns, catalog).collect()}
    assert names == {(1872, 1): "Ann", (1872, 2): "Bea", (1872, 3): "Cy", (1872, 4): "Dee", (1876, 1): "Ann"}
    C.check(K.unreconciled(cells, allotments, columns, catalog), *K.catalog_fits(allotments, columns, catalog))


def test_a_split_that_loses_votes_or_a_moved_total_is_told(spark):
    cells, allotments, columns, catalog = grid(spark, share=2)
    assert [tuple(r) for r in K.unreconciled(cells, allotments, columns, catalog).violations.collect()] == [(1872, "split", None, 10, 0, 8)]
    moved = allotments.replace({19: 20}, subset=["electors"])
    cells, _, columns, catalog = grid(spark)
    assert [tuple(r) for r in K.unreconciled(cells, moved, columns, catalog).violations.collect()] == [(1872, "appointed", None, 20, 8, 27)]


def test_a_catalog_that_does_not_fit_is_told(spark):
    _, allotments, columns, catalog = grid(spark)
    make = spark.createDataFrame
    wrong = K.Catalog(catalog.named.where("year = 2016"), catalog.shares.where("votes < 0"), make([(1872, "B", "Bea", 1), (1872, "X", "Ann", 1)], "year int, state string, name string, votes int"), make([(1872, "Y", 1)], "year int, state string, electors int"))
    broken = {r["constraint"]: r["n_violations"] for r in C.violations(K.catalog_fits(allotments, columns, wrong)).collect()}
    assert broken == {"placeholder_unnamed": 1, "unprinted_without_column": 1, "unprinted_match_once": 1, "appointed_match_once": 1}


def test_winners_without_votes_are_told_but_for_the_exempt(spark):
    rows = [(1900, "A", "Ann", 3, 10), (1900, "B", "Bea", 2, None), (1900, "B", "Ann", 0, None), (1900, "C", "Cy", 1, None), (1796, "A", "Dee", 5, None)]
    df = spark.createDataFrame(rows, "year int, state string, candidate string, president_electoral_votes int, candidate_votes int")
    exempt = spark.createDataFrame([(1900, "Cy"), (1904, "Bea")], "year int, candidate string")
    assert [r["candidate"] for r in C.winners_have_votes(df, exemptions=exempt).violations.collect()] == ["Bea"]
    assert {r["candidate"] for r in C.winners_have_votes(df, [1796, 1900]).violations.collect()} == {"Bea", "Cy", "Dee"}
    assert C.check_winners_inspected(df, 3) == 3
    with pytest.raises(C.ConstraintError):
        C.check_winners_inspected(df, 4)
