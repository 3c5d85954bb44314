"""Corrections of printed electoral grids: catalogued, applied in order, and held against what was printed.

A grid is long: cells (year, state, col_ind, votes) and allotments (year, state, electors), both with the printed totals
row (state TOTALS), and columns (year, col_ind, name, home), where a column without a home is a placeholder for several
people. Nothing is changed in place, so the printed rows stay at hand: totals of what a correction touches are sums over
the states, and unreconciled() compares them with the printed ones, which are not made of the same data.

Catalogs are small and curated, and each is joined by its key; years that a grid does not have are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.constraints import Constraint, matches_once
from psephos.operators.resolution import overlay_set

TOTALS = "Totals"
CELL = ["year", "state", "col_ind"]


@dataclass(frozen=True)
class Catalog:
    """named (year, col_ind, name, home): who takes the placeholders' place; shares (year, state, col_ind, votes): what these
    got; unprinted (year, state, name, votes): votes told in prose only; appointed (year, state, electors): allotments that
    the table leaves out."""

    named: DataFrame
    shares: DataFrame
    unprinted: DataFrame
    appointed: DataFrame

    def of(self, years: DataFrame) -> Catalog:
        """What concerns the years in the one column year."""
        return Catalog(*[df.join(years, "year", "left_semi") for df in (self.named, self.shares, self.unprinted, self.appointed)])


def named_columns(columns: DataFrame, catalog: Catalog) -> DataFrame:
    """columns with the named people in place of placeholders, in the years that have one."""
    people, open_years = columns.where("home is not null"), columns.where("home is null").select("year").distinct()
    return people.unionByName(catalog.named.join(open_years, "year", "left_semi").select(*columns.columns))


def _added(columns: DataFrame, catalog: Catalog) -> DataFrame:
    """(year, state, col_ind, votes) of the votes told in prose, by name and never by position."""
    people = named_columns(columns, catalog).select("year", "name", "col_ind")
    return catalog.unprinted.join(people, ["year", "name"]).select(*CELL, "votes")


def corrected_cells(cells: DataFrame, allotments: DataFrame, columns: DataFrame, catalog: Catalog) -> DataFrame:
    """cells after the split of placeholders and then the votes told in prose, which a split would wipe out.

    A named column has a cell, 0 if nothing else, in every state of its year. Totals of other columns stay as printed.
    """
    catalog = catalog.of(allotments.select("year").distinct())
    places = allotments.where(F.col("state") != TOTALS).select("year", "state").distinct()
    split = catalog.named.select("year", "col_ind").distinct()
    gone = split.unionByName(columns.where("home is null").select("year", "col_ind")).distinct()
    kept = cells.where(F.col("state") != TOTALS).join(gone, ["year", "col_ind"], "left_anti").select(*CELL, "votes")
    empty = places.join(split, "year").select(*CELL, F.lit(0).alias("votes"))
    added = _added(columns, catalog)
    told = catalog.shares.select(*CELL, "votes").unionByName(added).join(places, ["year", "state"], "left_semi").select(*CELL, "votes")
    states = kept.unionByName(empty).unionByName(told).groupBy(*CELL).agg(F.sum("votes").alias("votes"))
    touched = split.unionByName(added.select("year", "col_ind")).distinct()
    sums = states.join(touched, ["year", "col_ind"], "left_semi").groupBy("year", "col_ind").agg(F.sum("votes").alias("votes"))
    printed = cells.where(F.col("state") == TOTALS).join(gone.unionByName(touched), ["year", "col_ind"], "left_anti")
    return states.unionByName(sums.select("year", F.lit(TOTALS).alias("state"), "col_ind", "votes")).unionByName(printed.select(*CELL, "votes"))


def corrected_allotments(allotments: DataFrame, catalog: Catalog) -> DataFrame:
    """allotments with the appointed electors; the totals of their years are sums over the states."""
    fixes = catalog.appointed.select("year", "state", F.col("electors").alias("value"))
    states = overlay_set(allotments.where(F.col("state") != TOTALS), fixes, ["year", "state"], "electors")
    touched = fixes.select("year").distinct()
    sums = states.join(touched, "year", "left_semi").groupBy("year").agg(F.sum("electors").alias("electors"))
    printed = allotments.where(F.col("state") == TOTALS).join(touched, "year", "left_anti")
    return states.unionByName(sums.withColumn("state", F.lit(TOTALS)).select(*states.columns)).unionByName(printed.select(*states.columns))


def unreconciled(cells: DataFrame, allotments: DataFrame, columns: DataFrame, catalog: Catalog) -> Constraint:
    """(year, rule, col_ind, printed, catalogued, corrected) where a corrected total is not the printed one and what the
    catalog adds. Rules: split (all placeholders of a year against all people named for them), unprinted (a column),
    appointed (the allotment of a year). cells and allotments are those before any correction."""
    catalog = catalog.of(allotments.select("year").distinct())
    printed = cells.where(F.col("state") == TOTALS).select("year", "col_ind", F.col("votes").alias("printed"))
    corrected = corrected_cells(cells, allotments, columns, catalog).where(F.col("state") == TOTALS).select("year", "col_ind", F.col("votes").alias("corrected"))
    none = F.lit(None).cast("int").alias("col_ind")

    def rows(found: DataFrame, rule: str, column=none) -> DataFrame:
        figures = [F.col(c).cast("long").alias(c) for c in ("printed", "catalogued", "corrected")]
        return found.select("year", F.lit(rule).alias("rule"), column, *figures)

    places = columns.where("home is null").select("year", "col_ind")
    lumped = places.join(printed, ["year", "col_ind"], "left").groupBy("year").agg(F.coalesce(F.sum("printed"), F.lit(0)).alias("printed"))
    people = catalog.named.select("year", "col_ind").distinct().join(corrected, ["year", "col_ind"]).groupBy("year").agg(F.sum("corrected").alias("corrected"))
    split = lumped.join(people, "year").withColumn("catalogued", F.lit(0))
    told = _added(columns, catalog).groupBy("year", "col_ind").agg(F.sum("votes").alias("catalogued"))
    unprinted = told.join(printed.where("printed is not null"), ["year", "col_ind"]).join(corrected, ["year", "col_ind"], "left")
    after = corrected_allotments(allotments, catalog).where(F.col("state") == TOTALS).select("year", F.col("electors").alias("corrected"))
    before = allotments.where(F.col("state") == TOTALS).select("year", F.col("electors").alias("printed")).where("printed is not null")
    appointed = catalog.appointed.groupBy("year").agg(F.sum("electors").alias("catalogued")).join(before, "year").join(after, "year", "left")
    every = rows(split, "split").unionByName(rows(unprinted, "unprinted", F.col("col_ind"))).unionByName(rows(appointed, "appointed"))
    return Constraint("corrections_reconcile", every.where("not (corrected <=> printed + catalogued)"))


def catalog_fits(allotments: DataFrame, columns: DataFrame, catalog: Catalog) -> list[Constraint]:
    """Every placeholder's year names people, every vote told in prose has its column, and what names a state hits one row."""
    catalog = catalog.of(allotments.select("year").distinct())
    states = allotments.where(F.col("state") != TOTALS)
    people = named_columns(columns, catalog)
    return [
        Constraint("placeholder_unnamed", columns.where("home is null").select("year", "col_ind").join(catalog.named, "year", "left_anti")),
        Constraint("unprinted_without_column", catalog.unprinted.join(people, ["year", "name"], "left_anti").select("year", "state", "name")),
        matches_once(catalog.shares, states, ["year", "state"], "shares_match_once"),
        matches_once(catalog.unprinted, states, ["year", "state"], "unprinted_match_once"),
        matches_once(catalog.appointed, states, ["year", "state"], "appointed_match_once"),
    ]
