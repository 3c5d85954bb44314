"""Saved HTML pages of electoral votes: two tables a page, parsed to one nested record a year.

The first table names the winner and the main opponent with their parties in brackets. The second has a column for each
person voted for; how many is what its header says it spans, and where they begin differs between rows, as a totals row
may have its label in a header cell and then has one data cell less. As in pages.py only the markup is read in Python;
windows, kinds of rows, cells and the choice among several totals rows are expressions and joins over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.constraints import Constraint, check
from psephos.functions.text import clean_label, electoral_cell
from psephos.shared import stored
from psephos.sources.pages import page_rows

# Labels that the pages print.
ACROSS = "For President"
PARTY_ROWS = ["President", "Main Opponent"]
TOTALS = ["Total", "Totals"]
OTHERS = ["Other", "Others"]

TOTALS_STATE = "Totals"


def label(text: Column) -> Column:
    """clean_label without leading asterisks either."""
    return F.regexp_replace(clean_label(text), r"^[ *]+", "")


def _plain_name(text: Column) -> Column:
    return F.replace(label(text), F.lit(","), F.lit(""))


@dataclass(frozen=True)
class ElectoralPages:
    """parties (page, place, name, party); columns (page, col_ind, name, home), home null for a column of several people;
    rows (page, row_no, state, is_total, total_electoral_votes, cells), one totals row a page at most; contested (page,
    state, col_ind); and the constraints that the pages must keep."""

    parties: DataFrame
    columns: DataFrame
    rows: DataFrame
    contested: DataFrame
    constraints: list[Constraint]


def _tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[Constraint]]:
    """Rows of the first and of the second table of each page; the second with how many columns it has across."""
    head = rows.where("row_no = 0")
    span = F.filter("cells", lambda c: c["header"] & (label(c["text"]) == ACROSS))
    marked = head.where(F.size(span) > 0).select("page", "table_no", F.get(span, F.lit(0)).alias("across"))
    one = marked.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("table_no", "across")).alias("t"))
    votes = one.where("n = 1").select("page", F.col("t.table_no").alias("table_no"), F.col("t.across.span").alias("n_columns"), F.col("t.across.spanned").alias("spanned"))
    before = rows.select("page", "table_no").distinct().join(votes.select("page", F.col("table_no").alias("votes_no")), "page").where("table_no < votes_no")
    parties = before.groupBy("page").agg(F.max("table_no").alias("table_no"))
    pages = rows.select("page").distinct()
    broken = [
        Constraint("not_one_votes_table", pages.join(one, "page", "left").where("n is null or n > 1").select("page", "n")),
        Constraint("no_parties_table", votes.select("page").join(parties, "page", "left_anti")),
        Constraint("columns_without_span", votes.where("not spanned").select("page")),
    ]
    return rows.join(parties, ["page", "table_no"]), rows.join(votes.drop("spanned"), ["page", "table_no"]), broken


def _parties(rows: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """The cell reads Name [Party]."""
    headers, data = F.filter("cells", lambda c: c["header"]), F.filter("cells", lambda c: ~c["header"])
    told = rows.where(F.col("row_no") < len(PARTY_ROWS)).select("page", F.col("row_no").alias("place"), label(F.get(headers, F.lit(0))["text"]).alias("header"), F.get(data, F.lit(0))["text"].alias("text"))
    told = told.withColumn("parts", F.split(clean_label(F.col("text")), r" \["))
    wanted = F.element_at(F.array(*map(F.lit, PARTY_ROWS)), F.col("place") + 1)
    counted = told.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    broken = [
        Constraint("party_header_differs", told.where(~F.col("header").eqNullSafe(wanted)).select("page", "place", "header")),
        Constraint("party_cell_unreadable", told.where(~F.size("parts").eqNullSafe(2)).select("page", "place", "text")),
        Constraint("party_row_missing", counted.where(F.col("n") < len(PARTY_ROWS))),
    ]
    party = label(F.replace(F.get("parts", F.lit(1)), F.lit("]"), F.lit("")))
    return told.select("page", "place", _plain_name(F.get("parts", F.lit(0))).alias("name"), party.alias("party")), broken


def _columns(rows: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """Each cell of the second row reads Name, of State, or stands for several people."""
    data = F.slice(F.filter("cells", lambda c: ~c["header"]), F.lit(1), F.col("n_columns"))
    across = rows.where("row_no = 1").select("page", "n_columns", data.alias("data"))
    each = across.select("page", F.posexplode("data").alias("at", "cell")).select("page", (F.col("at") + 1).alias("col_ind"), label(F.col("cell.text")).alias("text"))
    parts, others = F.split("text", " of "), F.col("text").isin(*OTHERS)
    broken = [
        Constraint("columns_fewer_than_span", across.where("size(data) < n_columns").select("page", "n_columns", F.size("data").alias("found"))),
        Constraint("column_unreadable", each.where(~others & (F.size(parts) != 2)).select("page", "col_ind", "text")),
    ]
    name = F.when(others, F.col("text")).otherwise(_plain_name(F.get(parts, F.lit(0))))
    return each.select("page", "col_ind", name.alias("name"), F.when(~others, _plain_name(F.get(parts, F.lit(1)))).alias("home")), broken


def _vote_rows(rows: DataFrame, states: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """(page, row_no, state, is_total, total_electoral_votes, cells array<struct<col_ind, votes, contested>>) of state
    and totals rows. Rows whose first cell is neither a state's name nor a totals label are notes."""
    data = F.filter("cells", lambda c: ~c["header"])
    totals = F.filter("cells", lambda c: c["header"] & label(c["text"]).startswith(TOTALS[0]))
    told = rows.where("row_no > 1").select("page", "row_no", "n_columns", F.transform(data, lambda c: c["text"]).alias("data"), label(F.get(totals, F.lit(0))["text"]).alias("header"))
    told = told.withColumn("first", label(F.get("data", F.lit(0))))
    known = states.select(F.col("state").alias("first"), F.lit(True).alias("known")).distinct()
    told = told.join(known, "first", "left")
    in_cell = F.col("known").isNotNull() | F.col("first").isin(*TOTALS)
    kept = told.where(in_cell | F.col("header").isNotNull())
    # A label in a data cell shifts the window by one.
    window = F.slice("data", F.when(in_cell, 2).otherwise(1), F.col("n_columns") + 1)
    state = F.when(F.col("known").isNotNull(), F.col("first")).otherwise(TOTALS_STATE)
    kept = kept.select("page", "row_no", "n_columns", F.col("known").isNull().alias("is_total"), state.alias("state"), window.alias("window"))
    # In two steps: the cells are parsed once, in the struct.
    cell = lambda t, k: F.struct(k.alias("col_ind"), electoral_cell(t).alias("votes"), label(t).rlike(r"^\(\d+\)$").alias("contested"), t.alias("text"))
    read = kept.withColumn("cells", F.transform("window", cell))
    bad = read.select("page", "row_no", "state", F.explode("cells").alias("c")).where("c.votes is null").select("page", "row_no", "state", "c.col_ind", F.col("c.text").alias("text"))
    broken = [
        Constraint("row_width_differs", read.where("size(window) <> n_columns + 1").select("page", "row_no", "state", F.size("window").alias("found"))),
        Constraint("vote_cell_unreadable", bad),
    ]
    allotment = F.get("cells", F.lit(0))["votes"]
    return read.select("page", "row_no", "state", "is_total", allotment.alias("total_electoral_votes"), F.filter("cells", lambda c: c["col_ind"] > 0).alias("cells")), broken


def one_totals_row(rows: DataFrame, keys: list[str], whole: str, is_total: str = "is_total") -> tuple[DataFrame, Constraint]:
    """rows with at most one totals row for each key. A single one stays as it is; of several, the one whose `whole` is the
    sum over the other rows of its key. That none or more than one is says the constraint (keys, n_printed, n_matching, summed)."""
    totals, others = rows.where(F.col(is_total)), rows.where(~F.col(is_total))
    sums = others.groupBy(*keys).agg(F.sum(whole).alias("summed"))
    printed = totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_printed"))
    told = totals.join(printed, keys).join(sums, keys, "left").withColumn("matches", F.col("n_printed").eqNullSafe(1) | F.col(whole).eqNullSafe(F.col("summed")))
    several = told.where("n_printed > 1").groupBy(*keys).agg(F.max("n_printed").alias("n_printed"), F.sum(F.col("matches").cast("long")).alias("n_matching"), F.max("summed").alias("summed"))
    return others.unionByName(told.where("matches").select(*rows.columns)), Constraint("totals_row_undecided", several.where("n_matching <> 1"))


def electoral_pages(pages: DataFrame, states: DataFrame) -> ElectoralPages:
    """What the pages (page, html) say, unchecked. states (state): the labels that are states. Footnote marks go before
    anything is read. A page of null has no rows and so breaks no constraint: pages_without_results() is for these."""
    rows = stored(page_rows(pages), "electoral-rows")
    first, second, broken = _tables(rows)
    parties, of_parties = _parties(first)
    columns, of_columns = _columns(second)
    every, of_rows = _vote_rows(second, states)
    every = stored(every, "electoral-votes")
    chosen, undecided = one_totals_row(every, ["page"], "total_electoral_votes")
    contested = every.select("page", "state", F.explode("cells").alias("c")).where("c.contested").select("page", "state", "c.col_ind")
    return ElectoralPages(parties, columns, chosen, contested, [*broken, *of_parties, *of_columns, *of_rows, undecided])


def year_records(parsed: ElectoralPages) -> DataFrame:
    """(year, t1, t2): the pages, named by their years, as nested records; a record holds what one page does. Pages that break
    a constraint stop the build."""
    check(*parsed.constraints)
    t1 = parsed.parties.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "name", "party"))).alias("x"))
    t1 = t1.select("page", F.transform("x", lambda p: F.struct(p["name"].alias("president_candidate_name"), p["party"].alias("president_candidate_party"))).alias("t1"))
    across = parsed.columns.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("col_ind", "name", "home"))).alias("x"))
    across = across.select("page", F.transform("x", lambda c: F.struct(c["name"].alias("president_candidate_name"), c["col_ind"].alias("col_ind"), c["home"].alias("president_candidate_state"))).alias("candidate_state"))
    votes = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col_ind"], c["votes"])))
    rows = parsed.rows.select("page", F.struct("is_total", "row_no", "state", "total_electoral_votes", votes.alias("votes")).alias("r"))
    # Maps have no order, so rows are ordered by what stands before them.
    rows = rows.groupBy("page").agg(F.array_sort(F.collect_list("r"), lambda a, b: _before(a, b)).alias("x"))
    rows = rows.select("page", F.transform("x", lambda r: F.struct(r["state"].alias("state"), r["total_electoral_votes"].alias("total_electoral_votes"), r["votes"].alias("votes"))).alias("votes_by_state"))
    contested = parsed.contested.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("state", "col_ind"))).alias("contested_cells"))
    none = F.array().cast("array<struct<state:string,col_ind:int>>")
    every = t1.join(across, "page").join(rows, "page").join(contested, "page", "left")
    return every.select(F.col("page").try_cast("int").alias("year"), "t1", F.struct("candidate_state", "votes_by_state", F.coalesce("contested_cells", none).alias("contested_cells")).alias("t2"))


def _before(a: Column, b: Column) -> Column:
    """State rows as printed, the totals row last."""
    at = lambda r: r["is_total"].cast("long") * (1 << 32) + r["row_no"]
    return F.sign(at(a) - at(b)).cast("int")
