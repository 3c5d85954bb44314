"""The election build: from saved pages and a delimited file to the joined view, as steps that a Build runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.build import Step
from psephos.constraints import Constraint, disjoint, in_domain, references, status_has_reason, totals_match, unique
from psephos.functions.text import reliability
from psephos.operators import corrections as K
from psephos.operators import dimensions, measures, membership, reshape, resolution
from psephos.schemas import COUNT_STATUSES, PV_COLUMNS
from psephos.sources import delimited, electoral_pages, pages

#: What the build is given, with its columns.
INPUTS = {
    "electoral_pages": "page, html: the first page family, named by year",
    "popular_pages": "page, html: the second one",
    "popular_lines": "the delimited file as text",
    "states": "state",
    "named, shares, unprinted, appointed": "the catalog of corrections, see corrections.Catalog",
    "overrides": "year, state, candidate, count_status, count_status_reason",
    "office": "year, office_holder",
    "line_states, line_names": "native, canonical",
    "page_labels": "native, canonical: state labels of the pages",
    "page_names, page_dropped": "year, candidate, canonical and year, candidate",
    "absences": "year, state, note: states that took no part",
    "sources": "source, precedence_rank, redistributable",
    "exempt": "year, candidate: winners of electors without popular votes",
}
FILE, PAGES = "FILE", "PAGES"


def _grid(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, allotments, columns) as printed, the way corrections take them."""
    long = reshape.vote_cells(records)
    columns = reshape.candidate_columns(records).select("year", "col_ind", F.col("president_candidate_name").alias("name"), F.col("president_candidate_state").alias("home"))
    rows = records.select("year", F.explode("t2.votes_by_state").alias("s"))
    return long.select("year", "state", "col_ind", "votes"), rows.select("year", "s.state", F.col("s.total_electoral_votes").alias("electors")), columns


def corrected_grid(records: DataFrame, *catalog: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """(year, state, col_ind, votes, electors) after the catalogued corrections, and that these fit the pages and add up."""
    cells, allotments, columns = _grid(records)
    held = K.Catalog(*catalog)
    fixed = K.corrected_cells(cells, allotments, columns, held).join(K.corrected_allotments(allotments, held), ["year", "state"], "left")
    return fixed, [*K.catalog_fits(allotments, columns, held), K.unreconciled(cells, allotments, columns, held)]


def people(records: DataFrame, *catalog: DataFrame) -> DataFrame:
    return K.named_columns(_grid(records)[2], K.Catalog(*catalog))


def candidates(columns: DataFrame, records: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    parties = reshape.candidate_parties(records).select(F.col("president_candidate_name").alias("name"), F.col("president_candidate_party").alias("party"))
    return dimensions.candidate_dim(columns, parties)


def votes(grid: DataFrame, columns: DataFrame, people_dim: DataFrame, states: DataFrame, overrides: DataFrame, office: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """The votes fact with count status, counted votes, rank and office, numbered."""
    cells = grid.select("year", "state", F.col("electors").alias("total_electoral_votes"), "col_ind", "votes")
    fact, sound = dimensions.votes_fact(cells, columns, people_dim, states)
    named = fact.join(people_dim.select("candidate_id", F.col("name").alias("candidate")), "candidate_id")
    counted = measures.with_counted(named, overrides, ("year", "state", "candidate"))
    return measures.took_office(measures.electoral_rank(counted), office), [*sound, references(overrides, named, ["year", "state", "candidate"], "override_without_row")]


def votes_gates(rows: DataFrame, *needs: DataFrame) -> list[Constraint]:
    key = ["year", "candidate_id"]
    return [
        totals_match(rows.where("not is_total"), rows.where("is_total"), key, "president_electoral_votes"), status_has_reason(rows),
        in_domain(rows, "count_status", COUNT_STATUSES, "count_status"), unique(rows, ["votes_id"], "votes_id"),
    ]


def popular_of_pages(saved: DataFrame, labels: DataFrame, names: DataFrame, dropped: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """The shared popular-vote shape of the pages' rows, under canonical names and states."""
    found, _ = pages.popular_votes_of_pages(saved)
    native = found.withColumns({"year": F.col("page").try_cast("int"), "candidate": F.col("name")})
    placed = native.join(labels.select(F.col("native").alias("label"), F.col("canonical").alias("state")), "label")
    rows = membership.canonical_facts(placed, names).select(
        F.lit(PAGES).alias("source"), "year", "state", "candidate", "party", F.col("votes").alias("candidate_votes"), F.col("total_votes").alias("state_total_votes"),
        reliability(F.col("votes"), F.col("total_votes"), F.col("percent")).alias("reliability"),
    )
    return rows, [references(native.select(F.col("label").alias("native")), labels, ["native"], "label_unmapped"), membership.native_names_partition(native, names, dropped)]


def status_of_pages(saved: DataFrame, labels: DataFrame, absences: DataFrame, spine: DataFrame, facts: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """The status roster of the pages' years, and that nothing known of a state contradicts the rest."""
    _, told = pages.popular_votes_of_pages(saved)
    legislature = told.join(labels.select(F.col("native").alias("label"), F.col("canonical").alias("state")), "label").select(F.col("page").try_cast("int").alias("year"), "state", "note")
    part = spine.where("not is_total").select("year", "state", "total_electoral_votes")
    years = saved.select(F.col("page").try_cast("int").alias("year")).distinct()
    base = part.join(years, "year", "left_semi").select("year", "state").distinct()
    roster = membership.layered_status(base, {"not_participating": absences, "legislature_chosen": legislature}).withColumn("source", F.lit(PAGES))
    voting = facts.select("year", "state").distinct()
    clash = Constraint("status_contradictions", membership.status_contradictions(voting, legislature, absences, part))
    return roster.select("source", "year", "state", "pv_status", "note"), [clash, *membership.roster_constraints(roster, part, years)]


def joined(spine: DataFrame, people_dim: DataFrame, facts: DataFrame, sources: DataFrame, exempt: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """The joined view, after every popular vote has met its row of the spine and every winner of electors its popular votes."""
    named = spine.where("not is_total").join(people_dim.select("candidate_id", F.col("name").alias("person")), "candidate_id").withColumn("candidate", F.col("person"))
    resolved = resolution.preferred(facts, sources)
    getters = named.where("president_electoral_votes > 0").select("year", "candidate")
    out = resolution.spine_join(spine.drop("candidate"), people_dim, resolved, sources)
    return out, [references(resolved, named, ["year", "state", "candidate"], "popular_votes_outside_spine"), *membership.getters_complete(getters, exempt, facts, facts.select("year").distinct())]


def steps(parties: Sequence[str] = ("DEMOCRAT", "REPUBLICAN")) -> list[Step]:
    """The build from INPUTS, in order. parties: those of the delimited file whose lines count."""
    catalog = ("named", "shares", "unprinted", "appointed")
    return [
        Step("records", ("electoral_pages", "states"), lambda saved, states: electoral_pages.year_records(electoral_pages.electoral_pages(saved, states)), lambda rows, *_: [unique(rows.select("year"), ["year"], "year_with_two_pages")]),
        Step("grid", ("records", *catalog), corrected_grid),
        Step("columns", ("records", *catalog), people),
        Step("candidates", ("columns", "records"), candidates),
        Step("votes", ("grid", "columns", "candidates", "states", "overrides", "office"), votes, votes_gates),
        Step("file_votes", ("popular_lines", "line_states", "line_names"), lambda lines, states, names: delimited.popular_votes(lines, FILE, states, names, parties)),
        Step("page_votes", ("popular_pages", "page_labels", "page_names", "page_dropped"), popular_of_pages),
        Step("roster", ("popular_pages", "page_labels", "absences", "votes", "page_votes"), status_of_pages),
        Step("facts", ("file_votes", "page_votes", "sources"), lambda a, b, sources: a.select(*PV_COLUMNS).unionByName(b.select(*PV_COLUMNS)), lambda rows, a, b, sources: [unique(rows, ["source", "year", "state", "candidate"], "facts_grain"), references(rows, sources, ["source"], "source_not_described"), disjoint(rows.where("candidate_votes = 0"), rows, ["source", "year", "state", "candidate"], "votes_zero")]),
        Step("joined", ("votes", "candidates", "facts", "sources", "exempt"), joined),
    ]
