"""Which years there are and which of them a build takes; what catalogs must look like before they are used; what may be shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.constraints import Constraint, check, in_domain, references, row_rule, unique
from psephos.operators import resolution
from psephos.schemas import COUNT_STATUSES

# The first election, the first of the regular ones and the years between two of these.
FIRST, REGULAR, EVERY = 1789, 1792, 4


def election_years(spark: SparkSession, latest: int) -> DataFrame:
    """(year) of all elections up to `latest`, which need not be one; none before the first."""
    regular = spark.range(REGULAR, latest + 1, EVERY).select(F.col("id").cast("int").alias("year")) if latest >= REGULAR else spark.createDataFrame([], "year int")
    return regular.unionByName(spark.createDataFrame([(FIRST,)], "year int")) if latest >= FIRST else regular


def ingest_years(calendar: DataFrame, floor: int, gated: Sequence[int] = ()) -> DataFrame:
    """Years of the calendar from the floor on, without those that are shut out."""
    kept = calendar.where(F.col("year") >= floor)
    return kept.where(~F.col("year").isin(list(gated))) if gated else kept


def in_scope(df: DataFrame, years: DataFrame) -> tuple[DataFrame, Constraint]:
    """Rows of the years, and that every year has some: a missing one must not pass for one without votes."""
    return df.join(years, "year", "left_semi"), references(years, df, ["year"], "year_missing")


def check_statuses(values: Sequence[str], default: str, uncounted: Sequence[str]) -> None:
    """The statuses are the default one and the uncounted ones, each once: what counts follows from the first, what needs a
    reason from the second."""
    if sorted(values) != sorted([default, *uncounted]) or default in uncounted:
        raise ValueError(f"{list(values)} are not {default!r} and {list(uncounted)}")


def overrides_well_formed(overrides: DataFrame, statuses: Sequence[str] = COUNT_STATUSES, default: str = "counted", keys: Sequence[str] = ("year", "state", "candidate")) -> list[Constraint]:
    """Each override names a status there is, other than the default, which would change nothing, with a reason that says something; and no cell twice."""
    return [
        in_domain(overrides, "count_status", list(statuses), "override_status_unknown"),
        row_rule(overrides, F.col("count_status") != default, "override_changes_nothing"),
        row_rule(overrides, F.coalesce(F.length(F.trim("count_status_reason")), F.lit(0)) > 0, "override_without_reason"),
        unique(overrides, keys, "override_twice"),
    ]


def unprinted_are_uncounted(unprinted: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("year", "state", "candidate"), name: str = "unprinted_but_counted") -> Constraint:
    """Votes that a table leaves out did not enter the count, so each has an override; left alone they would raise a national sum."""
    return Constraint(name, unprinted.select(*keys).join(overrides, list(keys), "left_anti"))


def counted_within_cast(votes: DataFrame, name: str = "counted_beyond_cast") -> Constraint:
    """No row counts more votes than were cast."""
    return row_rule(votes, F.col("president_electoral_votes_counted") <= F.col("president_electoral_votes"), name)


def agreeing_roster(roster: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """(year, state, pv_status) of the sources that a surface is made of; sources that disagree stop what asks, as a coverage
    worked out from one of two answers would be arbitrary."""
    own = roster if sources is None else roster.where(F.col("source").isin(list(sources)))
    told = own.groupBy("year", "state").agg(F.min("pv_status").alias("pv_status"), F.max("pv_status").alias("other"))
    check(Constraint("sources_disagree", told.where("pv_status <> other")))
    return told.select("year", "state", "pv_status")


def licenses(rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, Constraint]:
    """(source, license, n_rows) of the sources whose rows are shown, and that each has a license. sources: (source, license)."""
    shown = rows.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    met = shown.join(sources.select("source", "license"), "source", "left").select("source", "license", "n_rows")
    return met, Constraint("source_without_license", met.where(F.coalesce(F.length(F.trim("license")), F.lit(0)) == 0).select("source"))


def public_roster(participation: DataFrame, absences: DataFrame, years: DataFrame) -> DataFrame:
    """(year, state, pv_status): the spine's states with the catalogued absences, without notes and sources, which may not be
    passed on. A year of the scope that the spine lacks, or an absence that is not in it, stops the build."""
    roster = resolution.roster(participation, absences, "catalog")
    check(references(years, roster, ["year"], "year_without_roster"), references(absences, roster, ["year", "state"], "absence_not_in_spine"), unique(roster, ["year", "state"], "roster_grain"))
    return roster.join(years, "year", "left_semi").select("year", "state", "pv_status")
