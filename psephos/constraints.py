"""Constraints that stop a build: each is a DataFrame of violations, and check() runs many in one job.

A constraint never changes rows and never sits inside a query, where an optimizer might prune it. What comes to the
driver is one row for each broken constraint: how often it is broken, and the smallest example.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Broken constraints by name, each with its number of violations and an example."""

    def __init__(self, broken: dict[str, tuple[int, str]]):
        self.broken = broken
        super().__init__("; ".join(f"{name}: {n} violation(s), e.g. {row}" for name, (n, row) in sorted(broken.items())))


@dataclass(frozen=True)
class Constraint:
    name: str
    violations: DataFrame

    def labelled(self) -> DataFrame:
        return self.violations.select(F.lit(self.name).alias("constraint"), F.to_json(F.struct("*")).alias("row"))


def violations(constraints: Sequence[Constraint]) -> DataFrame:
    """(constraint, n_violations, example) of the broken ones."""
    every = reduce(DataFrame.unionByName, [c.labelled() for c in constraints])
    return every.groupBy("constraint").agg(F.count(F.lit(1)).alias("n_violations"), F.min("row").alias("example"))


def check(*constraints: Constraint) -> None:
    """Raise ConstraintError if any is broken."""
    if constraints:
        broken = {r["constraint"]: (r["n_violations"], r["example"]) for r in violations(constraints).collect()}
        if broken:
            raise ConstraintError(broken)


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """The frame has exactly these columns in this order."""
    if df.columns != list(columns):
        missing, extra = [c for c in columns if c not in df.columns], [c for c in df.columns if c not in columns]
        raise ConstraintError({"columns": (1, f"missing {missing}, unexpected {extra}, got {df.columns}")})


def check_not_empty(df: DataFrame, name: str) -> None:
    if df.isEmpty():
        raise ConstraintError({name: (1, "no rows")})


def unique(df: DataFrame, keys: Sequence[str], name: str = "unique") -> Constraint:
    """No two rows share a key; nulls are a value."""
    return Constraint(name, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"))


def not_null(df: DataFrame, columns: Sequence[str], name: str = "not_null") -> Constraint:
    return Constraint(name, df.where(reduce(Column.__or__, [F.col(c).isNull() for c in columns])))


def row_rule(df: DataFrame, holds: Column, name: str) -> Constraint:
    """Each row satisfies the predicate; unknown counts as satisfied, as in SQL's CHECK."""
    return Constraint(name, df.where(~F.coalesce(holds, F.lit(True))))


def in_domain(df: DataFrame, column: str, values: Sequence[str], name: str = "in_domain") -> Constraint:
    """The column holds one of the values; null does not."""
    return Constraint(name, df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))))


def references(child: DataFrame, parent: DataFrame, keys: Sequence[str], name: str = "references") -> Constraint:
    """Each key of child that has no null is a key of parent."""
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return Constraint(name, child.where(whole).select(*keys).distinct().join(parent.select(*keys), list(keys), "left_anti"))


def disjoint(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "disjoint") -> Constraint:
    """No key is in both."""
    return Constraint(name, left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_semi"))


def constant(df: DataFrame, keys: Sequence[str], column: str, name: str = "constant") -> Constraint:
    """The column has one value within a key; nulls are not looked at."""
    grouped = df.groupBy(*keys).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return Constraint(name, grouped.where("low <> high"))


def sums_equal(df: DataFrame, keys: Sequence[str], part: str, whole: str, exceptions: DataFrame | None = None, name: str = "sums_equal") -> Constraint:
    """The parts of a key add up to its whole, but for the signed difference that exceptions (keys, difference) name."""
    sums = df.groupBy(*keys).agg(F.coalesce(F.sum(part), F.lit(0)).alias("parts"), F.min(whole).alias("whole"), F.max(whole).alias("whole_high"))
    if exceptions is not None:
        sums = sums.join(exceptions.select(*keys, "difference"), list(keys), "left")
    else:
        sums = sums.withColumn("difference", F.lit(0))
    return Constraint(name, sums.where("whole is null or whole <> whole_high or whole - parts <> coalesce(difference, 0)"))


def sums_within(df: DataFrame, keys: Sequence[str], part: str, whole: str, name: str = "sums_within") -> Constraint:
    """The parts of a key add up to no more than its whole."""
    sums = df.groupBy(*keys).agg(F.sum(part).alias("parts"), F.max(whole).alias("whole"))
    return Constraint(name, sums.where("parts > whole"))


def totals_match(states: DataFrame, totals: DataFrame, keys: Sequence[str], measure: str, name: str = "totals_match") -> Constraint:
    """For each key the totals row says what the other rows add up to; a key on one side only is a violation."""
    left = states.groupBy(*keys).agg(F.sum(measure).alias("summed"))
    right = totals.groupBy(*keys).agg(F.sum(measure).alias("stated"))
    return Constraint(name, left.join(right, list(keys), "full").where("not (summed <=> stated)"))


def rectangular(df: DataFrame, group: Sequence[str], one: str, other: str, name: str = "rectangular") -> Constraint:
    """Within a group every value of one meets every value of the other exactly once."""
    cells = df.groupBy(*group, one, other).agg(F.count(F.lit(1)).alias("n"))
    sizes = cells.groupBy(*group).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.count_distinct(one).alias("n_one"), F.count_distinct(other).alias("n_other"))
    return Constraint(name, sizes.where("n_rows <> n_cells or n_cells <> n_one * n_other"))


def same_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "same_counts") -> Constraint:
    """Both have the same number of rows for each key."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    return Constraint(name, a.join(b, list(keys), "full").where("not (n_left <=> n_right)"))


def matches_once(overlay: DataFrame, base: DataFrame, keys: Sequence[str], name: str = "matches_once") -> Constraint:
    """Each key of a curated overlay hits exactly one row of base."""
    hits = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    return Constraint(name, overlay.select(*keys).join(hits, list(keys), "left").where("coalesce(hits, 0) <> 1"))


def no_tie_at_top(df: DataFrame, group: Sequence[str], score: str, name: str = "no_tie_at_top") -> Constraint:
    """The largest score of a group stands once; a group without a score is exempt."""
    counted = df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("n"))
    return Constraint(name, counted.groupBy(*group).agg(F.max(F.struct(score, "n")).alias("top")).where("top.n > 1"))


def shares_bounded(df: DataFrame, group: Sequence[str], share: str, slack: float = 1e-9, name: str = "shares_bounded") -> Constraint:
    """Shares of a group add up to at most 1."""
    return Constraint(name, df.groupBy(*group).agg(F.sum(share).alias("total")).where(F.col("total") > 1 + slack))


def status_has_reason(df: DataFrame, name: str = "status_has_reason") -> Constraint:
    """A row has a reason exactly if it is not counted; a blank reason is none."""
    reason = F.coalesce(F.length(F.trim("count_status_reason")), F.lit(0)) > 0
    return row_rule(df, (F.col("count_status") != "counted") == reason, name)


def counted_follows_status(df: DataFrame, name: str = "counted_follows_status") -> Constraint:
    """On state rows the counted votes are the cast ones if the status is counted, else 0."""
    want = F.when(F.col("count_status") == "counted", F.col("president_electoral_votes")).otherwise(0)
    return row_rule(df.where("not is_total"), F.col("president_electoral_votes_counted") == want, name)


def roster_covers_facts(roster: DataFrame, facts: DataFrame, keys: Sequence[str] = ("year", "state")) -> list[Constraint]:
    """Facts exist exactly for the roster's popular-vote keys, and no fact is outside the roster."""
    voted, absent = roster.where("pv_status = 'popular_vote'"), roster.where("pv_status <> 'popular_vote'")
    return [
        references(voted, facts, keys, "roster_without_facts"),
        disjoint(absent, facts, keys, "facts_where_none_were_held"),
        references(facts, roster, keys, "facts_outside_roster"),
    ]


def catalog_matches_spine(absences: DataFrame, spine: DataFrame) -> list[Constraint]:
    """Absence keys are in the spine; not participating means no electors, and the other way round."""
    allotted = spine.groupBy("year", "state").agg(F.max("total_electoral_votes").alias("electors"))
    met = absences.join(allotted, ["year", "state"])
    none = absences.where("pv_status = 'not_participating'")
    return [
        references(absences, allotted, ["year", "state"], "absence_not_in_spine"),
        row_rule(met, (F.col("pv_status") == "not_participating") == (F.col("electors") == 0), "absence_and_electors"),
        references(allotted.where("electors = 0"), none, ["year", "state"], "no_electors_uncatalogued"),
    ]


def redistributable_only(df: DataFrame, allowed: Sequence[str], name: str = "redistributable_only") -> Constraint:
    """No row that may not be passed on; a row without popular votes has neither source nor flag and passes."""
    bad = (F.col("redistributable") == F.lit(False)) | (F.col("source").isNotNull() & ~F.col("source").isin(*allowed))
    return Constraint(name, df.where(F.coalesce(bad, F.lit(False))))


def nothing_below_floor(df: DataFrame, measure: str, floor: int, name: str = "nothing_below_floor") -> Constraint:
    """Before the floor year the measure is unknown, not 0."""
    return Constraint(name, df.where((F.col("year") < floor) & F.col(measure).isNotNull()))


def _contested(df: DataFrame, years: Sequence[int] | None) -> DataFrame:
    """Rows with electoral votes in the years given or, without any, in those of which some popular vote is known."""
    won = df.where(F.col("president_electoral_votes") > 0)
    if years is not None:
        return won.where(F.col("year").isin(*years))
    return won.join(df.where(F.col("candidate_votes").isNotNull()).select("year").distinct(), "year", "left_semi")


def winners_have_votes(df: DataFrame, years: Sequence[int] | None = None, exemptions: DataFrame | None = None, name: str = "winners_have_votes") -> Constraint:
    """In these years whoever has electoral votes in a state has popular votes there, but for exemptions (year, candidate).

    Without years: those of which some popular vote is known.
    """
    missing = _contested(df, years).where(F.col("candidate_votes").isNull())
    return Constraint(name, missing if exemptions is None else missing.join(exemptions.select("year", "candidate"), ["year", "candidate"], "left_anti"))


def check_winners_inspected(df: DataFrame, at_least: int, years: Sequence[int] | None = None) -> int:
    """How many rows winners_have_votes looks at; too few would let it pass without having shown anything."""
    n = _contested(df, years).count()
    if n < at_least:
        raise ConstraintError({"winners_inspected": (1, f"{n} rows, at least {at_least} are asked for")})
    return n


def winner_is_first(summary: DataFrame, measures: DataFrame, name: str = "winner_is_first") -> Constraint:
    """The winner by electoral share is the candidate of rank 1."""
    first = measures.where("president_electoral_rank = 1").select("year", F.col("candidate").alias("first"))
    return Constraint(name, summary.join(first, "year").where("not (ec_winner <=> first)"))
