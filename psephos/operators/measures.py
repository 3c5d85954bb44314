"""Three national outcome methods: electoral share, popular-vote share, and their mean.

Unknown is never 0: a sum without a known term is null, and so is all that follows from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.schemas import MEASURE_COLUMNS, SUMMARY_COLUMNS

MISMATCHED, RESTRICTED = "mismatched", "restricted"


def appointed_denominator(joined: DataFrame) -> DataFrame:
    """(year, ec_denominator): electors appointed, each state once."""
    states = joined.groupBy("year", "state").agg(F.max("total_electoral_votes").alias("electors"))
    return states.groupBy("year").agg(F.sum("electors").alias("ec_denominator"))


def national_rollup(joined: DataFrame, key: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """key, carry, national_pv_votes, national_pv_denominator. carry holds columns that are constant within a key.

    The denominator is the sum of the states' totals, each state once; a state without one adds nothing.
    """
    sums = joined.groupBy(*key).agg(*[F.min(c).alias(c) for c in carry], F.sum("candidate_votes").alias("national_pv_votes"))
    states = joined.groupBy("year", "state").agg(F.max("state_total_votes").alias("total"))
    return sums.join(states.groupBy("year").agg(F.sum("total").alias("national_pv_denominator")), "year", "left")


def resolved_roster(roster: DataFrame) -> DataFrame:
    """(year, state, pv_status) over all sources; they must agree, which constraints.constant() tests."""
    return roster.groupBy("year", "state").agg(F.min("pv_status").alias("pv_status"))


def coverage(joined: DataFrame, roster: DataFrame) -> DataFrame:
    """(year, ec_denominator, covered_electoral_votes, pv_coverage).

    A year that the roster has no state of is unknown (null); one without a popular-vote state is covered by 0.
    """
    known = resolved_roster(roster)
    electors = joined.groupBy("year", "state").agg(F.max("total_electoral_votes").alias("electors"))
    met = electors.join(known, ["year", "state"], "left").groupBy("year").agg(
        F.sum("electors").alias("ec_denominator"), F.sum(F.when(F.col("pv_status") == "popular_vote", F.col("electors"))).alias("covered")
    )
    years = known.select("year").distinct().withColumn("_known", F.lit(True))
    out = met.join(years, "year", "left").withColumn("covered_electoral_votes", F.when(F.col("_known"), F.coalesce("covered", F.lit(0))))
    return out.select("year", "ec_denominator", "covered_electoral_votes", F.try_divide("covered_electoral_votes", "ec_denominator").alias("pv_coverage"))


def measures(joined: DataFrame, roster: DataFrame, policy: str = MISMATCHED) -> DataFrame:
    """MEASURE_COLUMNS, one row per (year, candidate_id).

    Under the policy restricted, the electoral share that goes into the mean counts popular-vote states only, above and
    below the line; under mismatched it is the full one.
    """
    if policy not in (MISMATCHED, RESTRICTED):
        raise ValueError(f"unknown coverage policy {policy!r}")
    carry = ["candidate", "party", "national_electoral_votes", "national_counted_electoral_votes", "president_electoral_rank", "took_office"]
    out = national_rollup(joined, ["year", "candidate_id"], carry).join(coverage(joined, roster), "year", "left")
    out = out.withColumn("ec_share_full", F.try_divide("national_counted_electoral_votes", "ec_denominator"))
    out = out.withColumn("pv_share", F.try_divide("national_pv_votes", "national_pv_denominator"))
    if policy == RESTRICTED:
        voted = resolved_roster(roster).where("pv_status = 'popular_vote'")
        inside = joined.join(voted, ["year", "state"], "left_semi").groupBy("year", "candidate_id").agg(F.sum("president_electoral_votes_counted").alias("_inside"))
        out = out.join(inside, ["year", "candidate_id"], "left").withColumn("ec_share_hybrid", F.try_divide("_inside", "covered_electoral_votes"))
    else:
        out = out.withColumn("ec_share_hybrid", F.col("ec_share_full"))
    return out.withColumn("hybrid_score", (F.col("ec_share_hybrid") + F.col("pv_share")) / 2).select(*MEASURE_COLUMNS)


def winner(score: str, name: str, tie: str) -> Column:
    """Aggregate: the name with the largest known score, ties to the smaller tie value; null if no score is known."""
    known = F.col(score).isNotNull()
    return F.min_by(F.when(known, F.col(name)), F.when(known, F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))))


def margin(score: str) -> Column:
    """Aggregate: the largest known score less the second, in points; null with fewer than two.

    A group holds the candidates of one election, so the list that is sorted is as short as the ballot.
    """
    top = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 2)
    return F.when(F.size(top) == 2, (F.get(top, F.lit(0)) - F.get(top, F.lit(1))) * 100)


def summary(scores: DataFrame, tie: str = "candidate_id") -> DataFrame:
    """SUMMARY_COLUMNS, one row per year; a winner that is unknown makes its flip unknown."""
    out = scores.groupBy("year").agg(
        F.min("ec_denominator").alias("ec_denominator"),
        winner("ec_share_full", "candidate", tie).alias("ec_winner"),
        winner("pv_share", "candidate", tie).alias("pv_winner"),
        winner("hybrid_score", "candidate", tie).alias("hybrid_winner"),
        (F.max("ec_share_full") > 0.5).alias("ec_determinative"),
        F.min("pv_coverage").alias("pv_coverage"),
        margin("ec_share_full").alias("ec_margin"),
        margin("pv_share").alias("pv_margin"),
        margin("hybrid_score").alias("hybrid_margin"),
    )
    out = out.withColumn("pv_flip", F.col("pv_winner") != F.col("ec_winner")).withColumn("hybrid_flip", F.col("hybrid_winner") != F.col("ec_winner"))
    return out.select(*SUMMARY_COLUMNS)


def electoral_rank(votes: DataFrame, measure: str = "president_electoral_votes_counted") -> DataFrame:
    """votes with president_electoral_rank: the dense rank of a candidate's national sum in its year, on every row.

    Ranked are the sums, one row for each candidate of a year, not the fact.
    """
    sums = votes.where(F.col("state").isNotNull()).groupBy("year", "candidate_id").agg(F.sum(measure).alias("_sum"))
    ranked = sums.withColumn("president_electoral_rank", F.dense_rank().over(Window.partitionBy("year").orderBy(F.desc("_sum")))).drop("_sum")
    return votes.drop("president_electoral_rank").join(ranked, ["year", "candidate_id"], "left")


def took_office(votes: DataFrame, overrides: DataFrame) -> DataFrame:
    """votes with took_office: the candidate that overrides (year, office_holder) names, else rank 1."""
    out = votes.join(overrides.select("year", "office_holder"), "year", "left")
    holds = F.when(F.col("office_holder").isNotNull(), F.col("candidate") == F.col("office_holder")).otherwise(F.col("president_electoral_rank") == 1)
    return out.withColumn("took_office", holds).drop("office_holder")


def with_counted(votes: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("year", "state", "candidate_id")) -> DataFrame:
    """State rows with count_status, its reason and the counted votes; overrides (keys, count_status, count_status_reason) name the exceptions."""
    out = votes.join(overrides.select(*keys, F.col("count_status").alias("_status"), F.col("count_status_reason").alias("_reason")), list(keys), "left")
    status = F.coalesce("_status", F.lit("counted"))
    counted = F.when(status == "counted", F.col("president_electoral_votes")).otherwise(0)
    return out.withColumns({"count_status": status, "count_status_reason": F.col("_reason"), "president_electoral_votes_counted": counted}).drop("_status", "_reason")


def fusion_collapse(lines: DataFrame, keys: Sequence[str], party: str, votes: str, total: str) -> DataFrame:
    """One row per key for candidates on several lines: votes summed, the party of the largest line that has one (ties by name)."""
    known = F.col(party).isNotNull()
    return lines.groupBy(*keys).agg(
        F.min_by(F.when(known, F.col(party)), F.when(known, F.struct((-F.col(votes)).alias("v"), F.col(party).alias("p")))).alias(party),
        F.sum(votes).alias(votes),
        F.max(total).alias(total),
    )
