"""Nested records and wide tables to long rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """One row for each cell that is not null."""
    return df.unpivot(list(ids), list(values), name, value).where(F.col(value).isNotNull())


def candidate_columns(years: DataFrame) -> DataFrame:
    """(year, president_candidate_name, col_ind, president_candidate_state) of parsed year records."""
    return years.select("year", F.explode("t2.candidate_state").alias("c")).select("year", "c.*")


def candidate_parties(years: DataFrame) -> DataFrame:
    """(year, president_candidate_name, president_candidate_party) of parsed year records."""
    return years.select("year", F.explode("t1").alias("c")).select("year", "c.*")


def vote_cells(years: DataFrame) -> DataFrame:
    """(year, state, total_electoral_votes, col_ind, votes) of parsed year records: long, never widened."""
    rows = years.select("year", F.explode("t2.votes_by_state").alias("s"))
    return rows.select("year", "s.state", "s.total_electoral_votes", F.explode("s.votes").alias("col_ind", "votes")).where("votes is not null")


def votes_fact(years: DataFrame) -> DataFrame:
    """(year, state, candidate, total_electoral_votes, president_electoral_votes): the cells with the names of their columns."""
    named = candidate_columns(years).select("year", "col_ind", F.col("president_candidate_name").alias("candidate"))
    out = vote_cells(years).where("state <> 'Totals'").join(named, ["year", "col_ind"])
    return out.select("year", "state", "candidate", "total_electoral_votes", F.col("votes").alias("president_electoral_votes"))
