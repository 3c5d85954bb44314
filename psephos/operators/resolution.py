"""Overlapping sources: union, precedence, and the join onto the dense spine.

Picking one row of a key is an aggregation of structs, so it combines before the shuffle and a hot key costs no sort.
Whether a small side is broadcast is left to Spark, which knows its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.schemas import JOINED_COLUMNS


def union_tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows of all frames, each with the name of its own in the column source."""
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(name)) for name, df in frames.items()])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of the rows of a key the first one by the order; columns stay as they are. A null in the order comes first."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("_first"))
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def preferred(union: DataFrame, sources: DataFrame, keys: Sequence[str] = ("year", "state", "candidate")) -> DataFrame:
    """Of each key the row of the source with the least rank; sources: (source, precedence_rank, ...)."""
    ranked = union.join(sources.select("source", "precedence_rank"), "source")
    return first_by(ranked, keys, [F.col("precedence_rank"), F.col("source")]).drop("precedence_rank").select(*union.columns)


def redistributable(union: DataFrame, sources: DataFrame, keys: Sequence[str] = ("year", "state", "candidate")) -> DataFrame:
    """preferred() among the sources that may be passed on: these are filtered before, not after, one is picked."""
    return preferred(union, sources.where("redistributable"), keys)


def single_source(union: DataFrame, source: str) -> DataFrame:
    return union.where(F.col("source") == source)


def spine_join(votes: DataFrame, candidates: DataFrame, resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """Every state row of the spine with its candidate, its popular votes if any, and the national sums of electoral votes.

    A loser's row stays, with electoral votes 0; a row without popular votes has nulls there, never 0.
    """
    states = votes.where(F.col("state").isNotNull())
    national = states.groupBy("year", "candidate_id").agg(
        F.sum("president_electoral_votes").alias("national_electoral_votes"),
        F.sum("president_electoral_votes_counted").alias("national_counted_electoral_votes"),
    )
    named = states.join(candidates.select("candidate_id", F.col("name").alias("candidate")), "candidate_id").join(national, ["year", "candidate_id"])
    found = named.join(resolved, ["year", "state", "candidate"], "left").join(sources.select("source", "redistributable"), "source", "left")
    return found.select(*JOINED_COLUMNS)


def electoral_getters(votes: DataFrame, candidates: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """(year, candidate, president_electoral_votes) of the totals rows, which have one row for a year and candidate."""
    totals = votes.where("is_total") if years is None else votes.where(F.col("is_total") & F.col("year").isin(*years))
    return totals.join(candidates.select("candidate_id", F.col("name").alias("candidate")), "candidate_id").select("year", "candidate", "president_electoral_votes")


def overlay_set(df: DataFrame, overlay: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Values that the overlay (keys, value) names replace those of the column."""
    out = df.join(overlay.select(*keys, F.col("value").alias("_value")), list(keys), "left")
    return out.withColumn(column, F.coalesce("_value", column)).select(*df.columns)


def overlay_add(df: DataFrame, overlay: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Amounts that the overlay (keys, value) names are added to the column; the overlay may name a key repeatedly."""
    sums = overlay.groupBy(*keys).agg(F.sum("value").alias("_value"))
    out = df.join(sums, list(keys), "left")
    return out.withColumn(column, F.when(F.col("_value").isNull(), F.col(column)).otherwise(F.coalesce(column, F.lit(0)) + F.col("_value"))).select(*df.columns)


def replace_rows(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key stands in rows go and rows come: placeholders become named rows."""
    return df.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(*df.columns).unionByName(rows.select(*df.columns))


def with_totals(states: DataFrame, keys: Sequence[str], measures: Sequence[str], place: str = "state") -> DataFrame:
    """The rows, and for each key one more, without a place, with the sums of the measures: totals are derived, never edited."""
    totals = states.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    return states.withColumn("is_total", F.lit(False)).unionByName(totals.withColumns({place: F.lit(None).cast("string"), "is_total": F.lit(True)}), allowMissingColumns=True)


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, order: str, most: int = 2) -> DataFrame:
    """keys, value_1 .. value_most, n_values: the distinct values of a key by first appearance. Nulls are no values.

    A value is first reduced to its least place, so what a key gathers is its distinct values only, of which the first few
    are kept; n_values says if there were more.
    """
    firsts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    gathered = firsts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", value))).alias("_all"))
    columns = [F.get("_all", F.lit(k))[value].alias(f"{value}_{k + 1}") for k in range(most)]
    return gathered.select(*keys, *columns, F.size("_all").alias("n_values"))


def roster(participation: DataFrame, absences: DataFrame, source: str) -> DataFrame:
    """(source, year, state, pv_status, note): the catalogued absence of a participating state, else popular_vote."""
    keys = participation.where("not is_total").select("year", "state").distinct()
    met = keys.join(absences.select("year", "state", "pv_status", "note"), ["year", "state"], "left")
    return met.select(F.lit(source).alias("source"), "year", "state", F.coalesce("pv_status", F.lit("popular_vote")).alias("pv_status"), "note")


def with_status(facts: DataFrame, status: DataFrame) -> DataFrame:
    """Facts with pv_status; status has one row for a (year, state)."""
    return facts.join(status.select("year", "state", "pv_status"), ["year", "state"], "left").select(*facts.columns, "pv_status")
