"""Scoped reads of a published snapshot; each is a filtered scan, ordered, and capped by an error rather than by a cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.sources.publish import published

# Fixed value: rows of one read above which it is refused.
MOST_ROWS = 5000


def year_window(df: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    if year_from is not None and year_to is not None and year_from > year_to:
        raise ValueError(f"year_from {year_from} is after year_to {year_to}")
    if year_from is not None:
        df = df.where(F.col("year") >= year_from)
    return df.where(F.col("year") <= year_to) if year_to is not None else df


def capped(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """All rows, or an error if there are more than most."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise OverflowError(f"more than {most} rows; narrow the request")
    return [r.asDict() for r in rows]


def bounded(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df, or an error if it has more rows than most; no more than that many are counted."""
    if df.limit(most + 1).count() > most:
        raise OverflowError(f"more than {most} rows; narrow the request")
    return df


def year_index(rollup: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """(year, n_candidates, has_popular_vote), by year."""
    grouped = year_window(rollup, year_from, year_to).groupBy("year")
    return grouped.agg(F.count(F.lit(1)).alias("n_candidates"), (F.count("national_pv_votes") > 0).alias("has_popular_vote")).orderBy("year")


@dataclass(frozen=True)
class Snapshot:
    """The tables of one published version."""

    meta: dict
    rows: DataFrame
    rollup: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Snapshot:
        meta = published(spark, root)
        place = f"{root}/{meta['version']}"
        return cls(meta, spark.read.parquet(f"{place}/ec_pv"), spark.read.parquet(f"{place}/national_rollup"))

    def _known(self, df: DataFrame, what: str) -> DataFrame:
        if df.isEmpty():
            raise KeyError(what)
        return df

    def years(self, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        return year_index(self.rollup, year_from, year_to)

    def summary(self, year: int) -> DataFrame:
        return self._known(self.rollup.where(F.col("year") == year), f"year {year}").orderBy("president_electoral_rank", "candidate_slug")

    def election(self, year: int, state: str | None = None, candidate: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, summary); the summary is not narrowed by state or candidate."""
        rows = self.rows.where(F.col("year") == year)
        if state is not None:
            rows = rows.where(F.col("state_usps") == state.upper())
        if candidate is not None:
            rows = rows.where(F.col("candidate_slug") == candidate.lower())
        return bounded(rows).orderBy("state", "candidate_slug"), self.summary(year)

    def state(self, usps: str, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        rows = self._known(self.rows.where(F.col("state_usps") == usps.upper()), f"state {usps}")
        return bounded(year_window(rows, year_from, year_to)).orderBy("year", "candidate_slug")

    def candidate(self, slug: str, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        rows = self._known(self.rows.where(F.col("candidate_slug") == slug.lower()), f"candidate {slug}")
        return bounded(year_window(rows, year_from, year_to)).orderBy("year", "state")
