"""Checked loads: rows are appended by their natural key to a table of numbered versions.

A version is a list of folders, named by a commit. An append writes its rows once, holds them against the table and the
relations they refer to, and commits; a reader of the version before is not disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from psephos.constraints import Constraint, ConstraintError, check, check_columns, not_null, references, unique
from psephos.operators import resolution
from psephos.sources import commits

#: Registered by build_views and join_views; read_view refuses other names.
SERIES = ["pv_union", "pv_preferred", "pv_redistributable"]
JOINED = ["ec_pv_preferred", "ec_pv_redistributable"]


@dataclass(frozen=True)
class Table:
    """A table of versions under root, with declared columns and the key that tells its rows apart."""

    spark: SparkSession
    root: str
    schema: StructType
    key: tuple[str, ...]

    def version(self) -> int:
        return commits.latest(self.spark, self.root)[0]

    def read(self) -> DataFrame:
        """The rows of the last version; none if nothing was loaded."""
        return self._rows(commits.latest(self.spark, self.root)[1].get("folders", []))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def load(self, rows: DataFrame, requires: Callable[[DataFrame], Sequence[Constraint]] = lambda new: [], replace: bool = False, after: int | None = None) -> dict:
        """Append the rows whose key the table lacks, or make them the whole table; {version, received, added}.

        Rows that the table has already are left out, so a repeated load adds nothing and makes no version. A null in the
        key, a key that comes twice, a key that the table has with other values, and what `requires` says of the rows stop
        the load before anything is committed. after: the version that the rows were made for (the last one, if not given);
        if the table has moved on by the time of the commit, StaleWriterError is raised and the table stays.
        """
        check_columns(rows, self.schema.names)
        seen, facts = commits.latest(self.spark, self.root)
        after = seen if after is None else after
        if after != seen:
            raise commits.StaleWriterError(f"{self.root} is at version {seen}, not {after}")
        told, folder = Observation(), f"{self.root}/data-{uuid.uuid4().hex}"
        # Counted as they are written: the rows are worked out once.
        rows.observe(told, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}-staged")
        new, old = self._rows([f"{folder}-staged"]), self._rows([] if replace else facts.get("folders", []))
        try:
            rest = [c for c in self.schema.names if c not in self.key]
            other = ~F.struct(*[F.col(f"new.{c}") for c in rest]).eqNullSafe(F.struct(*[F.col(f"old.{c}") for c in rest])) if rest else F.lit(False)
            met = new.alias("new").join(old.alias("old"), [F.col(f"new.{c}") == F.col(f"old.{c}") for c in self.key])
            check(not_null(new, self.key, "key_null"), unique(new, self.key, "key_twice"), Constraint("key_with_other_values", met.where(other).select("new.*")), *requires(new))
            fresh = new.join(old, list(self.key), "left_anti").select(*self.schema.names)
            fresh.repartitionByRange(*self.key).sortWithinPartitions(*self.key).write.parquet(folder)
            n = self._rows([folder]).count()
            if n or replace or not seen:
                folders = [folder] if replace else [*facts.get("folders", []), folder]
                seen = commits.commit(self.spark, self.root, after, {"folders": folders})
            else:
                commits.remove(self.spark, folder)
        except Exception:
            commits.remove(self.spark, folder)
            raise
        finally:
            commits.remove(self.spark, f"{folder}-staged")
        return {"version": seen, "received": told.get["n"], "added": n}


def build_views(facts: Table, sources: DataFrame) -> dict[str, DataFrame]:
    """The union and the two series resolved from it, also as temporary views, once facts were loaded and every source of
    theirs is described: what is not would go from both series without a word."""
    if not facts.version():
        raise ConstraintError({"facts_not_loaded": (1, facts.root)})
    union = facts.read()
    check(unique(sources, ["source"], "source_twice"), references(union, sources, ["source"], "source_not_described"))
    series = dict(zip(SERIES, (union, resolution.preferred(union, sources), resolution.redistributable(union, sources))))
    for name, df in series.items():
        df.createOrReplaceTempView(name)
    return series


def join_views(spark: SparkSession, votes: DataFrame, candidates: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Both resolved series on the spine, also as temporary views, after every popular vote has met its row of the spine: the
    join keeps the spine's rows only. The wider series is looked at; the other one is part of it."""
    for name in SERIES[1:]:
        if not spark.catalog.tableExists(name):
            raise ConstraintError({"series_missing": (1, name)})
    named = votes.where("state is not null").join(candidates.select("candidate_id", F.col("name").alias("candidate")), "candidate_id")
    check(references(spark.table(SERIES[1]), named, ["year", "state", "candidate"], "popular_votes_outside_spine"))
    out = {}
    for name, series in zip(JOINED, SERIES[1:]):
        out[name] = resolution.spine_join(votes, candidates, spark.table(series), sources)
        out[name].createOrReplaceTempView(name)
    return out


def read_view(spark: SparkSession, name: str, columns: Sequence[str] | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """One of the resolved views, by name; other names are refused, whatever tables there are."""
    if name not in SERIES + JOINED:
        raise ValueError(f"unknown view {name!r}; one of {SERIES + JOINED}")
    df = spark.table(name) if columns is None else spark.table(name).select(*columns)
    return df if years is None else df.where(F.col("year").isin(list(years)))


def read_roster(roster: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Status rows of these sources, so that a surface of some sources is measured by their states only."""
    return roster if sources is None else roster.where(F.col("source").isin(list(sources)))


def participation(votes: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """(year, state, is_total, total_electoral_votes) of the spine. is_total may be a boolean or 0 and 1; text is refused, as any
    text would count as true."""
    if dict(votes.dtypes)["is_total"] not in ("boolean", "tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"is_total is {dict(votes.dtypes)['is_total']}, neither boolean nor a number")
    rows = votes if years is None else votes.where(F.col("year").isin(list(years)))
    check(not_null(rows, ["is_total"], "is_total_null"))
    return rows.select("year", "state", F.col("is_total").cast("boolean").alias("is_total"), "total_electoral_votes")
