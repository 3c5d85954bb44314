"""Delimited results: read as text by a declared schema, then typed by rules that name what they cannot read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.constraints import Constraint, ConstraintError, check, check_not_empty, row_rule, sums_equal, sums_within, unique
from psephos.operators.measures import fusion_collapse
from psephos.schemas import CSV_COLUMNS, PV_COLUMNS

KEY = ["year", "state", "candidate"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text. A missing column is an error; further ones are left out; the empty field is null."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    missing = sorted(set(CSV_COLUMNS) - set(raw.columns))
    if missing:
        raise ConstraintError({"csv_columns": (len(missing), f"missing {missing}")})
    return raw.select(*CSV_COLUMNS)


def typed(raw: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """(rows with numbers typed, constraints that name rows whose numbers could not be read)."""
    numbers = {"year": "int", "candidatevotes": "long", "totalvotes": "long", "writein": "boolean"}
    out = raw.withColumns({c: F.trim(c).try_cast(kind) for c, kind in numbers.items()})
    return out, [row_rule(raw, F.trim(c).try_cast(kind).isNotNull(), f"unreadable_{c}") for c, kind in numbers.items()]


def popular_votes(raw: DataFrame, source: str, states: DataFrame, names: DataFrame, parties: Sequence[str] = ("DEMOCRAT", "REPUBLICAN"), years: Sequence[int] | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """The shared popular-vote shape (PV).

    Rows without a candidate belong to nobody and go; one of a major party that is no write-in stops the build. Lines of
    one candidate are added up before the party is looked at. states and names map (native, canonical); a name that they
    lack stops the build. With exceptions (year, state, difference) the lines of a state must add up to its total but for
    the difference named there; without, to no more than it.
    """
    rows, readable = typed(raw)
    if years is not None:
        rows = rows.where(F.col("year").isin(list(years)))
        check_not_empty(rows, "rows_in_years")
    lost = rows.where(F.col("candidate").isNull() & F.col("party_simplified").isin(*parties) & ~F.coalesce("writein", F.lit(False)))
    place = ["year", "state"]
    sums = sums_within(rows, place, "candidatevotes", "totalvotes") if exceptions is None else sums_equal(rows, place, "candidatevotes", "totalvotes", exceptions)
    check(*readable, Constraint("major_party_row_without_candidate", lost), sums)
    one = fusion_collapse(rows.where("candidate is not null"), KEY, "party_simplified", "candidatevotes", "totalvotes")
    scoped = one.where(F.col("party_simplified").isin(*parties))
    check(
        Constraint("state_unmapped", scoped.select("state").distinct().join(states.select(F.col("native").alias("state")), "state", "left_anti")),
        Constraint("name_unmapped", scoped.select("candidate").distinct().join(names.select(F.col("native").alias("candidate")), "candidate", "left_anti")),
    )
    mapped = scoped.join(states.select(F.col("native").alias("state"), F.col("canonical").alias("_state")), "state").join(names.select(F.col("native").alias("candidate"), F.col("canonical").alias("_name")), "candidate")
    out = mapped.select(
        F.lit(source).alias("source"), "year", F.col("_state").alias("state"), F.col("_name").alias("candidate"), F.col("party_simplified").alias("party"),
        F.col("candidatevotes").alias("candidate_votes"), F.col("totalvotes").alias("state_total_votes"), F.lit("exact").alias("reliability"),
    )
    check(unique(out, ["source", *KEY], "popular_vote_grain"))
    return out.select(*PV_COLUMNS)
