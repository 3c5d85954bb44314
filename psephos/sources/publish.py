"""Publishing a snapshot: staged tables, a version computed from their rows, and one commit, written last.

A reader follows the last commit, so it sees all tables of a version or none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from psephos.constraints import Constraint, check, in_domain, not_null, nothing_below_floor, redistributable_only, row_rule, unique
from psephos.functions.text import content_line, slug
from psephos.operators.measures import appointed_denominator, national_rollup
from psephos.operators.numbering import ordered_digest
from psephos.operators.resolution import with_status
from psephos.schemas import COUNT_STATUSES, PV_STATUSES, ROLLUP_COLUMNS, SNAPSHOT_COLUMNS
from psephos.sources import commits

SCHEMA_VERSION = 1


def content_version(df: DataFrame, columns: list[str], schema_version: int = SCHEMA_VERSION) -> DataFrame:
    """One row (n_rows, version): equal for equal rows whatever their order or partitions.

    Each row's SHA-256 is cut into four numbers that are summed, so rows never meet in one task; the sums, the row count and the
    schema version are hashed again.
    """
    digest = F.sha2(content_line(columns), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(4)]
    sums = df.select(*parts).agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"p{k}") for k in range(4)])
    return sums.select("n_rows", F.sha2(F.concat_ws(":", F.lit(f"schema={schema_version}"), F.col("n_rows").cast("string"), "p0", "p1", "p2", "p3"), 256).alias("version"))


def snapshot_rows(joined: DataFrame, status: DataFrame, codes: DataFrame, allowed: list[str]) -> DataFrame:
    """SNAPSHOT_COLUMNS of rows that may be passed on. codes: (state, state_usps)."""
    check(redistributable_only(joined, allowed))
    out = with_status(joined, status).join(codes.select("state", "state_usps"), "state", "left").withColumn("candidate_slug", slug(F.col("candidate")))
    clash = out.select("candidate", "candidate_slug").distinct().groupBy("candidate_slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or candidate_slug = ''")
    check(
        Constraint("slug_clash", clash), not_null(out, ["pv_status", "count_status"], "status_unknown"), in_domain(out, "pv_status", PV_STATUSES, "pv_status"),
        in_domain(out, "count_status", COUNT_STATUSES, "count_status"), unique(out, ["year", "state", "candidate_slug"], "snapshot_grain"),
    )
    return out.select(*SNAPSHOT_COLUMNS)


def snapshot_rollup(rows: DataFrame) -> DataFrame:
    """ROLLUP_COLUMNS, one row per (year, candidate_slug)."""
    carry = ["candidate", "party", "national_electoral_votes", "president_electoral_rank", "took_office", "national_counted_electoral_votes"]
    out = national_rollup(rows, ["year", "candidate_slug"], carry)
    return out.join(appointed_denominator(rows).withColumnRenamed("ec_denominator", "national_electoral_denominator"), "year", "left").select(*ROLLUP_COLUMNS)


def snapshot_constraints(rows: DataFrame, rollup: DataFrame, modern: int | None, floor: int | None) -> list[Constraint]:
    """No popular votes before the floor year, in rows or roll-up (where a 0 would be made up), and popular votes everywhere from the modern year on."""
    out = []
    if modern is not None:
        out.append(row_rule(rows.select("year", "state", "pv_status"), (F.col("year") < modern) | (F.col("pv_status") == "popular_vote"), "modern_year_without_popular_vote"))
    if floor is not None:
        out += [nothing_below_floor(rows.select("year", "state", "candidate_votes"), "candidate_votes", floor, "votes_below_floor"), nothing_below_floor(rollup, "national_pv_votes", floor, "national_votes_below_floor")]
    return out


def publish(spark: SparkSession, root: str, rows: DataFrame, built: str, modern: int | None = None, floor: int | None = None) -> dict:
    """Write rows and roll-up, look at what was written, and commit it as the next version that readers see.

    rows are worked out once: they are counted as they are written, and all that follows - order, roll-up, digest,
    constraints - reads what was written. Tables of a version that is there already stay as they are. A writer that
    another one overtook gets StaleWriterError, and readers keep the other one's.
    """
    number, _ = commits.latest(spark, root)
    staging, told = f"{root}/_staging-{uuid.uuid4().hex}", Observation()
    facts = [F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max")]
    try:
        rows.observe(told, *facts).write.parquet(f"{staging}/rows")
        once = spark.read.schema(rows.schema).parquet(f"{staging}/rows")
        once.repartitionByRange("year", "state").sortWithinPartitions("year", "state", "candidate_slug").write.parquet(f"{staging}/ec_pv")
        written = spark.read.schema(rows.schema).parquet(f"{staging}/ec_pv")
        snapshot_rollup(written).write.parquet(f"{staging}/national_rollup")
        rollup = spark.read.parquet(f"{staging}/national_rollup")
        check(*snapshot_constraints(written, rollup, modern, floor))
        n, version = ordered_digest(written, ["year", "state", "candidate_slug"], SNAPSHOT_COLUMNS, f"schema={SCHEMA_VERSION}\x1e")
        if n != told.get["n_rows"]:
            raise RuntimeError(f"{n} rows written of {told.get['n_rows']}")
        people = rollup.select("candidate_slug").distinct().count()
        for table in ("ec_pv", "national_rollup"):
            commits.moved_once(spark, f"{staging}/{table}", f"{root}/{version}/{table}")
        meta = told.get | {"row_count": n, "candidate_count": people, "version": version, "schema_version": SCHEMA_VERSION, "built": built}
        meta["commit"] = commits.commit(spark, root, number, meta)
    finally:
        commits.remove(spark, staging)
    return meta


def published(spark: SparkSession, root: str) -> dict:
    """What the last commit says; none, or a version of another schema, is an error."""
    number, meta = commits.latest(spark, root)
    if not number:
        raise FileNotFoundError(f"nothing is published under {root}")
    if meta["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"snapshot has schema version {meta['schema_version']}, expected {SCHEMA_VERSION}")
    return meta
