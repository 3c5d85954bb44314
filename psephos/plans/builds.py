"""The election build over files made of the driver's tables, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.build import Build
from psephos.plans import ballots as B
from psephos.plans import election, electoral
from psephos.plans.flows import LINES, PAGES, result_pages, written_lines
from psephos.plans.registry import query
from psephos.shared import new_path, stored

OFFICE = (1997, "Household J. Jr.")


def inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The segments are people; the last one stands in a column of several, which the catalog names and splits."""
    names, votes = B.candidates(spark, d), B.counted_votes(spark, d)
    last = names.agg(F.max("candidate_id").alias("last"))
    person = F.when(F.col("candidate_id") == F.col("last"), "Mia Rest").otherwise(F.concat(F.initcap("name"), F.lit(" J. Jr.")))
    people = stored(names.crossJoin(last).select("candidate_id", "last", F.col("name").alias("segment"), person.alias("person")), "people")
    years = votes.select("year").distinct()
    other = people.where("candidate_id = last")
    named = years.crossJoin(other).select("year", F.col("last").alias("col_ind"), F.col("person").alias("name"), F.lit("Restland").alias("home"))
    shares = votes.join(other.withColumnRenamed("segment", "candidate"), "candidate").select("year", "state", F.col("last").alias("col_ind"), F.col("candidate_votes").alias("votes"))
    lines, _ = written_lines(spark, d)
    # The unnamed column of the pages of votes is the segment itself.
    pages = stored(years.crossJoin(people).select("year", F.initcap("segment").alias("candidate"), F.col("person").alias("canonical")), "page-names")
    states = B.electors(spark, d).select("state")
    given = {
        "electoral_pages": electoral.printed(spark, d), "popular_pages": result_pages(spark, d), "popular_lines": lines, "states": states, "named": named, "shares": shares,
        "unprinted": spark.createDataFrame([], "year int, state string, name string, votes int"), "appointed": spark.createDataFrame([], "year int, state string, electors long"),
        "overrides": states.limit(0).select(F.lit(0).alias("year"), "state", F.lit("").alias("candidate"), F.lit("").alias("count_status"), F.lit("").alias("count_status_reason")),
        "office": spark.createDataFrame([OFFICE], "year int, office_holder string"), "line_states": states.select(F.col("state").alias("native"), F.col("state").alias("canonical")),
        "line_names": people.select(F.concat("segment", F.lit(', "A."')).alias("native"), F.col("person").alias("canonical")), "page_labels": states.select(F.col("state").alias("native"), F.col("state").alias("canonical")),
        "page_names": pages.where("candidate <> 'Furniture'"), "page_dropped": pages.where("candidate = 'Furniture'").select("year", "candidate"),
        "absences": spark.createDataFrame([], "year int, state string, note string"), "sources": spark.createDataFrame([("FILE", 1, True), ("PAGES", 2, False)], "source string, precedence_rank int, redistributable boolean"),
        "exempt": spark.createDataFrame([(1995, "Furniture J. Jr.")], "year int, candidate string"),
    }
    # The file's totals of 1995 are off: the pages stand in, but for the name they drop, which is exempt there.
    given["popular_lines"] = given["popular_lines"].where("year <> '1995'")
    return {name: stored(df, name) for name, df in given.items()}


BUILT = electoral.GRID + LINES[len(B.SQL) :].rsplit("\nselect 'FILE'", 1)[0] + PAGES[len(B.SQL) :] + f""", who as (select candidate, candidate_id as col_ind, case when candidate_id = (select max(candidate_id) from cand) then 'Mia Rest' else upper(candidate[1]) || lower(candidate[2:]) || ' J. Jr.' end as person from cand),
two_fold as (select 'FILE' as source, 1 as rank, year, state, split_part(candidate, ',', 1) as candidate, party, v as candidate_votes, total as state_total_votes from one where party in ('DEMOCRAT', 'REPUBLICAN') and year <> 1995
  union all select 'PAGES', 2, year, state, candidate, lower(candidate), candidate_votes, total from pv join whole using (year, state) where candidate <> 'FURNITURE'),
best as (select * from two_fold qualify row_number() over (partition by year, state, candidate order by rank) = 1),
natl as (select year, col_ind, sum(votes)::bigint as national_electoral_votes, dense_rank() over (partition by year order by sum(votes) desc)::int as president_electoral_rank from grid group by year, col_ind),
built as (select g.year, g.state, w.person as candidate, sum(g.votes) over (partition by g.year, g.state)::bigint as total_electoral_votes, g.votes as president_electoral_votes, n.national_electoral_votes, n.president_electoral_rank,
    case when g.year = {OFFICE[0]} then w.person = '{OFFICE[1]}' else n.president_electoral_rank = 1 end as took_office, b.source, b.party, b.candidate_votes::bigint as candidate_votes, b.state_total_votes::bigint as state_total_votes
  from grid g join who w using (col_ind) join natl n on n.year = g.year and n.col_ind = g.col_ind left join best b on b.year = g.year and b.state = g.state and b.candidate = g.candidate)
"""


def build(spark: SparkSession, d: str) -> Build:
    made = Build(spark, new_path(spark, "build"), inputs(spark, d))
    made.run(election.steps())
    return made


@query(BUILT + "select * from built")
def built_joined(spark: SparkSession, d: str) -> DataFrame:
    out = build(spark, d).tables["joined"]
    longs = ["total_electoral_votes", "president_electoral_votes"]
    return out.select("year", "state", "candidate", *[F.col(c).cast("long").alias(c) for c in longs], "national_electoral_votes", "president_electoral_rank", "took_office", "source", "party", "candidate_votes", "state_total_votes")
