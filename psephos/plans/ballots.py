"""The driver's tables read as an election: orders are votes, market segments candidates, nations states, suppliers electors.

A nation's electors go to the segment with the most orders. Nations of region 0 hold no popular vote; EXCLUDED votes are
cast but not counted; in OFFICE_YEAR somebody else than the first takes office.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.operators import measures as M
from psephos.operators import resolution as R
from psephos.shared import stored

EXCLUDED_YEAR, EXCLUDED_NATION = 1996, 3
OFFICE_YEAR, OFFICE_SEGMENT = 1998, "BUILDING"
SOURCES = [("ballots", 1, True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The first and the last year wanted, None where that end is open.
Years = tuple[int | None, int | None]


def orders_of(spark: SparkSession, sf_dir: str, years: Years = (None, None)) -> DataFrame:
    """Orders of these years, as a range of o_orderdate: a filter on year(o_orderdate) would not reach the Parquet scan."""
    orders, (first, last) = table(spark, sf_dir, "orders"), years
    if first is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(date(first, 1, 1)))
    if last is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(date(last + 1, 1, 1)))
    return orders


def popular(spark: SparkSession, sf_dir: str, years: Years = (None, None)) -> DataFrame:
    """(year, state, candidate, o_orderstatus, candidate_votes). Orders are counted by customer before they meet customers."""
    orders = orders_of(spark, sf_dir, years).groupBy(F.year("o_orderdate").alias("year"), "o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    met = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    named = met.groupBy("year", "c_nationkey", "c_mktsegment", "o_orderstatus").agg(F.sum("n").alias("candidate_votes"))
    named = named.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("year", F.col("n_name").alias("state"), F.col("c_mktsegment").alias("candidate"), "o_orderstatus", "candidate_votes")


def all_sources(votes: DataFrame) -> DataFrame:
    return votes.groupBy("year", "state", "candidate").agg(F.sum("candidate_votes").alias("candidate_votes"))


def electors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, n_nationkey, n_regionkey, electors): suppliers of each nation, 0 for one without."""
    held = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    met = table(spark, sf_dir, "nation").join(held, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return met.select(F.col("n_name").alias("state"), "n_nationkey", "n_regionkey", F.coalesce("n", F.lit(0)).alias("electors"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, name): numbered by name. There are as many as market segments, whatever the number of customers."""
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return names.withColumn("candidate_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name"))).select("candidate_id", "name")


def counted_votes(spark: SparkSession, sf_dir: str, years: Years = (None, None)) -> DataFrame:
    """(year, state, candidate, candidate_votes), counted once and written: orders are scanned for this alone, and all that
    follows reads years x nations x segments."""
    return stored(all_sources(popular(spark, sf_dir, years)), "votes")


def spine(spark: SparkSession, sf_dir: str, votes: DataFrame | None = None) -> DataFrame:
    """The dense votes fact: every segment in every nation and year, 0 where it won no electors."""
    votes = counted_votes(spark, sf_dir) if votes is None else votes
    names = candidates(spark, sf_dir)
    places = votes.select("year", "state").distinct().join(electors(spark, sf_dir), "state")
    # Dense by definition: years x nations x segments, all three of them small dimensions.
    dense = places.crossJoin(names.withColumnRenamed("name", "candidate")).join(votes, ["year", "state", "candidate"], "left")
    first = F.row_number().over(Window.partitionBy("year", "state").orderBy(F.desc_nulls_last("candidate_votes"), "candidate"))
    won = dense.withColumn("president_electoral_votes", F.when(first == 1, F.col("electors")).otherwise(F.lit(0).cast("long")))
    kept = won.select("year", "state", "candidate_id", "candidate", F.col("electors").alias("total_electoral_votes"), "president_electoral_votes")
    excluded = electors(spark, sf_dir).where(F.col("n_nationkey") == EXCLUDED_NATION).select("state").crossJoin(names)
    overrides = excluded.select(F.lit(EXCLUDED_YEAR).alias("year"), "state", "candidate_id", F.lit("not_counted").alias("count_status"), F.lit("excluded").alias("count_status_reason"))
    counted = M.electoral_rank(M.with_counted(kept, overrides))
    office = spark.createDataFrame([(OFFICE_YEAR, OFFICE_SEGMENT)], "year int, office_holder string")
    return M.took_office(counted, office).drop("candidate").withColumn("is_total", F.lit(False))


def resolved(spark: SparkSession, sf_dir: str, votes: DataFrame | None = None) -> DataFrame:
    """Popular votes in the shared shape, of nations that hold a vote."""
    held = electors(spark, sf_dir).where("n_regionkey <> 0").select("state")
    votes = (counted_votes(spark, sf_dir) if votes is None else votes).join(held, "state", "left_semi")
    totals = votes.groupBy("year", "state").agg(F.sum("candidate_votes").alias("state_total_votes"))
    return votes.join(totals, ["year", "state"]).select(
        F.lit("ballots").alias("source"), "year", "state", "candidate", F.lower("candidate").alias("party"), "candidate_votes", "state_total_votes", F.lit("exact").alias("reliability")
    )


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, precedence_rank int, redistributable boolean")


def joined(spark: SparkSession, sf_dir: str, votes: DataFrame | None = None, years: Years = (None, None)) -> DataFrame:
    """The joined view, written once, as the measures read it several times. No column of it looks beyond its year, so the
    view of some years is that of all, cut to them; years counts where votes are not given."""
    votes = counted_votes(spark, sf_dir, years) if votes is None else votes
    return stored(R.spine_join(spine(spark, sf_dir, votes), candidates(spark, sf_dir), resolved(spark, sf_dir, votes), sources(spark)), "joined")


def election(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(joined, roster) of the same count."""
    votes = counted_votes(spark, sf_dir)
    return joined(spark, sf_dir, votes), roster(spark, sf_dir, votes)


def roster(spark: SparkSession, sf_dir: str, votes: DataFrame | None = None) -> DataFrame:
    years = (table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")) if votes is None else votes.select("year")).distinct()
    places = electors(spark, sf_dir).crossJoin(years)
    absent = places.where("n_regionkey = 0").select("year", "state", F.lit("legislature_chosen").alias("pv_status"), F.lit("region 0").alias("note"))
    return R.roster(places.withColumn("is_total", F.lit(False)), absent, "ballots")


#: The same in SQL, as the beginning of a WITH clause; the last table is joined.
SQL = f"""
with byc as (select cast(year(o_orderdate) as int) as year, n_name as state, c_mktsegment as candidate, o_orderstatus, count(*)::bigint as candidate_votes
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
pv as (select year, state, candidate, sum(candidate_votes)::bigint as candidate_votes from byc group by all),
ev as (select n_name as state, n_nationkey, n_regionkey, count(s_suppkey)::bigint as electors from nation left join supplier on s_nationkey = n_nationkey group by all),
cand as (select candidate, cast(row_number() over (order by candidate) as int) as candidate_id from (select distinct c_mktsegment as candidate from customer)),
places as (select distinct year, state from pv),
dense as (select p.year, p.state, c.candidate_id, c.candidate, e.electors as total_electoral_votes, e.n_nationkey, e.n_regionkey,
    case when row_number() over (partition by p.year, p.state order by v.candidate_votes desc nulls last, c.candidate) = 1 then e.electors else 0 end::bigint as president_electoral_votes
  from places p cross join cand c join ev e using (state) left join pv v on v.year = p.year and v.state = p.state and v.candidate = c.candidate),
counted as (select *, case when year = {EXCLUDED_YEAR} and n_nationkey = {EXCLUDED_NATION} then 'not_counted' else 'counted' end as count_status,
    case when year = {EXCLUDED_YEAR} and n_nationkey = {EXCLUDED_NATION} then 'excluded' end as count_status_reason,
    case when year = {EXCLUDED_YEAR} and n_nationkey = {EXCLUDED_NATION} then 0 else president_electoral_votes end::bigint as president_electoral_votes_counted from dense),
nat as (select year, candidate_id, sum(president_electoral_votes)::bigint as national_electoral_votes, sum(president_electoral_votes_counted)::bigint as national_counted_electoral_votes
  from counted group by all),
ranked as (select *, cast(dense_rank() over (partition by year order by national_counted_electoral_votes desc) as int) as president_electoral_rank from nat),
res as (select year, state, candidate, candidate_votes, sum(candidate_votes) over (partition by year, state)::bigint as state_total_votes from pv join ev using (state) where n_regionkey <> 0),
joined as (select c.year, c.state, c.candidate_id, c.candidate, c.total_electoral_votes, c.president_electoral_votes, r.national_electoral_votes, r.president_electoral_rank,
    case when c.year = {OFFICE_YEAR} then c.candidate = '{OFFICE_SEGMENT}' else r.president_electoral_rank = 1 end as took_office,
    case when v.candidate_votes is not null then 'ballots' end as source, case when v.candidate_votes is not null then lower(c.candidate) end as party, v.candidate_votes, v.state_total_votes,
    case when v.candidate_votes is not null then 'exact' end as reliability, case when v.candidate_votes is not null then true end as redistributable,
    c.president_electoral_votes_counted, r.national_counted_electoral_votes, c.count_status, c.count_status_reason
  from counted c join ranked r using (year, candidate_id) left join res v on v.year = c.year and v.state = c.state and v.candidate = c.candidate),
roster as (select y.year, e.state, case when e.n_regionkey = 0 then 'legislature_chosen' else 'popular_vote' end as pv_status from ev e cross join (select distinct cast(year(o_orderdate) as int) as year from orders) y),
den as (select year, sum(electors)::bigint as ec_denominator from (select year, state, max(total_electoral_votes) as electors from joined group by all) group by all),
pvden as (select year, sum(total)::bigint as national_pv_denominator from (select year, state, max(state_total_votes) as total from joined group by all) group by all)
"""
#: Measures over joined and a roster table named in the braces.
SCORES_SQL = """
, cov as (select d.year, d.ec_denominator, case when d.year in (select year from {roster}) then coalesce(c.covered, 0) end::bigint as covered_electoral_votes
  from den d left join (select j.year, sum(j.electors) as covered from (select year, state, max(total_electoral_votes) as electors from joined group by all) j
    join {roster} r on r.year = j.year and r.state = j.state and r.pv_status = 'popular_vote' group by all) c on c.year = d.year),
rolled as (select year, candidate_id, min(candidate) as candidate, min(party) as party, min(national_electoral_votes) as national_electoral_votes,
    min(national_counted_electoral_votes) as national_counted_electoral_votes, min(president_electoral_rank) as president_electoral_rank, min(took_office) as took_office,
    sum(candidate_votes)::bigint as national_pv_votes from joined group by all),
inside as (select j.year, j.candidate_id, sum(j.president_electoral_votes_counted)::bigint as n from joined j join {roster} r on r.year = j.year and r.state = j.state and r.pv_status = 'popular_vote' group by all),
shares as (select x.year, x.candidate_id, candidate, party, national_electoral_votes, national_counted_electoral_votes, c.ec_denominator,
    national_counted_electoral_votes / nullif(c.ec_denominator, 0) as ec_share_full, national_pv_votes, p.national_pv_denominator, national_pv_votes / nullif(p.national_pv_denominator, 0) as pv_share,
    {share} as ec_share_hybrid, covered_electoral_votes / nullif(c.ec_denominator, 0) as pv_coverage, president_electoral_rank, took_office
  from rolled x join cov c using (year) join pvden p using (year) left join inside i on i.year = x.year and i.candidate_id = x.candidate_id),
scores as (select *, (ec_share_hybrid + pv_share) / 2 as hybrid_score from shares)
"""
FULL_SHARE = "national_counted_electoral_votes / nullif(c.ec_denominator, 0)"
RESTRICTED_SHARE = "i.n / nullif(covered_electoral_votes, 0)"
