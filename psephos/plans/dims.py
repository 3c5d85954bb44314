"""Dimensions, dense ids and the ordered digest as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import constraints as C
from psephos.operators import dimensions as D
from psephos.operators import numbering, reshape
from psephos.plans import ballots as B
from psephos.plans import electoral
from psephos.plans.registry import query
from psephos.sources.electoral_pages import year_records


@query("select row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey)::bigint as id, c_custkey from customer")
def customer_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")
    return numbering.dense_ids(rows, ["c_mktsegment", F.desc("c_acctbal"), "c_custkey"]).select("id", "c_custkey")


@query("""with n as (select row_number() over (order by o_orderdate, o_orderkey) - 1 as k, concat_ws(chr(31), o_orderkey::varchar, o_orderstatus, coalesce(nullif(o_orderpriority, '1-URGENT'), '')) || chr(30) as line from orders),
c as (select k // 4096 as chunk, sha256(string_agg(line, '' order by k)) as h from n group by all)
select (select count(*) from n)::bigint as n_rows, sha256('schema=1' || chr(30) || case when (select count(*) from c) = 1 then (select h from c) else sha256((select string_agg(h, '' order by chunk) from c)) end) as digest""")
def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_orderstatus", F.expr("nullif(o_orderpriority, '1-URGENT')").alias("o_orderpriority"))
    found = numbering.ordered_digest(rows, ["o_orderdate"], ["o_orderkey", "o_orderstatus", "o_orderpriority"], "schema=1\x1e")
    return spark.createDataFrame([found], "n_rows long, digest string")


# --- several values of a key ---

VALUES = "with v as (select c_nationkey, c_mktsegment, min(c_custkey) as first_key from customer where c_acctbal > 5000 group by all), k as (select *, row_number() over (partition by c_nationkey order by first_key) as k from v) "


def rich(spark: SparkSession, d: str) -> DataFrame:
    """Customers; the segment of a poor one is unknown."""
    return B.table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("segment"))


@query(VALUES + "select c.c_nationkey, max(case when k = 1 then c_mktsegment end) as segment, max(case when k = 2 then c_mktsegment end) as segment_2 from (select distinct c_nationkey from customer) c left join k using (c_nationkey) group by all")
def first_two_values(spark: SparkSession, d: str) -> DataFrame:
    return D.collapsed(rich(spark, d), ["c_nationkey"], "segment", 2, "c_custkey")[0]


@query(VALUES + "select c_nationkey, count(*) as n_values from v group by all having count(*) > 2")
def more_than_two_values(spark: SparkSession, d: str) -> DataFrame:
    return D.collapsed(rich(spark, d), ["c_nationkey"], "segment", 2, "c_custkey")[1].violations


@query(VALUES + "select c.c_nationkey, string_agg(c_mktsegment, '/' order by k) as segment from (select distinct c_nationkey from customer) c left join k using (c_nationkey) group by all")
def values_in_one_text(spark: SparkSession, d: str) -> DataFrame:
    return D.joined_values(rich(spark, d), ["c_nationkey"], "segment", "/", 5, "c_custkey")[0]


@query(VALUES + "select c_nationkey, c_mktsegment as segment from v where c_mktsegment like '%ILD%'")
def delimiter_in_values(spark: SparkSession, d: str) -> DataFrame:
    return D.joined_values(rich(spark, d), ["c_nationkey"], "segment", "ILD", 5, "c_custkey")[1][1].violations


# --- dimensions ---


def people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(columns, parties): nations as people, whose homes are up to two regions and whose parties two segments, one respelled."""
    nation = B.table(spark, d, "nation").withColumn("name", F.concat("n_name", F.lit(" Lee")))
    home = nation.select(F.lit(1996).alias("year"), "name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("home"))
    later = nation.where("n_nationkey % 3 = 0").select(F.lit(1990).alias("year"), "name", F.lit("A0").alias("home"))
    none = nation.where("n_nationkey % 4 = 0").select(F.lit(1980).alias("year"), "name", F.lit(None).cast("string").alias("home"))
    party = nation.where("n_nationkey % 5 <> 0").select("name", F.lit("Blue").alias("party"))
    second = nation.where("n_nationkey % 2 = 0").select("name", F.when(F.col("n_nationkey") % 3 == 0, "BLUE").otherwise("Amber").alias("party"))
    return home.unionByName(later).unionByName(none), party.unionByName(second)


DIM = """with n as (select n_nationkey as k, n_regionkey as r, n_name || ' Lee' as name, n_name as first from nation),
p as (select name, 'Blue' as party from n where k % 5 <> 0 union select name, case when k % 3 = 0 then 'Blue' else 'Amber' end from n where k % 2 = 0),
q as (select name, min(party) as party, case when count(*) > 1 then max(party) end as party_2 from p group by all)
select row_number() over (order by name)::int as candidate_id, name, first as name_first, null::varchar as name_middle, 'Lee' as name_last, null::varchar as name_suffix,
  case when k % 3 = 0 then 'A0' else 'R' || r end as state, case when k % 3 = 0 then 'R' || r end as state_2, party, party_2 from n left join q using (name)"""


@query(DIM)
def candidate_dimension(spark: SparkSession, d: str) -> DataFrame:
    columns, parties = people(spark, d)
    out, constraints = D.candidate_dim(columns, parties, party_fixes=spark.createDataFrame([("BLUE", "Blue")], "native string, canonical string"))
    C.check(*constraints)
    return out


@query("""select 'more_than_2_of_state' as "constraint", count(*) as n_violations from nation where n_nationkey % 3 = 0 having count(*) > 0 union all select 'more_than_2_of_party', count(*) from nation where n_nationkey % 5 <> 0 and n_nationkey % 2 = 0
union all select 'party_without_candidate', 1""")
def candidate_dimension_broken(spark: SparkSession, d: str) -> DataFrame:
    columns, parties = people(spark, d)
    third = columns.where("year = 1990").withColumns({"year": F.lit(2000), "home": F.lit("Z9")})
    more = parties.where("party <> 'Blue'").withColumn("party", F.lit("Coral"))
    ghost = spark.createDataFrame([("Ghost", "Grey")], "name string, party string")
    return C.violations(D.candidate_dim(columns.unionByName(third), parties.unionByName(more).unionByName(ghost))[1]).drop("example")


@query("select n_name as state, cast(n_regionkey as int) as region, cast(n_nationkey as bigint) as area from nation where n_regionkey <> 4")
def state_dimension(spark: SparkSession, d: str) -> DataFrame:
    raw = B.table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("r"), F.col("n_nationkey").cast("string").alias("a"))
    out, constraints = D.attribute_dim(raw, "state", {"state": ("n_name", "string"), "region": ("r", "int"), "area": ("a", "long")}, F.col("r") == "4")
    C.check(*constraints)
    return out


# --- the fact, from pages to ids ---


@query(electoral.GRID + """select row_number() over (order by year, state = 'Totals', state, col_ind)::bigint as votes_id, year, case when state <> 'Totals' then state end as state, state = 'Totals' as is_total, rank_id as candidate_id,
  sum(votes) over (partition by year, state)::int as total_electoral_votes, votes::int as president_electoral_votes
from rows join (select candidate_id as col_ind, row_number() over (order by case when candidate_id < (select max(candidate_id) from cand) then upper(candidate[1]) || lower(candidate[2:]) || ' J. Jr.' else 'Others' end)::int as rank_id from cand) using (col_ind)""")
def votes_with_ids(spark: SparkSession, d: str) -> DataFrame:
    years = year_records(electoral.parsed(spark, d))
    columns = reshape.candidate_columns(years).select("year", "col_ind", F.col("president_candidate_name").alias("name"), F.col("president_candidate_state").alias("home"))
    parties = reshape.candidate_parties(years).select(F.col("president_candidate_name").alias("name"), F.col("president_candidate_party").alias("party"))
    candidates, sound = D.candidate_dim(columns.drop("col_ind"), parties)
    out, constraints = D.votes_fact(reshape.vote_cells(years), columns, candidates, B.electors(spark, d).select("state"))
    C.check(*sound, *constraints)
    return out
