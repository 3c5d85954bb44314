"""The constraints as queries over the driver's tables, each bound to rows that break it, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import constraints as C
from psephos.operators import measures as M
from psephos.plans import ballots as B
from psephos.plans.catalog import SUMMARY, _scores_sql
from psephos.plans.registry import query


@query("select l_orderkey, l_linenumber from lineitem where l_tax = 0")
def null_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_tax, 0D)").alias("l_tax"))
    return C.not_null(lines, ["l_orderkey", "l_tax"]).violations.select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus not in ('F', 'O') or o_orderstatus is null")
def out_of_domain(spark: SparkSession, d: str) -> DataFrame:
    return C.in_domain(B.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"]).violations


@query("select l_orderkey, l_linenumber from lineitem where not (l_quantity < 49)")
def row_rule_broken(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return C.row_rule(lines, F.col("l_quantity") < 49, "small").violations.select("l_orderkey", "l_linenumber")


@query("select distinct o_custkey as c_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey <> 3)")
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    child = B.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return C.references(child, B.table(spark, d, "customer").where("c_nationkey <> 3"), ["c_custkey"]).violations


@query("select distinct o_custkey from orders where o_totalprice > 200000 and o_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def keys_in_both(spark: SparkSession, d: str) -> DataFrame:
    orders = B.table(spark, d, "orders")
    return C.disjoint(orders.where("o_totalprice > 200000"), orders.where("o_orderstatus = 'P'"), ["o_custkey"]).violations


@query("select l_orderkey, min(l_returnflag) as low, max(l_returnflag) as high from lineitem group by all having min(l_returnflag) <> max(l_returnflag)")
def not_constant(spark: SparkSession, d: str) -> DataFrame:
    return C.constant(B.table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag").violations


@query("""with s as (select l_orderkey, sum(l_linenumber)::bigint as summed from lineitem group by all), t as (select o_orderkey as l_orderkey, sum(cast(floor(o_totalprice) as bigint) % 30)::bigint as stated from orders group by all)
select coalesce(s.l_orderkey, t.l_orderkey) as l_orderkey, summed, stated from s full join t using (l_orderkey) where summed is distinct from stated""")
def totals_against_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n"))
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.floor("o_totalprice") % 30).alias("n"))
    return C.totals_match(lines, orders, ["l_orderkey"], "n").violations


@query("""with a as (select s_nationkey as nation, count(*) as n_left from supplier group by all), b as (select c_nationkey as nation, count(*) as n_right from customer group by all)
select coalesce(a.nation, b.nation) as nation, n_left, n_right from a full join b using (nation) where n_left is distinct from n_right""")
def counts_differ(spark: SparkSession, d: str) -> DataFrame:
    suppliers = B.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return C.same_counts(suppliers, B.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), ["nation"]).violations


@query("select l_orderkey from (select l_orderkey, rank() over (partition by l_orderkey order by l_quantity desc) as k from lineitem) where k = 1 group by all having count(*) > 1")
def ties_at_top(spark: SparkSession, d: str) -> DataFrame:
    return C.no_tie_at_top(B.table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").violations.select("l_orderkey")


@query("select l_orderkey from lineitem group by all having sum(l_linenumber / 16.0::double) > 1 + 1e-9")
def shares_over_one(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") / 16.0).alias("share"))
    return C.shares_bounded(lines, ["l_orderkey"], "share").violations.select("l_orderkey")


@query("with h as (select o_custkey, count(*) as hits from orders group by all) select c_custkey as o_custkey, hits from customer left join h on c_custkey = o_custkey where coalesce(hits, 0) <> 1")
def overlay_hits(spark: SparkSession, d: str) -> DataFrame:
    return C.matches_once(B.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), B.table(spark, d, "orders"), ["o_custkey"]).violations


@query(B.SQL + f", x as (select *, case when year = {B.EXCLUDED_YEAR} and candidate_id = 1 then ' ' when year = 1995 and candidate_id = 2 then 'why' else count_status_reason end as r from joined) select year, state, candidate_id from x where (count_status <> 'counted') <> (length(trim(coalesce(r, ''))) > 0)")
def status_without_reason(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when((F.col("year") == B.EXCLUDED_YEAR) & (F.col("candidate_id") == 1), " ").when((F.col("year") == 1995) & (F.col("candidate_id") == 2), "why").otherwise(F.col("count_status_reason"))
    return C.status_has_reason(B.joined(spark, d).withColumn("count_status_reason", reason)).violations.select("year", "state", "candidate_id")


@query(B.SQL + ", x as (select *, president_electoral_votes_counted + case when year = 1999 then 1 else 0 end as c from joined) select year, state, candidate_id from x where c <> case when count_status = 'counted' then president_electoral_votes else 0 end")
def counted_against_status(spark: SparkSession, d: str) -> DataFrame:
    more = F.col("president_electoral_votes_counted") + F.when(F.col("year") == 1999, 1).otherwise(0)
    return C.counted_follows_status(B.joined(spark, d).withColumns({"is_total": F.lit(False), "president_electoral_votes_counted": more})).violations.select("year", "state", "candidate_id")


@query(B.SQL + """, al as (select year, state, max(case when state = (select state from ev where n_nationkey = 8) then 0 else total_electoral_votes end) as electors from joined group by all),
ab as (select year, state, case when state = (select state from ev where n_nationkey = 5) then 'not_participating' else pv_status end as pv_status from roster where pv_status <> 'popular_vote' union all select 1890, 'NOWHERE', 'not_participating'),
v as (select 'absence_not_in_spine' as "constraint" from (select distinct year, state from ab) a where not exists (select 1 from al where al.year = a.year and al.state = a.state)
 union all select 'absence_and_electors' from ab join al using (year, state) where (pv_status = 'not_participating') <> (electors = 0)
 union all select 'no_electors_uncatalogued' from al where electors = 0 and not exists (select 1 from ab where ab.year = al.year and ab.state = al.state and pv_status = 'not_participating'))
select "constraint", count(*) as n_violations from v group by all""")
def absences_against_spine(spark: SparkSession, d: str) -> DataFrame:
    votes = B.counted_votes(spark, d)
    named = {k: B.electors(spark, d).where(f"n_nationkey = {k}").head() for k in (5, 8)}
    name = {k: r["state"] if r else "" for k, r in named.items()}
    spine = B.joined(spark, d, votes).withColumn("total_electoral_votes", F.when(F.col("state") == name[8], 0).otherwise(F.col("total_electoral_votes")))
    absent = B.roster(spark, d, votes).where("pv_status <> 'popular_vote'").select("year", "state", F.when(F.col("state") == name[5], "not_participating").otherwise(F.col("pv_status")).alias("pv_status"))
    absent = absent.unionByName(spark.createDataFrame([(1890, "NOWHERE", "not_participating")], "year int, state string, pv_status string"))
    return C.violations(C.catalog_matches_spine(absent, spine)).drop("example")


@query(B.SQL + "select year, state, candidate_id from joined where year < 1997 and candidate_votes is not null")
def below_floor(spark: SparkSession, d: str) -> DataFrame:
    return C.nothing_below_floor(B.joined(spark, d, years=(None, 1996)), "candidate_votes", 1997).violations.select("year", "state", "candidate_id")


@query(B.SQL + "select year, state, candidate_id from joined where year in (1996, 1997) and president_electoral_votes > 0 and candidate_votes is null")
def winners_without_votes(spark: SparkSession, d: str) -> DataFrame:
    return C.winners_have_votes(B.joined(spark, d), [1996, 1997]).violations.select("year", "state", "candidate_id")


@query(B.SQL + """select year, state, candidate_id from joined where president_electoral_votes > 0 and candidate_votes is null
  and year in (select year from joined where candidate_votes is not null) and not (year >= 1995 and candidate in ('BUILDING', 'MACHINERY'))""")
def winners_not_exempt(spark: SparkSession, d: str) -> DataFrame:
    joined = B.joined(spark, d)
    exempt = joined.where("year >= 1995 and candidate in ('BUILDING', 'MACHINERY')").select("year", "candidate").distinct()
    return C.winners_have_votes(joined, exemptions=exempt).violations.select("year", "state", "candidate_id")


_SUMMARY_CTES, _SUMMARY_SELECT = SUMMARY.split("\nselect w.year", 1)


@query(_scores_sql() + _SUMMARY_CTES + ", z as (select w.year" + _SUMMARY_SELECT + """) select z.year, case when z.year = 1997 then 'NOBODY' else ec_winner end as ec_winner, s.candidate as first
from z join scores s on s.year = z.year and s.president_electoral_rank = 1 where case when z.year = 1997 then 'NOBODY' else ec_winner end is distinct from s.candidate""")
def winner_not_first(spark: SparkSession, d: str) -> DataFrame:
    scores = M.measures(*B.election(spark, d))
    summary = M.summary(scores).withColumn("ec_winner", F.when(F.col("year") == 1997, "NOBODY").otherwise(F.col("ec_winner")))
    return C.winner_is_first(summary, scores).violations.select("year", "ec_winner", "first")


@query(B.SQL + "select year, state, candidate_id from joined where source is not null and (year = 1997 or (case when year = 1998 then 'other' else source end) <> 'ballots')")
def not_redistributable(spark: SparkSession, d: str) -> DataFrame:
    rows = B.joined(spark, d).withColumn("redistributable", F.when((F.col("year") == 1997) & F.col("redistributable").isNotNull(), False).otherwise(F.col("redistributable")))
    rows = rows.withColumn("source", F.when((F.col("year") == 1998) & F.col("source").isNotNull(), "other").otherwise(F.col("source")))
    return C.redistributable_only(rows, ["ballots"]).violations.select("year", "state", "candidate_id")


@query("""with v as (select 'domain' as "constraint" from orders where o_orderstatus not in ('F', 'O') union all select 'rule' from lineitem where l_quantity >= 49
 union all select 'grain' from (select l_partkey, l_suppkey from lineitem group by all having count(*) > 1))
select "constraint", count(*) as n_violations from v group by all""")
def broken_in_one_job(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    found = C.violations([
        C.in_domain(orders, "o_orderstatus", ["F", "O"], "domain"), C.row_rule(lines, F.col("l_quantity") < 49, "rule"), C.unique(lines, ["l_partkey", "l_suppkey"], "grain"),
        C.not_null(orders, ["o_orderkey"], "kept"),
    ])
    return found.drop("example")
