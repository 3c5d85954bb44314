"""The engine's queries over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import constraints as C
from psephos.functions import text as T
from psephos.operators import measures as M
from psephos.operators import reshape, resolution
from psephos.plans import ballots as B
from psephos.plans.registry import query
from psephos.plans.serving import year_index
from psephos.sources.publish import content_version

KEY = ["year", "state", "candidate"]
STATUS_SOURCES = [("F", 2, True), ("O", 1, False), ("P", 3, True)]


def _scores_sql(share: str = B.FULL_SHARE, roster: str = "roster") -> str:
    return B.SQL + B.SCORES_SQL.format(share=share, roster=roster)


SUMMARY = """
, w as (select year, min(ec_denominator) as ec_denominator, min(pv_coverage) as pv_coverage, max(ec_share_full) > 0.5 as ec_determinative from scores group by all),
e as (select year, candidate, ec_share_full as s, row_number() over (partition by year order by ec_share_full desc, candidate_id) as k from scores where ec_share_full is not null),
p as (select year, candidate, pv_share as s, row_number() over (partition by year order by pv_share desc, candidate_id) as k from scores where pv_share is not null),
h as (select year, candidate, hybrid_score as s, row_number() over (partition by year order by hybrid_score desc, candidate_id) as k from scores where hybrid_score is not null)
select w.year, w.ec_denominator, e1.candidate as ec_winner, p1.candidate as pv_winner, h1.candidate as hybrid_winner, w.ec_determinative, w.pv_coverage,
  p1.candidate <> e1.candidate as pv_flip, h1.candidate <> e1.candidate as hybrid_flip, (e1.s - e2.s) * 100 as ec_margin, (p1.s - p2.s) * 100 as pv_margin, (h1.s - h2.s) * 100 as hybrid_margin
from w left join e e1 on e1.year = w.year and e1.k = 1 left join e e2 on e2.year = w.year and e2.k = 2
left join p p1 on p1.year = w.year and p1.k = 1 left join p p2 on p2.year = w.year and p2.k = 2
left join h h1 on h1.year = w.year and h1.k = 1 left join h h2 on h2.year = w.year and h2.k = 2
"""


@query(_scores_sql() + SUMMARY)
def three_method_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(M.measures(*B.election(spark, d)))


@query(_scores_sql() + "select * from scores")
def three_method_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.measures(*B.election(spark, d))


@query(_scores_sql(B.RESTRICTED_SHARE) + "select * from scores")
def scores_restricted(spark: SparkSession, d: str) -> DataFrame:
    return M.measures(*B.election(spark, d), M.RESTRICTED)


@query(_scores_sql() + "select year, ec_denominator, covered_electoral_votes, covered_electoral_votes / nullif(ec_denominator, 0) as pv_coverage from cov")
def coverage_by_year(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage(*B.election(spark, d))


PART_ROSTER = ", part as (select year, state, case when year = 1996 then 'legislature_chosen' else pv_status end as pv_status from roster where year < 1998)"


@query(B.SQL + PART_ROSTER + B.SCORES_SQL.format(share=B.FULL_SHARE, roster="part") + "select year, ec_denominator, covered_electoral_votes, covered_electoral_votes / nullif(ec_denominator, 0) as pv_coverage from cov")
def coverage_roster_unknown(spark: SparkSession, d: str) -> DataFrame:
    part = B.roster(spark, d).where("year < 1998").withColumn("pv_status", F.when(F.col("year") == 1996, "legislature_chosen").otherwise(F.col("pv_status")))
    return M.coverage(B.joined(spark, d), part)


def _union(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    votes = B.popular(spark, d).select("year", "state", "candidate", F.col("o_orderstatus").alias("source"), "candidate_votes")
    return votes, spark.createDataFrame(STATUS_SOURCES, "source string, precedence_rank int, redistributable boolean")


RANKED = B.SQL + ", src(source, precedence_rank, redistributable) as (values ('F', 2, true), ('O', 1, false), ('P', 3, true)), u as (select year, state, candidate, o_orderstatus as source, candidate_votes, precedence_rank, redistributable from byc join src on o_orderstatus = source)"


@query(RANKED + " select year, state, candidate, source, candidate_votes from u qualify row_number() over (partition by year, state, candidate order by precedence_rank) = 1")
def resolve_precedence(spark: SparkSession, d: str) -> DataFrame:
    return resolution.preferred(*_union(spark, d))


@query(RANKED + " select year, state, candidate, source, candidate_votes from u where redistributable qualify row_number() over (partition by year, state, candidate order by precedence_rank) = 1")
def redistributable_series(spark: SparkSession, d: str) -> DataFrame:
    return resolution.redistributable(*_union(spark, d))


@query(RANKED + " select year, state, candidate, source, candidate_votes from u where source = 'P'")
def single_source_series(spark: SparkSession, d: str) -> DataFrame:
    return resolution.single_source(_union(spark, d)[0], "P")


@query(B.SQL + "select * from joined")
def spine_left_join(spark: SparkSession, d: str) -> DataFrame:
    return B.joined(spark, d)


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    large = B.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return B.table(spark, d, "part").select("p_partkey").join(large, "p_partkey", "left_anti")


@query("select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def semi_matched(spark: SparkSession, d: str) -> DataFrame:
    large = B.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return B.table(spark, d, "part").select("p_partkey").join(large, "p_partkey", "left_semi")


@query(B.SQL + "select r.*, national_pv_denominator from (select year, candidate_id, min(candidate) as candidate, sum(candidate_votes)::bigint as national_pv_votes from joined group by all) r join pvden using (year)")
def national_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.national_rollup(B.joined(spark, d), ["year", "candidate_id"], ["candidate"])


@query(B.SQL + "select * from den")
def appointed_denominator(spark: SparkSession, d: str) -> DataFrame:
    return M.appointed_denominator(B.joined(spark, d))


@query("""select l_orderkey, l_suppkey, min_by(l_returnflag, struct_pack(a := -v, b := l_returnflag)) as l_returnflag, sum(v)::bigint as votes, max(l_linenumber) as lines
from (select *, cast(l_quantity as bigint) as v from lineitem) group by all""")
def plurality_party_collapse(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("votes"), F.col("l_linenumber").alias("lines"))
    return M.fusion_collapse(lines, ["l_orderkey", "l_suppkey"], "l_returnflag", "votes", "lines")


@query("""with f as (select user_id, event_type, min(event_id) as first_at from events where event_type is not null group by all),
k as (select *, row_number() over (partition by user_id order by first_at) as k from f)
select user_id, max(case when k = 1 then event_type end) as event_type_1, max(case when k = 2 then event_type end) as event_type_2, cast(count(*) as int) as n_values from k group by all""")
def ordered_distinct_pair(spark: SparkSession, d: str) -> DataFrame:
    return resolution.ordered_distinct(B.table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query(B.SQL + "select year, state, candidate_id, president_electoral_rank from joined")
def dense_rank_broadcast(spark: SparkSession, d: str) -> DataFrame:
    return B.spine(spark, d).select("year", "state", "candidate_id", "president_electoral_rank")


@query(B.SQL + "select year, candidate, candidate_id from joined where took_office group by all")
def office_override(spark: SparkSession, d: str) -> DataFrame:
    return B.joined(spark, d).where("took_office").select("year", "candidate", "candidate_id").distinct()


@query("select l_orderkey, l_linenumber, measure, amount from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, nullif(l_tax, 0) as l_tax from lineitem) on l_quantity, l_discount, l_tax into name measure value amount)")
def melt_long(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "lineitem").withColumn("l_tax", F.expr("nullif(l_tax, 0D)"))
    return reshape.melt(lines, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def extract_props(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


OVERLAY = B.SQL + """, o as (select year, state, candidate, case when year = 1995 and state = (select state from ev where n_nationkey = 1) then 7
  when year = 1997 then candidate_votes + 5 else candidate_votes end::bigint as candidate_votes from pv)
select year, state, candidate, candidate_votes, false as is_total from o union all select year, null, candidate, sum(candidate_votes)::bigint, true from o group by all"""


@query(OVERLAY)
def overlay_corrections(spark: SparkSession, d: str) -> DataFrame:
    votes = B.all_sources(B.popular(spark, d))
    place = B.electors(spark, d).where("n_nationkey = 1").select(F.lit(1995).alias("year"), "state", F.lit(7).cast("long").alias("value"))
    added = spark.createDataFrame([(1997, 2), (1997, 3)], "year int, value long")
    fixed = resolution.overlay_add(resolution.overlay_set(votes, place, ["year", "state"], "candidate_votes"), added, ["year"], "candidate_votes")
    return resolution.with_totals(fixed, ["year", "candidate"], ["candidate_votes"])


@query("""select l_orderkey, sum(l_linenumber)::bigint as parts, min(w) as whole, max(w) as whole_high, coalesce(max(case when l_orderkey % 10 = 0 then 1 end), 0)::bigint as difference
from (select *, cast(floor(o_totalprice) as bigint) % 30 as w from lineitem join orders on l_orderkey = o_orderkey) group by l_orderkey
having min(w) - sum(l_linenumber) <> coalesce(max(case when l_orderkey % 10 = 0 then 1 end), 0)""")
def row_sum_vs_total(spark: SparkSession, d: str) -> DataFrame:
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.floor("o_totalprice") % 30).alias("w"))
    lines = B.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).join(orders, "l_orderkey")
    known = orders.where("l_orderkey % 10 = 0").select("l_orderkey", F.lit(1).cast("long").alias("difference"))
    return C.sums_equal(lines, ["l_orderkey"], "l_linenumber", "w", known).violations.withColumn("difference", F.coalesce("difference", F.lit(0).cast("long")))


@query("select l_orderkey, sum(cast(l_quantity as bigint))::bigint as parts, 120::bigint as whole from lineitem group by all having sum(cast(l_quantity as bigint)) > 120")
def totals_not_exceeded(spark: SparkSession, d: str) -> DataFrame:
    lines = B.table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), F.lit(120).cast("long").alias("most"))
    return C.sums_within(lines, ["l_orderkey"], "q", "most").violations


@query(B.SQL + ", x as (select year, state, candidate, count(*) as n from byc where o_orderstatus = 'P' group by all) select year, sum(n)::bigint as n_rows, count(*) as n_cells, count(distinct state) as n_one, count(distinct candidate) as n_other from x group by all having sum(n) <> count(*) or count(*) <> count(distinct state) * count(distinct candidate)")
def rectangular_grain(spark: SparkSession, d: str) -> DataFrame:
    return C.rectangular(B.popular(spark, d).where("o_orderstatus = 'P'"), ["year"], "state", "candidate").violations


@query("select l_partkey, l_suppkey, count(*) as n_rows from lineitem group by all having count(*) > 1")
def duplicate_grain(spark: SparkSession, d: str) -> DataFrame:
    return C.unique(B.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"]).violations


ROSTER_CHECK = B.SQL + """, f as (select distinct year, state from joined where candidate_votes is not null and year <> 1997), r as (select year, state, case when state = (select state from ev where n_nationkey = 2) then 'legislature_chosen' else pv_status end as pv_status from roster where year <> 1998),
v as (select 'roster_without_facts' as "constraint" from r left join f using (year, state) where pv_status = 'popular_vote' and not exists (select 1 from f where f.year = r.year and f.state = r.state)
 union all select 'facts_where_none_were_held' from r where pv_status <> 'popular_vote' and exists (select 1 from f where f.year = r.year and f.state = r.state)
 union all select 'facts_outside_roster' from f where not exists (select 1 from r where f.year = r.year and f.state = r.state))
select "constraint", count(*) as n_violations from v group by all"""


@query(ROSTER_CHECK)
def roster_two_way(spark: SparkSession, d: str) -> DataFrame:
    facts = B.resolved(spark, d).where("year <> 1997")
    place = B.electors(spark, d).where("n_nationkey = 2").select("state", F.lit("legislature_chosen").alias("value"))
    roster = resolution.overlay_set(B.roster(spark, d).where("year <> 1998"), place, ["state"], "pv_status")
    return C.violations(C.roster_covers_facts(roster, facts)).drop("example")


@query(B.SQL + "select year, count(*) as n_candidates, count(national_pv_votes) > 0 as has_popular_vote from (select year, candidate_id, sum(candidate_votes) as national_pv_votes from joined group by all) group by all")
def years(spark: SparkSession, d: str) -> DataFrame:
    return year_index(M.national_rollup(B.joined(spark, d), ["year", "candidate_id"], ["candidate"]))


@query(B.SQL + "select * from joined where year = 1995")
def rows_by_year(spark: SparkSession, d: str) -> DataFrame:
    return B.joined(spark, d, years=(1995, 1995)).orderBy("state", "candidate")


@query(B.SQL + "select * from joined where state = (select state from ev where n_nationkey = 7) and year between 1996 and 1998")
def rows_by_state(spark: SparkSession, d: str) -> DataFrame:
    place = B.electors(spark, d).where("n_nationkey = 7").select("state")
    return B.joined(spark, d, years=(1996, 1998)).join(place, "state", "left_semi").orderBy("year", "candidate")


@query(B.SQL + "select * from joined where candidate = 'BUILDING'")
def rows_by_candidate(spark: SparkSession, d: str) -> DataFrame:
    return B.joined(spark, d).where("candidate = 'BUILDING'").orderBy("year", "state")


@query(r"select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


#: Names of one to four words, with and without Jr.; the rule in SQL: first word, then one middle word if two or more follow.
NAMES = """(select p_partkey, case p_partkey % 6 when 0 then p_type when 1 then p_type || ' ' || p_name when 2 then p_type || ' ' || p_name || ', Jr.'
  when 3 then p_brand || ' ' || p_type || ' ' || p_name when 4 then p_type || ' ' || p_brand || ' Jr.' else p_name || ' III' end as n from part)"""
NAME_SPLIT = rf"""with a as (select p_partkey, n, string_split(n, ' ')[1] as first, regexp_replace(case when contains(n, ' ') then substr(n, strpos(n, ' ') + 1) else '' end, ',? Jr\.?$', '') as rest from {NAMES}),
b as (select *, list_filter(regexp_split_to_array(trim(rest), '\s+'), lambda x: x <> '') as w from a)
select p_partkey, first, case when len(w) > 1 then w[1] end as middle, case when len(w) = 1 then w[1] when len(w) > 1 then array_to_string(w[2:], ' ') end as last,
  case when ends_with(n, 'Jr.') then 'Jr.' end as suffix from b"""


@query(NAME_SPLIT)
def name_split(spark: SparkSession, d: str) -> DataFrame:
    part, k = B.table(spark, d, "part"), F.col("p_partkey") % 6
    forms = [["p_type"], ["p_type", "p_name"], ["p_type", "p_name", "Jr,"], ["p_brand", "p_type", "p_name"], ["p_type", "p_brand", "Jr"]]
    name = F.concat_ws(" ", "p_name", F.lit("III"))
    for n, form in reversed(list(enumerate(forms))):
        end = {"Jr,": ", Jr.", "Jr": " Jr."}.get(form[-1], "")
        name = F.when(k == n, F.concat(F.concat_ws(" ", *[c for c in form if not c.startswith("Jr")]), F.lit(end))).otherwise(name)
    return part.select("p_partkey", *[v.alias(c) for c, v in T.name_parts(name).items()])


@query("select l_orderkey, l_linenumber, case when abs(l_quantity / 50.0::double * 100 - l_discount * 1000) > 0.5 then 'unreliable' else 'exact' end as reliability from lineitem")
def reliability_flag(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.reliability(F.col("l_quantity"), F.lit(50.0), F.col("l_discount") * 1000).alias("reliability"))


HASHED = ["year", "state", "candidate_id", "candidate", "total_electoral_votes", "president_electoral_votes", "national_electoral_votes", "president_electoral_rank", "took_office",
          "source", "party", "candidate_votes", "state_total_votes", "reliability", "redistributable", "president_electoral_votes_counted", "national_counted_electoral_votes",
          "count_status", "count_status_reason"]
VERSION_SQL = B.SQL + ", h as (select sha256(concat_ws(chr(31), " + ", ".join(f"coalesce({c}::varchar, '')" for c in HASHED) + """)) as h from joined),
s as (select count(*) as n_rows, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * k}, 15))::bigint)::varchar as p{k}" for k in range(4)) + """ from h)
select n_rows, sha256(concat_ws(':', 'schema=1', n_rows::varchar, p0, p1, p2, p3)) as version from s"""


@query(VERSION_SQL)
def snapshot_version(spark: SparkSession, d: str) -> DataFrame:
    df = B.joined(spark, d)
    return content_version(df, df.columns)


@query(B.SQL + """, k as (select year, state, candidate, candidate_id, candidate_votes::double as v, row_number() over (partition by year, state order by candidate_votes desc, candidate_id) as k from joined where candidate_votes is not null)
select a.year, a.state, a.candidate as winner, (a.v - b.v) * 100 as margin from k a left join k b on b.year = a.year and b.state = a.state and b.k = 2 where a.k = 1""")
def winner_and_margin(spark: SparkSession, d: str) -> DataFrame:
    df = B.joined(spark, d).where("candidate_votes is not null").withColumn("v", F.col("candidate_votes").cast("double"))
    return df.groupBy("year", "state").agg(M.winner("v", "candidate", "candidate_id").alias("winner"), M.margin("v").alias("margin"))


@query("select s_suppkey as key, s_nationkey as nation, 'supplier' as source from supplier union all select c_custkey, c_nationkey, 'customer' from customer")
def union_of_sources(spark: SparkSession, d: str) -> DataFrame:
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    return resolution.union_tagged({"supplier": s, "customer": c})


@query("select c_custkey from customer except select o_custkey from orders where o_totalprice > 300000")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "customer").select("c_custkey").subtract(B.table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")))


@query(B.SQL + "select year, state, pv_status, 'ballots' as source, case when pv_status <> 'popular_vote' then 'region 0' end as note from roster")
def status_roster(spark: SparkSession, d: str) -> DataFrame:
    return B.roster(spark, d)
