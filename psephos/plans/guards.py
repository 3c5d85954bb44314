"""Names, exemptions and status layers as queries, bound to rows of every class and contradiction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import constraints as C
from psephos.operators import membership as M
from psephos.plans import ballots as B
from psephos.plans.registry import query

# --- native names ---


def native(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, mapped, dropped). Three segments are mapped and two dropped, but for a forgotten one in 1996, one in both lists in
    1998 and one mapped twice in 1999; a name of 1890 is not among the facts."""
    facts = B.counted_votes(spark, d).withColumn("candidate", F.concat(F.lit("N:"), "candidate"))
    names = facts.select("year", "candidate").distinct()
    mapped = names.where("candidate in ('N:BUILDING', 'N:FURNITURE', 'N:HOUSEHOLD') and not (candidate = 'N:HOUSEHOLD' and year = 1996)")
    mapped = mapped.select("year", "candidate", F.initcap(F.substring("candidate", 3, 99)).alias("canonical"))
    twice = mapped.where("candidate = 'N:FURNITURE' and year = 1999").withColumn("canonical", F.lit("Chairs"))
    ghost = spark.createDataFrame([(1890, "N:GHOST", "Ghost")], "year int, candidate string, canonical string")
    dropped = names.where("candidate in ('N:MACHINERY', 'N:AUTOMOBILE') or (candidate = 'N:BUILDING' and year = 1998)")
    return facts, mapped.unionByName(twice).unionByName(ghost), dropped


NATIVE = B.SQL + """, facts as (select year, state, 'N:' || candidate as candidate, candidate_votes from pv), names as (select distinct year, candidate from facts),
mapped as (select year, candidate, upper(candidate[3]) || lower(candidate[4:]) as canonical from names where candidate in ('N:BUILDING', 'N:FURNITURE', 'N:HOUSEHOLD') and not (candidate = 'N:HOUSEHOLD' and year = 1996)),
dropped as (select year, candidate from names where candidate in ('N:MACHINERY', 'N:AUTOMOBILE') or (candidate = 'N:BUILDING' and year = 1998))
"""


@query(NATIVE + """select n.year, n.candidate, case when m.candidate is not null and d.candidate is not null then 'in_both' when n.candidate = 'N:FURNITURE' and n.year = 1999 then 'ambiguous'
  when m.candidate is not null then 'mapped' when d.candidate is not null then 'dropped' else 'unclassified' end as class
from names n left join mapped m on m.year = n.year and m.candidate = n.candidate left join dropped d on d.year = n.year and d.candidate = n.candidate union all select 1890, 'N:GHOST', 'unused'""")
def native_name_classes(spark: SparkSession, d: str) -> DataFrame:
    return M.native_classes(*native(spark, d))


@query(NATIVE + """select year, candidate, case when year = 1996 then 'unclassified' when year = 1998 then 'in_both' else 'ambiguous' end as class from names
where (year, candidate) in ((1996, 'N:HOUSEHOLD'), (1998, 'N:BUILDING'), (1999, 'N:FURNITURE'))""")
def native_names_unsettled(spark: SparkSession, d: str) -> DataFrame:
    return M.native_names_partition(*native(spark, d)).violations


@query(NATIVE + "select f.year, f.state, m.canonical as candidate, f.candidate_votes from facts f join mapped m using (year, candidate) where year <> 1999")
def canonical_votes(spark: SparkSession, d: str) -> DataFrame:
    facts, mapped, _ = native(spark, d)
    return M.canonical_facts(facts.where("year <> 1999"), mapped)


def getters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(getters, exempt, facts). Two segments have no votes; one of them is exempt, and so, wrongly, is one that has."""
    won = B.spine(spark, d).join(B.candidates(spark, d).withColumnRenamed("name", "candidate"), "candidate_id").where("president_electoral_votes > 0").select("year", "candidate")
    names = B.counted_votes(spark, d).select("year", "candidate").distinct()
    exempt = names.where("candidate = 'MACHINERY' or (candidate = 'BUILDING' and year = 1997)").unionByName(spark.createDataFrame([(1890, "GHOST")], "year int, candidate string"))
    return won, exempt, names.where("candidate not in ('MACHINERY', 'AUTOMOBILE')")


GETTERS = B.SQL + """, won as (select distinct year, candidate from dense where president_electoral_votes > 0), names as (select distinct year, candidate from pv),
exempt as (select year, candidate from names where candidate = 'MACHINERY' or (candidate = 'BUILDING' and year = 1997) union all select 1890, 'GHOST'),
held as (select year, candidate from names where candidate not in ('MACHINERY', 'AUTOMOBILE')),
k as (select year, candidate from won union select year, candidate from exempt union select year, candidate from held)
"""


@query(GETTERS + """select year, candidate, case when e and h then 'stale_exemption' when w and h then 'held' when h then 'votes_only' when w and e then 'exempt' when e then 'unused_exemption' else 'missing' end as class
from (select year, candidate, exists (select 1 from won x where x.year = k.year and x.candidate = k.candidate) as w, exists (select 1 from exempt x where x.year = k.year and x.candidate = k.candidate) as e,
  exists (select 1 from held x where x.year = k.year and x.candidate = k.candidate) as h from k) t""")
def getter_classes(spark: SparkSession, d: str) -> DataFrame:
    return M.getter_classes(*getters(spark, d))


@query(GETTERS + """, v as (select 'getter_missing' as "constraint" from won where not exists (select 1 from exempt e where e.year = won.year and e.candidate = won.candidate) and candidate in ('MACHINERY', 'AUTOMOBILE')
 union all select 'exemption_stale' from held where exists (select 1 from exempt e where e.year = held.year and e.candidate = held.candidate) union all select 'year_without_getters')
select "constraint", count(*) as n_violations from v group by all""")
def getters_incomplete(spark: SparkSession, d: str) -> DataFrame:
    won, exempt, facts = getters(spark, d)
    years = won.select("year").distinct().unionByName(spark.createDataFrame([(1890,)], "year int"))
    return C.violations(M.getters_complete(won, exempt, facts, years)).drop("example")


# --- layered status ---


def layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(participants, legislature, absent, voting): nations of region 0 choose by legislature and vote all the same, some nations are
    absent in 1996, one is printed twice, one stands in no roster."""
    votes = B.counted_votes(spark, d)
    places = votes.select("year").distinct().crossJoin(B.electors(spark, d))
    legislature = places.where("n_regionkey = 0").select("year", "state", F.concat(F.lit("region of "), "state").alias("note"))
    legislature = legislature.unionByName(spark.createDataFrame([(1890, "NOWHERE", "lost")], "year int, state string, note string"))
    absent = places.where("year = 1996 and n_nationkey < 8").select("year", "state", F.lit("took no part").alias("note"))
    rows = votes.select("year", "state").distinct()
    again = rows.join(places.where("n_nationkey = 9").select("year", "state"), ["year", "state"], "left_semi")
    return places.select("year", "state", F.when(F.col("n_nationkey") == 8, 0).otherwise(F.col("electors")).alias("total_electoral_votes")), legislature, absent, rows.unionByName(again)


LAYERS = B.SQL + """, parts as (select year, state, n_nationkey, n_regionkey, case when n_nationkey = 8 then 0 else electors end as electors from ev cross join (select distinct year from pv) y),
leg as (select year, state, 'region of ' || state as note from parts where n_regionkey = 0 union all select 1890, 'NOWHERE', 'lost'),
gone as (select year, state, 'took no part' as note from parts where year = 1996 and n_nationkey < 8),
voting as (select year, state, case when n_nationkey = 9 then 2 else 1 end as n from places join ev using (state)),
status as (select p.year, p.state, p.electors, case when g.state is not null then 'not_participating' when l.state is not null then 'legislature_chosen' else 'popular_vote' end as pv_status, coalesce(g.note, l.note) as note
  from parts p left join gone g on g.year = p.year and g.state = p.state left join leg l on l.year = p.year and l.state = p.state)
"""


@query(LAYERS + "select year, state, pv_status, note from status")
def layered_status(spark: SparkSession, d: str) -> DataFrame:
    places, legislature, absent, _ = layers(spark, d)
    return M.layered_status(places, {"not_participating": absent, "legislature_chosen": legislature})


@query(LAYERS + """select year, state, 'legislature_outside_roster' as contradiction from leg where (year, state) not in (select year, state from parts)
union all select year, state, 'legislature_and_absent' from leg where (year, state) in (select year, state from gone) union all select year, state, 'absent_with_votes' from gone where (year, state) in (select year, state from voting)
union all select year, state, 'legislature_with_votes' from leg where (year, state) in (select year, state from voting) union all select year, state, 'two_rows_one_state' from voting where n > 1""")
def status_contradictions(spark: SparkSession, d: str) -> DataFrame:
    places, legislature, absent, voting = layers(spark, d)
    return M.status_contradictions(voting, legislature, absent, places)


@query(LAYERS + """, v as (select 'year_without_roster' as "constraint" union all select 'note_on_popular_vote' from status where pv_status = 'popular_vote' and year = 1997
 union all select 'absence_against_electors' from status where (pv_status = 'not_participating' and electors <> 0) or (pv_status = 'popular_vote' and electors = 0))
select "constraint", count(*) as n_violations from v group by all""")
def roster_broken(spark: SparkSession, d: str) -> DataFrame:
    places, _, _, _ = layers(spark, d)
    noted = layered_status(spark, d).withColumn("note", F.when(F.col("year") == 1997, F.coalesce("note", F.lit("prose"))).otherwise(F.col("note")))
    years = places.select("year").distinct().unionByName(spark.createDataFrame([(1890,)], "year int"))
    return C.violations(M.roster_constraints(noted, places, years)).drop("example")
