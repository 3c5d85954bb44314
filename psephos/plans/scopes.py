"""Calendar, catalogs, layouts and the public snapshot as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos import constraints as C
from psephos.operators import scope
from psephos.plans import ballots as B
from psephos.plans.flows import ROWS
from psephos.plans.loads import TWO, loaded
from psephos.plans.registry import query
from psephos.plans.serving import Snapshot
from psephos.shared import new_path
from psephos.sources import pages, publish, versioned


@query("select year(o_orderdate)::int as year, count(*)::bigint as n from orders where year(o_orderdate) = 1789 or (year(o_orderdate) >= 1824 and year(o_orderdate) % 4 = 0 and year(o_orderdate) <> 2004) group by all")
def orders_in_scope(spark: SparkSession, d: str) -> DataFrame:
    years = scope.ingest_years(scope.election_years(spark, 2025), 1824, [2004])
    counted = B.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return scope.in_scope(counted, years)[0]


@query("""with y as (select unnest(generate_series(1792, 2003, 4))::int as year union all select 1789) select year from y where year >= 1900 and year <> 1996 and year not in (select year(o_orderdate) from orders)""")
def years_missing(spark: SparkSession, d: str) -> DataFrame:
    years = scope.ingest_years(scope.election_years(spark, 2003), 1900, [1996])
    return scope.in_scope(B.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")), years)[1].violations


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """An override for each large order's nation: statuses that there are not, that change nothing, reasons of blanks, and a cell twice."""
    cells = B.counted_votes(spark, d).where("year in (1996, 1997)")
    status = F.when(F.col("candidate") == "BUILDING", "not-counted").when(F.col("candidate") == "MACHINERY", "counted").otherwise("disputed")
    told = cells.select("year", "state", "candidate", status.alias("count_status"), F.when(F.col("state") < "NATION_15", "why").otherwise("  ").alias("count_status_reason"))
    return told.unionByName(told.where("candidate = 'FURNITURE' and year = 1996"))


OVERRIDES = B.SQL + """, o as (select year, state, candidate, case candidate when 'BUILDING' then 'not-counted' when 'MACHINERY' then 'counted' else 'disputed' end as s, case when state < 'NATION_15' then 'why' else '' end as r,
  case when candidate = 'FURNITURE' and year = 1996 then 2 else 1 end as n from pv where year in (1996, 1997))
"""


@query(OVERRIDES + """, v as (select 'override_status_unknown' as "constraint", n from o where s = 'not-counted' union all select 'override_changes_nothing', n from o where s = 'counted'
 union all select 'override_without_reason', n from o where r = '' union all select 'override_twice', 1 from o where n > 1)
select "constraint", sum(n)::bigint as n_violations from v group by all""")
def overrides_broken(spark: SparkSession, d: str) -> DataFrame:
    return C.violations(scope.overrides_well_formed(overrides(spark, d))).drop("example")


@query(OVERRIDES + "select year, state, candidate from pv where candidate_votes % 4 = 0 and year in (1995, 1996) and (year, state, candidate) not in (select year, state, candidate from o)")
def unprinted_but_counted(spark: SparkSession, d: str) -> DataFrame:
    unprinted = B.counted_votes(spark, d).where("candidate_votes % 4 = 0 and year in (1995, 1996)")
    return scope.unprinted_are_uncounted(unprinted, overrides(spark, d)).violations


@query(B.SQL + "select year, state, candidate_id from joined where year = 1999 and president_electoral_votes_counted + 1 > president_electoral_votes")
def counted_beyond_cast(spark: SparkSession, d: str) -> DataFrame:
    more = F.col("president_electoral_votes_counted") + F.when(F.col("year") == 1999, 1).otherwise(0)
    return scope.counted_within_cast(B.joined(spark, d).withColumn("president_electoral_votes_counted", more)).violations.select("year", "state", "candidate_id")


@query(B.SQL + "select year, state, pv_status from roster where year > 1996")
def roster_agreed(spark: SparkSession, d: str) -> DataFrame:
    one = B.roster(spark, d)
    other = one.withColumns({"source": F.lit("other"), "pv_status": F.lit("not_participating")})
    return scope.agreeing_roster(one.unionByName(other).unionByName(one), ["ballots"]).where("year > 1996")


@query(TWO + "select source, case source when 'OLD' then 'by hand' end as license, count(*) as n_rows from u group by all")
def licenses_shown(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("OLD", "by hand"), ("NONE", "free")], "source string, license string")
    return scope.licenses(loaded(spark, d)[0].read(), known)[0]


@query(ROWS.split(", snap as")[0] + """, held as (select year, state, candidate_id from joined where source is not null and year >= 1996)
select j.year, j.state, 'N' || ev.n_nationkey as state_usps, candidate, lower(candidate) as candidate_slug, case when h.year is not null then 'NEW' end as source, case when h.year is not null then candidate_votes end as candidate_votes, pv_status
from joined j join ev using (state) join roster r on r.year = j.year and r.state = j.state left join held h on h.year = j.year and h.state = j.state and h.candidate_id = j.candidate_id where j.year = 1996""")
def published_view(spark: SparkSession, d: str) -> DataFrame:
    """From the loaded facts to a served snapshot: views, public roster, publish, read."""
    facts, _, sources = loaded(spark, d)
    versioned.build_views(facts, sources)
    spine = B.spine(spark, d)
    versioned.join_views(spark, spine, B.candidates(spark, d), sources)
    part = versioned.participation(spine)
    absent = B.roster(spark, d).where("pv_status <> 'popular_vote'").select("year", "state", "pv_status", "note")
    roster = scope.public_roster(part, absent, part.select("year").distinct())
    codes = B.electors(spark, d).select("state", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("state_usps"))
    root = new_path(spark, "snapshot")
    publish.publish(spark, root, publish.snapshot_rows(versioned.read_view(spark, "ec_pv_redistributable"), roster, codes, ["NEW"]), "2000-01-01", floor=1996)
    return Snapshot.open(spark, root).election(1996)[0].select("year", "state", "state_usps", "candidate", "candidate_slug", "source", "candidate_votes", "pv_status")


# --- pages of every layout ---

#: Layouts by year modulo 5.
LAYOUTS = ["stacked", "stacked without spans", "three rows", "names first", "fused"]


def pages_of_layouts(spark: SparkSession, d: str) -> DataFrame:
    """(page, html): a layout a year, marks of absence, a column of others, and a block below the totals."""
    cells = B.counted_votes(spark, d).join(B.candidates(spark, d).withColumnRenamed("name", "candidate"), "candidate")
    cells = cells.withColumn("v", F.when(~((F.col("candidate_id") == 5) & (F.col("candidate_votes") % 3 == 0)), F.col("candidate_votes")))
    wide = F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "v"))), lambda x: x["v"])
    states = cells.groupBy("year", "state").agg(wide.alias("c"), F.sum("v").alias("total")).where(F.size("c") == 5)
    columns = [F.sum(F.get("c", F.lit(k))) for k in range(5)]
    totals = states.groupBy("year").agg(F.array(*columns).alias("c"), F.sum("total").alias("total")).select("year", F.lit("TOTALS").alias("state"), "c", "total", F.lit(1).alias("last"))
    tenths = lambda v, total: F.floor(v * 1000 / total + 0.5)
    percent = lambda v, total: F.concat((tenths(v, total) / 10).cast("long").cast("string"), F.lit("."), (tenths(v, total) % 10).cast("string"), F.lit("%"))
    cell = lambda v: F.concat(F.lit("<td>"), F.coalesce(F.format_number(v, 0), F.lit(" --")), F.lit("<td>"), F.coalesce(percent(v, F.col("total")), F.lit("-")), F.lit("<td>-"))
    every = states.withColumn("last", F.lit(0)).unionByName(totals)
    rows = every.select("year", "last", "state", F.concat(F.lit("<tr><td>"), "state", F.lit("<td>"), F.format_number("total", 0), F.array_join(F.transform("c", cell), ""), F.lit("</tr>")).alias("tr"))
    body = rows.groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "state", "tr"))), lambda x: x["tr"]), "\n").alias("body"))
    names = B.candidates(spark, d).agg(F.array_sort(F.collect_list(F.struct("candidate_id", "name"))).alias("n"))
    return body.crossJoin(names).select(F.col("year").cast("string").alias("page"), F.concat(F.lit("<table>"), _head(F.col("year") % 5), "body", F.lit(_BLOCK)).alias("html"))


_BLOCK = "<tr><td>PARTY<td>NOMINEES<td>x</tr><tr><td>Blue<td>Ann<td>7<td>1%<td>0</tr></table>"


def _head(layout: Column) -> Column:
    across = lambda f, tag="<td colspan=3>": F.array_join(F.transform("n", lambda x: F.concat(F.lit(tag), f(x))), "")
    name = lambda x: F.when(x["candidate_id"] == 4, "Others").otherwise(F.initcap(x["name"]))
    party = lambda x: F.concat(F.lit("P "), F.lower(x["name"]))
    fused = lambda x: F.concat(name(x), F.lit("<br>"), party(x))
    units = across(lambda x: F.lit(""), "<td>Votes<td>%<td>EV")
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.lit(c) if isinstance(c, str) else c for c in cells], F.lit("</tr>"))
    heads = [
        F.concat(row("<td>STATE<td>TOTAL VOTE", across(party)), row(across(name)), row(units)),
        F.concat(row("<td>STATE<td>TOTAL VOTE", across(party, "<td>")), row(across(name, "<td>")), row(units)),
        F.concat(row("<td>", across(name)), row("<td><td>TOTAL VOTES", across(party)), row("<td>STATE", units)),
        F.concat(row("<td>", across(name)), row("<td>STATE<td>TOTAL VOTE", across(party)), row(units)),
        F.concat(row("<td>", across(fused)), row("<td>STATE<td>TOTAL", units)),
    ]
    return F.element_at(F.array(*heads), layout + 1)


@query(B.SQL + """, c as (select year, state, candidate_id, candidate, case when not (candidate_id = 5 and candidate_votes % 3 = 0) then candidate_votes end as v from pv join cand using (candidate)),
w as (select year, state, sum(v)::bigint as total from c group by all having count(*) = 5)
select year::varchar as page, state as label, upper(candidate[1]) || lower(candidate[2:]) as name, 'P ' || lower(candidate) as party, total as total_votes, v as votes, floor(v * 1000 / total + 0.5) / 10 as percent
from c join w using (year, state) where v is not null and candidate_id <> 4""")
def layout_votes(spark: SparkSession, d: str) -> DataFrame:
    return pages.popular_votes_of_pages(pages_of_layouts(spark, d))[0]
