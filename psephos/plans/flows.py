"""Whole flows as queries: year records flattened, a delimited file and result pages written and read, a snapshot published
and served. The files are made of the driver's tables, so that SQL over these says what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import corrections as K
from psephos.operators import reshape, resolution
from psephos.plans import ballots as B
from psephos.plans.registry import query
from psephos.plans.serving import Snapshot
from psephos.schemas import CSV_COLUMNS
from psephos.shared import new_path
from psephos.sources import delimited, pages, publish

# --- nested year records ---


def year_records(spark: SparkSession, d: str) -> DataFrame:
    """One nested record a year; what is gathered in a record is a nation's segments and a year's nations."""
    votes, names = B.counted_votes(spark, d), B.candidates(spark, d)
    cells = votes.join(names.withColumnRenamed("name", "candidate"), "candidate")
    states = cells.groupBy("year", "state").agg(F.sum("candidate_votes").cast("int").alias("total_electoral_votes"), F.map_from_entries(F.collect_list(F.struct(F.col("candidate_id"), F.col("candidate_votes").cast("int")))).alias("votes"))
    rows = states.groupBy("year").agg(F.collect_list(F.struct("state", "total_electoral_votes", "votes")).alias("votes_by_state"))
    across = names.agg(
        F.collect_list(F.struct(F.col("name").alias("president_candidate_name"), F.lower("name").alias("president_candidate_party"))).alias("t1"),
        F.collect_list(F.struct(F.col("name").alias("president_candidate_name"), F.col("candidate_id").alias("col_ind"), F.when(F.col("candidate_id") > 1, F.initcap("name")).alias("president_candidate_state"))).alias("candidate_state"),
    )
    return rows.crossJoin(across).select("year", "t1", F.struct("candidate_state", "votes_by_state").alias("t2"))


CELLS = B.SQL + ", cells as (select year, state, candidate, candidate_id, sum(candidate_votes) over (partition by year, state)::int as total_electoral_votes, candidate_votes::int as votes from pv join cand using (candidate))"


@query(CELLS + " select year, state, total_electoral_votes, candidate_id as col_ind, votes from cells")
def record_cells(spark: SparkSession, d: str) -> DataFrame:
    return reshape.vote_cells(year_records(spark, d))


@query(CELLS + " select year, state, candidate, total_electoral_votes, votes as president_electoral_votes from cells")
def record_fact(spark: SparkSession, d: str) -> DataFrame:
    return reshape.votes_fact(year_records(spark, d))


@query(B.SQL + "select year, candidate as president_candidate_name, candidate_id as col_ind, case when candidate_id > 1 then upper(candidate[1]) || lower(candidate[2:]) end as president_candidate_state from cand cross join (select distinct year from pv)")
def record_columns(spark: SparkSession, d: str) -> DataFrame:
    return reshape.candidate_columns(year_records(spark, d))


@query(B.SQL + "select year, candidate as president_candidate_name, lower(candidate) as president_candidate_party from cand cross join (select distinct year from pv)")
def record_parties(spark: SparkSession, d: str) -> DataFrame:
    return reshape.candidate_parties(year_records(spark, d))


@query("select c_custkey, c_mktsegment from customer where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey, 'SUPPLIER' from supplier")
def placeholder_rows(spark: SparkSession, d: str) -> DataFrame:
    named = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"))
    return resolution.replace_rows(B.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), named, ["c_custkey"])


# --- a printed grid and its corrections ---


def printed_grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, K.Catalog]:
    """In 1995 and 1997 column 1 stands for two people, and some states' split of 1995 is lost; in 1996 the early states
    have votes and electors that are not printed, and the printed allotment is off by one."""
    names = B.candidates(spark, d)
    early, lumped = F.col("state") < "NATION_15", F.col("year").isin(1997, 1995)
    states = B.counted_votes(spark, d).join(names.withColumnRenamed("name", "candidate"), "candidate").select("year", "state", F.col("candidate_id").alias("col_ind"), F.col("candidate_votes").alias("votes"))
    totals = states.groupBy("year", "col_ind").agg(F.sum("votes").alias("votes")).withColumn("state", F.lit(K.TOTALS))
    held = states.groupBy("year", "state").agg(F.sum("votes").alias("electors")).withColumn("electors", F.when((F.col("year") == 1996) & early, 0).otherwise(F.col("electors")))
    sums = held.groupBy("year").agg((F.sum("electors") + F.when(F.col("year") == 1996, 1).otherwise(0)).alias("electors")).withColumn("state", F.lit(K.TOTALS))
    columns = states.select("year", "col_ind").distinct().join(names.withColumnRenamed("candidate_id", "col_ind"), "col_ind")
    columns = columns.select("year", "col_ind", "name", F.when(~(lumped & (F.col("col_ind") == 1)), F.col("name")).alias("home"))
    half = F.floor(F.col("votes") / 2)
    split = states.where(lumped & (F.col("col_ind") == 1) & ~((F.col("year") == 1995) & early))
    shares = split.withColumn("votes", half).unionByName(split.withColumns({"col_ind": F.lit(6), "votes": F.col("votes") - half}))
    late = held.where((F.col("year") == 1996) & early).select("year", "state")
    catalog = K.Catalog(
        spark.createDataFrame([(y, c, n, n) for y in (1997, 1995) for c, n in ((1, "ANN"), (6, "BOB"))], "year int, col_ind int, name string, home string"),
        shares, late.select("year", "state", F.lit("BUILDING").alias("name"), F.lit(3).alias("votes")), late.select("year", "state", F.lit(5).cast("long").alias("electors")),
    )
    return states.unionByName(totals), held.unionByName(sums), columns, catalog


PRINTED = B.SQL + ", printed as (select year, state, candidate_id as col_ind, candidate_votes as votes from pv join cand using (candidate)), lumps as (select * from printed where col_ind = 1 and (year = 1997 or (year = 1995 and state >= 'NATION_15')))"


@query(PRINTED + """, every as (select * from printed where not (col_ind = 1 and year in (1997, 1995))
  union all select year, state, c, 0 from places, (values (1), (6)) v(c) where year in (1997, 1995)
  union all select year, state, 1, votes // 2 from lumps union all select year, state, 6, votes - votes // 2 from lumps
  union all select year, state, candidate_id, 3 from places, cand where year = 1996 and state < 'NATION_15' and candidate = 'BUILDING'),
fixed as (select year, state, col_ind, sum(votes)::bigint as votes from every group by all)
select * from fixed union all select year, 'Totals', col_ind, sum(votes)::bigint from fixed group by all""")
def corrected_cells(spark: SparkSession, d: str) -> DataFrame:
    cells, allotments, columns, catalog = printed_grid(spark, d)
    return K.corrected_cells(cells, allotments, columns, catalog)


@query(PRINTED + """, held as (select year, state, case when year = 1996 and state < 'NATION_15' then 5 else sum(votes) end::bigint as electors from printed group by year, state)
select * from held union all select year, 'Totals', sum(electors)::bigint from held group by all""")
def corrected_allotments(spark: SparkSession, d: str) -> DataFrame:
    _, allotments, _, catalog = printed_grid(spark, d)
    return K.corrected_allotments(allotments, catalog)


@query(PRINTED + """, held as (select state, sum(votes)::bigint as electors from printed where year = 1996 group by all)
select 1995::int as year, 'split' as rule, null::int as col_ind, sum(votes)::bigint as printed, 0::bigint as catalogued, sum(case when state >= 'NATION_15' then votes else 0 end)::bigint as corrected
  from printed where year = 1995 and col_ind = 1 having sum(case when state < 'NATION_15' then votes else 0 end) > 0
union all select 1996, 'appointed', null, sum(case when state >= 'NATION_15' then electors else 0 end)::bigint + 1, 5 * count(*) filter (state < 'NATION_15'), sum(case when state >= 'NATION_15' then electors else 5 end)::bigint
  from held having count(*) filter (state < 'NATION_15') > 0""")
def corrections_unreconciled(spark: SparkSession, d: str) -> DataFrame:
    return K.unreconciled(*printed_grid(spark, d)).violations


@query(B.SQL + "select year, candidate, sum(president_electoral_votes)::bigint as president_electoral_votes from dense where year in (1996, 1997) group by all")
def electoral_getters(spark: SparkSession, d: str) -> DataFrame:
    votes = resolution.with_totals(B.spine(spark, d).drop("is_total"), ["year", "candidate_id"], ["president_electoral_votes"])
    return resolution.electoral_getters(votes, B.candidates(spark, d), [1996, 1997])


# --- a delimited file, written and read ---

LINES = B.SQL + """, lines as (select year, state, case when candidate = 'FURNITURE' and o_orderstatus = 'P' then null else candidate || ', "A."' end as candidate,
  case o_orderstatus when 'F' then 'DEMOCRAT' when 'O' then 'REPUBLICAN' else 'OTHER' end as party, candidate_votes as v,
  (sum(candidate_votes) over (partition by year, state) + case when year = 1995 then 7 else 0 end)::bigint as total from byc),
one as (select year, state, candidate, min_by(party, struct_pack(a := -v, b := party)) as party, sum(v)::bigint as v, max(total) as total from lines where candidate is not null group by all)
select 'FILE' as source, year, upper(state[1]) || lower(state[2:]) as state, candidate || '!' as candidate, party, v as candidate_votes, total as state_total_votes, 'exact' as reliability from one where party in ('DEMOCRAT', 'REPUBLICAN')"""


def written_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(lines of a file as text, known differences). Lines of several parties a candidate, doubled quotes, rows without a candidate,
    and totals that are off by a known difference in one year."""
    votes = B.popular(spark, d)
    totals = votes.groupBy("year", "state").agg((F.sum("candidate_votes") + F.when(F.col("year") == 1995, 7).otherwise(0)).alias("totalvotes"))
    party = F.when(F.col("o_orderstatus") == "F", "DEMOCRAT").when(F.col("o_orderstatus") == "O", "REPUBLICAN").otherwise("OTHER")
    nobody = (F.col("candidate") == "FURNITURE") & (F.col("o_orderstatus") == "P")
    lines = votes.join(totals, ["year", "state"]).select(
        "year", "state", F.when(~nobody, F.concat("candidate", F.lit(', "A."'))).alias("candidate"), party.alias("party_simplified"), F.col("o_orderstatus").alias("party_detailed"),
        F.lit("FALSE").alias("writein"), F.col("candidate_votes").alias("candidatevotes"), "totalvotes",
    )
    path = new_path(spark, "results-csv")
    lines.select(*[F.col(c) if c in lines.columns else F.lit("x").alias(c) for c in CSV_COLUMNS]).write.option("header", True).option("escape", '"').csv(path)
    return delimited.read_csv(spark, path), totals.where("year = 1995").select("year", "state", F.lit(7).cast("long").alias("difference"))


@query(LINES)
def delimited_votes(spark: SparkSession, d: str) -> DataFrame:
    raw, off = written_lines(spark, d)
    states = raw.select(F.col("state").alias("native"), F.initcap("state").alias("canonical")).distinct()
    names = raw.where("candidate is not null").select(F.col("candidate").alias("native"), F.concat("candidate", F.lit("!")).alias("canonical")).distinct()
    return delimited.popular_votes(raw, "FILE", states, names, exceptions=off)


# --- result pages, written and parsed ---


def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page, html): one results table a year, with names, parties, a legislature's row, an asterisk, a note over the whole width and totals."""
    cells = B.counted_votes(spark, d).join(B.candidates(spark, d).withColumnRenamed("name", "candidate"), "candidate")
    across = cells.groupBy("year").agg(F.count_distinct("candidate").alias("n"))
    wide = F.array_sort(F.collect_list(F.struct("candidate_id", "candidate", "candidate_votes")))
    states = cells.groupBy("year", "state").agg(wide.alias("c"), F.sum("candidate_votes").alias("total")).join(across, "year").where(F.size("c") == F.col("n"))
    sums = states.select("year", "total", F.explode("c").alias("c")).groupBy("year", "c.candidate_id", "c.candidate").agg(F.sum("c.candidate_votes").alias("candidate_votes"))
    totals = sums.groupBy("year").agg(wide.alias("c"), F.sum("candidate_votes").alias("total")).select("year", F.lit("Totals").alias("state"), "c", "total", F.lit(1).alias("last"))

    def row(label, c, total):
        return F.concat(F.lit("<tr><td>"), label, F.lit("</td><td>"), F.format_number(total, 0), F.lit("</td>"), F.array_join(F.transform(c, lambda x: F.concat(
            F.lit("<td>"), F.format_number(x["candidate_votes"], 0), F.lit("</td><td>"), F.format_string("%.1f%%", x["candidate_votes"] * 100 / total), F.lit("</td><td>-"))), ""), F.lit("</tr>"))

    every = states.select("year", "state", "c", "total", F.lit(0).alias("last")).unionByName(totals)
    rows = every.select("year", "last", "state", "c", row(F.when(F.col("last") == 0, F.concat("state", F.lit(" *"))).otherwise(F.col("state")), F.col("c"), F.col("total")).alias("tr"))
    page = rows.groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "state", "tr"))), lambda x: x["tr"]), "\n").alias("body"), F.max(F.when(F.col("last") == 1, F.col("c"))).alias("c"))
    n = F.size("c")
    head = lambda f: F.array_join(F.transform("c", lambda x: F.concat(F.lit("<th colspan=3>"), f(x["candidate"]), F.lit("</th>"))), "")
    parties, names = head(F.lower), head(F.initcap)
    across = (2 + 3 * n).cast("string")
    html = F.concat(
        F.lit("<html><table><tr><td>menu</td></tr></table><table>\n<tr><th rowspan=2>STATE</th><th rowspan=2>TOTAL VOTES</th>"), parties, F.lit("</tr>\n<tr>"), names, F.lit("</tr>\n<tr>"),
        F.repeat(F.lit("<td>Votes<td>%<td>EV"), n), F.lit("</tr>\n"), F.col("body"), F.lit("<tr><td>Elsewhere</td><td colspan="), (1 + 3 * n).cast("string"), F.lit(">chosen by the legislature</td></tr><tr><td colspan="), across,
        F.lit(">figures as published</td></tr></table></html>"),
    )
    return page.select(F.col("year").cast("string").alias("page"), html.alias("html"))


PAGES = B.SQL + """, across as (select year, count(distinct candidate) as n from pv group by all),
whole as (select year, state, sum(candidate_votes)::bigint as total from pv join across using (year) group by year, state, n having count(*) = n)
"""


@query(PAGES + "select year::varchar as page, state as label, upper(candidate[1]) || lower(candidate[2:]) as name, lower(candidate) as party, total as total_votes, candidate_votes as votes from pv join whole using (year, state)")
def page_votes(spark: SparkSession, d: str) -> DataFrame:
    return pages.popular_votes_of_pages(result_pages(spark, d))[0].drop("percent")


@query(PAGES + "select distinct year::varchar as page, 'Elsewhere' as label, 'legislature_chosen' as pv_status, 'chosen by the legislature' as note from whole")
def page_statuses(spark: SparkSession, d: str) -> DataFrame:
    return pages.popular_votes_of_pages(result_pages(spark, d))[1]


@query("select url as page from pages where page_id % 7 <> 0 and page_id % 5 = 0 and url not in (select url from pages where page_id % 5 <> 0)")
def pages_missing(spark: SparkSession, d: str) -> DataFrame:
    found = B.table(spark, d, "pages").select("page_id", F.col("url").alias("page"))
    manifest = found.select("page", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("http_status"))
    return pages.complete_corpus(manifest, found.where("page_id % 5 <> 0")).violations


# --- a snapshot, published and served ---


def served(spark: SparkSession, d: str) -> Snapshot:
    joined, roster = B.election(spark, d)
    codes = B.electors(spark, d).select("state", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("state_usps"))
    root = new_path(spark, "snapshot")
    publish.publish(spark, root, publish.snapshot_rows(joined, roster, codes, ["ballots"]), "2000-01-01")
    return Snapshot.open(spark, root)


ROWS = B.SQL + """, snap as (select j.year, j.state, 'N' || ev.n_nationkey as state_usps, candidate, lower(candidate) as candidate_slug, total_electoral_votes, president_electoral_votes, national_electoral_votes,
  president_electoral_rank, took_office, source, party, candidate_votes, state_total_votes, reliability, pv_status, president_electoral_votes_counted, national_counted_electoral_votes, count_status, count_status_reason
  from joined j join ev using (state) join roster r on r.year = j.year and r.state = j.state)
"""


@query(ROWS + "select * from snap where year = 1995 and state_usps = 'N4'")
def served_election(spark: SparkSession, d: str) -> DataFrame:
    return served(spark, d).election(1995, "n4")[0]


@query(ROWS + "select * from snap where state_usps = 'N6' and year between 1996 and 1998")
def served_state(spark: SparkSession, d: str) -> DataFrame:
    return served(spark, d).state("N6", 1996, 1998)


@query(ROWS + "select * from snap where candidate_slug = 'building' and year >= 1996")
def served_candidate(spark: SparkSession, d: str) -> DataFrame:
    return served(spark, d).candidate("BUILDING", 1996)


@query(B.SQL + "select year, count(distinct candidate) as n_candidates, count(candidate_votes) > 0 as has_popular_vote from joined where year <= 1996 group by all")
def served_years(spark: SparkSession, d: str) -> DataFrame:
    return served(spark, d).years(None, 1996)


@query(B.SQL + """select j.year, candidate, lower(candidate) as candidate_slug, min(party) as party, min(national_electoral_votes) as national_electoral_votes, min(president_electoral_rank) as president_electoral_rank, bool_or(took_office) as took_office,
  sum(candidate_votes)::bigint as national_pv_votes, min(national_pv_denominator) as national_pv_denominator, min(national_counted_electoral_votes) as national_counted_electoral_votes, min(ec_denominator) as national_electoral_denominator
from joined j join pvden using (year) join den using (year) where year = 1996 group by all""")
def served_summary(spark: SparkSession, d: str) -> DataFrame:
    return served(spark, d).summary(1996)
