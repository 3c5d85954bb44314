"""Pages of electoral votes as queries: written of the driver's tables with the marks such pages have, parsed, and held against SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import reshape
from psephos.plans import ballots as B
from psephos.plans.registry import query
from psephos.sources import electoral_pages as E

#: Years whose totals label is a header cell; years with a second totals row that leaves a state out.
IN_HEADER, WITH_DECOY = (1996, 1998, 2000), (1997, 1998)


def _cell(votes: Column) -> Column:
    """0 is a dash, a multiple of 5 is in parentheses."""
    text = votes.cast("string")
    return F.when(votes == 0, "-").when(votes % 5 == 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def _row(start: Column, allotment: Column, votes: Column) -> Column:
    """A row with the president's columns and, as pages have them, as many of the vice-president's."""
    tds = lambda f: F.array_join(F.transform(votes, lambda v: F.concat(F.lit("<td>"), f(v), F.lit("</td>"))), "")
    return F.concat(F.lit("<tr>"), start, F.lit("<td>"), allotment.cast("string"), F.lit("<sup>9</sup></td>"), tds(_cell), tds(lambda v: F.lit("(77)")), F.lit("</tr>"))


def printed(spark: SparkSession, d: str, decoys: str = "one") -> DataFrame:
    """(page, html) a year. decoys: one totals row matches the states (one), or all of several do (all), or none does (none)."""
    votes, names = B.counted_votes(spark, d), B.candidates(spark, d).withColumnRenamed("name", "candidate")
    # Years x nations x segments, all three of them small dimensions.
    grid = votes.select("year", "state").distinct().crossJoin(names).join(votes, ["year", "state", "candidate"], "left")
    states = grid.groupBy("year", "state").agg(F.array_sort(F.collect_list(F.struct("candidate_id", F.coalesce("candidate_votes", F.lit(0)).alias("v")))).alias("c"))
    states = states.select("year", "state", F.transform("c", lambda c: c["v"]).alias("votes"), F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + c["v"]).alias("electors"))
    sums = states.select("year", "electors", F.posexplode("votes").alias("k", "v")).groupBy("year", "k").agg(F.sum("v").alias("v"))
    totals = sums.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c")).select("year", F.transform("c", lambda c: c["v"]).alias("votes"))
    totals = totals.withColumn("electors", F.aggregate("votes", F.lit(0).cast("long"), lambda s, v: s + v))
    in_header = F.col("year").isin(*IN_HEADER)
    mark = F.when(in_header, F.concat(F.lit("<th>Totals"), F.col("mark"), F.lit("</th>"))).otherwise(F.lit("<td>Totals</td>"))
    off = {"one": [0, 1], "all": [0, 0], "none": [2, 1]}[decoys]
    first = totals.select("year", F.lit(2).alias("last"), F.lit("").alias("state"), (F.col("electors") + off[0]).alias("electors"), "votes", F.lit(" (including all)").alias("mark"))
    second = totals.where(F.col("year").isin(*WITH_DECOY)).select("year", F.lit(1).alias("last"), F.lit("").alias("state"), (F.col("electors") - off[1]).alias("electors"), "votes", F.lit(" (excluding one)").alias("mark"))
    every = states.select("year", F.lit(0).alias("last"), "state", "electors", "votes", F.lit("").alias("mark")).unionByName(first).unionByName(second)
    label = F.when(F.col("last") > 0, mark).otherwise(F.concat(F.lit("<td>"), "state", F.lit("&nbsp;<sup>1</sup>*</td>")))
    trs = every.select("year", "last", "state", _row(label, F.col("electors"), F.col("votes")).alias("tr"))
    body = trs.groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", "state", "tr"))), lambda x: x["tr"]), "\n<tr></tr>").alias("body"))
    across = names.agg(F.array_sort(F.collect_list(F.struct("candidate_id", "candidate"))).alias("c"))
    first_names, n = F.transform("c", lambda c: F.initcap(c["candidate"])), F.size("c").cast("string")
    td = lambda name, k: F.concat(F.lit("<td>"), F.when(k == F.size("c") - 1, F.lit("Others *")).otherwise(F.concat(name, F.lit(" J., Jr.,<br>of  Land of"), name)), F.lit("</td>"))
    heads = F.array_join(F.transform(first_names, td), "")
    opponents = F.concat(F.lit("<table><tr><th>President</th><td>"), F.get(first_names, F.lit(0)), F.lit(" J., Jr. * [Red]</td></tr><tr><th>Main Opponent</th><td>"), F.get(first_names, F.lit(1)), F.lit(" J., Jr. [Deep Blue] *</td></tr><tr><th>Vote</th><td>x</td></tr></table>"))
    html = F.concat(
        F.lit("<table><tr><td>menu</td></tr></table>"), opponents, F.lit("<table><tr><th>State</th><th>Electors</th><th colspan="), n, F.lit(">For President</th><th colspan="), n, F.lit(">For Vice-President</th></tr>\n<tr><th></th><th></th>"), heads, heads, F.lit("</tr>"),
        F.col("body"), F.lit("<tr><td colspan=12>Total votes are as the certificates have them, 7 notes</td></tr></table>"),
    )
    return body.crossJoin(across).select(F.col("year").cast("string").alias("page"), html.alias("html"))


def parsed(spark: SparkSession, d: str, decoys: str = "one") -> E.ElectoralPages:
    return E.electoral_pages(printed(spark, d, decoys), B.electors(spark, d).select("state"))


GRID = B.SQL + """, grid as (select p.year, p.state, c.candidate, c.candidate_id as col_ind, coalesce(v.candidate_votes, 0)::bigint as votes from places p cross join cand c left join pv v using (year, state, candidate)),
rows as (select year, state, col_ind, votes from grid union all select year, 'Totals', col_ind, sum(votes)::bigint from grid group by all)
"""


@query(GRID + "select year, state, sum(votes) over (partition by year, state)::int as total_electoral_votes, col_ind, votes::int as votes from rows")
def electoral_page_votes(spark: SparkSession, d: str) -> DataFrame:
    return reshape.vote_cells(E.year_records(parsed(spark, d)))


@query(GRID + """select year, case when candidate_id < (select max(candidate_id) from cand) then upper(candidate[1]) || lower(candidate[2:]) || ' J. Jr.' else 'Others' end as president_candidate_name, candidate_id as col_ind,
  case when candidate_id < (select max(candidate_id) from cand) then 'Land of' || upper(candidate[1]) || lower(candidate[2:]) end as president_candidate_state from cand cross join (select distinct year from pv)""")
def electoral_page_columns(spark: SparkSession, d: str) -> DataFrame:
    return reshape.candidate_columns(E.year_records(parsed(spark, d)))


@query(GRID + """select year, upper(candidate[1]) || lower(candidate[2:]) || ' J. Jr.' as president_candidate_name, case candidate_id when 1 then 'Red' else 'Deep Blue' end as president_candidate_party
from cand cross join (select distinct year from pv) where candidate_id <= 2""")
def electoral_page_parties(spark: SparkSession, d: str) -> DataFrame:
    return reshape.candidate_parties(E.year_records(parsed(spark, d)))


@query(GRID + f"select year, state, col_ind from rows where votes > 0 and votes % 5 = 0 union all select year, state, col_ind from rows where state = 'Totals' and votes > 0 and votes % 5 = 0 and year in {WITH_DECOY}")
def electoral_page_contested(spark: SparkSession, d: str) -> DataFrame:
    years = E.year_records(parsed(spark, d))
    return years.select("year", F.explode("t2.contested_cells").alias("c")).select("year", "c.*")


def _undecided(spark: SparkSession, d: str, decoys: str) -> DataFrame:
    return next(c for c in parsed(spark, d, decoys).constraints if c.name == "totals_row_undecided").violations


@query(GRID + f"select year::varchar as page, 2::bigint as n_printed, 2::bigint as n_matching, sum(votes)::bigint as summed from grid where year in {WITH_DECOY} group by all")
def totals_rows_all_match(spark: SparkSession, d: str) -> DataFrame:
    return _undecided(spark, d, "all")


@query(GRID + f"select year::varchar as page, 2::bigint as n_printed, 0::bigint as n_matching, sum(votes)::bigint as summed from grid where year in {WITH_DECOY} group by all")
def totals_rows_none_matches(spark: SparkSession, d: str) -> DataFrame:
    return _undecided(spark, d, "none")
