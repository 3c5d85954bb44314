"""Checked loads, the resolved views, and a corpus read by its manifest, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from psephos import constraints as C
from psephos.operators import resolution as R
from psephos.plans import ballots as B
from psephos.plans.flows import PAGES, result_pages
from psephos.plans.registry import query
from psephos.schemas import JOINED_COLUMNS, PV, PV_COLUMNS
from psephos.shared import new_path
from psephos.sources import corpus, pages, versioned

NATURAL_KEY = ("source", "year", "state", "candidate")


def fact_table(spark: SparkSession, name: str = "facts") -> versioned.Table:
    return versioned.Table(spark, new_path(spark, name), StructType.fromDDL(PV), NATURAL_KEY)


def two_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old, new, sources): the same votes by two sources; the old one ends in 1997 and has one vote more a row, the new one begins in 1996."""
    whole = B.resolved(spark, d).select(*PV_COLUMNS)
    old = whole.where("year <= 1997").withColumns({"source": F.lit("OLD"), "candidate_votes": F.col("candidate_votes") + 1})
    sources = spark.createDataFrame([("OLD", 2, False), ("NEW", 1, True), ("NONE", 3, True)], "source string, precedence_rank int, redistributable boolean")
    return old, whole.where("year >= 1996").withColumn("source", F.lit("NEW")), sources


def loaded(spark: SparkSession, d: str) -> tuple[versioned.Table, list[dict], DataFrame]:
    """Facts after four loads: the old source, it again, both of them, and the last one replaced by nothing new."""
    old, new, sources = two_sources(spark, d)
    facts = fact_table(spark)
    described = lambda rows: [C.references(rows, sources, ["source"], "source_not_described")]
    told = [facts.load(old, described), facts.load(old.where("year = 1995"), described), facts.load(old.unionByName(new), described), facts.load(new, described)]
    return facts, told, sources


TWO = B.SQL + """, o as (select 'OLD' as source, year, state, candidate, lower(candidate) as party, candidate_votes + 1 as candidate_votes, state_total_votes, 'exact' as reliability, 2 as rank from res where year <= 1997),
n as (select 'NEW' as source, year, state, candidate, lower(candidate) as party, candidate_votes, state_total_votes, 'exact' as reliability, 1 as rank from res where year >= 1996), u as (select * from o union all select * from n)
"""


@query(TWO + "select source, year, state, candidate, party, candidate_votes, state_total_votes, reliability from u")
def loaded_facts(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d)[0].read()


@query(TWO + """select 1::bigint as version, count(*) as received, count(*) as added, 1 as step from o union all select 1, count(*), 0, 2 from o where year = 1995
union all select 2, (select count(*) from u), count(*), 3 from n union all select 2, count(*), 0, 4 from n""")
def load_receipts(spark: SparkSession, d: str) -> DataFrame:
    told = loaded(spark, d)[1]
    return spark.createDataFrame([(t["version"], t["received"], t["added"], k) for k, t in enumerate(told, 1)], "version long, received long, added long, step int")


@query(TWO + "select source, year, state, candidate, party, candidate_votes, state_total_votes, reliability from u qualify row_number() over (partition by year, state, candidate order by rank) = 1")
def view_preferred(spark: SparkSession, d: str) -> DataFrame:
    facts, _, sources = loaded(spark, d)
    versioned.build_views(facts, sources)
    return versioned.read_view(spark, "pv_preferred")


_ON_SPINE = ", ".join({"source": "v.source", "party": "v.party", "candidate_votes": "v.candidate_votes", "state_total_votes": "v.state_total_votes", "reliability": "v.reliability", "redistributable": "case when v.source is not null then true end as redistributable"}.get(c, f"j.{c}") for c in JOINED_COLUMNS)


@query(TWO + f"select {_ON_SPINE} from joined j left join n v on v.year = j.year and v.state = j.state and v.candidate = j.candidate where j.year in (1995, 1996, 1997)")
def view_joined_redistributable(spark: SparkSession, d: str) -> DataFrame:
    facts, _, sources = loaded(spark, d)
    versioned.build_views(facts, sources)
    versioned.join_views(spark, B.spine(spark, d), B.candidates(spark, d), sources)
    return versioned.read_view(spark, "ec_pv_redistributable", years=[1995, 1996, 1997])


@query(B.SQL + "select year, state, false as is_total, total_electoral_votes from dense where year in (1995, 1996)")
def participation_rows(spark: SparkSession, d: str) -> DataFrame:
    return versioned.participation(B.spine(spark, d).withColumn("is_total", F.col("is_total").cast("int")), [1995, 1996])


@query(B.SQL + "select 'B' as source, year, state, pv_status, case when pv_status <> 'popular_vote' then 'region 0' end as note from roster")
def roster_of_source(spark: SparkSession, d: str) -> DataFrame:
    roster = B.roster(spark, d)
    return versioned.read_roster(R.union_tagged({"A": roster.drop("source"), "B": roster.drop("source")}), ["B"]).select("source", "year", "state", "pv_status", "note")


# --- a saved corpus ---


def saved(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """(folder, manifest) of the result pages, a file each. The page of 1995 was not given, and the manifest has an index."""
    folder = new_path(spark, "corpus")
    made = result_pages(spark, d)
    made.select("page", F.col("html").alias("value")).repartition("page").write.partitionBy("page").text(folder)
    named = corpus.files(spark, folder).select(F.regexp_extract("path", r"/page=([^/]+)/", 1).alias("page"), F.regexp_extract("path", r"/(page=[^/]+/[^/]+)$", 1).alias("file"), "bytes").where("file like '%part-%'")
    digest = made.select("page", F.sha2(F.concat("html", F.lit("\n")).cast("binary"), 256).alias("sha256"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("page").cast("int") - 1990)
    manifest = named.join(digest, "page").select("page", "file", F.when(F.col("page") == "1995", 404).otherwise(200).alias("http_status"), "bytes", "sha256", day.alias("fetched_at"))
    index = manifest.limit(1).select(F.lit(None).cast("string").alias("page"), F.lit("index").alias("file"), F.lit(200).alias("http_status"), "bytes", "sha256", F.lit("1990-01-01").cast("date").alias("fetched_at"))
    return folder, manifest.unionByName(index)


@query(PAGES + "select year::varchar as page, state as label, upper(candidate[1]) || lower(candidate[2:]) as name, lower(candidate) as party, total as total_votes, candidate_votes as votes from pv join whole using (year, state) where year in (1996, 1998)")
def corpus_votes(spark: SparkSession, d: str) -> DataFrame:
    folder, manifest = saved(spark, d)
    return pages.popular_votes_of_pages(corpus.checked_corpus(spark, folder, manifest, ["1996", "1998"]))[0].drop("percent")


@query("""select * from (values ('page_not_given', 2), ('page_twice', 1), ('file_missing', 1), ('file_changed', 2)) t("constraint", n_violations)""")
def corpus_broken(spark: SparkSession, d: str) -> DataFrame:
    folder, manifest = saved(spark, d)
    wrong = F.when(F.col("page") == "1996", F.lit("0" * 64)).otherwise(F.col("sha256"))
    longer = F.when(F.col("page") == "1997", F.col("bytes") + 1).otherwise(F.col("bytes"))
    lost = manifest.where("page = '1998'").withColumns({"file": F.lit("page=1998/lost")})
    planted = manifest.withColumns({"sha256": wrong, "bytes": longer}).unionByName(lost)
    return C.violations(corpus.read_corpus(spark, folder, planted, ["1890", "1995", "1996", "1997", "1998"])[1]).drop("example")


@query(PAGES + "select min(date '2000-01-01' + (year - 1990)) as first_fetched, max(date '2000-01-01' + (year - 1990)) as last_fetched, count(distinct year) as n_pages from whole")
def corpus_age(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_age(saved(spark, d)[1])
