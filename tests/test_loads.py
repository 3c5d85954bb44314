"""Versioned loads, commits of two writers, views, and a corpus with planted faults."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql.types import StructType

from psephos import constraints as C
from psephos.sources import commits, corpus, publish, versioned

SCHEMA = "k int, v string"


def table(spark, path):
    return versioned.Table(spark, str(path), StructType.fromDDL(SCHEMA), ("k",))


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def content(t):
    return sorted(map(tuple, t.read().collect()), key=str)


def test_loads_add_what_is_new(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.version() == 0 and content(t) == []
    assert t.load(rows(spark, (1, "a"), (2, None))) == {"version": 1, "received": 2, "added": 2}
    assert t.load(rows(spark, (2, None))) == {"version": 1, "received": 1, "added": 0}
    assert t.load(rows(spark, (2, None), (3, "c"))) == {"version": 2, "received": 2, "added": 1}
    assert content(t) == [(1, "a"), (2, None), (3, "c")]
    assert t.load(rows(spark, (9, "z")), replace=True)["version"] == 3 and content(t) == [(9, "z")]
    assert t.load(rows(spark).limit(0), replace=True)["added"] == 0 and content(t) == []


def test_an_empty_first_load_makes_the_table(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.load(rows(spark, (1, "a")).limit(0)) == {"version": 1, "received": 0, "added": 0} and content(t) == []


@pytest.mark.parametrize("bad, name", [(((1, "b"),), "key_with_other_values"), (((2, "b"), (2, "c")), "key_twice"), (((None, "b"),), "key_null"), (((7, "b"),), "not_known")])
def test_broken_loads_change_nothing(spark, tmp_path, bad, name):
    t = table(spark, tmp_path / "t")
    t.load(rows(spark, (1, "a")))
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    known = rows(spark, (1, ""), (2, ""))
    with pytest.raises(C.ConstraintError) as told:
        t.load(rows(spark, *bad), lambda new: [C.references(new, known, ["k"], "not_known")])
    assert set(told.value.broken) == {name} and content(t) == [(1, "a")]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == before


def test_other_columns_are_refused(spark, tmp_path):
    with pytest.raises(C.ConstraintError):
        table(spark, tmp_path / "t").load(rows(spark, (1, "a")).select("v", "k"))


def test_a_second_writer_is_refused(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.load(rows(spark, (1, "a")))
    t.load(rows(spark, (2, "b")))
    with pytest.raises(commits.StaleWriterError):
        t.load(rows(spark, (3, "c")), after=1)
    # One that looked in time, but was overtaken before its commit.
    other = table(spark, tmp_path / "t")
    with pytest.raises(commits.StaleWriterError):
        t.load(rows(spark, (4, "d")), lambda new: [C.row_rule(new, C.F.lit(other.load(rows(spark, (5, "e")))["added"] == 1), "other")])
    assert content(t) == [(1, "a"), (2, "b"), (5, "e")] and t.version() == 3


def test_commits_by_number(spark, tmp_path):
    root = str(tmp_path / "c")
    assert commits.latest(spark, root) == (0, {})
    assert [commits.commit(spark, root, k, {"k": k}) for k in (0, 1)] == [1, 2]
    with pytest.raises(commits.StaleWriterError):
        commits.commit(spark, root, 1, {"k": "late"})
    assert commits.latest(spark, root) == (2, {"k": 1})
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["_commits"]


def test_views_need_loaded_facts_and_described_sources(spark, tmp_path):
    schema = "source string, year int, state string, candidate string, party string, candidate_votes long, state_total_votes long, reliability string"
    facts = versioned.Table(spark, str(tmp_path / "f"), StructType.fromDDL(schema), ("source", "year", "state", "candidate"))
    sources = spark.createDataFrame([("A", 1, True)], "source string, precedence_rank int, redistributable boolean")
    with pytest.raises(C.ConstraintError) as told:
        versioned.build_views(facts, sources)
    assert "facts_not_loaded" in told.value.broken
    one = ("x", 1, 1, "exact")
    facts.load(spark.createDataFrame([("A", 1, "s", "ann", *one), ("B", 1, "s", "ann", *one)], schema))
    with pytest.raises(C.ConstraintError) as told:
        versioned.build_views(facts, sources)
    assert "source_not_described" in told.value.broken
    versioned.build_views(facts, sources.union(spark.createDataFrame([("B", 2, False)], sources.schema)))
    assert [r["source"] for r in versioned.read_view(spark, "pv_preferred", ["source"]).collect()] == ["A"]
    with pytest.raises(ValueError):
        versioned.read_view(spark, "pv_votes")
    votes = spark.createDataFrame([(1, "s", 7, 1, 1, 1)], "year int, state string, candidate_id int, total_electoral_votes int, president_electoral_votes int, president_electoral_votes_counted int")
    with pytest.raises(C.ConstraintError) as told:
        versioned.join_views(spark, votes, spark.createDataFrame([(7, "bea")], "candidate_id int, name string"), sources)
    assert "popular_votes_outside_spine" in told.value.broken


def test_participation_types(spark):
    df = spark.createDataFrame([(1, "a", 0, 3), (2, None, 1, 3)], "year int, state string, is_total int, total_electoral_votes int")
    assert [r["is_total"] for r in versioned.participation(df).orderBy("year").collect()] == [False, True]
    assert versioned.participation(df, [2]).count() == 1
    with pytest.raises(TypeError):
        versioned.participation(df.withColumn("is_total", C.F.lit("f")))
    with pytest.raises(C.ConstraintError):
        versioned.participation(df.withColumn("is_total", C.F.lit(None).cast("boolean")))


def test_corpus(spark, tmp_path):
    folder = tmp_path / "pages (saved)"
    (folder / "sub").mkdir(parents=True)
    texts = {"1900.html": b"<p>a\xff</p>", "sub/1904.html": b"<p>b</p>", "1908.html": b"<p>c</p>", "other.html": b"not asked for"}
    for name, data in texts.items():
        (folder / name).write_bytes(data)
    sha = {n: hashlib.sha256(t).hexdigest() for n, t in texts.items()}
    rows = [("1900", "1900.html", 200, 9, sha["1900.html"].upper()), ("1904", "/sub/1904.html", 200, None, None), ("1908", "1908.html", 404, 8, sha["1908.html"]), (None, "index.html", 200, 1, None)]
    manifest = spark.createDataFrame(rows, "page string, file string, http_status int, bytes long, sha256 string")
    got = {r["page"]: r["html"] for r in corpus.checked_corpus(spark, str(folder), manifest).collect()}
    assert got == {"1900": "<p>a�</p>", "1904": "<p>b</p>"}
    assert corpus.checked_corpus(spark, str(folder), manifest, ["1904"]).count() == 1
    (folder / "1900.html").write_bytes(b"<p>a!</p>")
    _, broken = corpus.read_corpus(spark, str(folder), manifest, ["1900", "1908"])
    assert {r["constraint"] for r in C.violations(broken).collect()} == {"file_changed", "page_not_given"}
    (folder / "1900.html").unlink()
    with pytest.raises(C.ConstraintError) as told:
        corpus.checked_corpus(spark, str(folder), manifest)
    assert set(told.value.broken) == {"file_missing"}
    out, broken = corpus.read_corpus(spark, str(folder), manifest, [])
    assert out.count() == 0 and C.violations(broken).count() == 0


def test_one_page_a_year(spark):
    parsed = spark.createDataFrame([("a", 1900), ("b", 1900), ("c", 1904)], "page string, year int")
    years = spark.createDataFrame([(1900,), (1908,)], "year int")
    assert {r["constraint"] for r in C.violations(corpus.one_page_a_year(parsed, years)).collect()} == {"year_with_two_pages", "year_without_page"}


def test_snapshot_guards(spark):
    rows = spark.createDataFrame([(1900, "a", "popular_vote", None), (1960, "a", "legislature_chosen", None), (1910, "b", "popular_vote", 4)], "year int, state string, pv_status string, candidate_votes long")
    rollup = spark.createDataFrame([(1900, 0), (1960, None)], "year int, national_pv_votes long")
    told = {r["constraint"] for r in C.violations(publish.snapshot_constraints(rows, rollup, 1950, 1950)).collect()}
    assert told == {"modern_year_without_popular_vote", "votes_below_floor", "national_votes_below_floor"}
    assert publish.snapshot_constraints(rows, rollup, None, None) == []
