"""Dense ids and ordered digests over several numbers of partitions, and dimensions with each constraint broken."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from psephos.constraints import ConstraintError, check, violations
from psephos.operators import dimensions as D
from psephos.operators import numbering
from psephos.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dense_ids(spark, parts):
    rows = [(k % 7 if k % 11 else None, k) for k in range(500)]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int").repartition(parts)
    got = numbering.dense_ids(df, [F.col("a").asc_nulls_last(), F.desc("b")], parts=parts).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["id"])] == want and sorted(r["id"] for r in got) == list(range(1, 501))


def test_no_task_numbers_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    plan = numbering.dense_ids(df, ["x"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_dense_ids_of_none_and_of_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 20, "x int")
    assert sorted(r["id"] for r in numbering.dense_ids(df, ["x"], first=0, parts=4).collect()) == list(range(20))
    assert numbering.dense_ids(df.limit(0), ["x"]).count() == 0


def plain_digest(lines, prefix, chunk):
    level = [line + "\x1e" for line in lines]
    while level:
        level = [hashlib.sha256("".join(level[k : k + chunk]).encode()).hexdigest() for k in range(0, len(level), chunk)]
        if len(level) == 1:
            break
    return hashlib.sha256((prefix + "".join(level)).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 5, 25, 26, 300])
def test_ordered_digest(spark, n):
    rows = [(k // 2, f"é{k}" if k % 3 else None) for k in range(n)]
    want = plain_digest([f"{a}\x1f{b or ''}" for a, b in sorted(rows, key=lambda r: (r[0], r[1] or ""))], "v1", 5)
    shuffled = random.Random(n).sample(rows, n)
    found = {numbering.ordered_digest(spark.createDataFrame(shuffled, "a int, b string").repartition(p), ["a"], ["a", "b"], "v1", 5, p) for p in (1, 3, 8)}
    assert found == {(n, want)}


def test_the_order_counts(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    up, down = (numbering.ordered_digest(df, [o], ["b"], "")[1] for o in (F.asc("a"), F.desc("a")))
    assert up != down


def test_collapsed(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("a", "x", 2), ("b", None, 1), ("c", "z", 1), ("c", None, 0), ("d", "p", 1), ("d", "q", 2), ("d", "r", 3)], "k string, v string, at int")
    wide, over = D.collapsed(df, ["k"], "v", 2, "at")
    assert {r["k"]: (r["v"], r["v_2"]) for r in wide.collect()} == {"a": ("y", "x"), "b": (None, None), "c": ("z", None), "d": ("p", "q")}
    assert [tuple(r) for r in over.violations.collect()] == [("d", 3)]
    text, broken = D.joined_values(df, ["k"], "v", "q", 3, "at")
    assert {r["k"]: r["v"] for r in text.collect()} == {"a": "yqx", "b": None, "c": "z", "d": "pqqqr"}
    assert [r["constraint"] for r in violations(broken).collect()] == ["delimiter_in_v"]


def test_candidates_and_fact(spark):
    columns = spark.createDataFrame([(1, "Ann Cole, Jr.", "Bern"), (2, "Ann Cole, Jr.", "Ada"), (2, "Dan Eck", None), (3, "D. Eck", "Cork")], "year int, name string, home string")
    parties = spark.createDataFrame([("Ann Cole, Jr.", "Whig"), ("Ann Cole, Jr.", "whig"), ("D. Eck", "Red")], "name string, party string")
    names = spark.createDataFrame([("D. Eck", "Dan Eck")], "native string, canonical string")
    labels = spark.createDataFrame([("whig", "Whig")], "native string, canonical string")
    dim, constraints = D.candidate_dim(columns, parties, names, labels)
    check(*constraints)
    assert sorted(map(tuple, dim.collect())) == [
        (1, "Ann Cole, Jr.", "Ann", None, "Cole", "Jr.", "Bern", "Ada", "Whig", None), (2, "Dan Eck", "Dan", None, "Eck", None, "Cork", None, "Red", None),
    ]
    cells = spark.createDataFrame([(1, "Ada", 3, 1, 3), (1, "Totals", 3, 1, 3), (1, "Ada", 3, 2, 0)], "year int, state string, total_electoral_votes int, col_ind int, votes int")
    across = spark.createDataFrame([(1, 1, "Dan Eck"), (1, 2, "Ann Cole, Jr.")], "year int, col_ind int, name string")
    fact, sound = D.votes_fact(cells, across, dim, spark.createDataFrame([("Ada",), ("Bern",)], "state string"))
    check(*sound)
    assert sorted(map(tuple, fact.collect())) == [(1, 1, "Ada", False, 1, 3, 0), (2, 1, "Ada", False, 2, 3, 3), (3, 1, None, True, 2, 3, 3)]
    with pytest.raises(ConstraintError) as told:
        check(*D.votes_fact(cells, across.where("col_ind = 1").withColumn("name", F.lit("Nobody")), dim, spark.createDataFrame([("Ada",)], "state string"))[1])
    assert set(told.value.broken) == {"name_not_in_dimension", "cell_without_column"}


def test_attributes(spark):
    raw = spark.createDataFrame([("Ada", "1", "+4.5"), ("Bern", "x", None), ("Bern", "2", "3"), ("Guam", "9", "1"), (None, "1", "1")], "NAME string, REGION string, LAT string")
    out, constraints = D.attribute_dim(raw, "state", {"state": ("NAME", "string"), "latitude": ("LAT", "double"), "region": ("REGION", "int")}, F.col("NAME") == "Guam")
    assert out.columns == ["state", "latitude", "region"] and out.count() == 4
    assert {r["constraint"] for r in violations(constraints).collect()} == {"state_grain", "state_null", "unreadable_region"}


@pytest.mark.parametrize("name", ["more_than_two_values", "delimiter_in_values", "candidate_dimension_broken", "votes_with_ids"])
def test_queries_have_rows(spark, name):
    assert queries()[name](spark, DATA).count() > 0
