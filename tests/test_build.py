"""Builds that stop and go on, and the gates of the election build."""

from __future__ import annotations

import pytest

from psephos import constraints as C
from psephos.build import Build, Step
from psephos.plans import builds, election

DATA = "/root/testdata/sf0.001"


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def chain(calls, stop=None, revision=1):
    def times(k):
        def make(df):
            calls.append(k)
            if k == stop:
                raise RuntimeError("the cluster is gone")
            return df.selectExpr(f"x * {k} as x")

        return make

    return [
        Step("two", ("a",), times(2)), Step("three", ("two",), times(3), revision=revision), Step("five", ("b",), times(5)),
        Step("all", ("three", "five"), lambda p, q: p.unionByName(q), lambda rows, p, q: [C.row_rule(rows, C.F.col("x") < 1000, "small")]),
    ]


def content(df):
    return sorted(r[0] for r in df.collect())


def test_a_stopped_build_goes_on(spark, tmp_path):
    calls: list[int] = []
    inputs = {"a": frame(spark, 1, 2), "b": frame(spark, 10)}
    with pytest.raises(RuntimeError):
        Build(spark, str(tmp_path), inputs).run(chain(calls, stop=5))
    assert calls == [2, 3, 5]
    again = Build(spark, str(tmp_path), {"a": frame(spark, 2, 1).repartition(3), "b": frame(spark, 10)})
    assert content(again.run(chain(calls))["all"]) == [6, 12, 50] and calls == [2, 3, 5, 5]
    assert [(s, rows, done) for s, _, rows, done in again.receipts] == [("two", None, "reused"), ("three", None, "reused"), ("five", 1, "made"), ("all", 3, "made")]
    # What changes is made again, with all that follows from it.
    third = Build(spark, str(tmp_path), {"a": frame(spark, 1, 2), "b": frame(spark, 11)})
    assert content(third.run(chain(calls))["all"]) == [6, 12, 55] and calls[4:] == [5]
    fourth = Build(spark, str(tmp_path), inputs)
    fourth.run(chain(calls, revision=2))
    assert calls[5:] == [3] and [r[3] for r in fourth.receipts] == ["reused", "made", "reused", "made"]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_staged")]


def test_a_closed_gate_leaves_nothing(spark, tmp_path):
    build = Build(spark, str(tmp_path), {"a": frame(spark, 1, 999), "b": frame(spark, 10)})
    with pytest.raises(C.ConstraintError):
        build.run(chain([]))
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["five", "three", "two"]


def test_names_are_checked(spark, tmp_path):
    build = Build(spark, str(tmp_path), {"a": frame(spark, 1)})
    with pytest.raises(ValueError):
        build.run([Step("a", (), lambda: frame(spark, 1))])
    with pytest.raises(ValueError):
        build.run([Step("c", ("nothing",), lambda df: df)])


@pytest.fixture(scope="module")
def given(spark):
    return builds.inputs(spark, DATA)


def test_the_election_build_resumes(spark, tmp_path, given):
    """Stopped by an unmapped name half-way; mended, it goes on with what was finished and equals an unbroken one."""
    lost = given | {"page_names": given["page_names"].where("candidate <> 'Building'")}
    first = Build(spark, str(tmp_path / "a"), lost)
    with pytest.raises(C.ConstraintError) as told:
        first.run(election.steps())
    assert set(told.value.broken) == {"native_names_partition"}
    second = Build(spark, str(tmp_path / "a"), given)
    second.run(election.steps())
    done = {step: what for step, _, _, what in second.receipts}
    assert [s for s, what in done.items() if what == "reused"] == ["records", "grid", "columns", "candidates", "votes", "file_votes"]
    whole = Build(spark, str(tmp_path / "b"), given)
    whole.run(election.steps())
    assert [k for _, k, _, _ in whole.receipts] == [k for _, k, _, _ in second.receipts]
    a, b = (x.tables["joined"].drop("redistributable") for x in (second, whole))
    assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()


def test_a_placeholder_without_people_stops_the_build(spark, tmp_path, given):
    with pytest.raises(C.ConstraintError) as told:
        Build(spark, str(tmp_path), given | {"named": given["named"].limit(0)}).run(election.steps()[:2])
    assert "placeholder_unnamed" in told.value.broken
