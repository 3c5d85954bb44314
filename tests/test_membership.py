"""Membership in several sets, and the classes and contradictions that follow from it, by hand and with rows of each."""

from __future__ import annotations

import pytest

from psephos.constraints import ConstraintError, check
from psephos.operators import membership as M
from psephos.plans import queries

DATA = "/root/testdata/sf0.001"


def frame(spark, rows, schema="year int, candidate string"):
    return spark.createDataFrame(rows, schema)


def as_dict(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_membership_counts_and_nulls(spark):
    a, b = frame(spark, [(1, "x"), (1, "x"), (None, "n")]), frame(spark, [(1, "x"), (2, "y"), (None, "n")])
    assert sorted(map(tuple, M.membership(("year", "candidate"), {"a": a, "b": b}).collect()), key=str) == [(1, "x", 2, 1), (2, "y", 0, 1), (None, "n", 1, 1)]
    assert M.membership(("year",), {"a": a.limit(0), "b": b.limit(0)}).count() == 0


def test_native_names(spark):
    facts = frame(spark, [(1, "A", 5), (1, "B", 6), (1, "C", 7), (1, "D", 8), (2, "A", 9)], "year int, candidate string, votes int")
    mapped = frame(spark, [(1, "A", "Ann"), (1, "D", "Dan"), (2, "A", "Ann"), (2, "A", "Abe"), (3, "A", "Ann")], "year int, candidate string, canonical string")
    dropped = frame(spark, [(1, "B"), (1, "D")])
    assert {k: r["class"] for k, r in as_dict(M.native_classes(facts, mapped, dropped), "year", "candidate").items()} == {
        (1, "A"): "mapped", (1, "B"): "dropped", (1, "C"): "unclassified", (1, "D"): "in_both", (2, "A"): "ambiguous", (3, "A"): "unused",
    }
    with pytest.raises(ConstraintError) as told:
        check(M.native_names_partition(facts, mapped, dropped))
    assert told.value.broken["native_names_partition"][0] == 3
    assert sorted(map(tuple, M.canonical_facts(facts.where("year = 1"), mapped).collect())) == [(1, "Ann", 5), (1, "Dan", 8)]


def test_getters(spark):
    getters = frame(spark, [(1, "A"), (1, "A"), (1, "B"), (1, "C")])
    facts = frame(spark, [(1, "A"), (1, "D"), (1, "E")])
    exempt = frame(spark, [(1, "C"), (1, "D"), (1, "F")])
    assert {k: r["class"] for k, r in as_dict(M.getter_classes(getters, exempt, facts), "candidate").items()} == {
        "A": "held", "B": "missing", "C": "exempt", "D": "stale_exemption", "E": "votes_only", "F": "unused_exemption",
    }
    with pytest.raises(ConstraintError) as told:
        check(*M.getters_complete(getters, exempt, facts, frame(spark, [(1,), (2,)], "year int")))
    assert {k: n for k, (n, _) in told.value.broken.items()} == {"getter_missing": 1, "exemption_stale": 1, "year_without_getters": 1}
    check(*M.getters_complete(getters.where("candidate <> 'B'"), exempt.where("candidate = 'C'"), facts, frame(spark, [(1,)], "year int")))


def test_layers_and_contradictions(spark):
    place, noted = "year int, state string", "year int, state string, note string"
    base = frame(spark, [(1, "a"), (1, "b"), (1, "c"), (1, "d")], place)
    law = frame(spark, [(1, "a", "by law"), (1, "b", "by law"), (1, "x", "by law"), (1, "c", None), (1, "c", "z"), (1, "c", "y")], noted)
    war = frame(spark, [(1, "b", "war")], noted)
    got = as_dict(M.layered_status(base, {"not_participating": war, "legislature_chosen": law}), "state")
    assert {k: (r["pv_status"], r["note"]) for k, r in got.items()} == {
        "a": ("legislature_chosen", "by law"), "b": ("not_participating", "war"), "c": ("legislature_chosen", "y"), "d": ("popular_vote", None),
    }
    voting = frame(spark, [(1, "a"), (1, "b"), (1, "d"), (1, "d")], place)
    told = {(r["state"], r["contradiction"]) for r in M.status_contradictions(voting, law, war, base).collect()}
    assert told == {("x", "legislature_outside_roster"), ("b", "legislature_and_absent"), ("b", "absent_with_votes"), ("a", "legislature_with_votes"), ("b", "legislature_with_votes"), ("d", "two_rows_one_state")}
    assert M.status_contradictions(base, law.limit(0), war.limit(0), base).count() == 0


CLASSES = {
    "native_name_classes": ("class", {"mapped", "dropped", "unclassified", "in_both", "ambiguous", "unused"}),
    "getter_classes": ("class", {"held", "missing", "exempt", "stale_exemption", "votes_only", "unused_exemption"}),
    "status_contradictions": ("contradiction", {"legislature_outside_roster", "legislature_and_absent", "absent_with_votes", "legislature_with_votes", "two_rows_one_state"}),
    "layered_status": ("pv_status", {"popular_vote", "legislature_chosen", "not_participating"}),
    "roster_broken": ("constraint", {"year_without_roster", "note_on_popular_vote", "absence_against_electors"}),
}


@pytest.mark.parametrize("name", list(CLASSES))
def test_queries_show_every_class(spark, name):
    column, want = CLASSES[name]
    found = {r[column] for r in queries()[name](spark, DATA).select(column).distinct().collect()}
    assert found <= want and len(found) >= len(want) - (name == "getter_classes")
