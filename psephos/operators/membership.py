"""Which of several sets a key belongs to, found in one pass, and what follows from that: names that are mapped, dropped or
forgotten, exemptions that no longer hold, and facts about a state that contradict each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.constraints import Constraint, references, row_rule, unique

NAME = ("year", "candidate")
PLACE = ("year", "state")


def membership(keys: Sequence[str], sets: dict[str, DataFrame]) -> DataFrame:
    """The keys and, by the name of each set, how many of its rows have the key; a key of no set has no row. Nulls are a value.

    One union and one aggregation, which combines before the shuffle, however many sets there are.
    """
    tagged = reduce(DataFrame.unionByName, [df.select(*keys, F.lit(name).alias("_set")) for name, df in sets.items()])
    return tagged.groupBy(*keys).agg(*[F.count_if(F.col("_set") == name).alias(name) for name in sets])


def _first(classes: dict[str, Column]) -> Column:
    """The first class whose condition holds."""
    return reduce(lambda found, c: found.when(c[1], c[0]), list(classes.items())[1:], F.when(*reversed(next(iter(classes.items())))))


# --- native names ---


def native_classes(facts: DataFrame, mapped: DataFrame, dropped: DataFrame) -> DataFrame:
    """(year, candidate, class) of each native name of a year: mapped, dropped, unclassified (in neither list), in_both lists,
    ambiguous (mapped twice), or unused (in a list, but not among the facts). mapped: (year, candidate, canonical)."""
    found = membership(NAME, {"facts": facts, "mapped": mapped, "dropped": dropped})
    f, m, d = (F.col(c) > 0 for c in ("facts", "mapped", "dropped"))
    kind = _first({"in_both": m & d, "ambiguous": F.col("mapped") > 1, "unused": ~f, "mapped": m, "dropped": d, "unclassified": f})
    return found.select(*NAME, kind.alias("class"))


def native_names_partition(facts: DataFrame, mapped: DataFrame, dropped: DataFrame, name: str = "native_names_partition") -> Constraint:
    """Each name of the facts is mapped or dropped, by one entry; an unused entry is none of their business."""
    return Constraint(name, native_classes(facts, mapped, dropped).where(F.col("class").isin("unclassified", "in_both", "ambiguous")))


def canonical_facts(facts: DataFrame, mapped: DataFrame) -> DataFrame:
    """facts of the mapped names, under their canonical ones; native_names_partition says that nothing else was lost."""
    named = facts.join(mapped.select(*NAME, F.col("canonical").alias("_canonical")), list(NAME))
    return named.withColumn("candidate", F.col("_canonical")).select(*facts.columns)


def getter_classes(getters: DataFrame, exempt: DataFrame, facts: DataFrame) -> DataFrame:
    """(year, candidate, class) of those who won electors, are exempt or have popular votes: held, missing, exempt,
    stale_exemption (exempt, yet with votes), votes_only, or unused_exemption. Several rows of a key count once."""
    found = membership(NAME, {"getters": getters, "exempt": exempt, "facts": facts})
    g, e, f = (F.col(c) > 0 for c in ("getters", "exempt", "facts"))
    kind = _first({"stale_exemption": e & f, "held": g & f, "votes_only": f, "exempt": g & e, "unused_exemption": e, "missing": g})
    return found.select(*NAME, kind.alias("class"))


def getters_complete(getters: DataFrame, exempt: DataFrame, facts: DataFrame, years: DataFrame) -> list[Constraint]:
    """Whoever won electors has popular votes or is exempt, no exemption is stale, and each of the years has such winners at
    all: a list without any would let the rest pass without having shown a thing."""
    classes = getter_classes(getters, exempt, facts)
    return [
        Constraint("getter_missing", classes.where(F.col("class") == "missing")),
        Constraint("exemption_stale", classes.where(F.col("class") == "stale_exemption")),
        references(years, getters, ["year"], "year_without_getters"),
    ]


# --- layered status ---


def layered_status(base: DataFrame, layers: dict[str, DataFrame], rest: str = "popular_vote") -> DataFrame:
    """(year, state, pv_status, note): for each key of base the status of the first layer that has it, with its note, else `rest`.

    layers: status -> (year, state, note), the strongest first. Keys that base lacks have no row; of several notes of one
    layer the least counts. status_contradictions() is to be asked before, as one status a key hides what disagrees.
    """
    tagged = base.select(*PLACE, F.lit(len(layers)).alias("_rank"), F.lit(rest).alias("pv_status"), F.lit(None).cast("string").alias("note"))
    for k, (status, rows) in enumerate(layers.items()):
        tagged = tagged.unionByName(rows.select(*PLACE, F.lit(k).alias("_rank"), F.lit(status).alias("pv_status"), "note"))
    top = F.min_by(F.struct("pv_status", "note"), F.struct("_rank", F.col("note").isNull(), "note"))
    picked = tagged.groupBy(*PLACE).agg(top.alias("_top"), F.max("_rank").alias("_last"))
    return picked.where(F.col("_last") == len(layers)).select(*PLACE, "_top.pv_status", "_top.note")


def status_contradictions(voting: DataFrame, legislature: DataFrame, absent: DataFrame, participants: DataFrame) -> DataFrame:
    """(year, state, contradiction), a row for each way in which what is known of a state disagrees; looked for in what goes
    into the roster, not in the roster.

    voting: a row for each printed row of votes; legislature: states said to have chosen by legislature; absent: states
    catalogued as taking no part; participants: the states of the electoral spine. All by canonical names, to which several
    printed ones may lead.
    """
    found = membership(PLACE, {"voting": voting, "legislature": legislature, "absent": absent, "participants": participants})
    v, g, a, p = (F.col(c) > 0 for c in ("voting", "legislature", "absent", "participants"))
    rules = {
        "legislature_outside_roster": g & ~p,
        "legislature_and_absent": g & a,
        "absent_with_votes": a & v,
        "legislature_with_votes": g & v,
        "two_rows_one_state": F.col("voting") > 1,
    }
    told = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    return found.select(*PLACE, F.explode(told).alias("contradiction"))


def roster_constraints(roster: DataFrame, participation: DataFrame, years: DataFrame) -> list[Constraint]:
    """Of a finished roster: every year has states, notes stand on absences only, states that took no part have no electors and
    states with a popular vote have some. participation: (year, state, total_electoral_votes)."""
    electors = participation.groupBy(*PLACE).agg(F.max("total_electoral_votes").alias("electors"))
    met = roster.join(electors, list(PLACE))
    fits = F.when(F.col("pv_status") == "not_participating", F.col("electors") == 0).when(F.col("pv_status") == "popular_vote", F.col("electors") != 0)
    return [
        references(years, roster, ["year"], "year_without_roster"),
        unique(roster, PLACE, "roster_grain"),
        row_rule(roster, (F.col("pv_status") != "popular_vote") | F.col("note").isNull(), "note_on_popular_vote"),
        row_rule(met.select(*PLACE, "pv_status", "electors"), fits, "absence_against_electors"),
    ]
