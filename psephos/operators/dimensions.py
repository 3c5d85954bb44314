"""Dimensions: people with their home states and parties, states with their attributes.

A key may have a few values of an attribute, which become columns; more than these are a violation, as one would be lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.constraints import Constraint, references, row_rule, same_counts, unique
from psephos.functions.text import name_parts
from psephos.operators.numbering import dense_ids


def _distinct(df: DataFrame, keys: Sequence[str], value: str, order: str | None) -> DataFrame:
    """Each value of a key once, with the least place it has (itself if no order is given)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order or value).alias("_at"))


def collapsed(df: DataFrame, keys: Sequence[str], value: str, most: int = 2, order: str | None = None) -> tuple[DataFrame, Constraint]:
    """(keys, value, value_2 .. value_<most>) of every key, and the constraint that none has more values (keys, n_values).

    Values stand in the order of their first place (by themselves without an order); a null is no value, and a key with
    none but nulls has nulls. Only the first of a key are looked at, so a hot key gathers no list.
    """
    values = _distinct(df, keys, value, order)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", value))
    first = values.withColumn("_k", place).where(F.col("_k") <= most)
    columns = [F.max(F.when(F.col("_k") == k + 1, F.col(value))).alias(f"{value}_{k + 1}" if k else value) for k in range(most)]
    found = df.select(*keys).distinct().join(first.groupBy(*keys).agg(*columns), list(keys), "left")
    over = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") > most)
    return found, Constraint(f"more_than_{most}_of_{value}", over)


def joined_values(df: DataFrame, keys: Sequence[str], value: str, delimiter: str, most: int = 2, order: str | None = None) -> tuple[DataFrame, list[Constraint]]:
    """(keys, value) with the few values of a key in one text, and the constraints that no value holds the delimiter, so that the
    text splits back into them, and that none has more values than `most`."""
    wide, over = collapsed(df, keys, value, most, order)
    columns = [value, *[f"{value}_{k + 1}" for k in range(1, most)]]
    held = _distinct(df, keys, value, order).where(F.contains(F.col(value), F.lit(delimiter))).select(*keys, value)
    # concat_ws leaves nulls out.
    return wide.select(*keys, F.nullif(F.concat_ws(delimiter, *columns), F.lit("")).alias(value)), [over, Constraint(f"delimiter_in_{value}", held)]


def candidate_dim(columns: DataFrame, parties: DataFrame, name_fixes: DataFrame | None = None, party_fixes: DataFrame | None = None, most: int = 2) -> tuple[DataFrame, list[Constraint]]:
    """(candidate_id, name, name_first, name_middle, name_last, name_suffix, state, state_2, party, party_2), one row a name, and
    the constraints that it rests on.

    columns: (year, name, home) of all those voted for; parties: (name, party) of some of them; fixes: (native, canonical)
    spellings of names and of party labels, applied before anything is counted, so that two spellings are one value.
    Homes stand in the order of the years in which they first appear, parties by name. A name without a home or a party has
    null there. Ids are dense, by name.
    """
    columns, parties = _respelled(columns, "name", name_fixes), _respelled(_respelled(parties, "name", name_fixes), "party", party_fixes)
    homes, many_homes = collapsed(columns.withColumnRenamed("home", "state"), ["name"], "state", most, "year")
    labels, many_parties = collapsed(parties, ["name"], "party", most)
    met = homes.join(labels, "name", "left")
    parts = [v.alias(f"name_{k}") for k, v in name_parts(F.col("name")).items()]
    rest = [f"{c}_{k + 1}" if k else c for c in ("state", "party") for k in range(most)]
    out = dense_ids(met.select("name", *parts, *rest), ["name"], "candidate_id")
    return out.withColumn("candidate_id", F.col("candidate_id").cast("int")), [
        many_homes, many_parties, references(parties, homes, ["name"], "party_without_candidate"), unique(out, ["name"], "candidate_grain"), same_counts(out, homes, ["name"], "candidates_lost_or_doubled"),
    ]


def _respelled(df: DataFrame, column: str, fixes: DataFrame | None) -> DataFrame:
    if fixes is None:
        return df
    told = fixes.select(F.col("native").alias(column), F.col("canonical").alias("_canonical"))
    return df.join(told, column, "left").withColumn(column, F.coalesce("_canonical", column)).select(*df.columns)


def attribute_dim(rows: DataFrame, key: str, columns: dict[str, tuple[str, str]], leave_out: Column | None = None) -> tuple[DataFrame, list[Constraint]]:
    """Attributes of a key under new names and types, in the order given. columns: new name -> (column, type), the key's too.

    leave_out: rows that do not belong to the dimension (unknown keeps a row). The constraints: one row a key, no null key,
    and every value that is there can be read as its type.
    """
    kept = rows if leave_out is None else rows.where(~F.coalesce(leave_out, F.lit(False)))
    typed = kept.select(*[F.col(c).try_cast(kind).alias(name) for name, (c, kind) in columns.items()])
    readable = [row_rule(kept, F.col(c).isNull() | F.col(c).try_cast(kind).isNotNull(), f"unreadable_{name}") for name, (c, kind) in columns.items()]
    return typed, [unique(typed, [key], f"{key}_grain"), row_rule(typed, F.col(key).isNotNull(), f"{key}_null"), *readable]


def votes_fact(cells: DataFrame, columns: DataFrame, candidates: DataFrame, states: DataFrame) -> tuple[DataFrame, list[Constraint]]:
    """(votes_id, year, state, is_total, candidate_id, total_electoral_votes, president_electoral_votes) and its constraints.

    cells: (year, state, total_electoral_votes, col_ind, votes); columns: (year, col_ind, name). A cell whose state is not in
    the dimension belongs to a totals row: its state is null. Every name must be in the candidate dimension, as a missing
    one would take its state rows and its totals row away together. Ids are dense by year, state (totals last), candidate.
    """
    named = cells.join(columns.select("year", "col_ind", "name"), ["year", "col_ind"])
    known = states.select("state", F.col("state").alias("_known"))
    met = named.join(candidates.select("candidate_id", "name"), "name").join(known, "state", "left")
    fact = met.select("year", F.col("_known").alias("state"), F.col("_known").isNull().alias("is_total"), "candidate_id", "total_electoral_votes", F.col("votes").alias("president_electoral_votes"))
    ids = dense_ids(fact, ["year", F.col("state").asc_nulls_last(), "is_total", "candidate_id"], "votes_id")
    return ids, [
        references(named, candidates, ["name"], "name_not_in_dimension"), references(cells, columns, ["year", "col_ind"], "cell_without_column"),
        unique(ids, ["year", "state", "candidate_id"], "votes_grain"),
    ]
