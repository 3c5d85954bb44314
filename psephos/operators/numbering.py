"""Dense ids and digests that follow an order, without ever bringing the rows into one task.

Rows are dealt by ranges of the order, sorted within these and written with their place; counts of the ranges, one number
each, give every range its offset. What is left is addition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.functions.text import content_line
from psephos.shared import stored

#: Bits below the partition's number in monotonically_increasing_id().
_PLACE = 33


def dense_ids(df: DataFrame, order: Sequence[str | Column], name: str = "id", first: int = 1, parts: int | None = None) -> DataFrame:
    """df with a column of ids first, first + 1, ... in the order, as the leading column.

    The order should be total; rows that it holds equal get neighbouring ids, in no stated order. Nulls come first unless a
    column says otherwise (asc_nulls_last). parts: how many ranges, by default as many as shuffle partitions. Rows equal in
    the whole order lie in one range, so a range grows with its most frequent value. An empty table has no ids.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = stored(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    return _offset(placed, name, first)


def _offset(placed: DataFrame, name: str, first: int) -> DataFrame:
    """Ids of rows with _at, a range's number and the place in it. One number for each range comes to the driver."""
    number = F.shiftright("_at", _PLACE).cast("int")
    counts = sorted((r["_range"], r["n"]) for r in placed.groupBy(number.alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = list(zip([r for r, _ in counts], accumulate([n for _, n in counts], initial=first)))
    # As many rows as ranges, whatever the number of rows: that bound makes the broadcast safe.
    told = placed.sparkSession.createDataFrame(offsets, "_range int, _offset long")
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    out = placed.withColumn("_range", number).join(F.broadcast(told), "_range")
    return out.select((F.col("_offset") + place).alias(name), *[c for c in placed.columns if c != "_at"])


def ordered_digest(df: DataFrame, order: Sequence[str | Column], columns: Sequence[str], prefix: str = "", chunk: int = 4096, parts: int | None = None) -> tuple[int, str]:
    """(rows, SHA-256 in hex) of the columns of all rows in the order.

    Rows are numbered in the order and cut into chunks of so many. A chunk's digest is that of its lines (fields joined by
    0x1F, null as the empty field), each ended by 0x1E; so many digests, one after the other, have a digest again, until one
    is left, which is hashed with the prefix before it. Chunks depend on the order alone, so the digest is the same for any
    number of partitions, and a task never holds more than one chunk. The columns break ties, so the order is total up to
    rows that are equal. No rows have the digest of the prefix.
    """
    keyed = dense_ids(df, [*order, *columns], "_id", 0, parts)
    level = keyed.select("_id", F.concat(content_line(list(columns)), F.lit("\x1e")).alias("_text"))
    n = rows = level.count()
    # At most `chunk` rows of a group are put together.
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_id", "_text"))), lambda x: x["_text"]), "")
    whole = ""
    while n:
        level = level.groupBy(F.floor(F.col("_id") / chunk).alias("_chunk")).agg(F.sha2(put.cast("binary"), 256).alias("_text")).select(F.col("_chunk").alias("_id"), "_text")
        n = -(-n // chunk)
        if n == 1:
            whole = level.head()["_text"]
            break
        level = stored(level, "digests")
    return rows, hashlib.sha256(f"{prefix}{whole}".encode()).hexdigest()
