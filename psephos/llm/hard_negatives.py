"""Hard negatives: for each anchor and each of its positives, the best different-label rows within limits of the positive's score.

Rows lie in shards and anchors in blocks, both packed into one row of a stored table. Each block meets each shard in a task
of its own (the anchors are a stated query set against all rows), twice. The first pass scores only rows of the anchor's
label and keeps the shard's best; a window merges them to the positives. In the second pass a task scores the whole shard
for an anchor, sorts all of it by score and id, finds each positive's upper limit by binary search and reads entries of
other labels from there down to the lower limit. The first k of all shards are among the first k of each shard, so the
merge, a window again, is exact. No task holds more than a shard, a block and the scores of a few anchors.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import stored
from psephos.llm.exact import Wholes, all_finite, first_places, matrix, read, written

#: Rows of a shard, and anchors of a block, at most (but for chance).
SHARD, BLOCK = 8192, 1024
#: Bytes of the vectors of a shard or a block, at most: longer vectors make smaller ones.
BYTES = 32 << 20
#: Scores that a task works out in one go.
AT_ONCE = 1 << 20

_PACKED = "part int, rows binary, ids binary, labels binary, dims int, vectors binary"


def usable(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, x): rows with an id, a label and a vector without null or non-finite components; others take no part."""
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & all_finite(F.col(vector)))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))


def packed(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, int]:
    """The rows dealt by a hash of id and place into parts, one stored row a part, and how many parts there are."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("d")).head()
    parts = max(1, -(-size["n"] // max(1, min(most, BYTES // (8 * max(1, size["d"]))))))

    def pack(t: pa.Table) -> pa.Table:
        x = matrix(t["x"])
        out = {"part": [t["part"][0].as_py()], "dims": [x.shape[1]], "vectors": [x.tobytes()]}
        out |= {k: [t[c].to_numpy().astype(np.int64).tobytes()] for k, c in (("rows", "row"), ("ids", "vec_id"), ("labels", "label"))}
        return pa.table({k: pa.array(out[k], t) for k, t in (("part", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("dims", pa.int32()), ("vectors", pa.binary()))})

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("vec_id", "row"), F.lit(parts)).cast("int"))
    return stored(dealt.groupBy("part").applyInArrow(pack, _PACKED), name), parts


class Part:
    """A packed shard or block, unpacked."""

    def __init__(self, t: pa.Table):
        row = {k: t[k][0].as_py() for k in ("rows", "ids", "labels", "dims", "vectors")}
        self.rows, self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("rows", "ids", "labels"))
        self.vectors = Wholes(np.frombuffer(row["vectors"]).reshape(len(self.ids), row["dims"]))


_POSITIVE = pa.schema([("block", pa.int32()), ("anchor", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("rest", pa.string())])
_NEGATIVE = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("score", pa.int64()), ("rest", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def same_label_best(shard: Part, block: Part, number: int, k: int) -> list[tuple]:
    """For each anchor the shard's k best other rows of its label."""
    out = []
    for label in np.unique(block.labels).tolist():
        near, asked = np.nonzero(shard.labels == label)[0], np.nonzero(block.labels == label)[0]
        ids, rows = shard.ids[near], shard.vectors.take(near)
        step = max(1, AT_ONCE // max(1, len(near)))
        for at in range(0, len(asked) if len(near) else 0, step):
            some = asked[at : at + step]
            for a, scores in zip(some.tolist(), block.vectors.take(some).products(rows)):
                other = np.nonzero(ids != block.ids[a])[0]
                for p in other[first_places(scores[other], ids[other])[:k]].tolist():
                    out.append((number, int(block.rows[a]), int(ids[p]), *written(int(scores[p]))))
    return out


def within_limits(scores: np.ndarray, positive: int, k: int, low: int, high: int) -> slice:
    """Of scores in falling order, the first k with low * positive <= 100 * score <= high * positive."""
    upper, lower = high * positive // 100, -(-low * positive // 100)
    if scores.dtype == object or not (abs(upper) < 2**62 and abs(lower) < 2**62):
        falling = [-int(s) for s in scores]
        first, last = bisect.bisect_left(falling, -upper), bisect.bisect_right(falling, -lower)
    else:
        first, last = np.searchsorted(-scores, -upper, "left"), np.searchsorted(-scores, -lower, "right")
    return slice(int(first), int(max(first, min(last, first + k))))


def hard(shard: Part, block: Part, positives: dict[int, list[tuple[int, int, int]]], k: int, low: int, high: int) -> list[tuple]:
    """For each anchor and positive the shard's first k rows of other labels within the limits."""
    out = []
    asked = np.array([a for a, row in enumerate(block.rows.tolist()) if row in positives], dtype=np.int64)
    step = max(1, AT_ONCE // max(1, len(shard.ids)))
    for at in range(0, len(asked), step):
        some = asked[at : at + step]
        for a, scores in zip(some.tolist(), block.vectors.take(some).products(shard.vectors)):
            order = first_places(scores, shard.ids)
            order = order[shard.labels[order] != block.labels[a]]
            falling, row = scores[order], int(block.rows[a])
            for place, positive_id, positive in positives[row]:
                at_positive = (row, place, int(block.ids[a]), positive_id, written(positive)[0])
                here = within_limits(falling, positive, k, low, high)
                out += [(*at_positive, int(shard.ids[p]), *written(int(scores[p]))) for p in order[here].tolist()]
    return out


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows and anchors: (vec_id, label, x) as usable() gives them. A score is the inner product of floor(256 x), exact. An
    anchor's positives are its best rows of the same label with another vec_id; a positive's negatives are the best rows of
    another label whose score is low to high per cent of its own (none if that is negative). Ties go to the smaller vec_id.

    Rows that share a vec_id are each a candidate, and each an anchor with results of its own. Vectors of unequal lengths
    are compared as if the shorter one ended in zeros; an empty one scores 0. Scores that a bigint cannot hold are ranked
    and limited exactly and shown as the nearest bigint. An empty table gives no rows.
    """
    shards, n_shards = packed(rows, SHARD, "shards")
    blocks, n_blocks = packed(anchors, BLOCK, "blocks")
    shards = shards.withColumnRenamed("part", "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = blocks.withColumnRenamed("part", "block")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    best_first = [F.desc("score"), F.desc("rest")]

    def find(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        return _table(same_label_best(Part(shard), Part(block), key[1].as_py(), positives) if shard.num_rows and block.num_rows else [], _POSITIVE)

    found = shards.groupBy("shard", "block").cogroup(blocks.withColumn("shard", everywhere).groupBy("shard", "block")).applyInArrow(find, "block int, anchor long, vec_id long, score long, rest string")
    place = F.row_number().over(Window.partitionBy("block", "anchor").orderBy(*best_first, "vec_id"))
    chosen = found.withColumn("place", place).where(F.col("place") <= positives)
    # At most `positives` rows for each anchor of a block.
    told = stored(chosen.groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "vec_id", "score", "rest")).alias("told")), "positives")

    def mine(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        if not (shard.num_rows and block.num_rows):
            return _table([], _NEGATIVE)
        known: dict[int, list] = {}
        for p in block["told"][0].as_py():
            known.setdefault(p["anchor"], []).append((p["place"], p["vec_id"], read(p["score"], p["rest"])))
        return _table(hard(Part(shard), Part(block), known, negatives, low, high), _NEGATIVE)

    asked = blocks.join(told, "block").withColumn("shard", everywhere)
    found = shards.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(mine, "anchor long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, score long, rest string")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*best_first, "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: anchors are the rows whose vec_id is divisible by 100; where it is divisible by 7 the label moves on by one first."""
    label = F.col("label").cast("long")
    moved = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    rows = stored(usable(moved), "labelled-vectors")
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
with v as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
           from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.rid, a.vec_id as anchor_id, c.vec_id, a.label = c.label as alike, c.rid as other,
             coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
      from v a, v c where a.vec_id % 100 = 0),
p as (select rid, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by rid order by score desc, vec_id) as place
      from s where alike and vec_id <> anchor_id),
n as (select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.rid, p.place order by s.score desc, s.vec_id) as rank
      from p join s on s.rid = p.rid and not s.alike
                   and 30 * p.positive_score::hugeint <= 100 * s.score::hugeint and 100 * s.score::hugeint <= 90 * p.positive_score::hugeint
      where p.place <= 5)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
