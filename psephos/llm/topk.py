"""Exact top-k search by inner product: M-trees searched best-first.

Metric. With M the largest norm of a shard, a vector x gets one more component sqrt(M^2 - |x|^2) and a query the
component 0; then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest neighbours.

Index. Rows are dealt by a hash to shards of about SHARD rows. A shard is one M-tree: leaves are pages of vectors with
their distances to the page's pivot; a routing entry has its pivot, a covering radius and its distance to the parent's
pivot. A shard is stored as a row of the index table.

Search. Queries go in blocks of BLOCK to every shard (each row is a query's candidate, as the contract asks). A query
takes the page of greatest possible score next, from a heap; entries whose stored parent distance already shows, by the
triangle inequality, that they cannot hold a better score are left out before any distance is computed. Scores are exact
integers of any size; bounds are doubles with a slack above their error and never exclude a tie. Vectors so large that their
squares are beyond a double have no distances: they stand beside the tree and are scored by every query.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from psephos.llm.common import stored
from psephos.llm.exact import Wholes, all_finite, written

SHARD = 8192
PAGE = 256
FANOUT = 32
BLOCK = 256
#: Blocks that meet a shard in one task.
BLOCKS_PER_TASK = 16
#: Slack for distances, relative to the sizes involved.
SLACK = 1e-9
#: Components from which on a vector stands beside the tree.
LOOSE = 2.0**480


class MTree:
    """Pages of one shard. vectors: rows of finite doubles x, of which floor(256 x) is searched."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.raw = ids, vectors
        self._read()
        tree = np.nonzero(~self.large)[0]
        floors = np.where(self.large[:, None], 0.0, self.wholes.floors)
        square = (floors * floors).sum(axis=1)
        self.most = float(square.max()) if len(ids) else 0.0
        self.lifted = np.hstack([floors, np.sqrt(np.maximum(self.most - square, 0))[:, None]])
        # A node: (pivot, radius, children as node numbers or None, rows, distances of children or rows to the pivot).
        self.nodes: list[tuple] = []
        self.root = self._build(tree, self.lifted[tree].mean(axis=0)) if len(tree) else -1

    def _read(self) -> None:
        self.wholes = Wholes(self.raw)
        self.large = np.abs(self.raw).max(axis=1, initial=0.0) >= LOOSE
        self.loose = np.nonzero(self.large)[0]
        self.any_large = bool(self.wholes.kinds.any())

    def scores(self, rows: np.ndarray, query: Wholes, least: int | None) -> tuple[list[int], list[int]]:
        """(exact inner products with the one query, ids) of these rows, without those below the least one, if there is one."""
        if not len(query.rows[0]) or (self.any_large and self.wholes.kinds[rows].any()):
            return [int(s) for s in self.wholes.take(rows).products(query)[:, 0]], self.ids[rows].tolist()
        found = self.wholes.floors[rows] @ query.floors[0]
        if least is not None:
            keep = found >= float(least)
            rows, found = rows[keep], found[keep]
        return found.astype(np.int64).tolist(), self.ids[rows].tolist()

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> int:
        away = np.linalg.norm(self.lifted[rows] - pivot, axis=1)
        if len(rows) <= PAGE:
            self.nodes.append((pivot, float(away.max()), None, rows, away))
            return len(self.nodes) - 1
        # Pivots far from each other, then each row to its nearest one.
        chosen, far = [int(away.argmax())], None
        for _ in range(min(FANOUT, -(-len(rows) // PAGE)) - 1):
            last = np.linalg.norm(self.lifted[rows] - self.lifted[rows[chosen[-1]]], axis=1)
            far = last if far is None else np.minimum(far, last)
            if far.max() == 0:
                break
            chosen.append(int(far.argmax()))
        if len(chosen) == 1:  # all rows are equal
            parts = np.array_split(rows, -(-len(rows) // PAGE))
        else:
            centres = self.lifted[rows[chosen]]
            square = (centres * centres).sum(axis=1)
            nearest = (square[None, :] - 2 * self.lifted[rows] @ centres.T).argmin(axis=1)
            parts = [rows[nearest == k] for k in range(len(chosen)) if (nearest == k).any()]
            if len(parts) == 1:
                parts = np.array_split(rows, -(-len(rows) // PAGE))
        pivots = [self.lifted[p].mean(axis=0) for p in parts]
        children = [self._build(p, c) for p, c in zip(parts, pivots)]
        self.nodes.append((pivot, float(away.max()), children, None, np.array([np.linalg.norm(c - pivot) for c in pivots])))
        return len(self.nodes) - 1

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) with an id other than the query's, best first, and how many scores were computed."""
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
        asked = Wholes(query[None, :])

        def look(rows: np.ndarray) -> int:
            if not len(rows):
                return 0
            least = best[0][0] if len(best) == k and abs(best[0][0]) < 1 << 53 else None
            for score, row in zip(*self.scores(rows, asked, least)):
                if row != query_id:
                    entry = (score, -row)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            return len(rows)

        unbounded = np.abs(query).max(initial=0.0) >= LOOSE
        seen = look(np.arange(len(self.ids)) if unbounded else self.loose)
        if self.root >= 0 and not unbounded:
            seen += self._best_first(asked.floors[0], best, k, look)
        return [(s, -i) for s, i in sorted(best, reverse=True)], seen

    def _best_first(self, query: np.ndarray, best: list[tuple[int, int]], k: int, look) -> int:
        seen = 0
        lifted = np.append(query, 0.0)
        half = (float(query @ query) + self.most) / 2
        slack = SLACK * (abs(half) + 1)

        def most(distance: float) -> float:
            """The greatest score at no less than this distance."""
            return half - distance * distance / 2 + slack if distance > 0 else half + slack

        def least() -> float:
            if len(best) < k:
                return -np.inf
            score = best[0][0]
            return float(score) if abs(score) < 1 << 1000 else np.copysign(np.inf, score)

        pivot, radius, *_ = self.nodes[self.root]
        d = float(np.linalg.norm(lifted - pivot))
        heap = [(-most(max(0.0, d - radius)), self.root, d)]
        while heap:
            bound, number, d = heapq.heappop(heap)
            if -bound < least():
                break
            _, _, children, rows, stored_distances = self.nodes[number]
            # Triangle inequality by the stored distances: no distance from the query is computed for what this excludes.
            gap = np.abs(d - stored_distances)
            if children is None:
                seen += look(rows[half - gap * gap / 2 + slack >= least()])
                continue
            for child, apart in zip(children, gap.tolist()):
                pivot, radius, *_ = self.nodes[child]
                if most(max(0.0, apart - radius)) < least():
                    continue
                away = float(np.linalg.norm(lifted - pivot))
                upper = most(max(0.0, away - radius))
                if upper >= least():
                    heapq.heappush(heap, (-upper, child, away))
        return seen

    def to_bytes(self) -> bytes:
        """Vectors and pages in one NumPy archive."""
        out = io.BytesIO()
        leaf = [n[2] is None for n in self.nodes]
        np.savez(
            out, ids=self.ids, vectors=self.raw, leaf=np.array(leaf, dtype=bool), pivots=np.array([n[0] for n in self.nodes]), radii=np.array([n[1] for n in self.nodes]),
            sizes=np.array([len(n[4]) for n in self.nodes], dtype=np.int64), entries=np.concatenate([np.asarray(n[3] if n[2] is None else n[2], dtype=np.int64) for n in self.nodes] or [np.zeros(0, np.int64)]),
            distances=np.concatenate([n[4] for n in self.nodes] or [np.zeros(0)]), most=self.most, root=self.root,
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> MTree:
        z = np.load(io.BytesIO(raw), allow_pickle=False)
        tree = cls.__new__(cls)
        tree.ids, tree.raw, tree.most, tree.root, tree.nodes = z["ids"], z["vectors"], float(z["most"]), int(z["root"]), []
        tree._read()
        at = 0
        entries, distances, pivots, radii = z["entries"], z["distances"], z["pivots"], z["radii"]
        for k, (leaf, n) in enumerate(zip(z["leaf"].tolist(), z["sizes"].tolist())):
            e = entries[at : at + n]
            tree.nodes.append((pivots[k], float(radii[k]), None if leaf else e.tolist(), e if leaf else None, distances[at : at + n]))
            at += n
        return tree


def integer_vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, v array<double>): vectors whose components x count as floor(256 x), which the search takes; rows with a null id, a
    null vector, or a null or non-finite component are left out.

    An empty vector has every score 0. Rows that share a vec_id are each a candidate; those with a query's own id are the
    query's own, and its results are the best of them all.
    """
    kept = rows.where(F.col(vec_id).isNotNull() & all_finite(F.col(vector)))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def _packed(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), dims))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def build_index(vectors: DataFrame, shards: int, dims: int) -> DataFrame:
    """(shard, tree): one M-tree for each shard of vectors (vec_id, v)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        tree = MTree(pdf["vec_id"].to_numpy(np.int64), _packed(pdf["v"], dims))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [tree.to_bytes()]})

    # The row's place deals rows that share an id over all shards. vectors is a table read back, so places stay the same.
    placed = vectors.withColumn("row", F.monotonically_increasing_id())
    return placed.withColumn("shard", shard_of(F.struct("vec_id", "row"), shards)).groupBy("shard").applyInPandas(build, "shard int, tree binary")


def shard_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all other vectors; ties to the smaller vec_id.

    vectors and queries: (vec_id, v) as integer_vectors gives them. Fewer than k candidates give fewer rows; an empty
    table gives none. Scores are exact and ranked as such; one that a bigint cannot hold is shown as the nearest bigint.
    """
    n, m = vectors.count(), queries.count()
    dims = max(1, int(vectors.agg(F.max(F.size("v")).alias("d")).head()["d"] or 1))
    shards, groups = max(1, -(-n // SHARD)), max(1, -(-m // (BLOCK * BLOCKS_PER_TASK)))
    trees = stored(build_index(vectors, shards, dims), "m-trees")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", shard_of(F.concat(F.lit("q"), F.col("vec_id").cast("string")), groups).alias("group"), everywhere.alias("shard"))
    held = trees.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(tree_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, str]] = []
        for raw in tree_rows["tree"]:
            tree = MTree.from_bytes(raw)
            for name, q in zip(query_rows["query_id"].tolist(), _packed(query_rows["v"], dims)):
                out += [(name, row, *written(score)) for score, row in tree.search(name, q, k)[0]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "rest"]).astype({c: "int64" for c in ("query_id", "vec_id", "score")})

    found = held.groupBy("group", "shard").cogroup(asked.groupBy("group", "shard")).applyInPandas(search, "query_id long, vec_id long, score long, rest string")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rest"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every row whose vec_id is divisible by 50 against all rows."""
    vectors = stored(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
           from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
             coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::bigint as score
      from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
