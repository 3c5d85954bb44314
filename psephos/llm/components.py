"""Connected components of an edge table, by rounds of large-star and small-star joins and of forests within tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import stored

#: Edges that a task looks at together when it makes a forest of them: 16 bytes each and about five times that in between.
CHUNK = 1 << 19


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of edges (a, b), both long and not null, the smallest node that can be reached.

    A task first replaces what edges it holds by stars around the smallest node of each of their components, so that later
    rounds have fewer and shorter ways. Each round groups by node with map-side minima and joins them back; its result is
    a table in the shared folder. The rounds end when every node has one smaller neighbour or only larger ones: all edges
    are then (node, smallest node). Ties cannot arise; loops and repeated edges change nothing; an empty table gives none.
    """
    now = stored(_stars(edges.select("a", "b")), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = stored(_stars(stored(_small_star(stored(_large_star(now), "large-star")), "small-star")), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # A star that lies in several tasks is there once each.
    now = now.distinct()
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these edges that are not the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, one, other = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        one, other = root[one], root[other]
        apart = one != other
        if not apart.any():
            break
        one, other = one[apart], other[apart]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while not np.array_equal(further := root[root], root):
            root = further
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[tied], nodes[root[tied]]


def _stars(edges: DataFrame) -> DataFrame:
    """The edges of each task, in chunks, as stars: never more rows than before, none of them a loop."""
    most = CHUNK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def put_together() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= most:
                yield put_together()
                held = []
        if held:
            yield put_together()

    return edges.mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether no node has two different smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("least"), F.col("b").alias("most"), F.lit(False).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most"), F.lit(True).alias("centre")))
    each = ends.groupBy("node").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("centre").alias("centre"))
    return each.where("least <> most or (centre and least is not null)").agg(F.count(F.lit(1)).alias("n")).head()["n"] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
