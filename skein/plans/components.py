"""Connected components of any edge table, by alternating star contraction.

The rounds follow Kiveris et al., "Connected Components in MapReduce and
Beyond": the large star links a node's larger neighbours to its smallest one,
the small star does so with its smaller ones. The edge count never grows, and
the number of rounds is logarithmic in practice, whatever the diameter. Each
round is aggregations and equi-joins; nothing is collected. A hub's edges are not
dealt by the hub: see ``hot_join``.

Before the first round and after each, every task contracts the edges that it holds
to stars, a bounded number of them at once, which spares rounds and loses no
connection. Where all edges that are left fit into one such lot, that ends it.

Rounds of stars shuffle all edges several times, so they come last. First the edges are
dealt by ranges of nodes and contracted there. Only nodes that occur in several lots
still join stars, so what is left are links between the roots of those, a graph of its
own; it is worked on in the same way while that at least halves it. Where near nodes
have near numbers, little is left after one such level; stars don't need that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.plans.hot import hot_join
from skein.plans.scratch import drop_path, materialise

EDGES_AT_ONCE = 1_000_000


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some edges, and the least node that each reaches."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of edges, each with a number of the lot it was found in; a root points to itself."""
    held: list[pa.RecordBatch] = []
    lot = TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        nonlocal lot
        lot += 1
        table = pa.Table.from_batches(held)
        held.clear()
        node, root = least_roots(table.column("u").to_numpy(), table.column("v").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(np.full(len(node), lot))], ["u", "v", "lot"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= EDGES_AT_ONCE:
            yield flush()
    if held:
        yield flush()


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return hot_join(both.where("v > u"), least, ["u"], "n", 2 * total, F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = hot_join(edges, least, ["u"], "n", total, F.col("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


_STARS = "u long, v long, lot long"


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple[int, int], bool]:
    """The edges contracted within tasks, as a table: that, its path, the number and sum of hashes of those that are no loops, and whether all came from one lot."""
    seen = Observation()
    link = F.col("u") != F.col("v")
    marks = F.count(F.when(link, 1)).alias("n"), F.coalesce(F.sum(F.when(link, F.hash("u", "v").cast("long"))), F.lit(0)).alias("h"), F.min("lot").alias("first"), F.max("lot").alias("last")
    table, path = materialise(edges.mapInArrow(_contract, _STARS).observe(seen, *marks), "cc-round")
    found = seen.get
    return table.select("u", "v"), path, (found["n"], found["h"]), found["first"] == found["last"]


def _by_stars(state: DataFrame, mark: tuple[int, int]) -> DataFrame:
    """``node, component`` of contracted edges (u, v), by rounds of stars."""
    spark = state.sparkSession
    loops = state.where("u = v")
    last, stars, done = None, False, False
    while not done:
        edges = state.where("u <> v")
        if stars:
            # The large star's rows have u > v, as the small star needs them.
            edges = _small_star(_large_star(edges, mark[0]), mark[0]).distinct()
        lots = max(1, -(-mark[0] // EDGES_AT_ONCE))
        state, path, new, done = _written(edges.repartition(lots, "u") if lots == 1 or not stars else edges)
        if last:
            drop_path(spark, last)
        done, mark, stars, last = done or (stars and new == mark), new, True, path
    return _named(state.unionByName(loops).groupBy("u").agg(F.min("v").alias("v")))


def _by_levels(state: DataFrame, mark: tuple[int, int]) -> DataFrame:
    """``node, component`` of contracted edges (u, v), by ranges of nodes and then by the links between their stars."""
    if mark[0] <= EDGES_AT_ONCE:
        return _by_stars(state, mark)
    stars, path, (before, _), done = _written(state.repartitionByRange("v", "u").sortWithinPartitions("v", "u"))
    if done:
        return _named(stars)
    table, _ = materialise(stars.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("most")), "cc-nodes")
    shared = table.where("v < most").select("u", F.col("v").alias("least"))
    links, _, left, done = _written(stars.join(shared, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
    drop_path(state.sparkSession, path)
    if not left[0]:
        return _named(table)
    found = _named(links) if done else _by_levels(links, left) if 2 * left[0] <= before else _by_stars(links, left)
    roots = found.select(F.col("node").alias("v"), "component")
    return table.join(roots, "v", "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component"))


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node on an edge; the component is its least node.

    Nodes are long integers. Edges are undirected; loops, repeats and null ends are
    allowed (null ends are ignored). A node that occurs only in loops is its own
    component.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    state, _, mark, done = _written(ends)
    return _named(state) if done else _by_levels(state, mark)
