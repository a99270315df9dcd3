"""Pointer doubling: where chains of pointers lead, in rounds logarithmic in their length.

A table gives some nodes one pointer each. After k rounds a node knows the node 2^k
pointers on (or the end before that), so each round is one equi-join of the table with
itself. Rings need no components: they are the nodes that never come to an end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.plans.scratch import drop_path, materialise


@dataclass(frozen=True)
class Followed:
    """Where pointers lead.

    ``ends``: ``x, root, steps`` of nodes whose pointers end at ``root``, a node without
    one, after ``steps``. ``rings``: ``x, least`` of the nodes on a ring and its least
    node. ``stray``: ``x`` of nodes that lead into a ring. ``jumps``: tables ``x, to``,
    the k-th with the node 2^k pointers on or the root before that, if asked for.
    """

    ends: DataFrame
    rings: DataFrame
    stray: DataFrame
    jumps: list[DataFrame]
    has_rings: bool


def follow(pointers: DataFrame, keep_jumps: bool = False) -> Followed:
    """Follow ``x, to`` (one row for each x; longs) to the end."""
    spark = pointers.sparkSession
    one = F.lit(1).cast("long")
    starts = pointers.select("x", "to")
    targets = starts.select(F.col("x").alias("to"), F.lit(True).alias("_on"))
    state = starts.join(targets, "to", "left").select("x", "to", one.alias("steps"), F.col("x").alias("least"), F.coalesce("_on", F.lit(False)).alias("live"))
    paths: list[str] = []
    tables: list[DataFrame] = []

    def written(table: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        done, path = materialise(table.observe(seen, F.count(F.when(F.col("live"), 1)).alias("n")), "pointers")
        if paths and not keep_jumps:
            drop_path(spark, paths.pop())
        paths.append(path)
        tables.append(done)
        return done, seen.get["n"]

    state, live = written(state)
    reach, before = 1, None
    # Fewer nodes are open after each round while any chain that ends is; then only rings are left,
    # which are known as such once every node has gone further than there are nodes.
    while live and (live != before or reach < live):
        on = state.select(F.col("x").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("live").alias("_live"))
        new = state.where("live").join(on, "to").select("x", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_live").alias("live"))
        before = live
        state, live = written(state.where("NOT live").unionByName(new))
        reach *= 2
    ends = state.where("NOT live").select("x", F.col("to").alias("root"), "steps")
    bound = state.where("live")
    ring = bound.select(F.col("to").alias("x")).distinct()
    return Followed(ends, bound.join(ring, "x", "left_semi").select("x", "least"), bound.join(ring, "x", "left_anti").select("x"), [t.select("x", "to") for t in tables] if keep_jumps else [], live > 0)


def all_ahead(marked: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``x`` of the marked nodes and of all nodes that their pointers pass, roots included."""
    found = marked.select("x")
    for jump in jumps:
        found, _ = materialise(found.unionByName(found.join(jump, "x").select(F.col("to").alias("x"))).distinct(), "ahead")
    return found
