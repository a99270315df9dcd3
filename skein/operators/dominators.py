"""Dominators and cut points by equi-joins.

A tree in which every vertex stands below all its dominators is drawn up until it is the
tree of dominators. It starts as a breadth-first tree; in each round every vertex moves
below the lowest common ancestor of all vertices with an arc to it. Common ancestors come
from tables of the ancestors 1, 2, 4, ... steps up, made by pointer doubling. Once no
vertex moves, each one's parent lies on all ways to it.

Stretches without branches are one vertex meanwhile: inside them, the vertex before
dominates the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.plans.pointers import all_ahead, follow
from skein.plans.scratch import drop_path, materialise

JOINS_AT_ONCE = 4


def _heads(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``x, head, steps`` of the vertices behind the first one of their stretch, and the links ``v, w`` inside stretches."""
    one_out = arcs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("v")
    one_in = arcs.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("w")
    links, _ = materialise(arcs.join(one_out, "v", "left_semi").join(one_in, "w", "left_semi").select("v", "w"), "stretches")
    return follow(links.select(F.col("w").alias("x"), F.col("v").alias("to"))).ends.withColumnRenamed("root", "head"), links


def _breadth_first(arcs: DataFrame, source: int) -> DataFrame:
    """``x, up`` of every vertex behind ``source``: its parent in a breadth-first tree."""
    spark = arcs.sparkSession
    start = spark.range(1).select(F.lit(source).cast("long").alias("x"), F.lit(None).cast("long").alias("up"))
    front, _ = materialise(start, "tree")
    parts = [front]
    while True:
        new = arcs.join(front.select(F.col("x").alias("v")), "v").groupBy(F.col("w").alias("x")).agg(F.min("v").alias("up"))
        for part in parts:
            new = new.join(part.select("x"), "x", "left_anti")
        seen = Observation()
        front, _ = materialise(new.observe(seen, F.count(F.lit(1)).alias("n")), "tree")
        if not seen.get["n"]:
            break
        parts.append(front)
        if len(parts) > 8:
            parts = [materialise(_union(parts), "tree")[0]]
    return _union(parts).where("up IS NOT NULL")


def _union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def common_ancestors(pairs: DataFrame, depths: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``pairs`` (a, b, ...) with ``top``, their lowest common ancestor, and ``top_depth``.

    ``depths`` has ``x, depth`` of all nodes but the root; ``jumps`` the ancestors 2^k up,
    or the root. All pairs are in one tree.
    """
    for end in ("a", "b"):
        depth = depths.select(F.col("x").alias(end), F.col("depth").alias(f"_d{end}"))
        pairs = pairs.join(depth, end, "left").withColumn(f"_d{end}", F.coalesce(f"_d{end}", F.lit(0)))
    deeper = F.col("_da") >= F.col("_db")
    rows = pairs.withColumn("_low", F.when(deeper, F.col("a")).otherwise(F.col("b"))).withColumn("_high", F.when(deeper, F.col("b")).otherwise(F.col("a")))
    rows = rows.withColumn("_gap", F.abs(F.col("_da") - F.col("_db"))).withColumn("_depth", F.least("_da", "_db")).drop("_da", "_db")
    paths: list[str] = []

    def settled(table: DataFrame, turn: int) -> DataFrame:
        """A long chain of joins in parts."""
        if turn % JOINS_AT_ONCE:
            return table
        done, path = materialise(table, "ancestors")
        paths.append(path)
        if len(paths) > 1:
            drop_path(table.sparkSession, paths.pop(0))
        return done

    turn = 0
    for k, jump in enumerate(jumps):
        to = jump.select(F.col("x").alias("_low"), F.col("to").alias("_to"))
        move = F.col("_gap").bitwiseAND(F.lit(1 << k)) > 0
        turn += 1
        rows = settled(rows.join(to, "_low", "left").withColumn("_low", F.when(move, F.col("_to")).otherwise(F.col("_low"))).drop("_to"), turn)
    for k, jump in reversed(list(enumerate(jumps))):
        for end in ("_low", "_high"):
            rows = rows.join(jump.select(F.col("x").alias(end), F.col("to").alias(f"_to{end}")), end, "left")
        apart = (F.col("_to_low") != F.col("_to_high")) & (F.col("_depth") >= 1 << k)
        for end in ("_low", "_high"):
            rows = rows.withColumn(end, F.when(apart, F.col(f"_to{end}")).otherwise(F.col(end)))
        rows = rows.withColumn("_depth", F.when(apart, F.col("_depth") - (1 << k)).otherwise(F.col("_depth"))).drop("_to_low", "_to_high")
        turn += 2
        rows = settled(rows, turn)
    same = F.col("_low") == F.col("_high")
    rows = rows.join(jumps[0].select(F.col("x").alias("_low"), F.col("to").alias("_to")), "_low", "left")
    rows = rows.withColumn("top", F.when(same, F.col("_low")).otherwise(F.col("_to"))).withColumn("top_depth", F.when(same, F.col("_depth")).otherwise(F.col("_depth") - 1))
    return rows.drop("_low", "_high", "_gap", "_depth", "_to")


def _drawn_up(arcs: DataFrame, tree: DataFrame) -> DataFrame:
    """``x, up``: the dominator tree from a tree of ways (x, up) and the arcs among its vertices."""
    spark = arcs.sparkSession
    tree, path = materialise(tree, "dominators")
    while True:
        followed = follow(tree.select("x", F.col("up").alias("to")), keep_jumps=True)
        pairs = arcs.join(tree.select(F.col("x").alias("w"), F.col("up").alias("a")), "w").where("v <> a").select(F.col("w").alias("x"), "a", F.col("v").alias("b"))
        tops = common_ancestors(pairs, followed.ends.select("x", F.col("steps").alias("depth")), followed.jumps)
        best = tops.groupBy("x").agg(F.min_by("top", "top_depth").alias("top"))
        seen = Observation()
        moved = tree.join(best, "x", "left").select("x", F.coalesce("top", "up").alias("up"), F.col("up").alias("_was"))
        new, new_path = materialise(moved.observe(seen, F.count(F.when(F.col("up") != F.col("_was"), 1)).alias("n")).select("x", "up"), "dominators")
        drop_path(spark, path)
        tree, path = new, new_path
        if not seen.get["n"]:
            return tree


def dominator_tree(arcs: DataFrame, source: int) -> DataFrame:
    """``v, idom`` of every vertex that can be reached from ``source``, but for itself.

    ``arcs`` has ``v, w``; loops and repeats may occur. The breadth-first tree takes a round
    for each branching vertex on the longest of shortest ways, everything else a
    logarithmic number of rounds in the depth of the tree, times the rounds until it rests
    (few, unless loops are nested deeply).
    """
    clean, _ = materialise(arcs.where(f"v <> w AND w <> {int(source)}").select("v", "w").distinct(), "dominator-arcs")
    heads, links = _heads(clean)
    heads, _ = materialise(heads, "heads")
    between = clean.join(links, ["v", "w"], "left_anti").join(heads.select(F.col("x").alias("v"), "head"), "v", "left").select(F.coalesce("head", "v").alias("v"), "w").where("v <> w").distinct()
    between, _ = materialise(between, "stretch-arcs")
    ways, _ = materialise(_breadth_first(between, source), "tree")
    inside = between.join(ways.select(F.col("x").alias("v")).unionByName(arcs.sparkSession.range(1).select(F.lit(source).cast("long").alias("v"))), "v", "left_semi")
    tree = _drawn_up(materialise(inside, "stretch-arcs")[0], ways)
    lasts = heads.groupBy(F.col("head").alias("up")).agg(F.max_by("x", "steps").alias("last"))
    of_heads = tree.join(lasts, "up", "left").select(F.col("x").alias("v"), F.coalesce("last", "up").alias("idom"))
    reached = tree.select(F.col("x").alias("head")).unionByName(arcs.sparkSession.range(1).select(F.lit(source).cast("long").alias("head")))
    of_rest = heads.join(reached, "head", "left_semi").join(links.select(F.col("w").alias("x"), "v"), "x").select(F.col("x").alias("v"), F.col("v").alias("idom"))
    return of_heads.unionByName(of_rest)


def dominating(tree: DataFrame, target: int) -> DataFrame:
    """``v, depth``: ``target`` and all its dominators in a tree ``v, idom``; the source has depth 0. Empty if it isn't in the tree."""
    tree, _ = materialise(tree.where("idom IS NOT NULL").select(F.col("v").alias("x"), F.col("idom").alias("to")), "dominators")
    followed = follow(tree, keep_jumps=True)
    chain = all_ahead(tree.where(F.col("x") == target).select("x"), followed.jumps)
    return chain.join(followed.ends, "x", "left").select(F.col("x").alias("v"), F.coalesce("steps", F.lit(0)).alias("depth"))
