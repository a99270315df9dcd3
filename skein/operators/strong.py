"""Strong components of a directed graph by equi-joins.

Two steps take turns until no arc is left.

* Contraction. A vertex with one arc out can only be in the strong component of where
  that arc leads, so trees of such vertices are drawn into their roots by pointer
  doubling, and rings of them are components of their own. The same is done against the
  arcs. Paths and rings of any length go in a logarithmic number of rounds. Which of the
  vertices drawn in belong to the root's component is settled later: those on the way of
  an arc that comes back from it.
* Colouring. Every vertex takes the largest vertex that reaches it as its colour; the
  members of a colour that reach the vertex it is named for are its component. They go,
  and so do arcs between colours. The rounds follow the width of what contraction leaves.

Nothing is collected, and no component is worked on in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.plans.pointers import Followed, all_ahead, follow
from skein.plans.scratch import drop_path, materialise

#: Paths among fewer vertices than these are short enough for colouring.
LEAST_SINGLE = 32


@dataclass(frozen=True)
class _Drawn:
    """A contraction: arcs ``u, x, root`` into the trees drawn into roots, and the pointers."""

    entries: DataFrame
    followed: Followed
    turned: bool


def _counted(table: DataFrame, what: str) -> tuple[DataFrame, str, int]:
    seen = Observation()
    done, path = materialise(table.observe(seen, F.count(F.lit(1)).alias("n")), what)
    return done, path, seen.get["n"]


def _turned(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("w").alias("v"), F.col("v").alias("w"))


def _inner(arcs: DataFrame) -> DataFrame:
    """Arcs between vertices that have arcs in and out."""
    return arcs.join(arcs.select(F.col("w").alias("v")).distinct(), "v", "left_semi").join(arcs.select(F.col("v").alias("w")).distinct(), "w", "left_semi").select("v", "w")


def _draw_in(arcs: DataFrame, turned: bool) -> tuple[DataFrame, DataFrame, _Drawn] | None:
    """Draw in the vertices with one arc out: what is left, labels of the rings among them, and how to undo it."""
    single = arcs.groupBy(F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("to")).where("n = 1").select("x", "to")
    single, path, n = _counted(single, "single")
    if n < LEAST_SINGLE:
        drop_path(arcs.sparkSession, path)
        return None
    found = follow(single, keep_jumps=True)
    rest = arcs.join(single.select(F.col("x").alias("v")), "v", "left_anti")
    outer = rest.join(single.select(F.col("x").alias("w")), "w", "left_anti")
    entries, _ = materialise(rest.join(found.ends.select(F.col("x").alias("w"), "root"), "w").select(F.col("v").alias("u"), F.col("w").alias("x"), "root"), "entries")
    drawn = entries.select(F.col("u").alias("v"), F.col("root").alias("w")).where("v <> w")
    return outer.select("v", "w").unionByName(drawn).distinct(), found.rings.select("x", F.col("least").alias("label")), _Drawn(entries, found, turned)


def _spread_colours(arcs: DataFrame) -> tuple[DataFrame, str]:
    """``x, colour``: the largest vertex from which arcs lead to x, or x."""
    ends = arcs.select(F.col("v").alias("x")).unionByName(arcs.select(F.col("w").alias("x"))).distinct()
    state, path = materialise(ends.withColumn("colour", F.col("x")), "colours")
    while True:
        # Two steps a round: a write costs more than a join.
        step = lambda s: s.unionByName(arcs.join(s.withColumnRenamed("x", "v"), "v").select(F.col("w").alias("x"), "colour")).groupBy("x").agg(F.max("colour").alias("colour"))
        new = step(step(state)).join(state.withColumnRenamed("colour", "_was"), "x")
        seen = Observation()
        new, new_path = materialise(new.observe(seen, F.count(F.when(F.col("colour") != F.col("_was"), 1)).alias("n")).select("x", "colour"), "colours")
        drop_path(arcs.sparkSession, path)
        state, path = new, new_path
        if not seen.get["n"]:
            return state, path


def _confirmed(arcs: DataFrame, colours: DataFrame) -> DataFrame:
    """``x, label``: the vertices of a colour that reach the vertex it is named for."""
    back = arcs.join(colours.withColumnRenamed("x", "v"), "v").join(colours.select(F.col("x").alias("w"), F.col("colour").alias("_c")), "w").where("colour = _c").select("v", "w")
    back, back_path = materialise(back, "own-arcs")
    found, _ = materialise(colours.where("x = colour").select("x"), "confirmed")
    front = found
    parts = [found]
    while True:
        new = back.join(front.select(F.col("x").alias("w")), "w").select(F.col("v").alias("x")).distinct()
        for part in parts:
            new = new.join(part, "x", "left_anti")
        front, _, n = _counted(new, "confirmed")
        if not n:
            break
        parts.append(front)
        if len(parts) > 8:
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            parts = [materialise(every, "confirmed")[0]]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    done, _ = materialise(every.join(colours, "x").select("x", F.col("colour").alias("label")), "components")
    drop_path(arcs.sparkSession, back_path)
    return done


def strong_labels(arcs: DataFrame) -> DataFrame:
    """``x, scc`` of the vertices in strong components of two or more: the least vertex of each.

    ``arcs`` has ``v, w``, oriented vertices or any long integers; loops, repeats and nulls
    may occur. Vertices that are not returned are components of their own.
    """
    spark = arcs.sparkSession
    state, path, left = _counted(arcs.where("v <> w").select("v", "w").distinct(), "strong-arcs")
    labels: list[DataFrame] = []
    undo: list[tuple[int, _Drawn]] = []
    while left:
        before = left
        for turned in (False, True):
            drawn = _draw_in(_turned(state) if turned else state, turned)
            if drawn is None:
                continue
            rest, rings, how = drawn
            labels.append(materialise(rings, "components")[0])
            undo.append((len(labels), how))
            new, new_path, left = _counted(_inner(_turned(rest) if turned else rest), "strong-arcs")
            drop_path(spark, path)
            state, path = new, new_path
            if not left:
                break
        if not left or left < 0.9 * before:
            continue
        colours, colours_path = _spread_colours(state)
        done = _confirmed(state, colours)
        labels.append(done)
        same = state.join(colours.withColumnRenamed("x", "v"), "v").join(colours.select(F.col("x").alias("w"), F.col("colour").alias("_c")), "w").where("colour = _c")
        open_ = same.join(done.select(F.col("x").alias("v")), "v", "left_anti").join(done.select(F.col("x").alias("w")), "w", "left_anti")
        new, new_path, left = _counted(_inner(open_.select("v", "w")), "strong-arcs")
        for old in (path, colours_path):
            drop_path(spark, old)
        state, path = new, new_path
    known = spark.createDataFrame([], "x long, label long")
    # Backwards: labels found after a contraction hold for its roots and for what leads into its trees.
    for turn in range(len(labels), -1, -1):
        for _, how in [u for u in undo if u[0] == turn][::-1]:
            entries = how.entries.join(known.select(F.col("x").alias("u"), F.col("label").alias("_u")), "u", "left").join(known.select(F.col("x").alias("root"), F.col("label").alias("_r")), "root", "left")
            back = entries.where("coalesce(_u, u) = coalesce(_r, root)").select("x")
            members = all_ahead(back.distinct(), how.followed.jumps).join(how.followed.ends, "x").select("x", "root")
            named = members.join(known.select(F.col("x").alias("root"), "label"), "root", "left").select("x", F.coalesce("label", "root").alias("label"))
            roots = named.select(F.col("label").alias("x"), "label").distinct()
            known, _ = materialise(known.unionByName(named).unionByName(roots).distinct(), "components")
        if turn:
            known = known.unionByName(labels[turn - 1])
    least = known.groupBy("label").agg(F.min("x").alias("scc"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(least, "label").select("x", "scc")
