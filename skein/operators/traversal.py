"""Components, reachability, strong components, sources and dominators.

Reachability runs as a loop of joins from a frontier, each round written to the
shared folder. Strong components and dominators are in modules of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import flip, segment_of
from skein.operators.dominators import dominating, dominator_tree
from skein.operators.graph import AssemblyGraph, first_arcs
from skein.operators.strong import strong_labels
from skein.plans.components import connected_components
from skein.plans.scratch import drop_path, materialise


def components(graph: AssemblyGraph) -> DataFrame:
    """``seg_id, component``: the least segment that can be reached on either strand."""
    pairs = graph.arcs.select(segment_of("v").alias("a"), segment_of("w").alias("b"))
    found = connected_components(pairs, "a", "b").withColumnRenamed("node", "seg_id")
    return graph.segments.select("seg_id").join(found, "seg_id", "left").select("seg_id", F.coalesce("component", "seg_id").alias("component"))


def component_of(labels: DataFrame, v: int) -> DataFrame:
    """The segments in the component of the oriented vertex ``v``; none if it has none."""
    return labels.join(labels.where(F.col("seg_id") == v >> 1).select("component"), "component", "left_semi").select("seg_id")


def arcs_with_component(graph: AssemblyGraph, labels: DataFrame) -> DataFrame:
    return graph.arcs.withColumn("seg_id", segment_of("v")).join(labels, "seg_id").drop("seg_id")


def _expand(start: DataFrame, arcs: DataFrame, lens: DataFrame, steps: int, dist: int, strands: bool) -> DataFrame:
    """``x, hops, bp``: first arrivals from ``start`` (x, hops, bp), by rounds.

    A vertex passes on only while its hops and bases are under the limits (0: no
    limit). An arrival adds the target's length without the overlap. Within a
    round the smallest arrival wins.
    """
    spark = start.sparkSession
    reached, path = materialise(start, "reach")
    edges, _ = materialise(first_arcs(arcs).select("v", "w", "ls").join(lens.select(F.col("seg_id").alias("_s"), "len"), F.col("_s") == segment_of("w")).select("v", "w", (F.col("len") - F.col("ls")).alias("gain")), "edges")
    round_ = 0
    while True:
        live = reached.where(F.col("hops") == round_)
        if steps and round_ >= steps:
            break
        if dist:
            live = live.where(F.col("bp") < dist)
        new = edges.join(live, edges["v"] == live["x"]).select("w", (F.col("hops") + 1).alias("hops"), (F.col("bp") + F.col("gain")).alias("bp"))
        if strands:
            new = new.unionByName(new.withColumn("w", flip("w")))
        new = new.groupBy(F.col("w").alias("x")).agg(F.min("hops").alias("hops"), F.min("bp").alias("bp")).join(reached.select("x"), "x", "left_anti")
        grown, new_path = materialise(reached.unionByName(new), "reach")
        if grown.where(F.col("hops") == round_ + 1).isEmpty():
            return grown
        drop_path(spark, path)
        reached, path, round_ = grown, new_path, round_ + 1
    return reached


def subgraph(graph: AssemblyGraph, seeds: DataFrame, steps: int = 0, dist: int = 0) -> DataFrame:
    """``seg_id, hops, bp``: segments within the limits of the seeds (seg_id), on any strand."""
    zero = F.lit(0).cast("long")
    start = seeds.select("seg_id").distinct().select(F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("x"), zero.alias("hops"), zero.alias("bp"))
    found = _expand(start, graph.arcs, graph.segments, steps, dist, strands=True)
    return found.groupBy(segment_of("x").alias("seg_id")).agg(F.min("hops").alias("hops"), F.min("bp").alias("bp"))


def restrict(graph: AssemblyGraph, kept: DataFrame) -> AssemblyGraph:
    """The graph of the segments ``seg_id`` and the arcs among them."""
    ids = kept.select("seg_id").distinct()
    arcs = graph.arcs
    for end in ("v", "w"):
        arcs = arcs.withColumn("seg_id", segment_of(end)).join(ids, "seg_id", "left_semi").drop("seg_id")
    return AssemblyGraph(graph.segments.join(ids, "seg_id", "left_semi"), arcs.select(*graph.arcs.columns))


def path_exists(graph: AssemblyGraph, source: int, sink: int, steps: int = 0, dist: int = 0) -> DataFrame:
    """One row ``hops, bp`` if arcs lead from ``source`` to ``sink``, else none.

    From a vertex to itself a real cycle is needed. ``bp`` counts the bases before
    the arc that arrives.
    """
    zero = F.lit(0).cast("long")
    spark = graph.arcs.sparkSession
    start = spark.range(1).select(F.lit(source).cast("long").alias("x"), zero.alias("hops"), zero.alias("bp"))
    found = _expand(start, graph.arcs, graph.segments, max(0, steps - 1) if steps else 0, dist, strands=False)
    last = graph.arcs.where(F.col("w") == sink).select(F.col("v").alias("x")).distinct()
    arrivals = found.join(last, "x")
    if steps == 1:
        arrivals = arrivals.where("hops = 0")
    return arrivals.orderBy("hops", "bp").limit(1).select((F.col("hops") + 1).alias("hops"), "bp")


def per_component(graph: AssemblyGraph, labels: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, extra: DataFrame | None = None) -> DataFrame:
    """Run ``kernel(segments, arcs)`` on every connected component.

    ``segments`` come in the order of ids, ``arcs`` of (v, w); ``extra`` columns by
    seg_id are joined to the segments. A component is one group, so these kernels
    suit what the order of steps decides.
    """
    segments = graph.segments.select("seg_id", "len", "cov").join(labels, "seg_id")
    if extra is not None:
        segments = segments.join(extra, "seg_id", "left")
    # A column of its own: both sides of a cogroup must not share one.
    arcs = arcs_with_component(graph, labels).withColumn("component", F.col("component") + 0)

    def run(s: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return kernel(s.sort_values("seg_id", ignore_index=True), a.sort_values(["v", "w", "ls", "cov", "link_id"], ignore_index=True))

    return segments.groupBy("component").cogroup(arcs.groupBy("component")).applyInPandas(run, schema)


def targets_by_vertex(arcs: pd.DataFrame) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for v, w in zip(arcs["v"].tolist(), arcs["w"].tolist()):
        out.setdefault(v, []).append(w)
    return out


def strong_components(graph: AssemblyGraph, labels: DataFrame) -> DataFrame:
    """``component, v, scc`` of every oriented vertex; ``scc`` is the least vertex of its strong component."""
    found = strong_labels(graph.arcs.select("v", "w")).withColumnRenamed("x", "v")
    vertices = labels.select("component", F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("v"))
    return vertices.join(found, "v", "left").select("component", "v", F.coalesce("scc", "v").alias("scc"))


def choose_sources(graph: AssemblyGraph, labels: DataFrame, by_scc: bool = True) -> DataFrame:
    """``component, seg_id``: where to start a search, on the forward strand.

    The strong component with the most bases times coverage (a segment counts once
    for both strands; the one with the lower least vertex wins ties), and in it the
    heaviest segment (the lower id wins). Without ``by_scc``, the heaviest of all.
    """
    weight = (F.col("len") * F.col("cov")).alias("weight")
    weights = graph.segments.select("seg_id", weight).join(labels, "seg_id")
    if by_scc:
        scc = strong_components(graph, labels).select("component", "scc", segment_of("v").alias("seg_id")).distinct()
        members = weights.join(scc, ["component", "seg_id"])
        best = members.groupBy("component", "scc").agg(F.sum("weight").alias("total"))
        best = best.groupBy("component").agg(F.max_by("scc", F.struct("total", (-F.col("scc")).alias("s"))).alias("scc"))
        weights = members.join(best, ["component", "scc"])
    return weights.groupBy("component").agg(F.max_by("seg_id", F.struct("weight", (-F.col("seg_id")).alias("s"))).alias("seg_id"))


def dominators(graph: AssemblyGraph, labels: DataFrame, source: int) -> DataFrame:
    """``v, idom`` in the component of ``source``; null for it and what it doesn't reach."""
    own = component_of(labels, source)
    tree = dominator_tree(restrict(graph, own).arcs, source)
    vertices = own.select(F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("v"))
    return vertices.join(tree, "v", "left").select("v", "idom")


def cut_points(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, source: int, target: int) -> DataFrame:
    """``place, v``: the vertices between which a search from ``source`` to ``target`` can be split.

    From the source (place 0) to the target: the ends, and the target's dominators with
    copy number 1 and one arc on either side; places ascend. If the target cannot be
    reached, just the ends.
    """
    spark = graph.arcs.sparkSession
    chain, _ = materialise(dominating(dominators(graph, labels, source), target), "cut-points")
    ends = spark.createDataFrame([(0, source), (1, target)], "place long, v long")
    inner = chain.where(~F.col("v").isin(source, target)).select(F.col("depth").alias("place"), "v")
    single = graph.arcs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("v")
    good = inner.join(single, "v", "left_semi").withColumn("o", flip("v")).join(single.withColumnRenamed("v", "o"), "o", "left_semi")
    good = good.withColumn("seg_id", segment_of("v")).join(copies.where("copy = 1").select("seg_id"), "seg_id", "left_semi").select("place", "v")
    # The target is deeper than all its dominators.
    last = chain.where(F.col("v") == target).select(F.col("depth").alias("_last"))
    placed = ends.join(F.broadcast(last), F.col("v") == target, "left").select(F.coalesce(F.when(F.col("v") != source, F.col("_last")), "place").alias("place"), "v")
    return placed.unionByName(good)


def rank_paths(paths: DataFrame) -> DataFrame:
    """``best``: the heaviest circular paths, and the linear ones if they outweigh those.

    All paths of a kind with that kind's largest ``wlen`` count; the order is by
    (wlen, len, ec, nv), descending.
    """
    top = Window.partitionBy("component")
    circ = F.coalesce(F.max(F.when(F.col("circ"), F.col("wlen"))).over(top), F.lit(float("-inf")))
    line = F.coalesce(F.max(F.when(~F.col("circ"), F.col("wlen"))).over(top), F.lit(float("-inf")))
    best = F.when(F.col("circ"), F.col("wlen") >= circ).otherwise((F.col("wlen") >= line) & (line > circ))
    return paths.withColumn("best", best)
