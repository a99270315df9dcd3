"""Copy numbers of segments from their coverage.

Estimates are per component. They only depend on how many bases have which
coverage, so segments are first added up to a histogram (component, cov), and
windows and self-joins run over that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.functions.ids import segment_of
from skein.operators.graph import AssemblyGraph, delete_segments, normalise
from skein.plans.scratch import drop_path, materialise

LOW_SHARE = 0.3
DROPPED_SHARE = 0.7
#: Components of more arcs are passed by rounds of joins; lots of smaller ones hold about as many arcs as that.
ARCS_IN_TASK = 20_000
ARCS_IN_LOT = 200_000


def histogram(segments: DataFrame) -> DataFrame:
    """``component, cov, bases`` of segments with a component."""
    return segments.groupBy("component", "cov").agg(F.sum("len").alias("bases"))


def lower_bound(segments: DataFrame, share: float = LOW_SHARE) -> DataFrame:
    """``component, lb``: the mean coverage of the lowest ``share`` of bases, times 1 - share.

    Components too small for a base in that share get 0.
    """
    by_cov = Window.partitionBy("component").orderBy("cov").rowsBetween(Window.unboundedPreceding, -1)
    hist = histogram(segments).withColumn("before", F.coalesce(F.sum("bases").over(by_cov), F.lit(0)))
    total = hist.groupBy("component").agg(F.floor(F.sum("bases") * F.lit(share)).cast("long").alias("limit"))
    taken = F.greatest(F.lit(0), F.least("bases", F.col("limit") - F.col("before")))
    sums = hist.join(total, "component").groupBy("component", "limit").agg(F.sum(F.col("cov") * taken).alias("covs"))
    return sums.select("component", F.coalesce(F.try_divide(F.col("covs").cast("double"), F.col("limit")) * (1 - share), F.lit(0.0)).alias("lb"))


def rough_average(segments: DataFrame, min_fraction: float = 0.0) -> DataFrame:
    """``component, rough``: the coverage c of a segment that best explains the bases.

    It minimises how far sum(len * cov) / (c * sum(len)) is from 1, over segments
    with cov / c of at least ``min_fraction``; the lowest such c wins. Coverages
    that leave out over 70 % of the bases, and all above them, don't come into
    question. Without any coverage the result is 0.
    """
    hist = histogram(segments)
    c = hist.where("cov > 0").select("component", F.col("cov").alias("c"))
    if min_fraction > 0:
        kept = (F.col("cov") / F.col("c")) >= min_fraction
        sums = hist.join(c, "component").groupBy("component", "c").agg(
            F.sum(F.when(kept, F.col("bases")).otherwise(0)).alias("bases"),
            F.sum(F.when(kept, F.col("bases") * F.col("cov")).otherwise(0)).alias("mass"),
            F.sum("bases").alias("all"),
        )
        up_to = Window.partitionBy("component").orderBy("c")
        dropped = (F.col("all") - F.col("bases")) / F.col("all") > DROPPED_SHARE
        sums = sums.withColumn("stop", F.max(dropped.cast("int")).over(up_to)).where("stop = 0 and bases > 0")
    else:
        total = hist.groupBy("component").agg(F.sum("bases").alias("bases"), F.sum(F.col("bases") * F.col("cov")).alias("mass"))
        sums = c.join(total.where("bases > 0"), "component")
    away = F.abs(F.col("mass").cast("double") / F.col("c") / F.col("bases") - 1.0)
    best = sums.groupBy("component").agg(F.min_by("c", F.struct(away.alias("away"), "c")).alias("c"))
    every = hist.select("component").distinct()
    return every.join(best, "component", "left").select("component", F.coalesce(F.col("c").cast("double"), F.lit(0.0)).alias("rough"))


def average_coverage(segments: DataFrame, min_fraction: float = 0.0, floor: float = 0.0) -> DataFrame:
    """``component, rough, lb, avg``: the rough average, not under ``floor`` or the lower bound."""
    return rough_average(segments, min_fraction).join(lower_bound(segments), "component").withColumn("avg", F.greatest("rough", F.lit(float(floor)), "lb"))


def copy_numbers(segments: DataFrame, min_copy: int = 1, max_copy: int = 10, min_fraction: float = 0.0, floor: float = 0.0) -> DataFrame:
    """``seg_id, component, copy, avg``: coverage over the average, rounded.

    The average is not refitted to the copies: one rounding is the estimate. Halves
    round up; with a ``floor`` everything does. Without coverage, ``min_copy``.
    """
    averages = average_coverage(segments, min_fraction, floor)
    ratio = F.try_divide(F.col("cov").cast("double"), F.col("avg"))
    whole = F.ceil(ratio) if floor else F.round(ratio)
    copy = F.least(F.greatest(F.coalesce(whole.cast("long"), F.lit(min_copy)), F.lit(min_copy)), F.lit(max_copy))
    return segments.join(averages, "component").select("seg_id", "component", copy.cast("int").alias("copy"), "avg")


def _start(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame) -> DataFrame:
    """``seg_id, copy`` of the labelled segments; without a copy number, 0."""
    own = graph.segments.select("seg_id").join(labels.select("seg_id"), "seg_id")
    return own.join(copies.select("seg_id", "copy"), "seg_id", "left").select("seg_id", F.coalesce("copy", F.lit(0)).cast("int").alias("copy"))


def _arrivals(hops: DataFrame, used: DataFrame) -> DataFrame:
    """``seg_id`` of unused segments that used ones reach along hops ``a, b, key`` of ascending keys.

    The least key at which each can be reached is lowered until it rests: whatever goes on
    from a segment reached late can also go on from it reached early. A round of joins
    for each hop of the longest such way; only what was lowered passes on.
    """
    spark = hops.sparkSession
    open_, open_path = materialise(hops.where("a <> b").join(used.select(F.col("seg_id").alias("b")), "b", "left_anti").select("a", "b", "key"), "hops")
    first = open_.join(used.select(F.col("seg_id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("seg_id")).agg(F.min("key").alias("key"))
    state, path = materialise(first.withColumn("fresh", F.lit(True)), "arrivals")
    while True:
        live = state.where("fresh")
        if live.isEmpty():
            break
        on = open_.join(live.select(F.col("seg_id").alias("a"), F.col("key").alias("_at")), "a").where(F.col("key") > F.col("_at")).groupBy(F.col("b").alias("seg_id")).agg(F.min("key").alias("_new"))
        both = state.select("seg_id", "key").join(on, "seg_id", "full")
        lower = F.col("key").isNull() | (F.col("_new") < F.col("key"))
        new = both.select("seg_id", F.least("key", "_new").alias("key"), F.coalesce(lower & F.col("_new").isNotNull(), F.lit(False)).alias("fresh"))
        new, new_path = materialise(new, "arrivals")
        drop_path(spark, path)
        state, path = new, new_path
    drop_path(spark, open_path)
    return state.select("seg_id")


def _raised_in_order(steps: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``seg_id, copy`` of whole components after ``steps`` passes over their arcs, one arc after the other."""

    def run(segments: pa.Table, arcs: pa.Table) -> pa.Table:
        segments = segments.sort_by("seg_id")
        ids, copy = (segments.column(c).to_numpy() for c in ("seg_id", "copy"))
        v, w = (arcs.column(c).to_numpy() for c in ("v", "w"))
        order = np.lexsort((w, v, v & 1))
        a, b = v[order] >> 1, w[order] >> 1
        inside = np.isin(a, ids) & np.isin(b, ids) & (a != b)
        ends = list(zip(np.searchsorted(ids, a[inside]).tolist(), np.searchsorted(ids, b[inside]).tolist()))
        used, may = (copy > 0).tolist(), segments.column("may").to_pylist()
        for _ in range(steps):
            for x, y in ends:
                if used[x]:
                    used[y] = used[y] or may[y]
                elif used[y]:
                    used[x] = may[x]
        raised = np.where(np.array(used, dtype=bool) & (copy <= 0), 1, copy).astype(np.int32)
        return pa.table({"seg_id": ids, "copy": raised})

    return run


def _spread(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, over: Column, into: Column, steps: int = 1) -> DataFrame:
    """Raise copies from 0 to 1 next to used segments, across arcs for which ``over`` holds, of segments for which ``into`` holds.

    Arcs count one after the other, those of forward vertices first, by (v, w), and a
    raised segment counts as used from then on: so one pass can reach several arcs far.
    There are ``steps`` passes. Components of up to ``ARCS_IN_TASK`` arcs are dealt into lots
    and passed there, so their number of hops costs nothing; larger ones go by rounds of joins.
    """
    spark = graph.arcs.sparkSession
    facts = graph.segments.select("seg_id", F.coalesce(into, F.lit(False)).alias("may"))
    now = _start(graph, labels, copies).join(labels.select("seg_id", "component"), "seg_id").join(facts, "seg_id")
    if not steps:
        return now.select("seg_id", "copy")
    open_ = graph.arcs.where(over).select("v", "w", segment_of("v").alias("seg_id"))
    seen = Observation()
    arcs, _ = materialise(open_.join(labels.select("seg_id", "component"), "seg_id").select("component", "v", "w").observe(seen, F.count(F.lit(1)).alias("n")), "open-arcs")
    now, _ = materialise(now, "copies")
    large, _ = materialise(arcs.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ARCS_IN_TASK).select("component"), "large-components")
    few = large.isEmpty()
    lot = F.pmod(F.xxhash64("component"), F.lit(-(-seen.get["n"] // ARCS_IN_LOT) + 1)).alias("lot")
    dealt = lambda rows, *c: (rows if few else rows.join(large, "component", "left_anti")).select(lot, *c).groupBy("lot")
    done = dealt(now, "seg_id", "copy", "may").cogroup(dealt(arcs, "v", "w")).applyInArrow(_raised_in_order(steps), "seg_id long, copy int")
    if few:
        return done
    now = now.join(large, "component", "left_semi")
    # Parallel arcs follow each other, so their order among themselves makes no difference.
    forth = arcs.join(large, "component", "left_semi").select(segment_of("v").alias("a"), segment_of("w").alias("b"), F.struct(F.col("v").bitwiseAND(F.lit(1).cast("long")).alias("strand"), "v", "w").alias("key"))
    hops = forth.unionByName(forth.select(F.col("b").alias("a"), F.col("a").alias("b"), "key"))
    hops, hops_path = materialise(hops.join(now.where("may").select(F.col("seg_id").alias("b")), "b", "left_semi"), "hops")
    for _ in range(steps):
        raised = _arrivals(hops, now.where("copy > 0")).withColumn("_raised", F.lit(1))
        now, _ = materialise(now.join(raised, "seg_id", "left").select("seg_id", "component", F.coalesce("_raised", "copy").alias("copy"), "may"), "copies")
    drop_path(spark, hops_path)
    return done.unionByName(now.select("seg_id", "copy"))


def rescue_by_arcs(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame) -> DataFrame:
    """``seg_id, copy``: unused segments across a covered arc from a used one get 1."""
    return _spread(graph, labels, copies, F.col("cov") > 0, F.lit(True))


def add_neighbours(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, steps: int = 1, below: int = 0) -> DataFrame:
    """``seg_id, copy``: unused segments shorter than ``below`` next to used ones get 1, ``steps`` times."""
    return _spread(graph, labels, copies, F.lit(True), F.col("len") < below, steps)


def simple_bubbles(graph: AssemblyGraph) -> DataFrame:
    """``l, r, m``: the middles of each pair of covered segments, over the arcs of forward vertices."""
    ahead = graph.arcs.where(F.col("v").bitwiseAND(F.lit(1).cast("long")) == 0).select(segment_of("v").alias("a"), segment_of("w").alias("b")).distinct()
    covered = graph.segments.where("cov > 0").select("seg_id")
    left = ahead.select(F.col("a").alias("l"), F.col("b").alias("m")).where("l <> m").join(covered.withColumnRenamed("seg_id", "l"), "l", "left_semi")
    right = ahead.select(F.col("a").alias("m"), F.col("b").alias("r")).where("m <> r").join(covered.withColumnRenamed("seg_id", "r"), "r", "left_semi")
    return left.join(right, "m").where("l <> r").select("l", "r", "m")


def pick_bubbles(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame) -> DataFrame:
    """``seg_id, copy, excluded``: settle simple bubbles between covered segments, by (left, right).

    If no middle is used when a bubble's turn comes, all get copy 1; else all are marked
    as excluded, the used one too. Their arcs stay, so a search can still cross them.

    Bubbles only meet in their middles. In each round those settle that are first among
    the open ones in all of their middles; the others that share a middle with them are
    excluded. That gives what the order one by one gives, in rounds of joins.
    """
    spark = graph.arcs.sparkSession
    now, _ = materialise(_start(graph, labels, copies), "copies")
    turn = F.struct("l", "r").alias("turn")
    middles, _ = materialise(simple_bubbles(graph).join(now.withColumnRenamed("seg_id", "m"), "m").select(turn, "m", "copy"), "bubbles")
    spoilt = middles.where("copy > 0").select("turn").distinct()
    open_, path = materialise(middles.join(spoilt, "turn", "left_anti").select("turn", "m"), "open-bubbles")
    raised, raised_path = materialise(open_.limit(0), "raised")
    while not open_.isEmpty():
        first = open_.groupBy("m").agg(F.min("turn").alias("first"))
        late = open_.join(first, "m").where("turn > first").select("turn").distinct()
        settled, settled_path = materialise(open_.join(late, "turn", "left_anti").select("turn", "m"), "settled-bubbles")
        gone = open_.join(settled.select("m").distinct(), "m", "left_semi").select("turn").distinct()
        rest, rest_path = materialise(open_.join(gone, "turn", "left_anti").select("turn", "m"), "open-bubbles")
        more, more_path = materialise(raised.unionByName(settled), "raised")
        for old in (path, raised_path, settled_path):
            drop_path(spark, old)
        open_, path, raised, raised_path = rest, rest_path, more, more_path
    excluded = middles.join(raised.select("turn").distinct(), "turn", "left_anti").select(F.col("m").alias("seg_id")).distinct().withColumn("excluded", F.lit(True))
    ones = raised.select(F.col("m").alias("seg_id")).distinct().withColumn("_raised", F.lit(1))
    marked = now.join(ones, "seg_id", "left").join(excluded, "seg_id", "left")
    return marked.select("seg_id", F.coalesce("_raised", "copy").alias("copy"), F.coalesce("excluded", F.lit(False)).alias("excluded"))


def total_weights(segments: DataFrame, copies: DataFrame) -> DataFrame:
    """``component, bases, mass``: bases times copies, and bases times coverage."""
    rows = segments.join(copies.select("seg_id", "copy"), "seg_id")
    return rows.groupBy("component").agg(F.sum(F.col("len") * F.col("copy")).alias("bases"), F.sum(F.col("len") * F.col("cov")).alias("mass"))


def clean_by_coverage(graph: AssemblyGraph, labels: DataFrame, min_fraction: float) -> AssemblyGraph:
    """Drop segments whose coverage is under ``min_fraction`` of their component's average."""
    segments = graph.segments.join(labels, "seg_id")
    averages = average_coverage(segments, min_fraction)
    weak = segments.join(averages, "component").where(F.try_divide(F.col("cov").cast("double"), F.col("avg")) < min_fraction)
    return normalise(delete_segments(graph, weak.select("seg_id")))
