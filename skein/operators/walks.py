"""Walks that respect copy numbers: enumeration, measures, ranking, search.

A walk may enter a segment, on either strand, as often as its copy number says;
its start counts as entered once in any case. Maximal walks cannot be extended.

Walks grow all at once, a join for each step. ``search_walks`` has a limit, which cuts
in the order of vertex ids as a depth-first search would: a walk behind as many others
as the limit allows, each of which will end as a walk at least, can be left at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.functions.ids import flip, segment_of
from skein.operators.graph import AssemblyGraph, first_arcs
from skein.operators.traversal import choose_sources, component_of, cut_points
from skein.plans.dense import dense_index
from skein.plans.scratch import materialise

MAX_PATHS = 10_000_000
STEPS_AT_ONCE = 4
FEW_WALKS = 100_000
EPSILON = 2.220446049250313e-16


def enumerate_walks(arcs: DataFrame, copies: DataFrame, starts: DataFrame, target: int | None = None) -> DataFrame:
    """``path``: all maximal walks from ``starts`` (v), in no order.

    With a ``target``, a walk also ends there once the target's copies are used.
    """
    budget = copies.select(F.col("seg_id").alias("_seg"), "copy")
    steps, _ = materialise(arcs.select("v", "w").join(budget, F.col("_seg") == segment_of("w")).select(F.col("v").alias("_v"), "w", "copy"), "steps")
    # The copies of the last vertex travel along, for the target's rule.
    open_, path = materialise(starts.select(F.array("v").alias("path")), "walks")
    ended: list[DataFrame] = []
    wanted = copies.where(F.col("seg_id") == (target >> 1 if target is not None else -1)).select("copy").first()
    while True:
        last = F.element_at("path", -1)
        used = lambda seg: F.size(F.filter("path", lambda x: F.shiftright(x, 1) == seg))
        going = open_
        if target is not None and wanted is not None:
            full = (last == target) & (used(F.lit(target >> 1)) >= wanted["copy"])
            ended.append(open_.where(full))
            going = open_.where(~full)
        fits = going.withColumn("_last", last).join(steps, F.col("_last") == F.col("_v"), "left")
        fits = fits.withColumn("_ok", F.coalesce(used(segment_of("w")) < F.col("copy"), F.lit(False)))
        grown, new_path = materialise(fits.where("_ok").select(F.concat("path", F.array("w")).alias("path")), "walks")
        stuck = fits.groupBy("path").agg(F.max("_ok").alias("_any"), F.count(F.lit(1)).alias("_n")).where("not _any").select("path")
        ended.append(stuck)
        if grown.isEmpty():
            break
        open_, path = grown, new_path
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def _choices(arcs: DataFrame, copies: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """``v, on``: for each vertex its targets in order, with their copies and what they are clones of (``w, copy, kin``)."""
    rows = arcs.select("v", "w").withColumn("seg_id", segment_of("w")).join(copies.select("seg_id", "copy"), "seg_id")
    if alike is not None:
        rows = rows.join(alike.select("seg_id", "origin"), "seg_id", "left")
    else:
        rows = rows.withColumn("origin", F.lit(None).cast("long"))
    strand = F.col("w").bitwiseAND(F.lit(1).cast("long"))
    kin = (2 * F.col("origin") + strand).alias("kin")
    return rows.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("w", F.col("copy").cast("int").alias("copy"), kin))).alias("on"))


def _step(rows: DataFrame, choices: DataFrame, target: int | None, own_copy: int | None) -> DataFrame:
    """Every open walk with each vertex that it can enter next; one that can enter none is done."""
    used = lambda seg: F.size(F.filter("path", lambda x: F.shiftright(x, 1) == seg))
    free = F.filter("on", lambda c: used(F.shiftright(c["w"], 1)) < c["copy"])
    # Of free clones of one segment, which are alike, only the first is entered.
    own = F.filter("free", lambda c, i: c["kin"].isNull() | ~F.exists(F.slice("free", F.lit(1), i), lambda b: b["kin"].eqNullSafe(c["kin"])))
    # Walks that are done find no choices; keys that no vertex has spread them over the join.
    nowhere = -1 - F.pmod(F.xxhash64("path"), F.lit(1_000))
    going = rows.withColumn("v", F.when(F.col("done"), nowhere).otherwise(F.element_at("path", -1))).join(choices, "v", "left").drop("v")
    if target is not None and own_copy is not None:
        full = (F.element_at("path", -1) == target) & (used(F.lit(target >> 1)) >= own_copy)
        going = going.withColumn("on", F.when(~full, F.col("on")))
    grown = going.withColumn("free", F.coalesce(free, F.array().cast("array<struct<w:bigint,copy:int,kin:bigint>>"))).withColumn("c", F.explode_outer(own))
    ended = F.col("c").isNull()
    return grown.select("component", "base", F.when(ended, F.col("path")).otherwise(F.concat("path", F.array("c.w"))).alias("path"), ended.alias("done"))


def _first_of(walks: DataFrame, limits: DataFrame) -> DataFrame:
    """The first ``limit`` walks of each component, by base and then by vertex ids."""
    placed = dense_index(walks, ["component", "base", "path"], "_n")
    placed, _ = materialise(placed, "walks")
    starts = placed.groupBy("component").agg(F.min("_n").alias("_first"))
    return placed.join(starts.join(limits, "component"), "component").where(F.col("_n") - F.col("_first") < F.col("limit")).select(walks.columns)


def grow_walks(starts: DataFrame, choices: DataFrame, limits: DataFrame, target: int | None = None, own_copy: int | None = None) -> DataFrame:
    """``component, base, path``: the maximal walks that go on from ``starts`` (the same columns), in no order.

    Of each component's walks the first ``limit`` (``limits``: component, limit) by base and
    then by vertex ids come back. Each open walk has at least one maximal walk
    behind it, so one that stands behind ``limit`` others, open or done, can be left: all
    that is kept at any time is a table of about as many rows, wherever the limit cuts.
    """
    spark = starts.sparkSession
    least = limits.agg(F.min("limit").alias("n")).first()["n"] or 0
    open_, path = materialise(starts.select("component", "base", "path", F.lit(False).alias("done")), "walks")
    ended: list[DataFrame] = []
    n_ended, n_open = 0, 1
    while True:
        rows = open_
        # While there are few, several steps make one job.
        for _ in range(STEPS_AT_ONCE if n_open <= FEW_WALKS else 1):
            rows = _step(rows, choices, target, own_copy)
        seen = Observation()
        table, new_path = materialise(rows.observe(seen, F.count(F.when(F.col("done"), 1)).alias("done"), F.count(F.when(~F.col("done"), 1)).alias("open")), "walks")
        ended.append(table.where("done"))
        n_ended, n_open = n_ended + seen.get["done"], seen.get["open"]
        open_, path = table.where("NOT done"), new_path
        if n_ended + n_open > least:
            every = ended[0]
            for part in ended[1:]:
                every = every.unionByName(part)
            kept, path = materialise(_first_of(every.unionByName(open_), limits), "walks")
            ended, open_ = [kept.where("done")], kept.where("NOT done")
            n_open = open_.count()
            n_ended = kept.count() - n_open
        if not n_open:
            break
    every = ended[0]
    for part in ended[1:]:
        every = every.unionByName(part)
    return every.select("component", "base", "path")


def _by_weight(walks: DataFrame, graph: AssemblyGraph) -> DataFrame:
    """``component, base, path``: walks numbered from the heaviest of each component, equal ones by vertex ids."""
    numbered, _ = materialise(dense_index(walks.select("component", "path"), ["component", "path"], "_id"), "walks")
    steps = numbered.select("_id", F.col("path").alias("_p"), F.posexplode("path").alias("at", "w")).withColumn("v", F.when(F.col("at") > 0, F.get("_p", F.col("at") - 1))).drop("_p")
    steps = steps.join(first_arcs(graph.arcs).select("v", "w", "ls"), ["v", "w"], "left").withColumn("seg_id", segment_of("w")).join(graph.segments.select("seg_id", "len", "cov"), "seg_id")
    weights = steps.groupBy("_id").agg(F.sum(F.col("cov") * (F.col("len") - F.coalesce("ls", F.lit(0)))).alias("_less"))
    return dense_index(numbered.join(weights, "_id").withColumn("_less", -F.col("_less")), ["component", "_less", "path"], "base").select("component", "base", "path")


def search_walks(
    graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, sources: DataFrame, target: int | None = None, max_paths: int = MAX_PATHS,
    both_ways: bool = True, alike: DataFrame | None = None,
) -> DataFrame:
    """``component, turn, path, exceeded``: the walks from ``sources`` (component, v) in the order of vertex ids.

    With ``both_ways`` every walk is then read from its other end and extended
    there too, the heaviest first (equal ones in the order of ids), up to twice the
    limit. Reaching a limit exactly counts as exceeding it; what comes first up to
    then is returned. Of segments that ``alike`` (seg_id, origin) names clones of one
    origin, a walk enters the first free one only.
    """
    inside = labels.join(sources.select("component").distinct(), "component", "left_semi")
    arcs = graph.arcs.withColumn("seg_id", segment_of("v")).join(inside.select("seg_id"), "seg_id", "left_semi").select("v", "w")
    choices, _ = materialise(_choices(arcs, copies, alike), "choices")
    own = lambda v: None if v is None else (copies.where(F.col("seg_id") == v >> 1).select("copy").first() or [None])[0]
    limits = sources.select("component", F.lit(max_paths).cast("long").alias("limit")).distinct()
    starts = sources.select("component", F.lit(0).cast("long").alias("base"), F.array(F.col("v").cast("long")).alias("path"))
    found, _ = materialise(grow_walks(starts, choices, limits, target, own(target)), "walks")
    counts, _ = materialise(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "walk-counts")
    over = counts.select("component", (F.col("n") >= max_paths).alias("exceeded"))
    if both_ways:
        # The first pass's walks count towards the limit.
        rest = counts.where(F.col("n") < max_paths).select("component", (2 * max_paths - F.col("n")).alias("limit"))
        again = _by_weight(found.join(rest.select("component"), "component", "left_semi"), graph)
        back = None if target is None else target ^ 1
        longer = grow_walks(flip_walks(again), choices, rest, back, own(back))
        # The order is that of the walks as they were extended.
        longer, _ = materialise(longer.select("component", "base", F.reverse(F.transform("path", flip)).alias("path"), F.col("path").alias("_read")), "walks")
        full = longer.groupBy("component").agg(F.count(F.lit(1)).alias("m")).join(rest, "component").select("component", (F.col("m") >= F.col("limit")).alias("_full"))
        kept = found.join(over.where("exceeded").select("component"), "component", "left_semi").select("component", "base", "path", F.col("path").alias("_read"))
        found = longer.unionByName(kept)
        over = over.join(full, "component", "left").select("component", (F.col("exceeded") | F.coalesce("_full", F.lit(False))).alias("exceeded"))
    else:
        found = found.withColumn("_read", F.col("path"))
    turns, _ = materialise(dense_index(found, ["component", "base", "_read"], "_n"), "walks")
    first = turns.groupBy("component").agg(F.min("_n").alias("_first"))
    return turns.join(first, "component").join(over, "component").select("component", (F.col("_n") - F.col("_first")).alias("turn"), "path", "exceeded")


def clip_to_target(walks: DataFrame, target: int) -> DataFrame:
    """Cut every walk at its last visit of ``target``; walks that miss it go."""
    size = F.size("path")
    back = F.array_position(F.reverse("path"), F.lit(target).cast("long"))
    return walks.where(back > 0).withColumn("path", F.slice("path", 1, (size - back + 1).cast("int")))


def measure(walks: DataFrame, graph: AssemblyGraph, keys: list[str]) -> DataFrame:
    """``nv, circ, len, wlen, ec`` of walks (keys, path), next to the keys and the path.

    A walk is circular if an arc leads from its last to its first vertex. A step
    adds its segment's length without the overlap, times its coverage for
    ``wlen``; a closing arc takes its overlap off again, at the first segment.
    """
    first = first_arcs(graph.arcs).select("v", "w", "ls", F.col("cov").alias("arc_cov"))
    steps = walks.select(*keys, F.posexplode("path").alias("at", "w"), F.col("path").alias("_p")).withColumn("v", F.when(F.col("at") > 0, F.get("_p", F.col("at") - 1)).otherwise(F.element_at("_p", -1)))
    steps = steps.select(*keys, "at", "v", "w").join(first, ["v", "w"], "left").withColumn("seg_id", segment_of("w")).join(graph.segments.select("seg_id", "len", "cov"), "seg_id")
    # Step 0 carries the closing arc: its overlap counts only if there is one.
    gain = F.col("len") - F.coalesce("ls", F.lit(0))
    sums = steps.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("nv"),
        F.max(F.when(F.col("at") == 0, F.col("arc_cov").isNotNull())).alias("circ"),
        F.sum(gain).alias("len"),
        F.sum(gain * F.col("cov")).cast("double").alias("wlen"),
        F.sum(F.coalesce("arc_cov", F.lit(0))).alias("ec"),
        F.count_if((F.col("at") > 0) & F.col("arc_cov").isNull()).alias("gaps"),
    )
    return walks.join(sums, keys)


def choose_path(measured: DataFrame, min_fraction: float = 1.0, turn: str = "turn") -> DataFrame:
    """One path for each component: the best circular or linear one.

    Best is the largest (wlen, len, ec, nv); of equals the earliest ``turn``. The
    circular one is taken unless its wlen is under ``min_fraction`` of the linear.
    """
    order = [F.col(c).desc() for c in ("wlen", "len", "ec", "nv")] + [F.col(turn)]
    place = F.row_number().over(Window.partitionBy("component", "circ").orderBy(*order))
    tops = measured.withColumn("_place", place).where("_place = 1").drop("_place")
    line = F.max(F.when(~F.col("circ"), F.col("wlen"))).over(Window.partitionBy("component"))
    ring = F.max(F.when(F.col("circ"), F.col("wlen"))).over(Window.partitionBy("component"))
    circular = ring.isNotNull() & (line.isNull() | (ring + EPSILON >= line * min_fraction))
    return tops.withColumn("_c", circular).where(F.col("circ") == F.col("_c")).drop("_c")


def find_paths(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, source: int | None = None, target: int | None = None, max_paths: int = MAX_PATHS, min_fraction: float = 1.0) -> DataFrame:
    """``component, path, nv, circ, len, wlen, ec, ...``: the best path of each component.

    With a ``source``, only its component is searched, from there on; else each
    component from its chosen source, both ways. With a ``target``, walks are cut
    at their last visit of it.
    """
    if source is not None:
        own = component_of(labels, source)
        labels = labels.join(own, "seg_id", "left_semi")
        sources = labels.where(F.col("seg_id") == source >> 1).select("component", F.lit(source).cast("long").alias("v"))
    else:
        sources = choose_sources(graph, labels).select("component", F.shiftleft("seg_id", 1).alias("v"))
    walks = search_walks(graph, labels, copies, sources, target, max_paths, both_ways=source is None)
    walks, _ = materialise(walks, "searched")
    if target is not None:
        walks = clip_to_target(walks, target)
    return choose_path(measure(walks, graph, ["component", "turn"]), min_fraction)


def find_path_in_parts(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, source: int, target: int, max_paths: int = MAX_PATHS, min_fraction: float = 1.0) -> DataFrame:
    """Like ``find_paths`` from source to target, searched between cut points.

    Every part is searched on the whole component; the cut points, each of which takes
    a search of its own, are listed on the driver. Without inner cut points, or if
    a part has no path, this is the plain search.
    """
    points = [r["v"] for r in cut_points(graph, labels, copies, source, target).orderBy("place").collect()]
    spark = graph.arcs.sparkSession
    if len(points) > 2:
        parts: list[int] = []
        for a, b in zip(points, points[1:]):
            found = find_paths(graph, labels, copies, a, b, max_paths, min_fraction).select("path").first()
            if found is None:
                break
            parts += found["path"][bool(parts) :]
        else:
            component = labels.where(F.col("seg_id") == source >> 1).select("component")
            one = component.join(F.broadcast(spark.createDataFrame([(0, parts)], "turn long, path array<long>")))
            return measure(one.withColumn("exceeded", F.lit(False)), graph, ["component", "turn"])
    return find_paths(graph, labels, copies, source, target, max_paths, min_fraction)


def walks_over_clones(graph: AssemblyGraph, clones: DataFrame, start: int, target: int | None = None, max_paths: int = MAX_PATHS, both_ways: bool = False) -> DataFrame:
    """``turn, path, exceeded``: maximal walks that use no segment twice, over a graph with clones.

    ``clones`` (seg_id, origin) names what a clone was made from. Clones of one
    segment are alike, so from a walk only the first free one is entered. With a
    ``target``, walks end there and are cut to it. The limit cuts in the order of vertex ids.
    """
    labels = graph.segments.select("seg_id", F.lit(0).cast("long").alias("component"))
    sources = graph.arcs.sparkSession.range(1).select(F.lit(0).cast("long").alias("component"), F.lit(start).cast("long").alias("v"))
    ones = graph.segments.select("seg_id", F.lit(1).alias("copy"))
    found = search_walks(graph, labels, ones, sources, target, max_paths, both_ways, clones)
    found = found if target is None else clip_to_target(found, target)
    return found.select("turn", "path", "exceeded")


def best_over_clones(graph: AssemblyGraph, clones: DataFrame, start: int, target: int | None = None, max_paths: int = MAX_PATHS, min_fraction: float = 1.0) -> DataFrame:
    """The best walk over clones, read both ways, with its measures (see ``choose_path``)."""
    found, _ = materialise(walks_over_clones(graph, clones, start, target, max_paths, both_ways=True).withColumn("component", F.lit(0).cast("long")), "searched")
    return choose_path(measure(found, graph, ["component", "turn"]), min_fraction)


def paths_from_strings(strings: DataFrame, graph: AssemblyGraph) -> DataFrame:
    """``sid, path, unknown``: paths written as ``a+,b-,...`` (sid, steps).

    Names that the graph lacks are left out of the path and listed in ``unknown``;
    steps without an arc stay, and ``measure`` counts them as gaps.
    """
    steps = strings.select("sid", F.posexplode(F.split("steps", ",")).alias("at", "step")).withColumn("step", F.trim("step")).where("step <> ''")
    steps = steps.withColumn("name", F.regexp_replace("step", "[+-]$", "")).withColumn("back", F.col("step").endswith("-"))
    placed = steps.join(graph.segments.select("seg_id", "name"), "name", "left")
    v = F.shiftleft("seg_id", 1) + F.col("back").cast("long")
    found = placed.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("at", v.alias("v"), "step"))).alias("s"))
    return found.select("sid", F.transform(F.filter("s", lambda x: x["v"].isNotNull()), lambda x: x["v"]).alias("path"), F.transform(F.filter("s", lambda x: x["v"].isNull()), lambda x: x["step"]).alias("unknown"))


def covered_share(paths: DataFrame, segments: DataFrame, total: int | None = None) -> DataFrame:
    """``sid, share``: bases of the distinct segments on a path, over ``total`` (all bases)."""
    base = segments.agg((F.sum("len") if total is None else F.lit(total)).alias("total"))
    used = paths.select("sid", F.explode(F.array_distinct(F.transform("path", segment_of))).alias("seg_id")).join(segments.select("seg_id", "len"), "seg_id")
    return used.groupBy("sid").agg(F.sum("len").alias("covered")).join(F.broadcast(base)).select("sid", F.try_divide(F.col("covered").cast("double"), F.col("total")).alias("share"))


def flip_walks(walks: DataFrame) -> DataFrame:
    """Every walk read from its other end."""
    return walks.withColumn("path", F.reverse(F.transform("path", flip)))
