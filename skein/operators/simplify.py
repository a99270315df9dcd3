"""Graph simplification: unitigs, tips, bubbles, weak links, clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skein.functions.ids import flip, segment_of
from skein.operators.graph import AssemblyGraph, degree, delete_arcs, delete_segments, normalise
from skein.plans.dense import dense_index
from skein.plans.pointers import all_ahead, follow
from skein.plans.scratch import drop_path, materialise

#: A sweep's frontier of up to so many rows is broadcast to the arcs, which then stay where they are.
FRONTIER_ROWS = 100_000


def mergeable_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs v -> w that are the only one out of v and the only one into w."""
    # Where there is one arc, its target is the least one: vertices are added up, and arcs not sorted for joins.
    single = arcs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w"), F.min("ls").alias("ls")).where("n = 1")
    back = single.select(flip("v").alias("w"))
    return single.join(back, "w", "left_semi").select("v", "w", "ls")


def chains(graph: AssemblyGraph) -> DataFrame:
    """``chain, at, x, circ``: every oriented vertex's place in its maximal chain.

    Chains follow mergeable arcs. A ring is opened before its lowest vertex. Places
    come by pointer doubling, so the rounds are logarithmic in the longest chain. A
    chain is named by its first vertex.
    """
    back, _ = materialise(mergeable_arcs(graph.arcs).where("v <> w").select(F.col("w").alias("x"), F.col("v").alias("to")), "mergeable")
    vertices = graph.segments.select(F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("x"))
    followed = follow(back)
    placed = followed.ends.select("x", F.col("root").alias("chain"), F.col("steps").alias("at"), F.lit(False).alias("circ"))
    if followed.has_rings:
        rings, _ = materialise(followed.rings, "rings")
        opened = follow(back.join(rings, "x").where("x <> least").select("x", "to")).ends
        around = rings.join(opened, "x", "left").select("x", F.col("least").alias("chain"), F.coalesce("steps", F.lit(0)).alias("at"), F.lit(True).alias("circ"))
        placed = placed.unionByName(around)
    return vertices.join(placed, "x", "left").select(F.coalesce("chain", "x").alias("chain"), F.coalesce("at", F.lit(0)).alias("at"), "x", F.coalesce("circ", F.lit(False)).alias("circ"))


def unitigs(graph: AssemblyGraph) -> tuple[AssemblyGraph, DataFrame]:
    """The graph with every maximal chain as one segment, and ``seg_id, members, circ``.

    Each chain is read in one of its two directions: a linear one from the end with
    the lower vertex, a ring from its lowest segment on the forward strand. Lengths
    are without overlaps; coverages start over at 0. A single segment is circular if
    an arc leads from it to itself.
    """
    placed, _ = materialise(chains(graph), "placed")
    ends = placed.groupBy("chain").agg(F.max_by("x", "at").alias("last"), F.max("circ").alias("circ"))
    loops = graph.arcs.where("v = w").select(F.col("v").alias("chain")).distinct().withColumn("loop", F.lit(True))
    mirror = flip("last")
    even = F.col("chain").bitwiseAND(F.lit(1).cast("long")) == 0
    read = ends.where(F.when(F.col("circ"), even).otherwise(F.col("chain") <= mirror))
    ids = dense_index(read.select("chain"), ["chain"], "new_id")
    ids, _ = materialise(ids.join(read, "chain").join(loops, "chain", "left").select("chain", "last", "new_id", (F.col("circ") | (F.coalesce("loop", F.lit(False)) & (F.col("last") == F.col("chain")))).alias("circ")), "unitig-ids")
    steps = placed.select("chain", "at", "x").join(ids.select("chain", "new_id"), "chain").withColumn("seg_id", segment_of("x")).join(graph.segments.select("seg_id", "name", "len", "seq"), "seg_id")
    inner = mergeable_arcs(graph.arcs).groupBy(F.col("v"), F.col("w")).agg(F.min("ls").alias("ls"))
    before = placed.select("chain", (F.col("at") + 1).alias("at"), F.col("x").alias("v"))
    steps = steps.join(before, ["chain", "at"], "left").join(inner.withColumnRenamed("w", "x"), ["v", "x"], "left")
    table = steps.groupBy("new_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s"),
        F.sum(F.col("len") - F.coalesce("ls", F.lit(0))).alias("len"),
    )
    zero = F.lit(0).cast("long")
    segments = table.select(F.col("new_id").alias("seg_id"), F.format_string("utg%06d", F.col("new_id") + 1).alias("name"), F.lit(None).cast("string").alias("seq"), "len", zero.alias("cov"))
    members = table.select(F.col("new_id").alias("seg_id"), F.transform("s", lambda x: x["x"]).alias("members")).join(ids.select(F.col("new_id").alias("seg_id"), "circ"), "seg_id")
    # An arc joins unitigs if it leaves a last vertex and enters a first one, in either reading.
    outs = ids.select(F.col("last").alias("v"), F.shiftleft("new_id", 1).alias("nv")).unionByName(ids.select(flip("chain").alias("v"), (F.shiftleft("new_id", 1) + 1).alias("nv")))
    ins = ids.select(F.col("chain").alias("w"), F.shiftleft("new_id", 1).alias("nw")).unionByName(ids.select(flip("last").alias("w"), (F.shiftleft("new_id", 1) + 1).alias("nw")))
    arcs = graph.arcs.join(outs, "v").join(ins, "w").select(F.col("nv").alias("v"), F.col("nw").alias("w"), "ln", "ls", "cov")
    return normalise(AssemblyGraph(segments, arcs)), members


def weak_crosslinks(arcs: DataFrame, share: float, min_cov: int = 0) -> DataFrame:
    """``v, w`` of arcs that are weak against an arc at either end (both directions).

    Weak: coverage over that of the strongest arc out of v, and over that of the
    strongest out of w's other strand, are both under ``share``. Only arcs of
    ``min_cov`` count as strong; only first arcs of pairs are judged.
    """
    strong = F.max(F.when(F.col("cov") >= min_cov, F.col("cov"))).over(Window.partitionBy("v"))
    there = arcs.groupBy(flip("v").alias("w")).agg(F.max(F.when(F.col("cov") >= min_cov, F.col("cov"))).alias("strong_w"))
    rows = arcs.withColumn("strong_v", strong).join(there, "w", "left").where("not comp")
    under = lambda c: F.coalesce(F.try_divide(F.col("cov").cast("double"), F.col(c)) < share, F.lit(False))
    weak = rows.where(under("strong_v") & under("strong_w")).select("v", "w")
    return weak.unionByName(weak.select(flip("w").alias("v"), flip("v").alias("w"))).distinct()


def remove_weak_crosslinks(graph: AssemblyGraph, share: float, min_cov: int = 0) -> AssemblyGraph:
    """The graph without its weak crosslinks (see ``weak_crosslinks``); its arcs are read four times, so they are written first."""
    graph = graph.with_arcs(materialise(graph.arcs, "crosslink-arcs")[0])
    return normalise(delete_arcs(graph, weak_crosslinks(graph.arcs, share, min_cov)))


def _vertices(graph: AssemblyGraph) -> DataFrame:
    """``x, len, cov, outs, ins, ls`` of every oriented vertex; ``ls`` is the largest overlap of its arcs out."""
    both = graph.segments.select(F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("x"), "len", "cov")
    out = graph.arcs.groupBy(F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("outs"), F.max("ls").alias("ls"))
    into = graph.arcs.groupBy(F.col("w").alias("x")).agg(F.count(F.lit(1)).alias("ins"))
    zero = F.lit(0).cast("long")
    return both.join(out, "x", "left").join(into, "x", "left").select("x", "len", "cov", F.coalesce("outs", zero).alias("outs"), F.coalesce("ins", zero).alias("ins"), F.coalesce("ls", zero).alias("ls"))


def _measured_chains(graph: AssemblyGraph) -> DataFrame:
    """Every oriented vertex in its chain, with what the chain has from it to the end.

    ``left`` vertices, ``bases`` (each vertex without its overlap) and ``weight``
    (those times coverage; the last vertex in full), all from here on, and ``last``,
    the chain's last vertex with its own ``own_bases`` and ``last_outs``.
    """
    rows = chains(graph).join(_vertices(graph), "x")
    onward = Window.partitionBy("chain").orderBy(F.col("at").desc())
    whole = onward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.first(F.struct(F.col("x").alias("last"), (F.col("len") - F.col("ls")).alias("own_bases"), F.col("outs").alias("last_outs"))).over(whole)
    final = F.row_number().over(onward) == 1
    rows = rows.select("*", ends.alias("e"), F.row_number().over(onward).cast("long").alias("left"), F.sum(F.col("len") - F.col("ls")).over(onward).alias("bases"), F.sum((F.col("len") - F.when(final, 0).otherwise(F.col("ls"))) * F.col("cov")).over(onward).alias("weight"))
    return rows.select("chain", "at", "x", "circ", "ins", "left", "bases", "weight", "e.*")


def drop_tips(graph: AssemblyGraph, max_segments: int, max_bases: int, protect: bool = False) -> AssemblyGraph:
    """Remove dead ends of at most ``max_segments`` segments and ``max_bases`` bases.

    A dead end is a chain that no arc enters; if it ends in a vertex with several
    arcs out, that vertex counts as a segment but stays. With ``protect``, a tip
    that is attached somewhere stays unless another branch out of there is as long as it
    or longer, or has at least twice its weight. Tips are found first and removed together.
    """
    placed, path = materialise(_measured_chains(graph), "tips")
    forks = F.col("last_outs") > 1
    bases = F.col("bases") - F.when(forks, F.col("own_bases")).otherwise(0)
    tips = placed.where((F.col("at") == 0) & (F.col("ins") == 0) & ~F.col("circ") & (F.col("left") <= max_segments) & (bases <= max_bases)).select("chain", "last", "last_outs", bases.alias("tip_bases"))
    if protect:
        # The vertex behind the tip: the fork itself, or what the last arc leads to.
        targets = graph.arcs.groupBy(F.col("v").alias("last")).agg(F.min("w").alias("w"))
        behind = tips.where("last_outs > 0").join(targets, "last").select("chain", "tip_bases", flip(F.when(F.col("last_outs") > 1, F.col("last")).otherwise(F.col("w"))).alias("v"))
        inner = placed.join(tips.select("chain", "last"), ["chain", "last"]).where((F.col("last_outs") <= 1) | (F.col("x") != F.col("last")))
        # Without the fork, the chain's new last vertex counts in full.
        cut = inner.join(_vertices(graph).select("x", "len", "cov", "ls"), "x").withColumn("full", F.row_number().over(Window.partitionBy("chain").orderBy(F.col("at").desc())) == 1)
        own = cut.groupBy("chain").agg(F.sum((F.col("len") - F.when(F.col("full"), 0).otherwise(F.col("ls"))) * F.col("cov")).alias("tip_weight"))
        back = inner.select("chain", flip("x").alias("x"))
        branches = behind.join(graph.arcs.select("v", F.col("w").alias("x")), "v").join(back, ["chain", "x"], "left_anti").join(placed.select("x", "bases", "weight"), "x").join(own, "chain")
        weaker = (F.col("tip_bases") <= F.col("bases")) | (2 * F.col("tip_weight") <= F.col("weight"))
        weak = branches.where(weaker).select("chain").distinct()
        tips = tips.where("last_outs = 0").unionByName(tips.where("last_outs > 0").join(weak, "chain", "left_semi").select(tips.columns))
    gone = placed.join(tips.select("chain"), "chain", "left_semi").where((F.col("last_outs") <= 1) | (F.col("x") != F.col("last")))
    gone, _ = materialise(gone.select(segment_of("x").alias("seg_id")).distinct(), "dead-ends")
    drop_path(graph.arcs.sparkSession, path)
    return normalise(delete_segments(graph, gone))


def sweeps(graph: AssemblyGraph, sources: DataFrame, over_tips: bool, through: bool = False) -> tuple[DataFrame, DataFrame]:
    """Topological sweeps from many sources (v, reach) at once, a round of joins for each step.

    A vertex is passed once all arcs into it were seen; where a sweep comes down to a
    single vertex with nothing pending, its branches have met: a sink. A sweep ends
    at its first sink (with ``through``, it goes on from there), beyond ``reach``
    bases, at an arc back to its source's segment, and at a dead end that reaches
    ``reach`` or, without ``over_tips``, at any. Dead ends of a round go first.

    Returns ``src, sink, dist, tips, sinks, cycle`` for sources with a sink or a cycle (0;
    1: to the source itself, 2: to its other strand): bases to the last sink and counts
    so far; and ``src, x, up`` of all vertices passed, ``up`` being the one before on the
    heaviest way (bases times coverage, then bases). A round is one job; what it finds
    and what goes on are one table. Arcs bring what is known of their targets, and only
    rounds of more than ``FRONTIER_ROWS`` open rows shuffle them.
    """
    spark = graph.arcs.sparkSession
    step = F.col("len") - F.col("ls")
    info, info_path = materialise(_vertices(graph).select("x", "len", "cov", "outs", "ins"), "sweep-vertices")
    targets = info.select(F.col("x").alias("w"), F.struct("len", "cov", "outs", "ins").alias("there"))
    arcs, arcs_path = materialise(graph.arcs.select(F.col("v").alias("x"), "w", "ls").join(targets, "w"), "sweep-arcs")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = Window.partitionBy("src")
    columns = ["kind", "src", "reach", "x", "up", "dist", "weight", "left", "far", "tips", "sinks", "len", "cov", "outs"]
    blank = {c: none for c in columns}

    def marked(rows: DataFrame, kind: str, **given: Column) -> DataFrame:
        """``rows`` as results of a kind, with the columns given and no others."""
        return rows.select(F.lit(kind).alias("kind"), *[F.coalesce(given[c], none).alias(c) if c in given else blank[c].alias(c) for c in columns[1:]])

    start = sources.select(F.lit("live").alias("kind"), F.col("v").alias("src"), "reach", F.col("v").alias("x"), none.alias("up"), *[zero.alias(c) for c in ("dist", "weight", "left", "far", "tips", "sinks")])
    seen = Observation()
    state, path = materialise(start.join(info.select("x", "len", "cov", "outs"), "x").select(columns).observe(seen, F.count(F.lit(1)).alias("n")), "sweep")
    tables = []
    while True:
        ready = F.col("left") == 0
        dead = ready & (F.col("outs") == 0)
        count = lambda c: F.sum(c.cast("long")).over(own)
        rows = state.where("kind = 'live' AND far <= reach").withColumn("_ready", count(ready)).withColumn("_dead", count(dead)).withColumn("_all", F.count(F.lit(1)).over(own)).withColumn("_top", F.max(F.when(dead, F.col("x"))).over(own))
        alone = ready & (F.col("_all") == F.col("_ready")) & F.when(F.col("_ready") == F.col("_dead"), F.col("x") == F.col("_top")).otherwise((F.col("_ready") - F.col("_dead") == 1) & (F.col("outs") > 0))
        rows = rows.where("_ready > 0").withColumn("_sink", alone & (F.col("x") != F.col("src"))).withColumn("_tip", dead & ~F.col("_sink"))
        stops = F.col("_tip") & ((F.col("dist") + F.col("len") >= F.col("reach")) | F.lit(not over_tips)) & (F.col("x") != F.col("src"))
        short = F.sum((F.col("_tip") & (F.col("x") != F.col("src"))).cast("long")).over(own)
        rows = rows.withColumn("_stops", F.max(stops).over(own)).withColumn("tips", F.col("tips") + short)
        rows = rows.where("not _stops").withColumn("sinks", F.col("sinks") + F.max(F.col("_sink").cast("long")).over(own))
        sinks = marked(rows.where("_sink"), "sink", src=F.col("src"), x=F.col("x"), dist=F.col("dist"), tips=F.col("tips"), sinks=F.col("sinks"))
        passed = marked(rows.where(ready & (F.col("x") != F.col("src"))), "passed", src=F.col("src"), x=F.col("x"), up=F.col("up"))
        going = rows if through else rows.withColumn("_met", F.max("_sink").over(own)).where("not _met")
        front = going.where(ready & (F.col("outs") > 0))
        pushed = (F.broadcast(front) if seen.get["n"] <= FRONTIER_ROWS else front).join(arcs, "x").select("src", "reach", F.col("w").alias("x"), F.col("x").alias("up"), (F.col("dist") + step).alias("dist"), (F.col("weight") + step * F.col("cov")).alias("weight"), F.lit(-1).cast("long").alias("left"), "far", "tips", "sinks", *[F.col(f"there.{c}").alias(c) for c in ("len", "cov", "outs", "ins")], F.lit(True).alias("_new"))
        waiting = going.where(~ready).select(*pushed.columns[:-2], none.alias("ins"), F.lit(False).alias("_new"))
        # 1: an arc leads back to the source, 2: to its other strand; either ends the sweep.
        turn = F.when(F.col("_new") & (segment_of("x") == segment_of("src")), F.when(F.col("x") == F.col("src"), 1).otherwise(2))
        both = waiting.unionByName(pushed).withColumn("_cycle", F.max(turn).over(own))
        cycles = marked(both.where("_cycle IS NOT NULL").select("src", "_cycle").distinct(), "cycle", src=F.col("src"), x=F.col("_cycle"))
        met = both.where("_cycle IS NULL").groupBy("src", "reach", "x").agg(
            F.min("dist").alias("dist"), F.max("weight").alias("weight"), F.max_by("up", F.struct("weight", "dist", F.negative("up").alias("turn"))).alias("up"),
            F.sum(F.when(F.col("_new"), -1).otherwise(F.col("left"))).alias("left"),
            F.max(~F.col("_new")).alias("_old"), F.max("far").alias("far"), F.max("tips").alias("tips"), F.max("sinks").alias("sinks"), F.max("_new").alias("_new"),
            *[F.max(c).alias(c) for c in ("len", "cov", "outs", "ins")],
        )
        met = met.withColumn("left", F.col("left") + F.when(F.col("_old"), 0).otherwise(F.col("ins")))
        live = met.withColumn("far", F.greatest(F.max("far").over(own), F.coalesce(F.max(F.when(F.col("_new"), F.col("dist"))).over(own), zero))).withColumn("kind", F.lit("live"))
        seen = Observation()
        every = sinks.unionByName(passed).unionByName(cycles).unionByName(live.select(columns))
        state, path = materialise(every.observe(seen, F.count(F.when(F.col("kind") == "live", 1)).alias("n")), "sweep")
        tables.append(state.where("kind <> 'live'"))
        if not seen.get["n"]:
            break
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    found, _ = materialise(found.select("kind", "src", "x", "up", "dist", "tips", "sinks"), "sweeps")
    sink = F.col("kind") == "sink"
    last = found.where("kind <> 'passed'").groupBy("src").agg(
        F.max_by(F.struct(F.col("x").alias("sink"), "dist", "tips"), F.when(sink, F.col("sinks"))).alias("s"),
        F.coalesce(F.max(F.when(sink, F.col("sinks"))), zero).alias("sinks"), F.coalesce(F.max(F.when(F.col("kind") == "cycle", F.col("x"))), zero).cast("int").alias("cycle"),
    )
    for path in (info_path, arcs_path):
        drop_path(spark, path)
    return last.select("src", F.when(F.col("sinks") > 0, F.col("s.sink")).alias("sink"), F.when(F.col("sinks") > 0, F.col("s.dist")).alias("dist"), F.when(F.col("sinks") > 0, F.col("s.tips")).alias("tips"), "sinks", "cycle"), found.where("kind = 'passed'").select("src", "x", "up")


def best_ways(ends: DataFrame, passed: DataFrame) -> DataFrame:
    """``src, x, up`` of the vertices behind each source on its heaviest way to its sink, by pointer doubling."""
    key = lambda x: F.struct("src", F.col(x).alias("x"))
    pointers, _ = materialise(passed.select(key("x").alias("x"), key("up").alias("to")), "ways")
    marked = ends.where("sink IS NOT NULL").select(key("sink").alias("x"))
    kept = all_ahead(marked, follow(pointers, keep_jumps=True).jumps)
    return kept.join(pointers, "x").select(F.col("x.src").alias("src"), F.col("x.x").alias("x"), F.col("to.x").alias("up"))


def topological_extent(graph: AssemblyGraph, source: int, reach: int, over_tips: bool = False, through: bool = False) -> DataFrame:
    """``sink, dist, tips, sinks, cycle`` of the sweep from ``source`` (see ``sweeps``).

    No row if its branches never meet within ``reach`` bases and no arc leads back.
    With ``through``, the sweep goes on behind each sink and the last one counts.
    """
    start = graph.segments.where(F.col("seg_id") == source >> 1).select(F.lit(source).cast("long").alias("v"), F.lit(reach).cast("long").alias("reach"))
    return sweeps(graph, start, over_tips, through)[0].select("sink", "dist", "tips", "sinks", "cycle")


def _too_strong(graph: AssemblyGraph, bubbles: DataFrame, lost: DataFrame, kept: DataFrame) -> DataFrame:
    """``src`` of bubbles that would lose more than their flanks or the kept branch bear out."""
    facts = graph.segments.select("seg_id", "len", (F.col("len") * F.col("cov")).alias("mass"))
    total = lambda rows, n, m: rows.join(facts, "seg_id").groupBy("src").agg(F.sum("len").alias(n), F.sum("mass").alias(m))
    flank = _measured_chains(graph).select("x", F.col("bases").alias("b"), F.col("weight").alias("w"))
    sides = bubbles.select("src", flip("src").alias("x")).unionByName(bubbles.select("src", F.col("sink").alias("x")))
    around = sides.join(flank, "x").groupBy("src").agg(F.sum("b").alias("flank_bases"), F.sum("w").alias("flank_mass"))
    rows = bubbles.select("src").join(total(lost, "lost_bases", "lost_mass"), "src").join(total(kept, "kept_bases", "kept_mass"), "src", "left").join(around, "src").na.fill(0)
    against = lambda bases, mass: 2 * F.col("lost_mass") * F.col(bases) > F.col(mass) * F.col("lost_bases")
    return rows.where(against("flank_bases", "flank_mass") | against("kept_bases", "kept_mass")).select("src")


def pop_bubbles(graph: AssemblyGraph, radius: int, max_removed: int = 0, protect_tips: bool = False, protect_super: bool = False) -> AssemblyGraph:
    """Reduce bubbles of up to ``radius`` bases to their heaviest branch.

    All forks sweep at once; a fork settles once no lower one that is open has seen
    any of its segments, so the lower of two that overlap goes first and the other
    one looks again at what is left. Every fork settles once. A bubble stays if it
    would lose more than ``max_removed`` segments (0: no limit), or, with
    ``protect_super``, if what it would lose is covered too well against its flanks
    or against the branch that is kept.
    """
    spark = graph.arcs.sparkSession
    graph = graph.with_arcs(materialise(graph.arcs, "bubble-arcs")[0])
    graph = graph.with_segments(materialise(graph.segments, "bubble-segments")[0])
    settled, _ = materialise(graph.segments.select(F.col("seg_id").alias("src")).limit(0), "settled")
    while True:
        forks = degree(graph.arcs).where("degree > 1").select("v").join(settled.select(F.col("src").alias("v")), "v", "left_anti")
        forks = forks.withColumn("seg_id", segment_of("v")).join(graph.segments.select("seg_id", "len"), "seg_id").select("v", (F.col("len") + radius).alias("reach"))
        forks, forks_path = materialise(forks, "forks")
        if forks.isEmpty():
            return normalise(graph)
        ends, inside = sweeps(graph, forks, not protect_tips)
        # A sink stays what it is, and so does a source: sweeps that only share these don't meet.
        inner = inside.join(ends.select("src", "sink"), "src", "left").select("src", segment_of("x").alias("seg_id"), F.coalesce(F.col("x") != F.col("sink"), F.lit(True)).alias("inner"))
        region = inner.unionByName(forks.select(F.col("v").alias("src"), segment_of("v").alias("seg_id"), F.lit(False).alias("inner"))).groupBy("src", "seg_id").agg(F.max("inner").alias("inner"))
        first = region.groupBy("seg_id").agg(F.min("src").alias("first"), F.min(F.when(F.col("inner"), F.col("src"))).alias("first_inner"))
        late = region.join(first, "seg_id").where("(inner AND src > first) OR src > first_inner").select("src").distinct()
        now, now_path = materialise(forks.select(F.col("v").alias("src")).join(late, "src", "left_anti"), "bubble-turn")
        met, met_path = materialise(ends.where("sink IS NOT NULL AND cycle = 0").join(now, "src", "left_semi"), "bubbles-met")
        within_met = inside.join(met.select("src"), "src", "left_semi")
        vertices = within_met.select("src", "x").distinct()
        kept, kept_path = materialise(best_ways(met, within_met), "bubbles-kept")
        branch = kept.select("src", segment_of("x").alias("seg_id")).distinct()
        lost = vertices.select("src", segment_of("x").alias("seg_id")).distinct().join(branch, ["src", "seg_id"], "left_anti")
        good = met.select("src", "sink")
        if max_removed:
            size = vertices.groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(kept.groupBy("src").agg(F.count(F.lit(1)).alias("k")), "src")
            good = good.join(size.where(F.col("n") <= F.col("k") + max_removed).select("src"), "src", "left_semi")
        if protect_super:
            good = good.join(_too_strong(graph, met.select("src", "sink"), lost, branch), "src", "left_anti")
        good, good_path = materialise(good, "bubbles")
        # Inside a bubble only the arcs along the kept branch stay.
        within = vertices.join(good.select("src", "sink"), "src").where("x <> sink").select("src", "x").unionByName(good.select("src", F.col("src").alias("x")))
        stay = kept.join(good.select("src"), "src", "left_semi").select("src", F.col("up").alias("v"), F.col("x").alias("w"))
        cut = within.join(graph.arcs.select(F.col("v").alias("x"), "w"), "x").select("src", F.col("x").alias("v"), "w").join(stay, ["src", "v", "w"], "left_anti")
        cut = cut.select("v", "w").unionByName(cut.select(flip("w").alias("v"), flip("v").alias("w"))).distinct()
        gone = lost.join(good.select("src"), "src", "left_semi").select("seg_id").distinct()
        less = delete_arcs(delete_segments(graph, gone), cut)
        graph = graph.with_arcs(materialise(less.arcs, "bubble-arcs")[0])
        graph = graph.with_segments(materialise(less.segments, "bubble-segments")[0])
        settled, _ = materialise(settled.unionByName(now), "settled")
        for path in (forks_path, now_path, met_path, kept_path, good_path):
            drop_path(spark, path)


def duplicate_by_copies(graph: AssemblyGraph, copies: DataFrame, drop_unused: bool = False) -> tuple[AssemblyGraph, DataFrame]:
    """Replace every segment of copy number n > 1 by n clones; also ``seg_id, origin, vertex_cov``.

    A clone is named ``<name>_copy<i>`` and keeps its segment's coverage; as a vertex, it has
    its share of it, ``vertex_cov`` (rounded down); arcs are cloned with
    either end, and their coverage is divided by the copies (rounded down), at one
    end and then at the other. An arc from a segment to itself joins all ordered
    pairs of its different clones; a hairpin goes. With ``drop_unused`` segments of
    copy number 0 go.
    """
    base = graph.segments.join(copies.select("seg_id", "copy"), "seg_id", "left").withColumn("copy", F.coalesce("copy", F.lit(1)))
    if drop_unused:
        gone = base.where("copy = 0").select("seg_id")
        graph = delete_segments(graph, gone)
        base = base.where("copy <> 0")
    base = base.withColumn("n", F.greatest(F.col("copy"), F.lit(1)).cast("int"))
    wide = base.select("seg_id", "name", "seq", "len", "cov", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    last = graph.segments.agg(F.coalesce(F.max("seg_id"), F.lit(-1)).alias("last"))
    clones = dense_index(wide.where("n > 1").select("seg_id", "i"), ["seg_id", "i"], "new").join(F.broadcast(last)).select("seg_id", "i", (F.col("last") + 1 + F.col("new")).alias("clone"))
    table, _ = materialise(wide.join(clones, ["seg_id", "i"], "left").withColumn("clone", F.coalesce("clone", "seg_id")), "clones")
    segments = table.select(F.col("clone").alias("seg_id"), F.when(F.col("n") > 1, F.concat("name", F.lit("_copy"), F.col("i").cast("string"))).otherwise(F.col("name")).alias("name"), "seq", "len", "cov")
    rows = graph.arcs.select("v", "w", "ln", "ls", "cov").withColumn("own", segment_of("v") == segment_of("w"))
    for end in ("v", "w"):
        ends = table.select(F.col("seg_id").alias("_s"), "clone", "n", F.col("i").alias(f"i_{end}"))
        rows = rows.withColumn("_s", segment_of(end)).join(ends, "_s").withColumn(end, F.shiftleft("clone", 1) + F.col(end).bitwiseAND(F.lit(1).cast("long")))
        rows = rows.withColumn("cov", F.when(F.col("own") & F.lit(end == "w"), F.col("cov")).otherwise(F.floor(F.col("cov") / F.col("n")))).withColumn(f"n_{end}", F.col("n")).drop("_s", "clone", "n")
    looped = F.col("own") & (F.col("n_v") > 1)
    hairpin = F.col("v").bitwiseAND(F.lit(1).cast("long")) != F.col("w").bitwiseAND(F.lit(1).cast("long"))
    rows = rows.where(~looped | ((F.col("i_v") != F.col("i_w")) & ~hairpin))
    origins = table.where("n > 1").select(F.col("clone").alias("seg_id"), F.col("seg_id").alias("origin"), F.floor(F.col("cov") / F.col("n")).alias("vertex_cov"))
    return normalise(AssemblyGraph(segments, rows.select("v", "w", "ln", "ls", "cov"))), origins


def open_ends(graph: AssemblyGraph) -> DataFrame:
    """Oriented vertices ``v`` without an arc out."""
    vertices = graph.segments.select(F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("v"))
    return vertices.join(graph.arcs.select("v").distinct(), "v", "left_anti")
