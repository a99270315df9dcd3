import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.config import Config
from skein.operators import coverage, flow, simplify, traversal, walks
from skein.operators.graph import AssemblyGraph, end_members, is_complement, normalise, with_link_ids
from skein.plans.resolve import resolve


def graph(spark, segments, links):
    """``segments``: (len, cov) in order; ``links``: ('0+', '1-', ls, cov)."""
    s = spark.createDataFrame([(i, f"s{i}", n, c) for i, (n, c) in enumerate(segments)], "seg_id long, name string, len long, cov long").withColumn("seq", F.lit(None).cast("string"))
    v = lambda x: 2 * int(x[:-1]) + (x[-1] == "-")
    a = spark.createDataFrame([(v(x), v(y), 0, ls, c) for x, y, ls, c in links], "v long, w long, ln long, ls long, cov long")
    made = normalise(AssemblyGraph(s.select("seg_id", "name", "seq", "len", "cov"), a))
    return AssemblyGraph(made.segments.cache(), made.arcs.cache())


def labels_of(g):
    return traversal.components(g).cache()


def copies_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "seg_id long, copy int")


def chain(n, cov=10):
    return [(f"{i}+", f"{i + 1}+", 2, cov) for i in range(n - 1)]


def test_components_and_copy_numbers(spark):
    g = graph(spark, [(300, 10), (100, 21), (50, 10), (30, 5), (1, 0)], [("0+", "1+", 5, 3), ("1-", "2+", 5, 3)])
    labels = labels_of(g)
    assert {r.seg_id: r.component for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    rows = g.segments.join(labels, "seg_id")
    got = {r.component: r for r in coverage.average_coverage(rows).collect()}
    assert got[0].rough == 10 and got[0].lb == pytest.approx(7.0) and got[3].avg == 5 and got[4].avg == 0
    copies = {r.seg_id: r.copy for r in coverage.copy_numbers(rows).collect()}
    assert copies == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1}
    up = {r.seg_id: r.copy for r in coverage.copy_numbers(rows, floor=10.0).collect()}
    assert up[1] == 3 and up[3] == 1
    some = {r.component: r.rough for r in coverage.rough_average(rows, 0.9).collect()}
    assert some[0] == 10 and some[4] == 0


def test_sequential_passes_spread_in_order(spark):
    g = graph(spark, [(100, 9), (5, 0), (5, 0), (500, 0)], chain(4))
    labels, copies = labels_of(g), copies_of(spark, [1, 0, 0, 0])
    values = lambda df: [r.copy for r in df.orderBy("seg_id").collect()]
    assert values(coverage.rescue_by_arcs(g, labels, copies)) == [1, 1, 1, 1]
    assert values(coverage.add_neighbours(g, labels, copies, 1, 100)) == [1, 1, 1, 0]
    assert values(coverage.add_neighbours(g, labels, copies, 1, 0)) == [1, 0, 0, 0]
    b = graph(spark, [(9, 5), (9, 1), (9, 1), (9, 5)], [("0+", "1+", 1, 1), ("0+", "2+", 1, 1), ("1+", "3+", 1, 1), ("2+", "3+", 1, 1)])
    none = coverage.pick_bubbles(b, labels_of(b), copies_of(spark, [1, 0, 0, 1])).orderBy("seg_id").collect()
    assert [(r.copy, r.excluded) for r in none] == [(1, False)] * 4
    one = coverage.pick_bubbles(b, labels_of(b), copies_of(spark, [1, 1, 0, 1])).orderBy("seg_id").collect()
    assert [(r.copy, r.excluded) for r in one] == [(1, False), (1, True), (0, True), (1, False)]


def test_reachability(spark):
    g = graph(spark, [(100, 1)] * 5, chain(4))
    out = {r.seg_id: (r.hops, r.bp) for r in traversal.subgraph(g, g.segments.where("seg_id = 0"), steps=2).collect()}
    assert out == {0: (0, 0), 1: (1, 98), 2: (2, 196)}
    assert {r.seg_id for r in traversal.subgraph(g, g.segments.where("seg_id = 0"), dist=150).collect()} == {0, 1, 2}
    assert traversal.path_exists(g, 0, 6).collect()[0].hops == 3 and traversal.path_exists(g, 0, 6, steps=2).collect() == []
    assert traversal.path_exists(g, 6, 0).collect() == [] and traversal.path_exists(g, 7, 1).collect()[0].hops == 3
    assert traversal.path_exists(g, 0, 0).collect() == []
    left = traversal.restrict(g, g.segments.where("seg_id < 2"))
    assert left.arcs.count() == 2 and left.segments.count() == 2


def test_strong_components_and_sources(spark):
    g = graph(spark, [(10, 1), (10, 5), (10, 9), (99, 2)], [("0+", "1+", 1, 1), ("1+", "2+", 1, 1), ("2+", "1+", 1, 1), ("2+", "3+", 1, 1)])
    labels = labels_of(g)
    scc = {r.v: r.scc for r in traversal.strong_components(g, labels).collect()}
    assert scc[2] == scc[4] and len(set(scc.values())) == 6
    assert [r.seg_id for r in traversal.choose_sources(g, labels).collect()] == [3]
    assert [r.seg_id for r in traversal.choose_sources(graph(spark, [(10, 1), (10, 50), (10, 90), (99, 2)], [("0+", "1+", 1, 1), ("1+", "2+", 1, 1), ("2+", "1+", 1, 1), ("2+", "3+", 1, 1)]), labels).collect()] == [2]


def test_dominators_and_cut_points(spark):
    links = [("0+", "1+", 1, 1), ("0+", "2+", 1, 1), ("1+", "3+", 1, 1), ("2+", "3+", 1, 1), ("3+", "4+", 1, 1), ("4+", "5+", 1, 1), ("5+", "6+", 1, 1)]
    g = graph(spark, [(10, 1)] * 7, links)
    labels = labels_of(g)
    dom = {r.v: r.idom for r in traversal.dominators(g, labels, 0).collect()}
    assert dom[6] == 0 and dom[2] == dom[4] == 0 and dom[8] == 6 and dom[0] is None and dom[1] is None
    ones = copies_of(spark, [1] * 7)
    cuts = lambda a, b: [r.v for r in traversal.cut_points(g, labels, ones, a, b).orderBy("place").collect()]
    assert cuts(0, 12) == [0, 8, 10, 12] and cuts(12, 0) == [12, 0] and cuts(4, 4) == [4, 4]
    parts = walks.find_path_in_parts(g, labels, ones, 0, 12).collect()[0]
    whole = walks.find_paths(g, labels, ones, 0, 12).collect()[0]
    assert (parts.nv, parts.len, parts.ec) == (whole.nv, whole.len, whole.ec) == (6, 55, 5)


def brute_walks(arcs, copy, start):
    return brute_longer(arcs, copy, [start])


def brute_longer(arcs, copy, begun):
    out = []

    def grow(path):
        more = [w for v, w in arcs if v == path[-1] and sum(x >> 1 == w >> 1 for x in path) < copy[w >> 1]]
        if not more:
            out.append(tuple(path))
        for w in sorted(more):
            grow([*path, w])

    grow(list(begun))
    return out


def test_walks_by_brute_force(spark):
    links = [(f"{a}{s}", f"{b}{t}", 1, a + b) for (a, b), s, t in zip(itertools.combinations(range(5), 2), itertools.cycle("+-+"), itertools.cycle("++-"))] + [("2+", "2+", 1, 3)]
    g = graph(spark, [(10 + i, i + 1) for i in range(5)], links)
    copy = [1, 2, 2, 1, 1]
    arcs = [(r.v, r.w) for r in g.arcs.collect()]
    copies, labels = copies_of(spark, copy), labels_of(g)
    want = brute_walks(arcs, copy, 0)
    found = walks.enumerate_walks(g.arcs, copies, spark.createDataFrame([(0,)], "v long"))
    assert sorted(tuple(r.path) for r in found.collect()) == sorted(want)
    source = labels.where("seg_id = 0").select("component", F.lit(0).cast("long").alias("v"))
    searched = walks.search_walks(g, labels, copies, source, both_ways=False).orderBy("turn").collect()
    assert [tuple(r.path) for r in searched] == want and not searched[0].exceeded
    some = walks.search_walks(g, labels, copies, source, max_paths=3, both_ways=False).orderBy("turn").collect()
    assert [tuple(r.path) for r in some] == want[:3] and some[0].exceeded
    back = walks.search_walks(g, labels, copies, source).collect()
    assert all(sum(x >> 1 == s for x in r.path) <= max(copy[s], 1) for r in back for s in range(5)) and len(back) >= len(want)
    weight = lambda p: sum((i + 1) * (10 + i - (k > 0)) for k, i in enumerate(x >> 1 for x in p))
    flipped = lambda p: tuple(x ^ 1 for x in reversed(p))
    longer = [flipped(q) for p in sorted(want, key=lambda p: (-weight(p), p)) for q in brute_longer(arcs, copy, flipped(p))]
    assert [tuple(r.path) for r in sorted(back, key=lambda r: r.turn)] == longer
    few = walks.search_walks(g, labels, copies, source, max_paths=len(want) + 1).orderBy("turn").collect()
    assert [tuple(r.path) for r in few] == longer[: len(want) + 2] and few[0].exceeded == (len(longer) >= len(want) + 2)
    clipped = walks.clip_to_target(found, 6).collect()
    assert all(r.path[-1] == 6 for r in clipped) and len(clipped) == sum(6 in p for p in want)


def test_measures_and_choice(spark):
    g = graph(spark, [(100, 2), (50, 4), (30, 1)], [("0+", "1+", 10, 5), ("1+", "0+", 5, 6), ("1+", "2+", 3, 7)])
    rows = spark.createDataFrame([(0, 0, [0, 2]), (0, 1, [0, 2, 4]), (0, 2, [4, 0])], "component long, turn long, path array<long>")
    got = {r.turn: r for r in walks.measure(rows, g, ["component", "turn"]).collect()}
    assert (got[0].circ, got[0].len, got[0].wlen, got[0].ec) == (True, 135, 95 * 2 + 40 * 4, 11)
    assert (got[1].circ, got[1].len, got[1].wlen, got[1].ec, got[1].nv) == (False, 167, 200 + 160 + 27, 12, 3)
    assert got[2].gaps == 1 and got[2].len == 130
    measured = walks.measure(rows, g, ["component", "turn"])
    assert [r.turn for r in walks.choose_path(measured).collect()] == [1] and [r.turn for r in walks.choose_path(measured, 0.9).collect()] == [0]
    best = {r.turn: r.best for r in traversal.rank_paths(measured).collect()}
    assert best == {0: True, 1: True, 2: False}
    assert walks.covered_share(rows.select(F.col("turn").alias("sid"), "path"), g.segments).where("sid = 0").first().share == pytest.approx(150 / 180)
    text = walks.paths_from_strings(spark.createDataFrame([("p", "s0+, s9-,s1-")], "sid string, steps string"), g).first()
    assert text.path == [0, 3] and text.unknown == ["s9-"]


def test_unitigs(spark):
    ring = [("4+", "5+", 1, 1), ("5+", "6-", 1, 1), ("6-", "4+", 1, 1)]
    g = graph(spark, [(10, 1)] * 9, [*chain(3), ("2+", "3+", 1, 1), ("2+", "3-", 1, 1), *ring, ("7+", "7+", 1, 1)])
    new, members = simplify.unitigs(g)
    rows = {tuple(r.members): r for r in members.join(new.segments, "seg_id").collect()}
    assert set(rows) == {(0, 2, 4), (6,), (8, 10, 13), (14,), (16,)}
    assert rows[0, 2, 4].len == 26 and rows[8, 10, 13].circ and rows[8, 10, 13].len == 28 and rows[14,].circ and not rows[6,].circ
    ends = {tuple(r.members): r.seg_id for r in members.collect()}
    pairs = {(r.v >> 1, r.w >> 1) for r in new.arcs.collect()}
    assert (ends[0, 2, 4], ends[6,]) in pairs and (ends[8, 10, 13],) * 2 in pairs
    heads = end_members(new.arcs, members).collect()
    assert {(r.tail, r.head) for r in heads} >= {(4, 6), (4, 7), (13, 8)}


def test_tips_bubbles_and_weak_links(spark):
    g = graph(spark, [(100, 9)] * 4 + [(10, 1)], [*chain(4), ("4+", "2+", 1, 1)])
    kept = lambda x: sorted(r.seg_id for r in x.segments.collect())
    assert kept(simplify.drop_tips(g, 2, 50)) == [0, 1, 2, 3]
    assert kept(simplify.drop_tips(g, 2, 5)) == [0, 1, 2, 3, 4]
    b = graph(spark, [(100, 9), (50, 7), (50, 2), (100, 9)], [("0+", "1+", 1, 7), ("0+", "2+", 1, 2), ("1+", "3+", 1, 7), ("2+", "3+", 1, 2)])
    extent = simplify.topological_extent(b, 0, 1000).collect()
    assert [(r.sink, r.dist) for r in extent] == [(6, 148)]
    popped = simplify.pop_bubbles(b, 1000)
    assert kept(popped) == [0, 1, 3] and {(r.v, r.w) for r in popped.arcs.collect()} == {(0, 2), (2, 6), (3, 1), (7, 3)}
    assert kept(simplify.pop_bubbles(b, 10)) == [0, 1, 2, 3]
    weak = simplify.weak_crosslinks(b.arcs, 0.5).collect()
    assert weak == []
    x = graph(spark, [(9, 9)] * 4, [("0+", "1+", 1, 9), ("2+", "3+", 1, 9), ("0+", "3+", 1, 1)])
    assert {(r.v, r.w) for r in simplify.weak_crosslinks(x.arcs, 0.5).collect()} == {(0, 6), (7, 1)}
    assert simplify.remove_weak_crosslinks(x, 0.5).arcs.count() == 4


def test_clones_and_walks_over_them(spark):
    g = graph(spark, [(10, 8), (10, 4)], [("0+", "1+", 1, 6), ("1+", "0+", 1, 6), ("0+", "0+", 1, 4)])
    new, origins = simplify.duplicate_by_copies(g, copies_of(spark, [2, 1]))
    names = {r.seg_id: r["name"] for r in new.segments.collect()}
    assert sorted(names.values()) == ["s0_copy0", "s0_copy1", "s1"] and {r.vertex_cov for r in origins.collect()} == {4} and origins.count() == 2
    arcs = {(names[r.v >> 1], r.v & 1, names[r.w >> 1], r.w & 1): r.cov for r in new.arcs.collect()}
    assert arcs["s0_copy0", 0, "s1", 0] == 3 and arcs["s0_copy0", 0, "s0_copy1", 0] == 2 and arcs["s0_copy1", 0, "s0_copy0", 0] == 2
    assert ("s0_copy0", 0, "s0_copy0", 0) not in arcs
    start = next(i for i, n in names.items() if n == "s1") * 2
    found = [r.path for r in walks.walks_over_clones(new, origins, start).collect()]
    assert len(found) == 1 and len(found[0]) == 3
    assert [(r.nv, r.circ) for r in walks.best_over_clones(new, origins, start).collect()] == [(3, True)]


def test_flow(spark):
    g = graph(spark, [(1000, 10), (1000, 20), (1000, 10)], [("0+", "1+", 1, 1), ("1+", "1+", 1, 1), ("1+", "2+", 1, 1), ("2+", "0+", 1, 1)])
    labels = labels_of(g)
    start = coverage.copy_numbers(g.segments.join(labels, "seg_id")).cache()
    got = {r.seg_id: r.copy for r in flow.adjust_copies(g, labels, start).collect()}
    assert got == {0: 1, 1: 2, 2: 1}
    moved = {r.seg_id: r.copy for r in flow.adjust_copies(g, labels, start, links_in_task=0).collect()}
    assert moved == got
    again = flow.adjust_copies(g, labels, start, full_search=1)
    assert sorted(again.collect()) == sorted(again.collect())
    groups = {r.link_id: r.grp for r in flow.link_groups(g, labels).collect()}
    assert len(groups) == 4 and len(set(groups.values())) < 4


def test_whole_run(spark):
    ring = [("0+", "1+", 2, 9), ("1+", "2+", 2, 9), ("2+", "0+", 2, 9)]
    g = graph(spark, [(100, 10), (200, 10), (300, 10), (50, 3), (60, 1)], [*ring, ("3+", "4+", 1, 1)])
    found = resolve(g)
    best = {r.component: r for r in found.paths.collect()}
    assert best[0].circ and best[0].len == 594 and best[0].nv == 3 and best[3].nv == 2 and not best[3].circ
    one = resolve(g, Config(source="s0+", target="s2+", partition=True, adjust=True, bubbles=True, arcs_to_segments=True, neighbour_steps=1, neighbour_len=100)).paths.collect()
    assert [(r.component, r.path) for r in one] == [(0, [0, 2, 4])]
    with pytest.raises(ValueError):
        resolve(g, Config(source="s0+", target="s3+"))
    assert resolve(g, Config(min_seg_cov=2.0)).graph.segments.count() == 4


def brute_sink(arcs, length, source, reach):
    """The sink by its meaning: the first vertex through which all that was entered leads, all its arcs in seen."""
    dist, entered, passed = {source: 0}, [source], set()
    while True:
        ready = [x for x in entered if x not in passed and (x == source or all(u in passed for u, w in arcs if w == x))]
        dead = [x for x in ready if not any(u == x for u, _ in arcs)]
        rest = [x for x in entered if x not in passed and x not in ready]
        if not ready or max(dist.values()) > reach:
            return None
        lone = max(dead) if len(dead) == len(ready) else next((x for x in ready if x not in dead), None) if len(ready) - len(dead) == 1 else None
        if not rest and lone not in (None, source):
            return lone, dist[lone]
        if any(dist[x] + length[x >> 1] >= reach for x in dead if x != source):
            return None
        new = [(u, w) for u, w in arcs if u in ready]
        if any(w >> 1 == source >> 1 for _, w in new):
            return None
        for u, w in new:
            far = dist[u] + length[u >> 1] - 1
            dist[w] = min(dist.get(w, far), far)
            if w not in entered:
                entered.append(w)
        passed.update(ready)


def test_sweeps_by_brute_force(spark):
    rng = random.Random(4)
    length = [rng.randrange(5, 30) for _ in range(40)]
    links = []
    for k in range(6):
        block = list(range(6 * k, 6 * k + 6))
        links.append((f"{block[4]}+", f"{block[5] + 1}+"))
        links += [(f"{block[0]}+", f"{block[1]}+"), (f"{block[0]}+", f"{block[2]}+"), (f"{block[1]}+", f"{block[4]}+"), (f"{block[2]}+", f"{block[4]}+")]
        if k % 2:
            links.append((f"{block[2]}+", f"{block[5]}+"))
    links += [("36+", "37+"), ("37+", "37+"), ("37+", "38-"), ("39+", "0+"), ("3+", "39-")]
    g = graph(spark, [(n, i + 1) for i, n in enumerate(length)], [(a, b, 1, 1) for a, b in dict.fromkeys(links)])
    arcs = [(r.v, r.w) for r in g.arcs.collect()]
    sources = spark.createDataFrame([(v, 100) for v in range(80)], "v long, reach long")
    ends, _ = simplify.sweeps(g, sources, True)
    got = {r.src: (r.sink, r.dist) for r in ends.where("sink is not null").collect()}
    want = {v: found for v in range(80) if (found := brute_sink(arcs, length, v, 100))}
    assert got == want and len({s for s, _ in got.values()}) > 3


def test_cycles_nested_bubbles_and_going_through(spark):
    ring = graph(spark, [(10, 1)] * 4, [("0+", "1+", 1, 1), ("1+", "2+", 1, 1), ("2+", "1+", 1, 1), ("2+", "3+", 1, 1)])
    assert simplify.topological_extent(ring, 0, 1000).collect() == []  # 1+ waits for 2+ for ever
    loop = graph(spark, [(10, 1)] * 2, [("0+", "1+", 1, 1), ("1+", "0+", 1, 1)])
    assert [(r.sink, r.cycle) for r in simplify.topological_extent(loop, 0, 1000, through=True).collect()] == [(2, 1)]
    nested = [("0+", "1+", 1, 9), ("0+", "2+", 1, 2), ("1+", "3+", 1, 5), ("1+", "4+", 1, 4), ("3+", "5+", 1, 5), ("4+", "5+", 1, 4), ("5+", "6+", 1, 9), ("2+", "6+", 1, 2), ("6+", "7+", 1, 9)]
    g = graph(spark, [(10, c) for c in (9, 9, 2, 5, 4, 9, 9, 9)], nested)
    assert [(r.sink, r.sinks) for r in simplify.topological_extent(g, 0, 1000).collect()] == [(12, 1)]
    assert [(r.sink, r.sinks) for r in simplify.topological_extent(g, 0, 1000, through=True).collect()] == [(14, 2)]
    popped = simplify.pop_bubbles(g, 1000)
    assert sorted(r.seg_id for r in popped.segments.collect()) == [0, 1, 3, 5, 6, 7] and popped.arcs.count() == 10
    # The outer bubble is too large at first; read from its other end, after the inner one, it is not.
    assert simplify.pop_bubbles(g, 1000, max_removed=1).segments.count() == 6


def test_long_and_protected_tips(spark):
    links = [*chain(4), ("4+", "5+", 1, 1), ("5+", "2+", 1, 1)]
    g = graph(spark, [(100, 9)] * 4 + [(10, 90), (10, 90)], links)
    kept = lambda x: sorted(r.seg_id for r in x.segments.collect())
    assert kept(simplify.drop_tips(g, 2, 50)) == [0, 1, 2, 3]
    assert kept(simplify.drop_tips(g, 1, 50)) == [0, 1, 2, 3, 4, 5]
    assert kept(simplify.drop_tips(g, 2, 5)) == [0, 1, 2, 3, 4, 5]
    strong = graph(spark, [(100, 9)] * 4 + [(900, 90)], [*chain(4), ("4+", "2+", 1, 1)])
    assert kept(simplify.drop_tips(strong, 2, 1000, protect=True)) == [2, 3, 4] and 4 not in kept(simplify.drop_tips(strong, 2, 1000))


def test_arcs_are_worked_out_once(spark):
    """Neither numbering links nor removing weak crosslinks repeats what its arcs come from."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    links = [(0, 2, 9), (0, 4, 1), (6, 4, 9)]
    arcs = [(v, w, 0, 0, c) for a, b, c in links for v, w in ((a, b), (b ^ 1, a ^ 1))]
    bare = spark.createDataFrame(arcs, "v long, w long, ln long, ls long, cov long").withColumn("comp", is_complement())
    slow = bare.mapInArrow(counted, bare.schema).withColumn("link_id", F.lit(None).cast("long"))
    assert {(r.v, r.w): r.link_id for r in with_link_ids(slow).collect()} == {(0, 2): 0, (3, 1): 0, (0, 4): 1, (5, 1): 1, (5, 7): 2, (6, 4): 2}
    assert rows.value == len(arcs)
    segments = spark.createDataFrame([(s, 10, 5) for s in range(4)], "seg_id long, len long, cov long")
    left = simplify.remove_weak_crosslinks(AssemblyGraph(segments, slow), 0.7).arcs.select("v", "w").collect()
    assert {(r.v, r.w) for r in left} == {(0, 2), (3, 1), (6, 4), (5, 7)}
    assert rows.value == 2 * len(arcs)
