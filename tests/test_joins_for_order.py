"""What used to depend on an order of steps, against plain versions that take the steps."""

import itertools
import random
import types
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.operators import coverage
from skein.operators import strong as strong_module
from skein.operators.dominators import dominating, dominator_tree
from skein.operators.graph import AssemblyGraph
from skein.operators.strong import strong_labels
from skein.plans import components
from skein.plans.pointers import all_ahead, follow


def behind(arcs, start, gone=None):
    out = defaultdict(list)
    for v, w in arcs:
        out[v].append(w)
    seen, work = ({start} if start != gone else set()), [start] * (start != gone)
    while work:
        for w in out[work.pop()]:
            if w not in seen and w != gone:
                seen.add(w)
                work.append(w)
    return seen


def strong(arcs):
    reach = {x: behind(arcs, x) for x in itertools.chain(*arcs)}
    groups = {x: [y for y in seen if x in reach[y]] for x, seen in reach.items()}
    return {x: min(g) for x, g in groups.items() if len(g) > 1}


def immediate_dominators(arcs, source):
    reached = behind(arcs, source)
    above = {v: ({source} if v != source else set()) for v in reached}
    for d in reached - {source}:
        for v in reached - behind(arcs, source, d) - {d}:
            above[v].add(d)
    return {v: max(ds, key=lambda d: len(above[d])) for v, ds in above.items() if ds}, above


def some_graphs():
    rng = random.Random(6)
    for n, m in ((12, 14), (20, 40)):
        arcs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        yield [*arcs, *[(100 + k, 101 + k) for k in range(9)], (arcs[3][1], 100), (109, arcs[5][0])]


@pytest.mark.parametrize("arcs", list(some_graphs()))
def test_strong_components_and_dominators(spark, arcs, monkeypatch):
    monkeypatch.setattr(strong_module, "LEAST_SINGLE", 1)
    df = spark.createDataFrame([*arcs, arcs[0], (7, 7), (None, 1)], "v long, w long")
    assert {r.x: r.scc for r in strong_labels(df).collect()} == strong(arcs)
    monkeypatch.setattr(strong_module, "LEAST_SINGLE", 1000)
    assert {r.x: r.scc for r in strong_labels(df).collect()} == strong(arcs)
    source = arcs[0][0]
    want, above = immediate_dominators(arcs, source)
    tree = dominator_tree(df.where("v IS NOT NULL"), source).cache()
    assert {r.v: r.idom for r in tree.collect()} == want
    deepest = max(above, key=lambda v: len(above[v]))
    chain = {r.v: r.depth for r in dominating(tree, deepest).collect()}
    assert chain == {v: len(above[v]) for v in above[deepest] | {deepest}}


def test_a_ring_of_100000(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("v"), ((F.col("id") * 7919 + 1) % n).alias("w"))
    order = spark.range(n).select(((F.col("id") + 1) % n).alias("w"), F.col("id").alias("v"))
    tail = spark.range(1000).select((F.col("id") + n).alias("v"), (F.col("id") + n + 1).alias("w"))
    found = strong_labels(order.unionByName(tail).unionByName(spark.createDataFrame([(5, n), (n + 500, n + 7000)], "v long, w long")))
    assert [tuple(r) for r in found.groupBy("scc").count().collect()] == [(0, n)]
    assert strong_labels(ring.where("v < 0")).collect() == []


def test_pointers(spark):
    to = {1: 2, 2: 3, 3: 4, 10: 3, 20: 21, 21: 22, 22: 20, 30: 22, 31: 30, 40: 40}
    followed = follow(spark.createDataFrame(list(to.items()), "x long, to long"), keep_jumps=True)
    assert {(r.x, r.root, r.steps) for r in followed.ends.collect()} == {(1, 4, 3), (2, 4, 2), (3, 4, 1), (10, 4, 2)}
    assert {(r.x, r.least) for r in followed.rings.collect()} == {(20, 20), (21, 20), (22, 20), (40, 40)}
    assert {r.x for r in followed.stray.collect()} == {30, 31} and followed.has_rings
    assert {r.x for r in all_ahead(spark.createDataFrame([(2,)], "x long"), followed.jumps).collect()} == {2, 3, 4}


def bare_graph(spark, n, links, rng):
    arcs = {}
    for v, w, cov in links:
        arcs[v, w] = arcs[w ^ 1, v ^ 1] = cov
    segments = [(s, rng.randrange(20), rng.randrange(3)) for s in range(n)]
    a = spark.createDataFrame([(v, w, c) for (v, w), c in arcs.items()], "v long, w long, cov long")
    return AssemblyGraph(spark.createDataFrame(segments, "seg_id long, len long, cov long"), a), sorted((v & 1, v, w, c) for (v, w), c in arcs.items()), {s: (n_, c) for s, n_, c in segments}


def test_passes_in_order(spark):
    rng = random.Random(2)
    n = 60
    links = [(rng.randrange(2 * n), rng.randrange(2 * n), rng.randrange(3)) for _ in range(70)] + [(2 * k, 2 * k + 2, 1) for k in range(40, 55)]
    graph, arcs, facts = bare_graph(spark, n, links, rng)
    copies = {s: int(s % 5 == 0) for s in range(n) if s != 17}
    labels = graph.segments.select("seg_id", F.lit(0).alias("component"))
    table = spark.createDataFrame(list(copies.items()), "seg_id long, copy int")

    def passed(copy, may):
        copy = {s: copy.get(s, 0) for s in range(n)}
        for _, v, w, cov in arcs:
            for a, b in ((v >> 1, w >> 1), (w >> 1, v >> 1)):
                if copy[a] and not copy[b] and may(b, cov):
                    copy[b] = 1
        return copy

    got = lambda df: {r.seg_id: r.copy for r in df.collect()}
    assert got(coverage.rescue_by_arcs(graph, labels, table)) == passed(copies, lambda b, cov: cov > 0)
    short = lambda b, cov: facts[b][0] < 12
    assert got(coverage.add_neighbours(graph, labels, table, 2, 12)) == passed(passed(copies, short), short)
    assert got(coverage.add_neighbours(graph, labels, table, 0, 12)) == {s: copies.get(s, 0) for s in range(n)}


def test_bubbles_one_by_one(spark):
    rng = random.Random(9)
    n = 40
    graph, arcs, facts = bare_graph(spark, n, [(2 * rng.randrange(n), 2 * rng.randrange(n), 1) for _ in range(90)], rng)
    copies = {s: int(s % 9 == 0) for s in range(n)}
    after = defaultdict(set)
    for strand, v, w, _ in arcs:
        if not strand:
            after[v >> 1].add(w >> 1)
    between = defaultdict(set)
    for left in range(n):
        for middle in after[left]:
            for right in after[middle]:
                if facts[left][1] and facts[right][1] and len({left, middle, right}) == 3:
                    between[left, right].add(middle)
    copy, gone, raised = dict(copies), set(), 0
    for _, middles in sorted(between.items()):
        if any(copy[m] for m in middles):
            gone |= middles
        else:
            copy.update((m, 1) for m in middles)
            raised += 1
    labels = graph.segments.select("seg_id", F.lit(0).alias("component"))
    found = coverage.pick_bubbles(graph, labels, spark.createDataFrame(list(copies.items()), "seg_id long, copy int")).collect()
    assert {(r.seg_id, r.copy, r.excluded) for r in found} == {(s, copy[s], s in gone) for s in range(n)}
    assert raised > 5 and len(gone) > 5


def test_components_over_star_rounds(spark, monkeypatch):
    """With lots and batches of a few edges, contraction within tasks can't finish, so star rounds must."""
    # Workers import the module anew, so the function takes its small lots along.
    small = types.FunctionType(components._contract.__code__, {**vars(components), "EDGES_AT_ONCE": 20})
    small.__module__ = "__main__"
    monkeypatch.setattr(components, "_contract", small)
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 20)
    seen = []
    star = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda *a: seen.append(1) or star(*a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rng = random.Random(1)
        edges = [(k, k + 1) for k in range(120)] + [(500, 501 + k) for k in range(90)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(3000, 3000)]
        rng.shuffle(edges)
        both = edges + [(b, a) for a, b in edges]
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()}
        assert seen and got == {x: min(behind(both, x)) for x in itertools.chain(*edges)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_near_numbers_need_no_star_rounds(spark, monkeypatch):
    """Where near nodes have near numbers, ranges of nodes and the links between their stars are enough."""
    small = types.FunctionType(components._contract.__code__, {**vars(components), "EDGES_AT_ONCE": 120})
    small.__module__ = "__main__"
    monkeypatch.setattr(components, "_contract", small)
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 120)
    seen = []
    star = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda *a: seen.append(1) or star(*a))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rng = random.Random(2)
        edges = [(k, k + 1) for k in range(900) if k % 23] + [(k, k + 2) for k in range(0, 900, 5)] + [(5000, 5000)]
        rng.shuffle(edges)
        both = edges + [(b, a) for a, b in edges]
        rows = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), "a", "b").collect()
        assert not seen and len(rows) == len({r.node for r in rows})
        assert {r.node: r.component for r in rows} == {x: min(behind(both, x)) for x in itertools.chain(*edges)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passes_in_tasks_and_by_rounds_agree(spark, monkeypatch):
    """Small components are passed in tasks, without a round for each hop, and give what rounds of joins give."""
    rng = random.Random(5)
    n = 90
    links = [(2 * k, 2 * k + 2, 1) for k in range(1, 40)] + [(2 * rng.randrange(45, 80) + rng.randrange(2), 2 * rng.randrange(45, 80) + rng.randrange(2), rng.randrange(3)) for _ in range(60)]
    graph, _, _ = bare_graph(spark, n, links, rng)
    labels = graph.segments.select("seg_id", F.when(F.col("seg_id") < 45, F.lit(0)).otherwise(F.when(F.col("seg_id") < 80, F.lit(45)).otherwise(F.col("seg_id"))).cast("long").alias("component"))
    table = spark.createDataFrame([(s, int(s % 9 == 1)) for s in range(n)], "seg_id long, copy int")
    rounds = []
    by_joins = coverage._arrivals
    monkeypatch.setattr(coverage, "_arrivals", lambda *a: rounds.append(1) or by_joins(*a))
    results = []
    for in_task, used in ((1000, 0), (60, 1 + 2), (0, 1 + 2)):
        monkeypatch.setattr(coverage, "ARCS_IN_TASK", in_task)
        found = [{r.seg_id: r.copy for r in rows.collect()} for rows in (coverage.rescue_by_arcs(graph, labels, table), coverage.add_neighbours(graph, labels, table, 2, 12))]
        assert len(rounds) == used
        assert all(len(f) == n for f in found)
        rounds.clear()
        results.append(found)
    assert results[0] == results[1] == results[2] and sum(results[0][0].values()) > 10
