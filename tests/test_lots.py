import os
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import coverage, flow, simplify, traversal
from skein.operators import graph as g
from skein.plans import dense
from skein.plans.derived import derived_graph

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables here")
def test_part_graph_is_dealt_into_lots_that_do_not_grow(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, derived_graph(spark, FOLDER, "P").arcs.select("v", "w", "ls", "cov", "comp").collect()))
    whole = rows()
    monkeypatch.setattr(dense, "ROWS_IN_LOT", 500)
    arcs = derived_graph(spark, FOLDER, "P").arcs
    sizes = [r.n for r in arcs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert len(sizes) == -(-lines // 500)
    assert max(sizes) < 4 * 500
    assert rows() == whole


def test_numbers_are_shared_within_and_across_batches(spark):
    rows = spark.range(40_000).select((F.col("id") % 7_001 - 3_000).alias("a"), (F.col("id") % 3).alias("b"), "id")
    found = dense.shared_index(rows, ["a", "b"], "n", 9)
    assert found.columns == ["id", "a", "b", "n"]
    found = found.toPandas()
    expected = found.set_index(["a", "b"]).index
    names = {k: i for i, k in enumerate(sorted(set(expected)))}
    assert len(found) == 40_000 and [names[k] for k in expected] == found["n"].tolist()
    hub = spark.range(30_000).select(F.lit(5).cast("long").alias("a"))
    assert [tuple(r) for r in dense.shared_index(hub, ["a"], "n", 4).groupBy("n").count().collect()] == [(0, 30_000)]
    assert dense.shared_index(hub.limit(0), ["a"], "n", 4).count() == 0


def test_link_ids_pair_parallel_arcs_and_hairpins_in_order(spark):
    arcs = g.symmetrise(spark.createDataFrame([(0, 4, 0, 1, 1), (0, 4, 0, 2, 1), (2, 3, 0, 0, 1), (5, 1, 0, 1, 1), (6, 6, 0, 0, 2)], "v long, w long, ln long, ls long, cov long"))
    found = sorted((r.v, r.w, r.link_id) for r in g.with_link_ids(arcs).collect())
    assert found == [(0, 4, 0), (0, 4, 1), (2, 3, 2), (5, 1, 0), (5, 1, 1), (6, 6, 3), (7, 7, 3)]


def test_open_ends_read_each_vertex_once(spark):
    arcs = spark.createDataFrame([(0, 2, 0, 0, 1), (0, 4, 0, 0, 1)], "v long, w long, ln long, ls long, cov long")
    segments = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "seg_id long, name string")
    found = simplify.open_ends(g.normalise(g.AssemblyGraph(segments, arcs)))
    assert sorted(r.v for r in found.collect()) == [1, 2, 4]


def test_mergeable_arcs_do_not_sort_arcs_for_joins(spark):
    arcs = spark.createDataFrame([(0, 2, 1), (2, 4, 7), (2, 6, 2), (6, 8, 3), (8, 8, 1), (10, 11, 4), (12, 14, None)], "v long, w long, ls long")
    graph = g.normalise(g.AssemblyGraph(spark.createDataFrame([(0, "a")], "seg_id long, name string"), arcs.selectExpr("v", "w", "0L AS ln", "ls", "1L AS cov")))
    rows, out = graph.arcs.select("v", "w", "ls").collect(), {}
    for v, w, ls in rows:
        out.setdefault(v, []).append((w, ls))
    expected = {(v, *x[0]) for v, x in out.items() if len(x) == 1 and len(out.get(x[0][0] ^ 1, [])) == 1}
    found = simplify.mergeable_arcs(spark.createDataFrame(rows, "v long, w long, ls long"))
    assert {tuple(r) for r in found.collect()} == expected and (0, 2, 1) in expected and (12, 14, None) in expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def _random_graph(spark, seed, n=40, links=120, chains=5):
    """Mostly links of their own, some from a segment to itself, chains, hairpins and segments of one base."""
    rng = random.Random(seed)
    arcs = {(rng.randrange(2 * n), rng.randrange(2 * n)) for _ in range(links)} | {(2 * k, 2 * k) for k in range(0, n, 7)} | {(3, 2)}
    arcs |= {(2 * k, 2 * k + 2) for k in range(n, n + chains)} | {(0, 2 * n), (2 * (n + chains), 0)}
    segments = spark.createDataFrame([(k, f"s{k}", None, rng.choice([1, 2, 50, 900]), rng.randrange(1, 40)) for k in range(n + chains + 1)], "seg_id long, name string, seq string, len long, cov long")
    made = g.normalise(g.AssemblyGraph(segments, spark.createDataFrame([(v, w, 0, 0, 1) for v, w in sorted(arcs)], "v long, w long, ln long, ls long, cov long")))
    return g.AssemblyGraph(made.segments.cache(), made.arcs.cache())


def test_moves_look_at_the_groups_that_may_lower_the_cost(spark, monkeypatch):
    woken, real = [], flow.materialise
    monkeypatch.setattr(flow, "materialise", lambda df, what, *a: (lambda t: (woken.append(t[0].count()) if what == "flow-uses" else None, t)[1])(real(df, what, *a)))
    graph = _random_graph(spark, 1)
    labels = traversal.components(graph).cache()
    copies = coverage.copy_numbers(graph.segments.join(labels, "seg_id")).cache()
    fit = lambda: sorted(map(tuple, flow.adjust_copies(graph, labels, copies, rounds=2, links_in_task=0).collect()))
    found, few = fit(), (max(woken), woken.clear())[0]
    with monkeypatch.context() as all_awake:
        all_awake.setattr(flow, "_eager", lambda ends, *_: ends.select("grp"))
        assert fit() == found
    assert found != sorted((r.seg_id, r.copy, r.avg) for r in copies.collect())
    assert few < max(woken)
    woken.clear()
    # None of these links can lower the cost, so none is looked at.
    arcs = spark.createDataFrame([(2 * a, 2 * b, 0, 0, 1) for a in range(6) for b in range(a + 1, 6)], "v long, w long, ln long, ls long, cov long")
    still = g.normalise(g.AssemblyGraph(graph.segments.where("seg_id < 6").withColumn("len", F.lit(9).cast("long")), arcs))
    assert flow.fit_by_moves(still, labels.where("seg_id < 6"), copies).count() == 6
    assert woken == [0]


def test_links_are_told_apart_only_where_arcs_leave_it_open(spark):
    segments = spark.createDataFrame([(k, f"s{k}") for k in range(8)], "seg_id long, name string")
    arcs = spark.createDataFrame([(0, 2, 0, 0, 1), (2, 0, 0, 0, 1), (4, 5, 0, 0, 1), (6, 7, 0, 0, 1), (4, 6, 0, 0, 1), (8, 10, 0, 0, 1)], "v long, w long, ln long, ls long, cov long")
    graph = g.normalise(g.AssemblyGraph(segments, arcs))
    for most in range(5):
        large, small = flow._by_links(graph, traversal.components(graph), most)
        links = {0: 2, 1: 2, 2: 3, 3: 3, 4: 1, 5: 1, 6: 0, 7: 0}
        assert {r.seg_id for r in large.collect()} == {k for k, n in links.items() if n > most}
        assert {r.seg_id for r in small.collect()} == {k for k, n in links.items() if n <= most}
