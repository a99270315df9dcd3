import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from skein.operators import flow, walks
from skein.plans.derived import derived_graph

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables here")
def test_part_graph_keeps_all_arcs(spark):
    graph = derived_graph(spark, FOLDER, "P")
    arcs = [(r.v, r.w) for r in graph.arcs.select("v", "w").collect()]
    segments = [r.seg_id for r in graph.segments.select("seg_id").collect()]
    root = {s: s for s in segments}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for v, w in arcs:
        a, b = sorted((find(v >> 1), find(w >> 1)))
        root[b] = a
    run = lambda name: entry.queries()[name](spark, FOLDER).collect()
    assert {r.seg_id: r.component for r in run("components_all_arcs")} == {s: find(s) for s in segments}
    links = {min((v, w), (w ^ 1, v ^ 1)) for v, w in arcs}
    groups = run("link_groups")
    assert len({r.link_id for r in groups}) == len(groups) == len(links)
    assert all(r.grp <= r.link_id for r in groups)
    out = {v for v, _ in arcs}
    assert {r.v for r in run("open_ends_all_arcs")} == {x for s in segments for x in (2 * s, 2 * s + 1)} - out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables here")
def test_searches_run_with_their_own_limits(spark, monkeypatch):
    seen = []
    for module, name in ((walks, "find_paths"), (flow, "adjust_copies")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), **k: (seen.append((len(a), k)), _f(*a, **k))[1])
    found = entry.queries()["find_paths"](spark, FOLDER).collect()
    assert found and not any(r.exceeded for r in found)
    entry.queries()["adjust_copies"](spark, FOLDER)
    assert seen == [(3, {}), (3, {})]


def test_annealing_follows_the_full_objective():
    rng = np.random.default_rng(3)
    pairs = sorted({(int(v), int(w)) for v, w in rng.integers(0, 40, (60, 2))} | {(0, 1), (4, 4)})
    pairs = sorted({p for v, w in pairs for p in ((v, w), (w ^ 1, v ^ 1))})
    names = {p: i for i, p in enumerate(sorted({min(p, (p[1] ^ 1, p[0] ^ 1)) for p in pairs}))}
    s = pd.DataFrame({"seg_id": range(20), "len": rng.integers(10, 99, 20), "cov": rng.integers(1, 40, 20)})
    a = pd.DataFrame([(v, w, 1, names[min((v, w), (w ^ 1, v ^ 1))]) for v, w in pairs], columns=["v", "w", "ls", "link_id"])
    group = flow.arc_groups(s, a)
    objective = flow._Objective(s, a, group, max(group.values()) + 1)
    best, state = flow._annealing(objective, [4] * objective.n, 9.0, np.random.default_rng(1))
    assert best == pytest.approx(float(objective.cost(state[:, None], 9.0)[0]))
    assert best < objective.cost(np.zeros((objective.n, 1)), 9.0)[0]


def test_annealing_takes_more_groups_than_a_dense_table_holds():
    n = 60_000  # a dense table of segments x groups would be 58 GB
    a = pd.DataFrame({"v": np.arange(n) * 2, "w": np.roll(np.arange(n) * 2, -1), "link_id": np.arange(n)})
    s = pd.DataFrame({"seg_id": np.arange(n), "len": 100, "cov": 5})
    objective = flow._Objective(s, a, {i: i for i in range(n)}, n)
    assert objective.terms(*objective.flows(np.ones(n)), 5.0).sum() == pytest.approx(2 * n * 0.75 * 2)
    assert objective.ends()[0][-1] == n
