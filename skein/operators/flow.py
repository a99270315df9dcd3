"""Fitting copy numbers to the graph's layout as an integer flow.

Links that must carry equal flow form groups. A fit gives every group an integer
so that what flows in and out of a segment agrees with its coverage. Small search
spaces are gone through in full, in vectorised blocks; larger ones by annealing.
A component is one group, unless it is large: then groups of links
that share no segment move at once, by joins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import flip, segment_of
from skein.operators.coverage import lower_bound
from skein.operators.graph import AssemblyGraph
from skein.operators.traversal import arcs_with_component, per_component
from skein.plans.components import connected_components, least_roots
from skein.plans.scratch import materialise

ROUNDS = 10
FULL_SEARCH = 100_000_000
NEAR = 1.1920929e-07
_BLOCK = 1 << 14
SEED = 1234
LINKS_IN_TASK = 20_000
#: Costs are compared as whole millionths, so that sums don't depend on the order of rows.
MILLIONTHS = 1_000_000


def arc_groups(segments: pd.DataFrame, arcs: pd.DataFrame) -> dict[int, int]:
    """Group of each link: the two links of a segment with one on either side carry equal flow."""
    sides = arcs.groupby("v")["link_id"].agg(["size", "first"])
    single = sides.loc[sides["size"] == 1, "first"]
    ahead = single[single.index % 2 == 0]
    behind = single.reindex(ahead.index + 1).to_numpy(dtype=float)
    both = ~np.isnan(behind)
    links = np.unique(arcs["link_id"].to_numpy())
    pairs = np.concatenate([links, ahead.to_numpy()[both]]), np.concatenate([links, behind[both].astype(np.int64)])
    nodes, roots = least_roots(*pairs)
    return dict(zip(nodes.tolist(), np.unique(roots, return_inverse=True)[1].tolist()))


class _Objective:
    """sum of log10(len) * (|e - out| / 2 + |e - in| / 2 + |out - in|) over the segments.

    Flows are kept as one entry for each arc, so memory follows the arcs; ``cost``
    expands them for the few groups of a full search.
    """

    def __init__(self, segments: pd.DataFrame, arcs: pd.DataFrame, group: dict[int, int], n: int):
        self.n, self.size = n, len(segments)
        v = arcs["v"].to_numpy()
        self.row, self.side = np.searchsorted(segments["seg_id"].to_numpy(), v >> 1), v & 1
        self.group = np.array([group[name] for name in arcs["link_id"].tolist()], dtype=np.int64)
        self.own = np.bincount(self.row, minlength=self.size) > 0
        self.weight = np.where(self.own, np.log10(np.maximum(1, segments["len"].to_numpy(dtype=float))), 0)
        self.cov = segments["cov"].to_numpy(dtype=float)

    def flows(self, values: np.ndarray) -> list[np.ndarray]:
        """What flows out of and into each segment in one assignment."""
        return [np.bincount(self.row[at], values[self.group[at]], self.size) for at in (self.side == 0, self.side == 1)]

    def terms(self, out: np.ndarray, into: np.ndarray, avg: float, rows=slice(None)) -> np.ndarray:
        expected = self.cov[rows] / avg
        return self.weight[rows] * (np.abs(expected - out) / 2 + np.abs(expected - into) / 2 + np.abs(out - into))

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments that a group's flow touches, with arcs out and in; by group from ``starts``."""
        keys, at = np.unique(self.group * self.size + self.row, return_inverse=True)
        counts = np.stack([np.bincount(at[self.side == k], minlength=len(keys)) for k in (0, 1)])
        return np.searchsorted(keys, np.arange(self.n + 1) * self.size), keys % self.size, counts

    def cost(self, values: np.ndarray, avg: float) -> np.ndarray:
        """Costs of assignments, a column each."""
        flow = np.zeros((2, self.size, self.n))
        np.add.at(flow, (self.side, self.row, self.group), 1)
        out, into = flow[0] @ values, flow[1] @ values
        expected = (self.cov / avg)[:, None]
        return self.weight @ (np.abs(expected - out) / 2 + np.abs(expected - into) / 2 + np.abs(out - into))


def _at_most(upper: list[int], limit: int) -> bool:
    total = 1
    for u in upper:
        total *= u + 1
        if total > limit:
            return False
    return True


def _full_search(objective: _Objective, upper: list[int], avg: float) -> tuple[float, np.ndarray]:
    """The first assignment of least cost, group 0 running fastest."""
    sizes = np.array([u + 1 for u in upper], dtype=np.int64)
    strides = np.concatenate([[1], np.cumprod(sizes)[:-1]])
    total = int(np.prod(sizes))
    best, at = math.inf, 0
    for start in range(0, total, _BLOCK):
        numbers = np.arange(start, min(total, start + _BLOCK))
        costs = objective.cost((numbers // strides[:, None]) % sizes[:, None], avg)
        k = int(costs.argmin())
        if costs[k] < best:
            best, at = float(costs[k]), int(numbers[k])
        if abs(best) < NEAR:
            break
    return best, (at // strides) % sizes


def _annealing(objective: _Objective, upper: list[int], avg: float, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Steps of one at random groups, reflected at the bounds; restarts get cooler.

    A step changes the terms of the segments that its group touches, no others.
    """
    top = np.array(upper)
    state = np.zeros(len(upper), dtype=np.int64)
    starts, touched, (n_out, n_in) = objective.ends()
    best_state, best = state.copy(), float(objective.terms(*objective.flows(state), avg).sum())
    cost, hot = best, 1000.0
    for _ in range(100):
        if best < NEAR:
            break
        before, t = best, hot
        state, cost = best_state.copy(), best
        out, into = objective.flows(state)
        terms = objective.terms(out, into, avg)
        while t > 1e-6:
            g = int(rng.integers(len(upper)))
            if top[g]:
                step = 1 if state[g] == 0 else -1 if state[g] == top[g] else int(rng.choice((-1, 1)))
                own = slice(starts[g], starts[g + 1])
                rows = touched[own]
                held = out[rows], into[rows], terms[rows]
                state[g] += step
                out[rows] += step * n_out[own]
                into[rows] += step * n_in[own]
                terms[rows] = objective.terms(out[rows], into[rows], avg, rows)
                new = float(terms.sum())
                if new <= cost or rng.random() < math.exp((cost - new) / t):
                    cost = new
                    if cost < best:
                        best, best_state = cost, state.copy()
                else:
                    state[g] -= step
                    out[rows], into[rows], terms[rows] = held
            t *= 0.999
        hot *= 0.99
        if best == before:
            break
    return best, best_state


def _kernel(max_copy: int, rounds: int, full_search: int):
    def run(s: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        copy = s["copy"].fillna(0).astype(int).to_numpy().copy()
        avg, lower = float(s["avg"].dropna().iloc[0]), float(s["lb"].dropna().iloc[0])
        row = {x: i for i, x in enumerate(s["seg_id"].tolist())}
        if len(a) and avg > 0:
            group = arc_groups(s, a)
            n = max(group.values()) + 1
            upper = [0] * n
            for v, w, name in zip(a["v"].tolist(), a["w"].tolist(), a["link_id"].tolist()):
                most = max(copy[row[v >> 1]], copy[row[w >> 1]])
                upper[group[name]] = max(upper[group[name]], min(most * 4 // 3 + 1, max_copy))
            objective = _Objective(s, a, group, n)
            best = float(objective.terms(*objective.flows(np.zeros(n)), avg).sum())
            length = s["len"].to_numpy(dtype=float)
            rng = np.random.default_rng(SEED)
            for _ in range(rounds):
                if _at_most(upper, full_search):
                    cost, values = _full_search(objective, upper, avg)
                else:
                    cost, values = _annealing(objective, upper, avg, rng)
                if cost >= best:
                    break
                best = cost
                out, into = objective.flows(values)
                bases = (length * (out + into) / 2).sum()
                if bases < NEAR:
                    break
                new = max((length * objective.cov)[out + into > 0].sum() / bases, lower)
                if abs(new - avg) < NEAR:
                    break
                copy = np.where(out == into, out.astype(int), copy)
                avg = new
        return pd.DataFrame({"seg_id": s["seg_id"], "copy": copy.astype("int32"), "avg": avg})

    return run


def _term(out: Column, into: Column) -> Column:
    """A segment's part of the cost (see ``_Objective``) with these flows."""
    expected = F.col("cov") / F.col("avg")
    return F.col("weight") * (F.abs(expected - out) / 2 + F.abs(expected - into) / 2 + F.abs(out - into))


def _flows(uses: DataFrame, state: DataFrame) -> DataFrame:
    """``seg_id, out, into`` of the segments that moved groups touch, as a table."""
    through = uses.join(state, "grp").groupBy("seg_id").agg(F.sum(F.col("n_out") * F.col("value")).alias("out"), F.sum(F.col("n_in") * F.col("value")).alias("into"))
    return materialise(through, "flow-through")[0]


def _moves(uses: DataFrame, segments: DataFrame, state: DataFrame, flows: DataFrame) -> DataFrame:
    """``grp, step``: steps of one that lower the cost most, of groups without a common segment.

    Groups that share segments are coloured by their gains: one moves if none that it
    shares a segment with gains more (of equal gains, the lower group goes). So moves of
    a round don't touch each other, and the best of all is among them. ``state`` has
    the groups whose value isn't 0.
    """
    held = segments.join(uses.select("seg_id"), "seg_id", "left_semi").join(flows, "seg_id", "left").na.fill(0, ["out", "into"])
    rows = uses.join(state, "grp", "left").na.fill(0, ["value"]).join(held, "seg_id").withColumn("step", F.explode(F.array(F.lit(1), F.lit(-1))))
    after = F.col("value") + F.col("step")
    gain = _term(F.col("out") + F.col("step") * F.col("n_out"), F.col("into") + F.col("step") * F.col("n_in")) - _term(F.col("out"), F.col("into"))
    sums = rows.where((after >= 0) & (after <= F.col("upper"))).groupBy("grp", "step").agg(F.sum(F.round(gain * MILLIONTHS).cast("long")).alias("gain"))
    wanted = sums.where("gain < 0").groupBy("grp").agg(F.min(F.struct("gain", "step")).alias("m")).select("grp", F.struct("m.gain", "grp").alias("turn"), "m.step")
    wanted, _ = materialise(wanted, "flow-moves")
    near = uses.join(wanted, "grp")
    first = near.groupBy("seg_id").agg(F.min("turn").alias("first"))
    late = near.join(first, "seg_id").where("turn > first").select("grp").distinct()
    return wanted.join(late, "grp", "left_anti").select("grp", "step")


def _eager(ends: DataFrame, joined: DataFrame, roused: DataFrame) -> DataFrame:
    """``grp`` of what may lower the cost where as much flows into each segment as out of it."""
    return ends.where("seg_id = other").select("grp").unionByName(joined.select("grp")).unionByName(ends.join(roused, "seg_id", "left_semi").select("grp"))


def fit_by_moves(graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, max_copy: int = 10, rounds: int = ROUNDS) -> DataFrame:
    """``seg_id, copy, avg`` like ``adjust_copies``, for components of any size.

    Flows start at nothing, and in each step all groups that can lower the cost by one
    up or down, and that share no segment, do so at once, until none can: joins over the
    groups' segments, without a task that holds a component. It ends in a cost that no
    single group can lower, which need not be the least of all.

    Only groups that may lower it are looked at. A link of its own between two segments,
    as much flowing in as out of either, raises |out - in| by a whole and lowers the
    other terms by half of that at most, so it wakes when one of its segments gets out of
    balance. Links from a segment to itself, groups of several links and segments without
    a weight are awake from the start.
    """
    bounds = lower_bound(graph.segments.join(labels, "seg_id"))
    own = graph.segments.select("seg_id", "len", "cov").join(labels, "seg_id").join(copies.select("seg_id", "copy", "avg"), "seg_id").join(bounds, "component").where("avg > 0")
    own, _ = materialise(own, "flow-segments")
    joined, _ = materialise(_joined_links(graph), "flow-groups")
    side = F.col("v").bitwiseAND(F.lit(1).cast("long"))
    ends = graph.arcs.select("link_id", "v", "w", segment_of("v").alias("seg_id"), segment_of("w").alias("other"))
    ends = ends.join(joined, "link_id", "left").withColumn("grp", F.coalesce("grp", "link_id"))
    copy_of = lambda c: own.select(F.col("seg_id").alias(c), F.col("copy").alias(f"{c}_copy"))

    def uses_of(groups: DataFrame) -> DataFrame:
        """``grp, seg_id, n_out, n_in, upper`` of some groups."""
        woken, _ = materialise(groups.distinct(), "flow-woken")
        own_ends, _ = materialise(ends.join(woken, "grp", "left_semi"), "flow-ends")
        most = own_ends.join(copy_of("seg_id"), "seg_id").join(copy_of("other"), "other")
        upper = most.groupBy("grp").agg(F.max(F.least(F.floor(F.greatest("seg_id_copy", "other_copy") * 4 / 3).cast("int") + 1, F.lit(max_copy))).alias("upper"))
        inside = own.join(own_ends.select("seg_id"), "seg_id", "left_semi").select("seg_id")
        return own_ends.join(inside, "seg_id", "left_semi").groupBy("grp", "seg_id").agg(F.count_if(side == 0).alias("n_out"), F.count_if(side == 1).alias("n_in")).join(upper, "grp")

    roused, _ = materialise(own.where("coalesce(len, 0) <= 1").select("seg_id"), "flow-roused")
    uses, _ = materialise(uses_of(_eager(ends, joined, roused)), "flow-uses")
    linked = graph.arcs.select(segment_of("v").alias("seg_id")).distinct().withColumn("linked", F.lit(1))
    weight = F.when(F.col("linked") == 1, F.log10(F.greatest(F.lit(1), "len").cast("double"))).otherwise(0.0).alias("weight")
    segments = own.join(linked, "seg_id", "left").select("seg_id", "component", "len", "cov", "copy", "avg", "lb", weight)
    segments, _ = materialise(segments, "flow-segments")
    state, _ = materialise(uses.select("grp", F.lit(0).cast("long").alias("value")).limit(0), "flow")
    flows = _flows(uses, state)
    best = segments.groupBy("component").agg(F.sum(F.round(_term(F.lit(0), F.lit(0)) * MILLIONTHS).cast("long")).alias("best"))
    live, _ = materialise(best, "flow-costs")
    for _ in range(rounds):
        going = segments.join(live.select("component"), "component", "left_semi")
        while True:
            fresh, _ = materialise(flows.where("out <> into").select("seg_id").join(roused, "seg_id", "left_anti"), "flow-fresh")
            if not fresh.isEmpty():
                woken = ends.join(fresh, "seg_id", "left_semi").select("grp").join(uses.select("grp"), "grp", "left_anti")
                uses, _ = materialise(uses.unionByName(uses_of(woken)), "flow-uses")
                roused, _ = materialise(roused.unionByName(fresh), "flow-roused")
            moves, _ = materialise(_moves(uses, going, state, flows), "flow-moves")
            if moves.isEmpty():
                break
            moved = state.unionByName(moves.select("grp", F.col("step").cast("long").alias("value")))
            state, _ = materialise(moved.groupBy("grp").agg(F.sum("value").alias("value")).where("value <> 0"), "flow")
            flows = _flows(uses, state)
        held = segments.join(flows, "seg_id", "left").na.fill(0, ["out", "into"])
        through = F.col("out") + F.col("into")
        sums = held.groupBy("component").agg(
            F.sum(F.round(_term(F.col("out"), F.col("into")) * MILLIONTHS).cast("long")).alias("cost"), F.sum(F.col("len") * through / 2).alias("bases"),
            F.sum(F.when(through > 0, F.col("len") * F.col("cov")).otherwise(0)).alias("mass"), F.first("lb").alias("lb"), F.first("avg").alias("was"),
        )
        new = F.greatest(F.col("mass") / F.col("bases"), "lb")
        better = sums.join(live, "component").where("cost < best AND bases > 0").withColumn("new", new).where(F.abs(F.col("new") - F.col("was")) >= NEAR)
        live, _ = materialise(better.select("component", F.col("cost").alias("best"), "new"), "flow-costs")
        if live.isEmpty():
            break
        fitted = held.join(live.select("component", "new"), "component", "left")
        agreed = F.col("new").isNotNull() & (F.col("out") == F.col("into"))
        fitted = fitted.withColumn("copy", F.when(agreed, F.col("out").cast("int")).otherwise(F.col("copy"))).withColumn("avg", F.coalesce("new", "avg"))
        segments, _ = materialise(fitted.select(segments.columns), "flow-segments")
        live = live.select("component", "best")
    fitted = segments.select("seg_id", F.col("copy").alias("_c"), F.col("avg").alias("_a"))
    rest = copies.select("seg_id", "copy", "avg").join(labels.select("seg_id"), "seg_id").join(fitted, "seg_id", "left")
    return rest.select("seg_id", F.coalesce("_c", "copy").cast("int").alias("copy"), F.coalesce("_a", "avg").alias("avg"))


def _by_links(graph: AssemblyGraph, labels: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The labels of components of over ``most`` links, and the other ones, as tables.

    A link has one arc or two, so arcs are counted by segment and mostly tell; links are
    told apart only where the number of arcs leaves it open.
    """
    by_segment = graph.arcs.groupBy(segment_of("v").alias("seg_id")).agg(F.count(F.lit(1)).alias("n"))
    arcs, _ = materialise(by_segment.join(labels, "seg_id").groupBy("component").agg(F.sum("n").alias("n")), "component-arcs")
    unsure, _ = materialise(labels.join(arcs.where((F.col("n") > most) & (F.col("n") <= 2 * most)).select("component"), "component", "left_semi").select("seg_id", "component"), "components-to-count")
    links = arcs_with_component(graph, unsure).groupBy("component").agg(F.countDistinct("link_id").alias("n"))
    over = arcs.where(F.col("n") > 2 * most).unionByName(links.where(F.col("n") > most)).select("component")
    over, _ = materialise(over, "components-over")
    large, _ = materialise(labels.join(over, "component", "left_semi").select(labels.columns), "large-components")
    small, _ = materialise(labels.join(over, "component", "left_anti").select(labels.columns), "small-components")
    return large, small


def adjust_copies(
    graph: AssemblyGraph, labels: DataFrame, copies: DataFrame, max_copy: int = 10, rounds: int = ROUNDS, full_search: int = FULL_SEARCH, links_in_task: int = LINKS_IN_TASK
) -> DataFrame:
    """``seg_id, copy, avg``: copies (seg_id, copy, avg) refitted to the layout.

    A segment's copy number changes where in- and outflow agree. Rounds end when the
    cost no longer falls or the average has settled (that round is not applied).
    Components of up to ``links_in_task`` links are gone through in a task each: in full,
    or above ``full_search`` assignments by annealing, seeded, so that repeated runs
    agree. Larger ones are fitted by moves over many tasks (``fit_by_moves``).
    """
    large, small = _by_links(graph, labels, links_in_task)
    bounds = lower_bound(graph.segments.join(small, "seg_id"))
    extra = copies.select("seg_id", "copy", "avg").join(small, "seg_id").join(bounds, "component").select("seg_id", "copy", "avg", "lb")
    fitted = per_component(graph, small, _kernel(max_copy, rounds, full_search), "seg_id long, copy int, avg double", extra)
    if large.isEmpty():
        return fitted
    return fitted.unionByName(fit_by_moves(graph, large, copies, max_copy, rounds))


def _joined_links(graph: AssemblyGraph) -> DataFrame:
    """``link_id, grp`` of the links that are in a group with others."""
    single = graph.arcs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.first("link_id").alias("link_id")).where("n = 1")
    behind = single.select(flip("v").alias("v"), F.col("link_id").alias("other"))
    pairs = single.where("v % 2 = 0").join(behind, "v").where("link_id <> other").select("link_id", "other")
    return connected_components(pairs, "link_id", "other").select(F.col("node").alias("link_id"), F.col("component").alias("grp"))


def link_groups(graph: AssemblyGraph, labels: DataFrame) -> DataFrame:
    """``component, link_id, grp``; a group is named by its least link.

    The two links of a segment that has one on either side are in one group; groups
    are the connected components of these pairs.
    """
    links = arcs_with_component(graph, labels).select("component", "link_id").distinct()
    return links.join(_joined_links(graph), "link_id", "left").select("component", "link_id", F.coalesce("grp", "link_id").alias("grp"))
