"""Graph operators over the users' journeys (graph J), where chains merge, tips drop and bubbles pop, with their SQL.

The SQL uses what is known of these graphs: forward arcs lead from column to column and
have no cycles, so sweeps and walks are recursions by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import coverage, flow, simplify, traversal
from skein.operators import graph as g
from skein.plans.derived import DUCK, SPARK, derived_graph, journeys, table
from skein.plans.scratch import materialise

TIP_SEGMENTS, TIP_BASES = 3, 250
RADIUS = 50_000


def journey_graph(spark: SparkSession, sf_dir: str) -> g.AssemblyGraph:
    raw = derived_graph(spark, sf_dir, "J")
    return g.AssemblyGraph(materialise(raw.segments, "segments")[0], g.with_link_ids(raw.arcs))


_HEAD = f"WITH RECURSIVE {journeys(DUCK)}"
_FLIP_W = DUCK.flip("w")
_CHAINS = f"""
, one AS (SELECT v FROM arc GROUP BY v HAVING count(*) = 1)
, m AS (SELECT v, w, ls FROM arc WHERE v <> w AND v IN (SELECT v FROM one) AND {_FLIP_W} IN (SELECT v FROM one))
, vertex AS (SELECT seg_id * 2 + k AS x FROM seg, (SELECT 0 AS k UNION ALL SELECT 1))
, r AS (SELECT x AS chain, x, 0 AS pos, 0 AS ls FROM vertex WHERE x NOT IN (SELECT w FROM m) UNION ALL SELECT chain, m.w, pos + 1, m.ls FROM r JOIN m ON r.x = m.v)
"""


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, members = simplify.unitigs(journey_graph(spark, sf_dir))
    return graph.segments.join(members, "seg_id").select("seg_id", "name", "len", "circ", F.size("members").alias("n"))


_UNITIGS = f"""{_HEAD}{_CHAINS}
, tig AS (SELECT chain, arg_max(x, pos) AS last, CAST(sum(len - ls) AS BIGINT) AS len, CAST(count(*) AS INTEGER) AS n FROM r JOIN seg ON seg_id = x // 2 GROUP BY chain)
, own AS (SELECT *, row_number() OVER (ORDER BY chain) - 1 AS seg_id FROM tig WHERE chain <= {DUCK.flip('last')})
SELECT seg_id, printf('utg%06d', seg_id + 1) AS name, len, false AS circ, n FROM own
"""


def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = journey_graph(spark, sf_dir)
    return flow.link_groups(graph, materialise(traversal.components(graph), "labels")[0]).select("link_id", "grp")


_LINK_GROUPS = f"""{_HEAD}
, pairs AS (SELECT *, least(v, {_FLIP_W}) AS v0, CASE WHEN v <= {_FLIP_W} THEN w ELSE {DUCK.flip('v')} END AS w0 FROM arc)
, named AS (SELECT v, w, dense_rank() OVER (ORDER BY v0, w0) - 1 AS link_id FROM pairs)
, single AS (SELECT v, min(link_id) AS link_id FROM named GROUP BY v HAVING count(*) = 1)
, pair AS (SELECT a.link_id AS a, b.link_id AS b FROM single a JOIN single b ON b.v = {DUCK.flip('a.v')})
, reach AS (SELECT a AS x, a AS y FROM pair UNION SELECT reach.x, pair.b FROM reach JOIN pair ON reach.y = pair.a)
, least_of AS (SELECT x, min(y) AS grp FROM reach GROUP BY x)
SELECT DISTINCT link_id, coalesce(grp, link_id) AS grp FROM named LEFT JOIN least_of ON x = link_id
"""


def drop_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplify.drop_tips(journey_graph(spark, sf_dir), TIP_SEGMENTS, TIP_BASES).segments.select("seg_id", "len")


_TIPS = f"""
, outs AS (SELECT v AS x, count(*) AS outs, max(ls) AS most FROM arc GROUP BY v)
, ins AS (SELECT w AS x, count(*) AS ins FROM arc GROUP BY w)
, step AS (SELECT r.*, seg.len, seg.cov, seg_id, coalesce(outs, 0) AS outs, seg.len - coalesce(most, 0) AS own FROM r JOIN seg ON seg_id = r.x // 2 LEFT JOIN outs ON outs.x = r.x)
, tip AS (
  SELECT chain, arg_max(step.x, pos) AS last, arg_max(outs, pos) AS last_outs, count(*) AS n, sum(own) - CASE WHEN arg_max(outs, pos) > 1 THEN arg_max(own, pos) ELSE 0 END AS bases
  FROM step GROUP BY chain HAVING chain NOT IN (SELECT x FROM ins) AND n <= {TIP_SEGMENTS} AND bases <= {TIP_BASES}
)
"""
_DROP_TIPS = f"""{_HEAD}{_CHAINS}{_TIPS}
SELECT seg_id, len FROM seg WHERE seg_id NOT IN (SELECT seg_id FROM step JOIN tip USING (chain) WHERE last_outs <= 1 OR step.x <> last)
"""


def drop_tips_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplify.drop_tips(journey_graph(spark, sf_dir), TIP_SEGMENTS, TIP_BASES, protect=True).segments.select("seg_id", "len")


# A tip's weight counts its last vertex in full; a branch runs from a vertex to the end of its chain.
_DROP_TIPS_PROTECTED = f"""{_HEAD}{_CHAINS}{_TIPS}
, inner_step AS (SELECT step.*, last, last_outs, bases FROM step JOIN tip USING (chain) WHERE last_outs <= 1 OR step.x <> last)
, weighed AS (
  SELECT chain, any_value(last) AS last, any_value(last_outs) AS last_outs, any_value(bases) AS bases,
         sum(CASE WHEN pos = (SELECT max(pos) FROM inner_step o WHERE o.chain = i.chain) THEN len ELSE own END * cov) AS weight
  FROM inner_step i GROUP BY chain
)
, place AS (SELECT t.chain, t.bases, t.weight, {DUCK.flip('CASE WHEN last_outs > 1 THEN last ELSE (SELECT min(w) FROM arc WHERE arc.v = t.last) END')} AS v FROM weighed t WHERE last_outs > 0)
, onward AS (
  SELECT s.x, sum(o.own) AS bases, sum(CASE WHEN o.pos = (SELECT max(pos) FROM step z WHERE z.chain = s.chain) THEN o.len ELSE o.own END * o.cov) AS weight
  FROM step s JOIN step o ON o.chain = s.chain AND o.pos >= s.pos GROUP BY s.x
)
, weak AS (
  SELECT DISTINCT p.chain FROM place p JOIN arc ON arc.v = p.v JOIN onward b ON b.x = arc.w
  WHERE NOT EXISTS (SELECT 1 FROM inner_step i WHERE i.chain = p.chain AND i.x = {DUCK.flip('arc.w')}) AND (p.bases <= b.bases OR 2 * p.weight <= b.weight)
)
SELECT seg_id, len FROM seg WHERE seg_id NOT IN (SELECT seg_id FROM inner_step WHERE last_outs = 0 OR chain IN (SELECT chain FROM weak))
"""

# What a sweep from a vertex enters in each round: the columns behind it and the errors on the way.
_LEVELS = """
, ahead AS (SELECT v // 2 AS a, w // 2 AS b, ls FROM arc WHERE v % 2 = 0)
, alone AS (SELECT min(id) AS id FROM col GROUP BY u, c HAVING count(*) = 1)
, source AS (SELECT id FROM alone UNION ALL SELECT id FROM ev WHERE t = 'error')
, lev AS (
  SELECT id AS src, id AS x, 0 AS k, CAST(0 AS BIGINT) AS dist, CAST(0 AS BIGINT) AS weight, CAST(NULL AS BIGINT) AS up FROM source
  UNION ALL
  SELECT src, b, k + 1, CAST(min(dist + len - ls) AS BIGINT), CAST(max(weight + (len - ls) * cov) AS BIGINT), arg_max(a, {'w': weight + (len - ls) * cov, 'd': dist + len - ls, 'a': -a})
  FROM lev JOIN ahead ON a = x JOIN seg ON seg_id = x GROUP BY src, b, k + 1
)
, round AS (
  SELECT src, k, count(*) FILTER (WHERE x IN (SELECT a FROM ahead)) AS going, max(x) FILTER (WHERE x IN (SELECT a FROM ahead)) AS one, max(x) AS top FROM lev WHERE k > 0 GROUP BY src, k
)
, met AS (SELECT src, min(k) AS k, CASE WHEN arg_min(going, k) = 1 THEN arg_min(one, k) ELSE arg_min(top, k) END AS sink FROM round WHERE going <= 1 GROUP BY src)
"""


def topological_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = journey_graph(spark, sf_dir)
    sources = graph.segments.select(F.shiftleft("seg_id", 1).alias("v"), F.lit(RADIUS).cast("long").alias("reach"))
    return simplify.sweeps(graph, sources, True)[0].select("src", "sink", "dist", "tips", "sinks", "cycle")


_EXTENT = f"""{_HEAD}{_LEVELS}
SELECT met.src * 2 AS src, met.sink * 2 AS sink, lev.dist,
       (SELECT count(*) FROM lev o WHERE o.src = met.src AND o.k BETWEEN 1 AND met.k AND o.x <> met.sink AND o.x NOT IN (SELECT a FROM ahead)) AS tips,
       CAST(1 AS BIGINT) AS sinks, CAST(0 AS INTEGER) AS cycle
FROM met JOIN lev ON lev.src = met.src AND lev.x = met.sink AND lev.k = met.k
"""


def pop_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplify.pop_bubbles(journey_graph(spark, sf_dir), RADIUS).arcs.select("v", "w", "cov")


# Forks settle along each journey; the next one stands at the last one's sink or behind it.
_POP_BUBBLES = f"""{_HEAD}{_LEVELS}
, fork AS (SELECT id, u FROM col JOIN alone USING (id) WHERE id IN (SELECT a FROM ahead GROUP BY a HAVING count(*) > 1))
, turn AS (
  SELECT u, min(id) AS id FROM fork GROUP BY u
  UNION ALL
  SELECT turn.u, min(fork.id) FROM turn JOIN met ON met.src = turn.id JOIN fork ON fork.u = turn.u AND fork.id >= met.sink WHERE met.sink IN (SELECT id FROM col) GROUP BY turn.u
)
, seen AS (SELECT lev.src, lev.x, lev.up, met.sink FROM lev JOIN met ON lev.src = met.src AND lev.k BETWEEN 1 AND met.k JOIN turn ON turn.id = met.src)
, kept AS (SELECT src, sink AS x FROM seen GROUP BY src, sink UNION SELECT seen.src, seen.up FROM kept JOIN seen ON seen.src = kept.src AND seen.x = kept.x WHERE seen.up <> seen.src)
, lost AS (SELECT x FROM seen WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.src = seen.src AND kept.x = seen.x))
SELECT v, w, cov FROM arc WHERE v // 2 NOT IN (SELECT x FROM lost) AND w // 2 NOT IN (SELECT x FROM lost)
"""

# Passes in order

_EVERY = 7


def _journey_copies(spark: SparkSession, sf_dir: str) -> tuple[g.AssemblyGraph, DataFrame, DataFrame]:
    graph = journey_graph(spark, sf_dir)
    copies = graph.segments.select("seg_id", F.when(F.col("seg_id") % _EVERY == 0, 1).otherwise(0).alias("copy"))
    return graph, materialise(traversal.components(graph), "labels")[0], copies


_COPIES = f"\n, copies0 AS (SELECT seg_id, CASE WHEN seg_id % {_EVERY} = 0 THEN 1 ELSE 0 END AS copy FROM seg)"


def spread_sql(turn: int, may: str) -> str:
    """CTEs from ``copies<turn>`` to the next: hops count by forward vertices first, then (v, w); ``may`` judges a hop's cov and its end's len."""
    hops = "" if turn else """
, hop AS (SELECT v // 2 AS a, w // 2 AS b, cov, row_number() OVER (ORDER BY v % 2, v, w) AS k FROM arc)
, hops AS (SELECT a, b, cov, k FROM hop UNION ALL SELECT b, a, cov, k FROM hop)"""
    return f"""{hops}
, open{turn} AS (SELECT h.a, h.b, h.k FROM hops h JOIN seg ON seg.seg_id = h.b JOIN copies{turn} c ON c.seg_id = h.b WHERE c.copy = 0 AND h.a <> h.b AND {may})
, arrive{turn} AS (
  SELECT h.b AS x, h.k FROM open{turn} h JOIN copies{turn} c ON c.seg_id = h.a WHERE c.copy > 0
  UNION SELECT h.b, h.k FROM arrive{turn} r JOIN open{turn} h ON h.a = r.x AND h.k > r.k
)
, copies{turn + 1} AS (SELECT seg_id, CASE WHEN seg_id IN (SELECT x FROM arrive{turn}) THEN 1 ELSE copy END AS copy FROM copies{turn})"""


RESCUE = spread_sql(0, "h.cov > 0") + "\nSELECT seg_id, CAST(copy AS INTEGER) AS copy FROM copies1"


def neighbours_sql(below: int) -> str:
    return spread_sql(0, f"seg.len < {below}") + spread_sql(1, f"seg.len < {below}") + "\nSELECT seg_id, CAST(copy AS INTEGER) AS copy FROM copies2"


def bubbles_sql(part: str) -> str:
    """Bubbles one by one within each ``part`` (of the left segment, l)."""
    return f"""
, ahead AS (SELECT DISTINCT v // 2 AS a, w // 2 AS b FROM arc WHERE v % 2 = 0)
, mid AS (
  SELECT p.a AS l, q.b AS r, p.b AS m FROM ahead p JOIN ahead q ON p.b = q.a JOIN seg x ON x.seg_id = p.a JOIN seg y ON y.seg_id = q.b
  WHERE x.cov > 0 AND y.cov > 0 AND p.a <> p.b AND q.a <> q.b AND p.a <> q.b
)
, bub AS (
  SELECT {part} AS part, l, r, list(m) AS ms, bool_or(copy > 0) AS used, row_number() OVER (PARTITION BY {part} ORDER BY l, r) AS k
  FROM mid JOIN copies0 ON seg_id = m GROUP BY l, r
)
, pick AS (
  SELECT part, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS up, CAST([] AS BIGINT[]) AS ms, true AS raised FROM (SELECT DISTINCT part FROM bub)
  UNION ALL
  SELECT b.part, b.k, CASE WHEN NOT b.used AND NOT list_has_any(pick.up, b.ms) THEN list_concat(pick.up, b.ms) ELSE pick.up END, b.ms, NOT b.used AND NOT list_has_any(pick.up, b.ms)
  FROM pick JOIN bub b ON b.part = pick.part AND b.k = pick.k + 1
)
, raised AS (SELECT DISTINCT unnest(ms) AS x FROM pick WHERE raised)
, gone AS (SELECT DISTINCT unnest(ms) AS x FROM pick WHERE NOT raised)
SELECT seg_id, CAST(CASE WHEN seg_id IN (SELECT x FROM raised) THEN 1 ELSE copy END AS INTEGER) AS copy, seg_id IN (SELECT x FROM gone) AS excluded FROM copies0
"""


def rescue_by_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.rescue_by_arcs(*_journey_copies(spark, sf_dir))


def add_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.add_neighbours(*_journey_copies(spark, sf_dir), steps=2, below=90)


def pick_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.pick_bubbles(*_journey_copies(spark, sf_dir))


# Cut points


_ENDS = "SELECT u, min(id) AS s, max(id) AS t FROM (SELECT id, u FROM col) WHERE u = (SELECT min(u) FROM col) GROUP BY u"


def cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places at which a search through the first user's journey can be split."""
    graph = journey_graph(spark, sf_dir)
    ends = table(spark, sf_dir, journeys(SPARK), _ENDS).first()
    labels, _ = materialise(traversal.components(graph), "labels")
    return traversal.cut_points(graph, labels, graph.segments.select("seg_id", F.lit(1).alias("copy")), 2 * ends["s"], 2 * ends["t"])


_CUT_POINTS = f"""{_HEAD}
, ends AS ({_ENDS})
, reach AS (SELECT s * 2 AS x FROM ends UNION SELECT w FROM reach JOIN arc ON v = x)
, without AS (SELECT r.x AS gone, s * 2 AS x FROM reach r, ends WHERE r.x <> s * 2 UNION SELECT gone, w FROM without JOIN arc ON v = x WHERE w <> gone)
, dom AS (SELECT d.x AS d, t.x AS t FROM reach d, reach t, ends WHERE d.x <> t.x AND (d.x = s * 2 OR NOT EXISTS (SELECT 1 FROM without o WHERE o.gone = d.x AND o.x = t.x)))
, depth AS (SELECT t AS x, count(*) AS n FROM dom GROUP BY t)
, one AS (SELECT v FROM arc GROUP BY v HAVING count(*) = 1)
SELECT CAST(coalesce(n, 0) AS BIGINT) AS place, v FROM (
  SELECT s * 2 AS v FROM ends UNION SELECT t * 2 FROM ends
  UNION SELECT d FROM dom, ends WHERE dom.t = ends.t * 2 AND d IN (SELECT v FROM one) AND {DUCK.flip('d')} IN (SELECT v FROM one)
) LEFT JOIN depth ON x = v
"""

QUERIES = {
    "unitigs_of_journeys": unitigs,
    "link_groups_of_journeys": link_groups,
    "drop_tips_of_journeys": drop_tips,
    "drop_protected_tips_of_journeys": drop_tips_protected,
    "topological_extent_of_journeys": topological_extent,
    "pop_bubbles_of_journeys": pop_bubbles,
    "rescue_by_arcs_of_journeys": rescue_by_arcs,
    "add_neighbours_of_journeys": add_neighbours,
    "pick_bubbles_of_journeys": pick_bubbles,
    "cut_points_of_journeys": cut_points,
}
ORACLE_SQL = {
    "unitigs_of_journeys": _UNITIGS,
    "link_groups_of_journeys": _LINK_GROUPS,
    "drop_tips_of_journeys": _DROP_TIPS,
    "drop_protected_tips_of_journeys": _DROP_TIPS_PROTECTED,
    "topological_extent_of_journeys": _EXTENT,
    "pop_bubbles_of_journeys": _POP_BUBBLES,
    "rescue_by_arcs_of_journeys": _HEAD + _COPIES + RESCUE,
    "add_neighbours_of_journeys": _HEAD + _COPIES + neighbours_sql(90),
    "pick_bubbles_of_journeys": _HEAD + _COPIES + bubbles_sql("(SELECT any_value(u) FROM ev WHERE id = l)"),
    "cut_points_of_journeys": _CUT_POINTS,
}
