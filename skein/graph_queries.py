"""The graph operators as registered queries over the derived graphs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import journey_queries
from skein.functions.ids import flip, segment_of
from skein.functions.sequences import overlap_length, overlap_query_length, reverse_complement
from skein.operators import coverage, flow, simplify, traversal, walks
from skein.operators import graph as g
from skein.plans.dense import dense_index
from skein.plans.derived import DUCK, GRAPHS, SPARK, derived_graph, table
from skein.plans.scratch import materialise
from skein.sources import sinks
from skein.sources.gfa import typed_tags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

FLIP_V, FLIP_W = DUCK.flip("v"), DUCK.flip("w")
COMP = f"(v > {FLIP_W} OR (v = {FLIP_W} AND w >= {FLIP_V}))"
SEGMENT_V, SEGMENT_W = "(v // 2)", "(w // 2)"


def query(name: str, kind: str | None = None, sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` follows the CTEs of the derived graph ``kind``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{GRAPHS[kind](DUCK)}" if kind else ""
            ORACLE_SQL[name] = head + sql
        return f

    return add


def _graph(spark: SparkSession, sf_dir: str, kind: str) -> g.AssemblyGraph:
    """A derived graph with link ids, written once: many operators read it more than once."""
    raw = derived_graph(spark, sf_dir, kind)
    return g.AssemblyGraph(materialise(raw.segments, "segments")[0], g.with_link_ids(raw.arcs))


def _links(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, GRAPHS[kind](SPARK), "SELECT v, w, CAST(0 AS BIGINT) AS ln, min(ls) AS ls, max(cov) AS cov FROM link GROUP BY v, w")


# Normalising and lookups

_FULL = f"""
, own AS (SELECT v, w, min(ls) AS ls, max(cov) AS cov FROM link GROUP BY v, w)
, other AS (SELECT {FLIP_W} AS v, {FLIP_V} AS w, ls AS ls2, cov AS cov2 FROM own)
SELECT v, w, least(coalesce(ls, ls2), coalesce(ls2, ls)) AS ls, coalesce(cov, cov2) AS cov, {COMP} AS comp
FROM own FULL JOIN other USING (v, w)
"""


@query("symmetrise", "P", _FULL)
def _symmetrise(spark, d):
    return g.symmetrise(_links(spark, d, "P")).select("v", "w", "ls", "cov", "comp")


@query("link_ids", "P", f"""
, pair AS (SELECT *, CASE WHEN {COMP} THEN {FLIP_W} ELSE v END AS v0, CASE WHEN {COMP} THEN {FLIP_V} ELSE w END AS w0 FROM arc)
SELECT v, w, dense_rank() OVER (ORDER BY v0, w0) - 1 AS link_id FROM pair
""")
def _link_ids(spark, d):
    return g.with_link_ids(derived_graph(spark, d, "P").arcs).select("v", "w", "link_id")


@query("max_link_id", "P", f"""
, pair AS (SELECT CASE WHEN {COMP} THEN {FLIP_W} ELSE v END AS v0, CASE WHEN {COMP} THEN {FLIP_V} ELSE w END AS w0 FROM arc)
SELECT count(*) - 1 AS link_id FROM (SELECT DISTINCT v0, w0 FROM pair)
""")
def _max_link_id(spark, d):
    return g.max_link_id(g.with_link_ids(derived_graph(spark, d, "P").arcs))


@query("first_arcs", "P", """
, low AS (SELECT v, w, ls, cov FROM arc), twice AS (SELECT * FROM low UNION ALL SELECT v, w, ls + 1, cov + 1 FROM low)
SELECT v, w, min(ls) AS ls, arg_min(cov, ls) AS cov FROM twice GROUP BY v, w
""")
def _first_arcs(spark, d):
    """Every arc stands twice, with a longer overlap behind it; the first of each pair is found."""
    arcs = derived_graph(spark, d, "P").arcs
    return g.first_arcs(arcs.unionByName(arcs.withColumn("ls", F.col("ls") + 1).withColumn("cov", F.col("cov") + 1))).select("v", "w", "ls", "cov")


@query("drop_sequences", "P", " SELECT v, w, CAST(0 AS BIGINT) AS ls, cov, a.n AS n, a.total AS total FROM arc, (SELECT count(*) AS n, CAST(0 AS BIGINT) AS total FROM seg) a")
def _drop_sequences(spark, d):
    bare = g.drop_sequences(derived_graph(spark, d, "P"))
    size = bare.segments.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"))
    return bare.arcs.select("v", "w", "ls", "cov").join(F.broadcast(size))


@query("degree", "P", " SELECT v, count(*) AS degree FROM arc GROUP BY v")
def _degree(spark, d):
    return g.degree(derived_graph(spark, d, "P").arcs)


@query("adjacency", "N", " SELECT v, string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) AS targets FROM arc GROUP BY v")
def _adjacency(spark, d):
    return g.adjacency(derived_graph(spark, d, "N").arcs).select("v", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query("first_out_arc", "P", " SELECT v, w, ls, cov FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY w) AS t FROM arc) WHERE t = 1")
def _first_out_arc(spark, d):
    return g.first_out_arc(derived_graph(spark, d, "P").arcs).select("v", "w", "ls", "cov")


@query("complement_pairs", "P", f" SELECT v, w, {FLIP_W} AS comp_v, {FLIP_V} AS comp_w FROM arc")
def _complement_pairs(spark, d):
    return g.complement_pairs(derived_graph(spark, d, "P").arcs)


@query("arc_ids", "E", f"""
, pair AS (SELECT *, {COMP} AS comp, CASE WHEN {COMP} THEN {FLIP_W} ELSE v END AS v0, CASE WHEN {COMP} THEN {FLIP_V} ELSE w END AS w0 FROM arc)
, named AS (SELECT *, (dense_rank() OVER (ORDER BY v0, w0) - 1) * 2 + CAST(comp AS INTEGER) AS arc_id FROM pair)
SELECT v, w, arc_id, CASE WHEN {FLIP_V} = w THEN arc_id ELSE xor(arc_id, 1) END AS comp_arc_id FROM named
""")
def _arc_ids(spark, d):
    return g.arc_ids(g.with_link_ids(derived_graph(spark, d, "E").arcs)).select("v", "w", "arc_id", "comp_arc_id")


@query("arcs_exist", "N", f" SELECT s.v, s.w FROM (SELECT v, w FROM link UNION SELECT {FLIP_V}, w FROM link) s WHERE EXISTS (SELECT 1 FROM arc WHERE arc.v = s.v AND arc.w = s.w)")
def _arcs_exist(spark, d):
    links = _links(spark, d, "N").select("v", "w")
    return g.arcs_that_exist(links.unionByName(links.withColumn("v", flip("v"))).distinct(), derived_graph(spark, d, "N").arcs)


@query("stats", "P", f"""
SELECT (SELECT count(*) FROM seg) AS n_seg, (SELECT CAST(sum(len) AS BIGINT) FROM seg) AS total_len, (SELECT avg(len) FROM seg) AS avg_len,
       (SELECT count(*) FROM arc) AS n_arc, (SELECT count(*) FROM arc WHERE NOT {COMP}) AS n_link,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM arc GROUP BY v)) AS max_degree,
       (SELECT count(*) FROM arc) / CAST((SELECT count(*) FROM seg) AS DOUBLE) / 2 AS avg_degree
""")
def _stats(spark, d):
    return g.stats(derived_graph(spark, d, "P"))


# Changes


def _after(where_segments: str, where_arcs: str) -> str:
    """Arcs of live segments that pass, made symmetric again with the coverage that is left."""
    return f"""
, live AS (SELECT seg_id FROM seg WHERE {where_segments})
, own AS (SELECT v, w, ls, cov FROM arc WHERE {SEGMENT_V} IN (SELECT seg_id FROM live) AND {SEGMENT_W} IN (SELECT seg_id FROM live) AND {where_arcs})
, other AS (SELECT {FLIP_W} AS v, {FLIP_V} AS w, ls AS ls2, cov AS cov2 FROM own)
SELECT v, w, coalesce(ls, ls2) AS ls, coalesce(cov, cov2) AS cov FROM own FULL JOIN other USING (v, w)
"""


@query("clean", "P", _after("cov >= 25", "cov >= 2"))
def _clean(spark, d):
    return g.clean(derived_graph(spark, d, "P"), 2, 24.5).arcs.select("v", "w", "ls", "cov")


@query("delete_segments", "P", f" SELECT v, w, cov FROM arc WHERE {SEGMENT_V} NOT IN (SELECT seg_id FROM seg WHERE len < 1010) AND {SEGMENT_W} NOT IN (SELECT seg_id FROM seg WHERE len < 1010)")
def _delete_segments(spark, d):
    graph = derived_graph(spark, d, "P")
    return g.delete_segments(graph, graph.segments.where("len < 1010")).arcs.select("v", "w", "cov")


@query("delete_arcs_of", "N", f" SELECT v, w, cov FROM arc WHERE v NOT IN (SELECT v FROM arc GROUP BY v HAVING count(*) > 2) AND {FLIP_W} NOT IN (SELECT v FROM arc GROUP BY v HAVING count(*) > 2)")
def _delete_arcs_of(spark, d):
    graph = derived_graph(spark, d, "N")
    return g.delete_arcs_of(graph, g.degree(graph.arcs).where("degree > 2")).arcs.select("v", "w", "cov")


@query("delete_arcs", "N", f" SELECT v, w, cov FROM arc WHERE {SEGMENT_V} < {SEGMENT_W}")
def _delete_arcs(spark, d):
    graph = derived_graph(spark, d, "N")
    return g.delete_arcs(graph, graph.arcs.where(segment_of("v") >= segment_of("w"))).arcs.select("v", "w", "cov")


@query("add_arcs", "N", f"""
, more AS (SELECT seg_id * 2 AS v, seg_id * 2 + 1 AS w, CAST(1 AS BIGINT) AS ls, CAST(1 AS BIGINT) AS cov FROM seg)
SELECT v, w, ls, cov FROM arc UNION ALL SELECT v, w, ls, cov FROM more
""")
def _add_arcs(spark, d):
    graph = derived_graph(spark, d, "N")
    long = lambda x: F.lit(x).cast("long")
    new = graph.segments.select(F.shiftleft("seg_id", 1).alias("v"), (F.shiftleft("seg_id", 1) + 1).alias("w"), long(0).alias("ln"), long(1).alias("ls"), long(1).alias("cov"))
    return g.add_arcs(graph, new).arcs.select("v", "w", "ls", "cov")


@query("add_segments", "N", " SELECT seg_id, name, len FROM seg UNION ALL SELECT (SELECT max(seg_id) FROM seg) + row_number() OVER (ORDER BY name), 'new ' || name, len FROM seg")
def _add_segments(spark, d):
    graph = derived_graph(spark, d, "N")
    return g.add_segments(graph, graph.segments.withColumn("name", F.concat(F.lit("new "), "name"))).segments.select("seg_id", "name", "len")


@query("compact", "P", f"""
, live AS (SELECT seg_id, row_number() OVER (ORDER BY seg_id) - 1 AS n FROM seg WHERE len >= 1010)
SELECT a.n * 2 + v % 2 AS v, b.n * 2 + w % 2 AS w, cov FROM arc JOIN live a ON {SEGMENT_V} = a.seg_id JOIN live b ON {SEGMENT_W} = b.seg_id
""")
def _compact(spark, d):
    graph = derived_graph(spark, d, "P")
    return g.compact(g.delete_segments(graph, graph.segments.where("len < 1010"))).arcs.select("v", "w", "cov")


@query("cap_arc_cov", "N", f" SELECT v, w, least(arc.cov, a.cov, b.cov) AS cov FROM arc JOIN seg a ON {SEGMENT_V} = a.seg_id JOIN seg b ON {SEGMENT_W} = b.seg_id")
def _cap_arc_cov(spark, d):
    return g.cap_arc_cov(derived_graph(spark, d, "N")).arcs.select("v", "w", "cov")


# Components and reachability

_STRONG = f"""
, strong AS (SELECT v // 2 AS a, w // 2 AS b FROM arc WHERE cov >= 2)
, reach AS (SELECT seg_id AS a, seg_id AS b FROM seg UNION SELECT reach.a, strong.b FROM reach JOIN strong ON reach.b = strong.a)
, label AS (SELECT a AS seg_id, min(b) AS component FROM reach GROUP BY a)
"""

# Labels spread by a hop a round; 60 rounds are far more than the widest of these graphs needs.
_ALL_LABELS = """
, beside AS (SELECT v // 2 AS a, w // 2 AS b FROM arc UNION SELECT seg_id, seg_id FROM seg)
, lab AS (SELECT seg_id, seg_id AS component, 0 AS k FROM seg UNION ALL SELECT b.a, min(component), k + 1 FROM lab JOIN beside b ON b.b = seg_id WHERE k < 60 GROUP BY b.a, k + 1)
, label AS (SELECT seg_id, component FROM lab WHERE k = 60)
"""


def _parts(spark, d) -> tuple[g.AssemblyGraph, DataFrame]:
    graph = _graph(spark, d, "P")
    return graph, materialise(traversal.components(graph), "labels")[0]


def _strong_parts(spark, d) -> tuple[g.AssemblyGraph, DataFrame]:
    """For queries whose SQL is about arcs of coverage 2 or more; each has one on all arcs beside it."""
    graph = _graph(spark, d, "P")
    graph = graph.with_arcs(graph.arcs.where("cov >= 2"))
    return graph, materialise(traversal.components(graph), "labels")[0]


@query("components", "P", _STRONG + " SELECT * FROM label", recursive=True)
def _components(spark, d):
    return _strong_parts(spark, d)[1]


@query("component_of_the_first", "P", _ALL_LABELS + " SELECT seg_id FROM label WHERE component = (SELECT component FROM label ORDER BY seg_id LIMIT 1)", recursive=True)
def _component_of(spark, d):
    labels = _parts(spark, d)[1]
    return traversal.component_of(labels, 2 * labels.agg(F.min("seg_id").alias("s")).first()["s"])


@query("components_all_arcs", "P", _ALL_LABELS + " SELECT seg_id, component FROM label", recursive=True)
def _components_all(spark, d):
    return _parts(spark, d)[1]


@query("subgraph_steps", "N", f"""
, link2 AS (SELECT v // 2 AS a, w // 2 AS b FROM arc)
, r AS (SELECT CAST(0 AS BIGINT) AS seg_id, 0 AS hops UNION SELECT b, hops + 1 FROM r JOIN link2 ON a = seg_id WHERE hops < 2)
SELECT seg_id, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY seg_id
""", recursive=True)
def _subgraph_steps(spark, d):
    graph = derived_graph(spark, d, "N")
    return traversal.subgraph(graph, graph.segments.where("seg_id = 0"), steps=2).select("seg_id", "hops")


@query("path_exists", "N", """
, goal AS (SELECT w AS sink FROM arc ORDER BY w DESC LIMIT 1), start AS (SELECT v AS source FROM arc ORDER BY v LIMIT 1)
, r AS (SELECT w AS x, 1 AS hops FROM arc, start WHERE v = source UNION SELECT w, hops + 1 FROM r JOIN arc ON v = x WHERE hops < 60)
SELECT CAST(min(hops) AS BIGINT) AS hops FROM r, goal WHERE x = sink HAVING count(*) > 0
""", recursive=True)
def _path_exists(spark, d):
    graph = _graph(spark, d, "N")
    ends = graph.arcs.agg(F.min("v").alias("v"), F.max("w").alias("w")).first()
    return traversal.path_exists(graph, ends["v"], ends["w"]).select("hops")


@query("strong_components", "N", """
, vertex AS (SELECT seg_id * 2 + k AS x FROM seg, (SELECT 0 AS k UNION ALL SELECT 1))
, r AS (SELECT x AS a, x AS b FROM vertex UNION SELECT r.a, w FROM r JOIN arc ON r.b = v)
SELECT p.a AS v, min(p.b) AS least FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a
""", recursive=True)
def _strong_components(spark, d):
    graph = _graph(spark, d, "N")
    found, _ = materialise(traversal.strong_components(graph, traversal.components(graph)), "scc")
    least = found.groupBy("component", "scc").agg(F.min("v").alias("least"))
    return found.join(least, ["component", "scc"]).select("v", "least")


@query("dominators", "N", """
, root AS (SELECT v AS s FROM arc GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
, vertex AS (SELECT seg_id * 2 + k AS x FROM seg, (SELECT 0 AS k UNION ALL SELECT 1))
, reach AS (SELECT s AS x FROM root UNION SELECT w FROM reach JOIN arc ON v = x)
, without AS (SELECT vertex.x AS gone, s AS x FROM vertex, root WHERE vertex.x <> s UNION SELECT gone, w FROM without JOIN arc ON v = x WHERE w <> gone)
, dom AS (SELECT vertex.x AS d, reach.x AS t FROM vertex, reach WHERE vertex.x <> reach.x AND (vertex.x = (SELECT s FROM root) OR NOT EXISTS (SELECT 1 FROM without o WHERE o.gone = vertex.x AND o.x = reach.x)) AND vertex.x IN (SELECT x FROM reach))
, depth AS (SELECT t, count(*) AS n FROM dom GROUP BY t)
SELECT vertex.x AS v, (SELECT d FROM dom WHERE t = vertex.x ORDER BY coalesce((SELECT n FROM depth WHERE depth.t = dom.d), 0) DESC LIMIT 1) AS idom FROM vertex
""", recursive=True)
def _dominators(spark, d):
    graph = _graph(spark, d, "N")
    root = g.degree(graph.arcs).orderBy(F.col("degree").desc(), "v").first()["v"]
    labels, _ = materialise(traversal.components(graph), "labels")
    vertices = graph.segments.select(F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("v"))
    return vertices.join(traversal.dominators(graph, labels, root), "v", "left")


# Coverage

_ESTIMATE = """
, own AS (SELECT seg.*, component FROM seg JOIN label USING (seg_id))
, total AS (SELECT component, sum(len) AS bases, sum(len * cov) AS mass, floor(sum(len) * 0.3) AS lim FROM own GROUP BY component)
, hist AS (SELECT component, cov, sum(len) AS bases FROM own GROUP BY component, cov)
, run AS (SELECT *, coalesce(sum(bases) OVER (PARTITION BY component ORDER BY cov ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hist)
, low AS (SELECT component, coalesce(CAST(sum(run.cov * greatest(0, least(run.bases, lim - before))) AS DOUBLE) / nullif(any_value(lim), 0) * 0.7, 0) AS lb FROM run JOIN total USING (component) GROUP BY component)
, near AS (SELECT h.component, h.cov, abs(CAST(t.mass AS DOUBLE) / h.cov / t.bases - 1.0) AS away FROM hist h JOIN total t USING (component) WHERE h.cov > 0 AND t.bases > 0)
, rough AS (SELECT component, CAST(cov AS DOUBLE) AS rough FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY away, cov) AS turn FROM near) WHERE turn = 1)
"""
_MASS, _ALL_MASS = _STRONG + _ESTIMATE, _ALL_LABELS + _ESTIMATE
_AVERAGES = " SELECT t.component, coalesce(rough, 0) AS rough, lb, greatest(coalesce(rough, 0), lb, 0) AS avg FROM total t LEFT JOIN rough USING (component) JOIN low USING (component)"
_COPY = "CAST(least(greatest(coalesce(round(own.cov / nullif(greatest(coalesce(rough, 0), lb), 0)), {0}), {0}), 10) AS INTEGER) AS copy FROM own LEFT JOIN rough USING (component) JOIN low USING (component)"
_WEIGHTS = " SELECT component, CAST(sum(len * (1 + cov % 3)) AS BIGINT) AS bases, CAST(sum(len * cov) AS BIGINT) AS mass FROM seg JOIN label USING (seg_id) GROUP BY component"


@query("average_coverage", "P", _MASS + _AVERAGES, recursive=True)
def _average_coverage(spark, d):
    graph, labels = _strong_parts(spark, d)
    return coverage.average_coverage(graph.segments.join(labels, "seg_id"))


@query("average_coverage_all_arcs", "P", _ALL_MASS + _AVERAGES, recursive=True)
def _average_coverage_all(spark, d):
    graph, labels = _parts(spark, d)
    return coverage.average_coverage(graph.segments.join(labels, "seg_id"))


@query("copy_numbers", "P", _MASS + " SELECT seg_id, own.component, " + _COPY.format(1), recursive=True)
def _copy_numbers(spark, d):
    graph, labels = _strong_parts(spark, d)
    return coverage.copy_numbers(graph.segments.join(labels, "seg_id")).select("seg_id", "component", "copy")


@query("copy_numbers_all_arcs", "P", _ALL_MASS + " SELECT seg_id, own.component, " + _COPY.format(1), recursive=True)
def _copy_numbers_all(spark, d):
    graph, labels = _parts(spark, d)
    return coverage.copy_numbers(graph.segments.join(labels, "seg_id")).select("seg_id", "component", "copy")


@query("total_weights", "P", _STRONG + _WEIGHTS, recursive=True)
def _total_weights(spark, d):
    graph, labels = _strong_parts(spark, d)
    return coverage.total_weights(graph.segments.join(labels, "seg_id"), graph.segments.select("seg_id", (1 + F.col("cov") % 3).alias("copy")))


@query("total_weights_all_arcs", "P", _ALL_LABELS + _WEIGHTS, recursive=True)
def _total_weights_all(spark, d):
    graph, labels = _parts(spark, d)
    return coverage.total_weights(graph.segments.join(labels, "seg_id"), graph.segments.select("seg_id", (1 + F.col("cov") % 3).alias("copy")))


def _nation_copies(spark, d):
    graph = _graph(spark, d, "N")
    labels, _ = materialise(traversal.components(graph), "labels")
    copies, _ = materialise(coverage.copy_numbers(graph.segments.join(labels, "seg_id"), min_copy=0), "copies")
    return graph, labels, copies


_NATION_COPIES = _ALL_MASS + ", copies0 AS (SELECT seg_id, " + _COPY.format(0) + ")"


@query("rescue_by_arcs", "N", _NATION_COPIES + journey_queries.RESCUE, recursive=True)
def _rescue(spark, d):
    return coverage.rescue_by_arcs(*_nation_copies(spark, d))


@query("pick_bubbles", "N", _NATION_COPIES + journey_queries.bubbles_sql("0"), recursive=True)
def _bubbles(spark, d):
    return coverage.pick_bubbles(*_nation_copies(spark, d))


@query("add_neighbours", "N", _NATION_COPIES + journey_queries.neighbours_sql(1500), recursive=True)
def _neighbours(spark, d):
    return coverage.add_neighbours(*_nation_copies(spark, d), steps=2, below=1500)


_FRACTION = 0.9


@query("clean_by_coverage", "P", _ALL_MASS + f"""
, tried AS (
  SELECT c.component, c.cov AS c, sum(CASE WHEN h.cov / c.cov >= {_FRACTION} THEN h.bases ELSE 0 END) AS b, sum(CASE WHEN h.cov / c.cov >= {_FRACTION} THEN h.bases * h.cov ELSE 0 END) AS m, sum(h.bases) AS a
  FROM hist c JOIN hist h USING (component) WHERE c.cov > 0 GROUP BY 1, 2
)
, allowed AS (SELECT * FROM (SELECT *, max(CASE WHEN (a - b) / a > 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY component ORDER BY c) AS stop FROM tried) WHERE stop = 0 AND b > 0)
, found AS (SELECT component, CAST(c AS DOUBLE) AS c FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(CAST(m AS DOUBLE) / c / b - 1.0), c) AS turn FROM allowed) WHERE turn = 1)
, weak AS (SELECT seg_id FROM own JOIN low USING (component) LEFT JOIN found USING (component) WHERE own.cov / nullif(greatest(coalesce(found.c, 0), lb), 0) < {_FRACTION})
SELECT v, w, cov FROM arc WHERE v // 2 NOT IN (SELECT seg_id FROM weak) AND w // 2 NOT IN (SELECT seg_id FROM weak)
""", recursive=True)
def _clean_by_coverage(spark, d):
    graph, labels = _parts(spark, d)
    return coverage.clean_by_coverage(graph, labels, _FRACTION).arcs.select("v", "w", "cov")


# Flow


@query("link_groups", "P", f"""
, named AS (SELECT v, w, dense_rank() OVER (ORDER BY CASE WHEN {COMP} THEN {FLIP_W} ELSE v END, CASE WHEN {COMP} THEN {FLIP_V} ELSE w END) - 1 AS link_id FROM arc)
, single AS (SELECT v, min(link_id) AS link_id FROM named GROUP BY v HAVING count(*) = 1)
, pair AS (SELECT a.link_id AS a, b.link_id AS b FROM single a JOIN single b ON b.v = {DUCK.flip('a.v')})
, r AS (SELECT a AS x, a AS y FROM pair UNION SELECT r.x, pair.b FROM r JOIN pair ON r.y = pair.a)
, least AS (SELECT x, min(y) AS grp FROM r GROUP BY x)
SELECT DISTINCT link_id, coalesce(grp, link_id) AS grp FROM named LEFT JOIN least ON x = link_id
""", recursive=True)
def _link_groups(spark, d):
    graph, labels = _parts(spark, d)
    return flow.link_groups(graph, labels).select("link_id", "grp")


@query("adjust_copies")
def _adjust(spark, d):
    graph, labels = _parts(spark, d)
    copies = coverage.copy_numbers(graph.segments.join(labels, "seg_id"))
    return flow.adjust_copies(graph, labels, materialise(copies, "copies")[0])


# Simplification


_WEAK = f"""
, top AS (SELECT v, max(cov) AS m FROM arc WHERE cov >= 2 GROUP BY v)
, weak AS (SELECT v, w FROM arc JOIN top a USING (v) JOIN top b ON b.v = {DUCK.flip('arc.w')} WHERE NOT (arc.v > {DUCK.flip('arc.w')} OR (arc.v = {DUCK.flip('arc.w')} AND arc.w >= {DUCK.flip('arc.v')})) AND CAST(cov AS DOUBLE) / a.m < 0.7 AND CAST(cov AS DOUBLE) / b.m < 0.7)
"""


@query("weak_crosslinks", "P", f"""{_WEAK}SELECT v, w FROM weak UNION SELECT {FLIP_W}, {FLIP_V} FROM weak
""")
def _weak_crosslinks(spark, d):
    return simplify.weak_crosslinks(derived_graph(spark, d, "P").arcs, 0.7, 2)


@query("remove_weak_crosslinks", "P", f"""{_WEAK}
, gone AS (SELECT v, w FROM weak UNION SELECT {FLIP_W}, {FLIP_V} FROM weak)
SELECT v, w, ls, cov FROM arc WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.v = arc.v AND gone.w = arc.w)
""")
def _remove_weak(spark, d):
    return simplify.remove_weak_crosslinks(derived_graph(spark, d, "P"), 0.7, 2).arcs.select("v", "w", "ls", "cov")


@query("mergeable_arcs", "P", f"""
, firm AS (SELECT v, w, ls FROM arc WHERE cov >= 2), one AS (SELECT v FROM firm GROUP BY v HAVING count(*) = 1)
SELECT v, w, ls FROM firm WHERE v IN (SELECT v FROM one) AND {FLIP_W} IN (SELECT v FROM one)
""")
def _mergeable(spark, d):
    return simplify.mergeable_arcs(_strong_parts(spark, d)[0].arcs)


@query("mergeable_arcs_all_arcs", "P", f"""
, one AS (SELECT v FROM arc GROUP BY v HAVING count(*) = 1)
SELECT v, w, ls FROM arc WHERE v IN (SELECT v FROM one) AND {FLIP_W} IN (SELECT v FROM one)
""")
def _mergeable_all(spark, d):
    return simplify.mergeable_arcs(_graph(spark, d, "P").arcs)


@query("unitigs", "P", f"""
, one AS (SELECT v FROM arc GROUP BY v HAVING count(*) = 1)
, m AS (SELECT v, w, ls FROM arc WHERE v <> w AND v IN (SELECT v FROM one) AND {FLIP_W} IN (SELECT v FROM one))
, vertex AS (SELECT seg_id * 2 + k AS x FROM seg, (SELECT 0 AS k UNION ALL SELECT 1))
, r AS (SELECT x AS chain, x, 0 AS pos, 0 AS ls FROM vertex WHERE x NOT IN (SELECT w FROM m) UNION ALL SELECT chain, m.w, pos + 1, m.ls FROM r JOIN m ON r.x = m.v)
, tig AS (SELECT chain, arg_max(x, pos) AS last, CAST(sum(len - ls) AS BIGINT) AS len, CAST(count(*) AS INTEGER) AS n FROM r JOIN seg ON seg_id = x // 2 GROUP BY chain)
, own AS (SELECT *, row_number() OVER (ORDER BY chain) - 1 AS seg_id FROM tig WHERE chain <= {DUCK.flip('last')})
SELECT seg_id, printf('utg%06d', seg_id + 1) AS name, len, chain = last AND EXISTS (SELECT 1 FROM arc WHERE v = chain AND w = chain) AS circ, n FROM own
""", recursive=True)
def _unitigs(spark, d):
    graph, members = simplify.unitigs(_parts(spark, d)[0])
    return graph.segments.join(members, "seg_id").select("seg_id", "name", "len", "circ", F.size("members").alias("n"))


@query("drop_tips")
def _drop_tips(spark, d):
    return simplify.drop_tips(_graph(spark, d, "P"), 3, 4000).segments.select("seg_id", "len")


@query("pop_bubbles")
def _pop_bubbles(spark, d):
    return simplify.pop_bubbles(_graph(spark, d, "N"), 5000).arcs.select("v", "w", "cov")


@query("topological_extent")
def _topological_extent(spark, d):
    """The sweeps from both ends of every part, over arcs of coverage 2 or more."""
    graph = _strong_parts(spark, d)[0]
    both = graph.segments.select(F.explode(F.array(F.shiftleft("seg_id", 1), F.shiftleft("seg_id", 1) + 1)).alias("v"), F.lit(20_000).cast("long").alias("reach"))
    return simplify.sweeps(graph, both, True)[0].select("src", "sink", "dist", "tips", "sinks", "cycle")


@query("duplicate_by_copies", "N", f"""
, n AS (SELECT seg_id, CAST(1 + seg_id % 2 AS BIGINT) AS n FROM seg)
SELECT 'seg' AS kind, CASE WHEN n > 1 THEN name || '_copy' || CAST(i AS VARCHAR) ELSE name END AS a, CAST(NULL AS VARCHAR) AS b, cov FROM seg JOIN n USING (seg_id), (SELECT 0 AS i UNION ALL SELECT 1) k WHERE i < n
UNION ALL
SELECT 'arc', CASE WHEN a.n > 1 THEN x.name || '_copy' || CAST(i.i AS VARCHAR) ELSE x.name END || CASE WHEN v % 2 = 1 THEN '-' ELSE '+' END,
       CASE WHEN b.n > 1 THEN y.name || '_copy' || CAST(j.i AS VARCHAR) ELSE y.name END || CASE WHEN w % 2 = 1 THEN '-' ELSE '+' END,
       arc.cov // a.n // b.n
FROM arc JOIN n a ON {SEGMENT_V} = a.seg_id JOIN n b ON {SEGMENT_W} = b.seg_id JOIN seg x ON x.seg_id = a.seg_id JOIN seg y ON y.seg_id = b.seg_id,
     (SELECT 0 AS i UNION ALL SELECT 1) i, (SELECT 0 AS i UNION ALL SELECT 1) j WHERE i.i < a.n AND j.i < b.n
""")
def _duplicate(spark, d):
    graph = _graph(spark, d, "N")
    new, _ = simplify.duplicate_by_copies(graph, graph.segments.select("seg_id", (1 + F.col("seg_id") % 2).cast("int").alias("copy")))
    segments, _ = materialise(new.segments, "clones")
    text = lambda c: F.col(c).cast("string")
    own = segments.select(F.lit("seg").alias("kind"), text("name").alias("a"), F.lit(None).cast("string").alias("b"), "cov")
    arcs = sinks._named(new.arcs, segments)
    return own.unionByName(arcs.select(F.lit("arc").alias("kind"), F.concat("v_name", F.when(F.col("v") % 2 == 1, "-").otherwise("+")).alias("a"), F.concat("w_name", F.when(F.col("w") % 2 == 1, "-").otherwise("+")).alias("b"), "cov"))


# Walks

_WALKS = f"""
, root AS (SELECT v AS s FROM arc GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
, w AS (SELECT [s] AS path FROM root UNION ALL SELECT list_append(path, arc.w) FROM w JOIN arc ON arc.v = path[-1] WHERE NOT list_contains(path, arc.w) AND NOT list_contains(path, {DUCK.flip('arc.w')}))
, full_walk AS (SELECT path FROM w WHERE NOT EXISTS (SELECT 1 FROM arc WHERE arc.v = path[-1] AND NOT list_contains(path, arc.w) AND NOT list_contains(path, {DUCK.flip('arc.w')})))
, named AS (SELECT path, list_aggregate(list_transform(path, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS name FROM full_walk)
, step AS (SELECT name, path, unnest(path) AS x, generate_subscripts(path, 1) AS pos FROM named)
, hop AS (SELECT step.*, CASE WHEN pos = 1 THEN path[-1] ELSE path[pos - 1] END AS y FROM step)
, gain AS (SELECT hop.name, pos, seg.len - coalesce(arc.ls, 0) AS gain, seg.cov AS c, arc.cov AS ac FROM hop JOIN seg ON seg.seg_id = x // 2 LEFT JOIN arc ON arc.v = y AND arc.w = x)
, measured AS (SELECT name, CAST(count(*) AS INTEGER) AS nv, max(CASE WHEN pos = 1 THEN ac IS NOT NULL END) AS circ, CAST(sum(gain) AS BIGINT) AS len, CAST(sum(gain * c) AS DOUBLE) AS wlen, CAST(sum(coalesce(ac, 0)) AS BIGINT) AS ec FROM gain GROUP BY name)
"""


def _nation_walks(spark, d) -> tuple[g.AssemblyGraph, DataFrame]:
    graph = _graph(spark, d, "N")
    start = g.degree(graph.arcs).orderBy(F.col("degree").desc(), "v").limit(1).select("v")
    copies = graph.segments.select("seg_id", F.lit(1).alias("copy"))
    found, _ = materialise(walks.enumerate_walks(graph.arcs, copies, start), "found")
    return graph, walks.measure(found.withColumn("component", F.lit(0)), graph, ["component", "path"])


def _name():
    return F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("name")


@query("walks", "N", _WALKS + " SELECT * FROM measured", recursive=True)
def _walks(spark, d):
    return _nation_walks(spark, d)[1].select(_name(), "nv", "circ", "len", "wlen", "ec")


@query("rank_paths", "N", _WALKS + """
, top AS (SELECT max(CASE WHEN circ THEN wlen END) AS c, max(CASE WHEN NOT circ THEN wlen END) AS l FROM measured)
SELECT name, wlen, CASE WHEN circ THEN wlen >= c ELSE wlen >= l AND l > coalesce(c, -1) END AS best FROM measured, top
""", recursive=True)
def _rank_paths(spark, d):
    return traversal.rank_paths(_nation_walks(spark, d)[1]).select(_name(), "wlen", "best")


@query("choose_path", "N", _WALKS + """
, top AS (SELECT max(CASE WHEN circ THEN wlen END) AS c, max(CASE WHEN NOT circ THEN wlen END) AS l FROM measured)
SELECT circ, len, wlen, ec, nv FROM measured, top WHERE circ = (c IS NOT NULL AND (l IS NULL OR c >= l)) ORDER BY wlen DESC, len DESC, ec DESC, nv DESC LIMIT 1
""", recursive=True)
def _choose_path(spark, d):
    return walks.choose_path(_nation_walks(spark, d)[1], turn="path").select("circ", "len", "wlen", "ec", "nv")


@query("clip_to_target", "N", _WALKS + """
, goal AS (SELECT max(x) AS t FROM step)
, cut AS (SELECT path[1:list_position(path, t)] AS path FROM full_walk, goal WHERE list_contains(path, t))
SELECT list_aggregate(list_transform(path, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS name, count(*) AS n FROM cut GROUP BY 1
""", recursive=True)
def _clip(spark, d):
    found = _nation_walks(spark, d)[1].select("path")
    goal = found.agg(F.max(F.array_max("path")).alias("t")).first()["t"]
    return walks.clip_to_target(found, goal).groupBy(_name()).agg(F.count(F.lit(1)).alias("n"))


@query("covered_share", "N", _WALKS + """
SELECT walk AS sid, CAST(sum(len) AS DOUBLE) / (SELECT sum(len) FROM seg) AS share FROM (SELECT DISTINCT name AS walk, x // 2 AS seg_id FROM step) JOIN seg USING (seg_id) GROUP BY walk
""", recursive=True)
def _covered(spark, d):
    graph, found = _nation_walks(spark, d)
    return walks.covered_share(found.select(_name().alias("sid"), "path"), graph.segments)


@query("flip_walks", "N", _WALKS + f" SELECT list_aggregate(list_transform(list_reverse(path), lambda x: CAST({DUCK.flip('x')} AS VARCHAR)), 'string_agg', ',') AS name FROM full_walk", recursive=True)
def _flip(spark, d):
    return walks.flip_walks(_nation_walks(spark, d)[1].select("path")).select(_name())


@query("copy_report", "N", _WALKS + """
, used AS (SELECT x // 2 AS seg_id, count(*) AS n FROM step GROUP BY 1)
SELECT seg_id, name, len, cov, CAST(1 AS BIGINT) AS copy_estd, coalesce(n, 0) AS copy_incl, coalesce(n, 0) - 1 AS copy_diff FROM seg LEFT JOIN used USING (seg_id)
""", recursive=True)
def _copy_report(spark, d):
    graph, found = _nation_walks(spark, d)
    return sinks.copy_report(graph.segments.select("seg_id", F.lit(1).alias("copy")), graph.segments, found.select(F.col("path").alias("v")))


@query("paths_from_strings", "N", " SELECT name AS sid, CAST(seg_id * 2 + 1 AS VARCHAR) AS path, CAST(seg_id * 0 + 1 AS INTEGER) AS unknown FROM seg")
def _from_strings(spark, d):
    graph = _graph(spark, d, "N")
    found = walks.paths_from_strings(graph.segments.select(F.col("name").alias("sid"), F.concat("name", F.lit("-, no such name+")).alias("steps")), graph)
    return found.select("sid", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), F.size("unknown").alias("unknown"))


@query("choose_sources", "N", """
, vertex AS (SELECT seg_id * 2 + k AS x FROM seg, (SELECT 0 AS k UNION ALL SELECT 1))
, r AS (SELECT x AS a, x AS b FROM vertex UNION SELECT r.a, w FROM r JOIN arc ON r.b = v)
, scc AS (SELECT p.a AS v, min(p.b) AS least FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a)
, member AS (SELECT DISTINCT least, v // 2 AS seg_id FROM scc)
, mass AS (SELECT least, sum(len * cov) AS m FROM member JOIN seg USING (seg_id) GROUP BY least)
SELECT seg_id FROM member JOIN seg USING (seg_id) WHERE least IN (SELECT least FROM mass WHERE m = (SELECT max(m) FROM mass)) ORDER BY len * cov DESC, seg_id LIMIT 1
""", recursive=True)
def _choose_sources(spark, d):
    graph = _graph(spark, d, "N")
    labels, _ = materialise(traversal.components(graph), "labels")
    found = traversal.choose_sources(graph, labels).join(graph.segments, "seg_id")
    return found.orderBy((F.col("len") * F.col("cov")).desc(), "seg_id").limit(1).select("seg_id")


_FREE = f"NOT list_contains(path, arc.w) AND NOT list_contains(path, {DUCK.flip('arc.w')})"
_BACK = f"list_reverse(list_transform(path, lambda x: {DUCK.flip('x')}))"
_FIND = _ALL_LABELS + f"""
, vertex AS (SELECT seg_id * 2 + k AS x FROM seg, (SELECT 0 AS k UNION ALL SELECT 1))
, r AS (SELECT x AS a, x AS b FROM vertex UNION SELECT r.a, w FROM r JOIN arc ON r.b = v)
, scc AS (SELECT p.a AS v, min(p.b) AS least FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a)
, member AS (SELECT DISTINCT component, least, seg.seg_id, len * cov AS mass FROM scc JOIN seg ON seg.seg_id = v // 2 JOIN label ON label.seg_id = seg.seg_id)
, heavy AS (SELECT component, least FROM (SELECT component, least, row_number() OVER (PARTITION BY component ORDER BY sum(mass) DESC, least) AS turn FROM member GROUP BY component, least) WHERE turn = 1)
, root AS (SELECT component, seg_id * 2 AS s FROM (SELECT component, seg_id, row_number() OVER (PARTITION BY component ORDER BY mass DESC, seg_id) AS turn FROM member JOIN heavy USING (component, least)) WHERE turn = 1)
, w AS (SELECT component, [s] AS path FROM root UNION ALL SELECT component, list_append(path, arc.w) FROM w JOIN arc ON arc.v = path[-1] WHERE {_FREE})
, back AS (
  SELECT DISTINCT component, {_BACK} AS path FROM w WHERE NOT EXISTS (SELECT 1 FROM arc WHERE arc.v = path[-1] AND {_FREE})
  UNION ALL SELECT component, list_append(path, arc.w) FROM back JOIN arc ON arc.v = path[-1] WHERE {_FREE}
)
, both_ways AS (SELECT DISTINCT component, {_BACK} AS path FROM back WHERE NOT EXISTS (SELECT 1 FROM arc WHERE arc.v = path[-1] AND {_FREE}))
, named AS (SELECT *, row_number() OVER (ORDER BY component, path) AS name FROM both_ways)
, step AS (SELECT component, name, path, unnest(path) AS x, generate_subscripts(path, 1) AS pos FROM named)
, hop AS (SELECT step.*, CASE WHEN pos = 1 THEN path[-1] ELSE path[pos - 1] END AS y FROM step)
, gain AS (SELECT hop.component, hop.name, pos, seg.len - coalesce(arc.ls, 0) AS gain, seg.cov AS c, arc.cov AS ac FROM hop JOIN seg ON seg.seg_id = x // 2 LEFT JOIN arc ON arc.v = y AND arc.w = x)
, measured AS (
  SELECT component, CAST(count(*) AS INTEGER) AS nv, max(CASE WHEN pos = 1 THEN ac IS NOT NULL END) AS circ, CAST(sum(gain) AS BIGINT) AS len,
         CAST(sum(gain * c) AS DOUBLE) AS wlen, CAST(sum(coalesce(ac, 0)) AS BIGINT) AS ec FROM gain GROUP BY component, name
)
, top AS (SELECT component, max(CASE WHEN circ THEN wlen END) AS c, max(CASE WHEN NOT circ THEN wlen END) AS l FROM measured GROUP BY component)
, placed AS (SELECT measured.*, row_number() OVER (PARTITION BY component ORDER BY wlen DESC, len DESC, ec DESC, nv DESC) AS turn FROM measured JOIN top USING (component) WHERE circ = (c IS NOT NULL AND (l IS NULL OR c >= l)))
SELECT component, nv, circ, len, wlen, ec, false AS exceeded FROM placed WHERE turn = 1
"""


@query("find_paths", "N", _FIND, recursive=True)
def _find_paths(spark, d):
    graph, labels, copies = _nation_copies(spark, d)
    ones = copies.select("seg_id", F.lit(1).alias("copy"))
    return walks.find_paths(graph, labels, ones).select("component", "nv", "circ", "len", "wlen", "ec", "exceeded")


# Segments 0 and 1 become two clones each, numbered behind all others.
_CLONES = f"""
, place AS (SELECT seg_id AS origin, i, (SELECT max(seg_id) FROM seg) + 1 + 2 * seg_id + i AS clone FROM seg, (SELECT 0 AS i UNION ALL SELECT 1) WHERE seg_id < 2
  UNION ALL SELECT seg_id, 0, seg_id FROM seg WHERE seg_id >= 2)
, move AS (
  SELECT a.clone * 2 + v % 2 AS v, b.clone * 2 + w % 2 AS w, CASE WHEN b.origin < 2 THEN b.origin * 2 + w % 2 ELSE -1 - b.clone * 2 - w % 2 END AS kin
  FROM arc JOIN place a ON v // 2 = a.origin JOIN place b ON w // 2 = b.origin
  WHERE a.origin <> b.origin OR a.origin >= 2 OR (a.i <> b.i AND v % 2 = w % 2)
)
, w AS (
  SELECT [CAST(8 AS BIGINT)] AS path
  UNION ALL
  SELECT list_append(path, next) FROM (
    SELECT path, min(move.w) AS next FROM w JOIN move ON move.v = path[-1]
    WHERE NOT list_contains(path, move.w) AND NOT list_contains(path, {DUCK.flip('move.w')}) GROUP BY path, kin
  )
)
SELECT list_aggregate(list_transform(path, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS name
FROM w WHERE NOT EXISTS (SELECT 1 FROM move WHERE move.v = path[-1] AND NOT list_contains(path, move.w) AND NOT list_contains(path, {DUCK.flip('move.w')}))
"""


def _cloned_types(spark, d):
    graph = _graph(spark, d, "E")
    new, origins = simplify.duplicate_by_copies(graph, graph.segments.select("seg_id", F.when(F.col("seg_id") < 2, 2).otherwise(1).alias("copy")))
    return g.AssemblyGraph(materialise(new.segments, "clones")[0], materialise(new.arcs, "arcs")[0]), materialise(origins, "origins")[0]


@query("walks_over_clones", "E", _CLONES, recursive=True)
def _walks_over_clones(spark, d):
    return walks.walks_over_clones(*_cloned_types(spark, d), 8, max_paths=50_000).select(_name())


# Rendering and sequences


@query("vertex_names", "N", " SELECT seg_id, name FROM seg")
def _vertex_names(spark, d):
    return sinks.vertex_names(derived_graph(spark, d, "N"))


@query("path_stats", "N", _WALKS + """
, wide AS (SELECT CAST(max(length(CAST(nv AS VARCHAR))) AS INTEGER) AS a, CAST(max(length(CAST(len AS VARCHAR))) AS INTEGER) AS b, CAST(max(length(printf('%.0f', wlen))) AS INTEGER) AS c, CAST(max(length(CAST(ec AS VARCHAR))) AS INTEGER) AS d FROM measured)
SELECT concat_ws(' ', 'path 0', 'nv=' || lpad(CAST(nv AS VARCHAR), a, ' '), 'len=' || lpad(CAST(len AS VARCHAR), b, ' '), 'wlen=' || lpad(printf('%.0f', wlen), c, ' '),
  'ec=' || lpad(CAST(ec AS VARCHAR), d, ' '), CASE WHEN circ THEN 'circular' ELSE 'linear' END) AS line FROM measured, wide
""", recursive=True)
def _path_stats(spark, d):
    found = _nation_walks(spark, d)[1].select(F.lit(0).alias("path_id"), "nv", "len", "wlen", "ec", "circ", F.lit(False).alias("best"))
    return sinks.path_stats_lines(found).select("line")


@query("gfa_lines", "N", """
, text AS (SELECT 0 AS part, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, 'H' || chr(9) || 'VN:Z:1.0' AS line
UNION ALL SELECT 1, seg_id, 0, concat_ws(chr(9), 'S', name, '*', 'LN:i:' || len, 'KC:i:' || (len * cov), 'SC:f:' || cov || '.000') FROM seg
UNION ALL SELECT 2, v, w, concat_ws(chr(9), 'L', x.name, CASE WHEN v % 2 = 1 THEN '-' ELSE '+' END, y.name, CASE WHEN w % 2 = 1 THEN '-' ELSE '+' END, ls || 'M', 'EC:i:' || arc.cov)
FROM arc JOIN seg x ON x.seg_id = v // 2 JOIN seg y ON y.seg_id = w // 2)
SELECT * FROM text
""")
def _gfa_lines(spark, d):
    return sinks.gfa_lines(derived_graph(spark, d, "N"), both_directions=True)


QUERIES["reverse_complement"] = lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", reverse_complement(F.col("p_name")).alias("seq"))
ORACLE_SQL["reverse_complement"] = "SELECT p_partkey, reverse(translate(upper(p_name), 'ACGTUBVDHKMRYSWN', 'TGCAAVBHDMKYRSWN')) AS seq FROM part"


@query("overlap_lengths")
def _overlaps(spark, d):
    text = F.format_string("%dM%dI%dD", F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_suppkey"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_quantity", text.alias("cigar"))
    return rows.select("l_orderkey", "l_quantity", overlap_length(F.col("cigar")).alias("own"), overlap_query_length(F.col("cigar")).alias("other"))


ORACLE_SQL["overlap_lengths"] = "SELECT l_orderkey, l_quantity, CAST(l_quantity AS BIGINT) + l_suppkey AS own, CAST(l_quantity AS BIGINT) + l_linenumber AS other FROM lineitem"


_TAGS = ("KC:i:%d", "XF:f:%.2f", "XA:A:%s", "XZ:Z:%s", "XB:B:i,%d,%d", "KC:i:-1", "no tag", "XN:i:%s")


@query("typed_tags")
def _typed_tags(spark, d):
    """Tags of each order line, written as text and read again by their types."""
    text = F.format_string("\t".join(_TAGS), "l_partkey", "l_extendedprice", F.substring("l_returnflag", 1, 1), "l_linestatus", F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"), "l_returnflag")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", typed_tags(F.split(text, "\t")).alias("t"))
    get = lambda tag, path, kind: F.try_variant_get(F.col("t")[tag], path, kind)
    return rows.select(
        "l_orderkey", "l_linenumber", get("KC", "$", "long").alias("kc"), get("XF", "$", "double").alias("xf"), get("XA", "$", "string").alias("xa"), get("XZ", "$", "string").alias("xz"),
        get("XB", "$.subtype", "string").alias("subtype"), get("XB", "$.values[1]", "long").alias("second"), F.col("t")["XN"].isNull().alias("none"), F.size("t").alias("n"),
    )


ORACLE_SQL["typed_tags"] = """
SELECT l_orderkey, l_linenumber, l_partkey AS kc, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS xf, substr(l_returnflag, 1, 1) AS xa, l_linestatus AS xz,
       'i' AS subtype, CAST(trunc(l_quantity) AS BIGINT) AS second, true AS none, 6 AS n FROM lineitem
"""

_BASES = "rpad(upper(seg.name), CAST(seg.len AS INTEGER), 'ACGT')"


@query("path_pieces", "N", _WALKS + f"""
, part AS (
  SELECT hop.name, hop.pos, substr(CASE WHEN hop.x % 2 = 1 THEN reverse(translate({_BASES}, 'ACGTUBVDHKMRYSWN', 'TGCAAVBHDMKYRSWN')) ELSE {_BASES} END, CAST(coalesce(arc.ls, 0) AS INTEGER) + 1) AS bases
  FROM hop JOIN seg ON seg.seg_id = x // 2 LEFT JOIN arc ON arc.v = y AND arc.w = x
)
, whole AS (SELECT name, string_agg(bases, '' ORDER BY pos) AS seq FROM part GROUP BY name)
, cut AS (SELECT name, seq, unnest(generate_series(0, (length(seq) - 1) // 1000)) AS piece FROM whole)
SELECT name, piece, piece * 1000 AS start, substr(seq, CAST(piece * 1000 + 1 AS INTEGER), 1000) AS seq FROM cut
""", recursive=True)
def _path_pieces(spark, d):
    """The sequences along all walks in pieces of 1,000 bases; nations have their names, filled up."""
    graph, found = _nation_walks(spark, d)
    named = graph.with_segments(graph.segments.withColumn("seq", F.rpad(F.upper("name"), F.col("len").cast("int"), F.lit("ACGT"))))
    paths, _ = materialise(dense_index(found.select("path", "circ"), ["path"], "path_id"), "paths")
    pieces = sinks.path_pieces(paths.select("path_id", "circ", F.col("path").alias("v")), named, piece=1000)
    return pieces.join(paths.select("path_id", _name()), "path_id").select("name", "piece", "start", "seq")


@query("complement_arcs", "E", f" SELECT {FLIP_W} AS v, {FLIP_V} AS w, cov FROM arc")
def _complement(spark, d):
    return g.complement(derived_graph(spark, d, "E").arcs).select("v", "w", "cov")


@query("open_ends", "P", f" SELECT seg_id * 2 + k AS v FROM seg, (SELECT 0 AS k UNION ALL SELECT 1) WHERE seg_id * 2 + k NOT IN (SELECT v FROM arc WHERE cov >= 2)")
def _open_ends(spark, d):
    return simplify.open_ends(_strong_parts(spark, d)[0])


@query("open_ends_all_arcs", "P", " SELECT seg_id * 2 + k AS v FROM seg, (SELECT 0 AS k UNION ALL SELECT 1) WHERE seg_id * 2 + k NOT IN (SELECT v FROM arc)")
def _open_ends_all(spark, d):
    return simplify.open_ends(_graph(spark, d, "P"))


@query("flip_ids", "E", f" SELECT v, {FLIP_V} AS other, v // 2 AS seg_id FROM arc")
def _flip_ids(spark, d):
    return derived_graph(spark, d, "E").arcs.select("v", flip("v").alias("other"), segment_of("v").alias("seg_id"))


QUERIES |= journey_queries.QUERIES
ORACLE_SQL |= journey_queries.ORACLE_SQL
