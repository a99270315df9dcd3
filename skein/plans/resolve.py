"""The whole run: from a graph file to the best path of each component."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.config import Config
from skein.operators.coverage import add_neighbours, copy_numbers, pick_bubbles, rescue_by_arcs
from skein.operators.flow import adjust_copies
from skein.operators.graph import AssemblyGraph, clean, delete_segments
from skein.operators.traversal import component_of, components
from skein.operators.walks import find_path_in_parts, find_paths
from skein.plans.scratch import materialise
from skein.sources.gfa import node_spec


@dataclass(frozen=True)
class Resolution:
    graph: AssemblyGraph
    labels: DataFrame
    copies: DataFrame
    paths: DataFrame


def _saved(graph: AssemblyGraph) -> AssemblyGraph:
    return AssemblyGraph(materialise(graph.segments, "segments")[0], materialise(graph.arcs, "arcs")[0])


def estimate(graph: AssemblyGraph, labels: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """``seg_id, component, copy, avg``, and the segments that bubbles exclude (seg_id)."""
    first = copy_numbers(graph.segments.join(labels, "seg_id"), config.min_copy, config.max_copy, floor=config.floor)
    copies, _ = materialise(first, "copies")
    rest = copies.select("seg_id", "component", "avg")
    excluded = copies.select("seg_id").limit(0)
    now = copies.select("seg_id", "copy")
    if config.arcs_to_segments:
        now, _ = materialise(rescue_by_arcs(graph, labels, now), "copies")
    if config.bubbles:
        found, _ = materialise(pick_bubbles(graph, labels, now), "copies")
        now, excluded = found.select("seg_id", "copy"), found.where("excluded").select("seg_id")
    if config.neighbour_steps:
        live = delete_segments(graph, excluded)
        more = add_neighbours(live, labels, now, config.neighbour_steps, config.neighbour_len)
        now, _ = materialise(now.join(more.withColumnRenamed("copy", "_c"), "seg_id", "left").select("seg_id", F.coalesce("_c", "copy").alias("copy")), "copies")
    copies = rest.join(now, "seg_id").select("seg_id", "component", "copy", "avg")
    if config.adjust:
        fitted = adjust_copies(delete_segments(graph, excluded), labels, copies, config.max_copy).select("seg_id", F.col("copy").alias("_c"), F.col("avg").alias("_a"))
        copies = copies.join(fitted, "seg_id", "left").select("seg_id", "component", F.coalesce("_c", "copy").alias("copy"), F.coalesce("_a", "avg").alias("avg"))
    return materialise(copies, "copies")[0], excluded


def resolve(graph: AssemblyGraph, config: Config = Config()) -> Resolution:
    """Clean, split, estimate, search: the best path of every component.

    With a source, only its component is worked on; a target elsewhere raises.
    Excluded bubbles keep their arcs for the search.
    """
    graph = _saved(clean(graph, config.min_arc_cov, config.min_seg_cov))
    source, _ = node_spec(graph, config.source)
    target, _ = node_spec(graph, config.target)
    labels, _ = materialise(components(graph), "labels")
    if source is not None:
        own = component_of(labels, source)
        labels, _ = materialise(labels.join(own, "seg_id", "left_semi"), "labels")
        if target is not None and labels.where(F.col("seg_id") == target >> 1).isEmpty():
            raise ValueError("source and target are in different components")
    copies, _ = estimate(graph, labels, config)
    if config.partition and source is not None and target is not None:
        paths = find_path_in_parts(graph, labels, copies, source, target, config.max_paths, config.circular_share)
    else:
        paths = find_paths(graph, labels, copies, source, target, config.max_paths, config.circular_share)
    return Resolution(graph, labels, copies, materialise(paths, "paths")[0])
