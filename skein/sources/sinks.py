"""Text renderings of graphs and paths, as rows of lines in order.

Each returns ``line`` with the columns that order it; ``write_lines`` sorts by
range and writes, so no task holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import is_reverse, segment_of, strand_sign
from skein.functions.sequences import reverse_complement, wrap
from skein.operators.graph import AssemblyGraph, first_arcs


def _named(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    for end in ("v", "w"):
        names = segments.select(F.col("seg_id").alias("_seg"), F.col("name").alias(f"{end}_name"))
        arcs = arcs.withColumn("_seg", segment_of(end)).join(names, "_seg").drop("_seg")
    return arcs


def gfa_lines(graph: AssemblyGraph, both_directions: bool = False) -> DataFrame:
    """``part, a, b, line`` of a GFA file: header, segments, links.

    Complements are left out unless ``both_directions``. KC is length times
    coverage, SC the coverage.
    """
    spark = graph.segments.sparkSession
    long = lambda x: F.lit(x).cast("long")
    head = spark.range(1).select(F.lit(0).alias("part"), long(0).alias("a"), long(0).alias("b"), F.lit("H\tVN:Z:1.0").alias("line"))
    s = graph.segments.select(
        F.lit(1).alias("part"), F.col("seg_id").alias("a"), long(0).alias("b"),
        F.format_string("S\t%s\t%s\tLN:i:%d\tKC:i:%d\tSC:f:%.3f", "name", F.coalesce("seq", F.lit("*")), "len", F.col("len") * F.col("cov"), F.col("cov").cast("double")).alias("line"),
    )
    arcs = graph.arcs if both_directions else graph.arcs.where("not comp")
    links = _named(arcs, graph.segments).select(
        F.lit(2).alias("part"), F.col("v").alias("a"), F.col("w").alias("b"),
        F.format_string("L\t%s\t%s\t%s\t%s\t%dM\tEC:i:%d", "v_name", strand_sign("v"), "w_name", strand_sign("w"), "ls", "cov").alias("line"),
    )
    return head.unionByName(s).unionByName(links)


def fasta_lines(segments: DataFrame, width: int = 60) -> DataFrame:
    """``seg_id, line``: a record for each segment that has a sequence."""
    return segments.where("seq is not null").select("seg_id", F.concat(F.lit(">"), "name", F.lit("\n"), wrap(F.col("seq"), width)).alias("line"))


PIECE = 600_000


def _steps_with_bases(paths: DataFrame, graph: AssemblyGraph, gap: int, linear: bool) -> DataFrame:
    """``path_id, at, w, cut, fill, bases``: each step with how many bases it loses to the overlap, the N before it, and the bases it gives in all."""
    steps = paths.select("path_id", "circ", F.posexplode("v").alias("at", "w"), F.col("v").alias("_path"))
    before = F.when(F.col("at") > 0, F.get("_path", F.col("at") - 1)).when(F.col("circ") & F.lit(not linear), F.element_at("_path", -1))
    steps = steps.select("path_id", "at", "w", before.alias("v"))
    arcs = first_arcs(graph.arcs).select("v", "w", "ls")
    own = F.coalesce(F.length("seq").cast("long"), F.col("len"))
    sizes = graph.segments.select("seg_id", own.alias("size"))
    found = steps.join(arcs, ["v", "w"], "left").withColumn("seg_id", segment_of("w")).join(sizes, "seg_id")
    cut = F.least(F.coalesce("ls", F.lit(0)).cast("long"), "size")
    fill = F.when(F.col("v").isNotNull() & F.col("ls").isNull() & (F.col("at") > 0), F.lit(gap)).otherwise(0).cast("long")
    return found.select("path_id", "at", "w", cut.alias("cut"), fill.alias("fill"), (F.col("size") - cut + fill).alias("bases"))


def path_pieces(paths: DataFrame, graph: AssemblyGraph, gap: int = 100, linear: bool = False, piece: int = PIECE) -> DataFrame:
    """``path_id, piece, start, seq``: the sequence along each path (path_id, circ, v) in pieces of ``piece`` bases.

    A step gives its oriented sequence without the overlap with the step before;
    where no arc leads to it, ``gap`` N stand between. A circular path loses the
    overlap of its closing arc at the start, unless ``linear``. Segments without a
    sequence give N.

    Only lengths are added up along a path; bases go straight to their pieces, so that
    no row holds more than a piece and a segment, however long the path.
    """
    steps = _steps_with_bases(paths, graph, gap, linear)
    before = Window.partitionBy("path_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = steps.withColumn("start", F.coalesce(F.sum("bases").over(before), F.lit(0)).cast("long")).where("bases > 0")
    bases = F.coalesce(F.col("seq"), F.repeat(F.lit("N"), F.col("len").cast("int")))
    bases = F.when(is_reverse("w"), reverse_complement(bases)).otherwise(bases)
    rows = placed.withColumn("seg_id", segment_of("w")).join(graph.segments.select("seg_id", "seq", "len"), "seg_id")
    part = F.concat(F.repeat(F.lit("N"), F.col("fill").cast("int")), F.substring(bases, (F.col("cut") + 1).cast("int"), F.length(bases)))
    rows = rows.select("path_id", "start", "bases", part.alias("part"))
    first, last = F.floor(F.col("start") / piece).cast("long"), F.floor((F.col("start") + F.col("bases") - 1) / piece).cast("long")
    spread = rows.withColumn("piece", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("piece") * piece - F.col("start"), F.lit(0))
    high = F.least((F.col("piece") + 1) * piece - F.col("start"), F.col("bases"))
    cuts = spread.select("path_id", "piece", "start", F.substring("part", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    joined = cuts.groupBy("path_id", "piece").agg(F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))
    return joined.select("path_id", "piece", (F.col("piece") * piece).alias("start"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("seq"))


def path_sequences(paths: DataFrame, graph: AssemblyGraph, gap: int = 100, linear: bool = False) -> DataFrame:
    """``path_id, seq``: ``path_pieces`` put together, for paths that fit into a row; one without bases has an empty sequence."""
    pieces = path_pieces(paths, graph, gap, linear).groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("piece", "seq"))).alias("p"))
    whole = pieces.select("path_id", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))
    return paths.select("path_id").join(whole, "path_id", "left").select("path_id", F.coalesce("seq", F.lit("")).alias("seq"))


def path_fasta_lines(paths: DataFrame, graph: AssemblyGraph, width: int = 60, gap: int = 100, linear: bool = False, best_only: bool = False) -> DataFrame:
    """``path_id, piece, line``: FASTA records of paths (path_id, sid, nv, len, wlen, ec, circ, v), figures in the header.

    The header is piece -1 and pieces have whole lines, so that they can be written one
    after the other. With ``best_only``, only paths marked ``best``.
    """
    if best_only:
        paths = paths.where("best")
    steps = paths.select("path_id", F.posexplode("v").alias("at", "x")).withColumn("seg_id", segment_of("x")).join(graph.segments.select("seg_id", "name"), "seg_id")
    names = steps.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("at", F.concat("name", strand_sign("x")).alias("n")))).alias("s"))
    names = names.select("path_id", F.array_join(F.transform("s", lambda p: p["n"]), ",").alias("steps"))
    totals = _steps_with_bases(paths, graph, gap, linear).groupBy("path_id").agg(F.sum("bases").cast("long").alias("_bases"))
    sid = F.coalesce(F.col("sid"), F.format_string("ctg%06d%s", F.col("path_id") + 1, F.when(F.col("circ") & F.lit(not linear), "c").otherwise("l")))
    rows = paths.join(totals, "path_id").join(names, "path_id")
    head = F.format_string(">%s length=%d wlength=%.0f nv=%d ec=%d circular=%s path=%s", sid, "_bases", "wlen", "nv", "ec", F.when(F.col("circ"), "true").otherwise("false"), "steps")
    heads = rows.select("path_id", F.lit(-1).cast("long").alias("piece"), head.alias("line"))
    lines = path_pieces(paths, graph, gap, linear, max(1, PIECE // width) * width).select("path_id", "piece", wrap(F.col("seq"), width).alias("line"))
    return heads.unionByName(lines)


def copy_report(copies: DataFrame, segments: DataFrame, included: DataFrame) -> DataFrame:
    """``seg_id, name, len, cov, copy_estd, copy_incl, copy_diff``.

    ``included`` holds the paths' steps (v arrays); segments that are in none, or
    have no estimate, count 0.
    """
    used = included.select(F.explode("v").alias("x")).groupBy(segment_of("x").alias("seg_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = segments.join(copies.select("seg_id", "copy"), "seg_id", "left").join(used, "seg_id", "left")
    estimated, there = F.coalesce("copy", F.lit(0)).cast("long"), F.coalesce("n", F.lit(0)).cast("long")
    return rows.select("seg_id", "name", "len", "cov", estimated.alias("copy_estd"), there.alias("copy_incl"), (there - estimated).alias("copy_diff"))


def report_lines(copies: DataFrame, paths: DataFrame, graph: AssemblyGraph, source: str | None = None, target: str | None = None) -> DataFrame:
    """``component, part, at, line``: the copy table of each component and its path, as text.

    ``copies`` has ``seg_id, component, copy`` of all segments that are listed, ``paths``
    ``component`` and the figures; a component without a path has its table only.
    """
    own = copies.select("seg_id", "component")
    width = F.max(F.length("name")).over(Window.partitionBy("component"))
    rows = copy_report(copies, graph.segments.join(own.select("seg_id"), "seg_id", "left_semi"), paths).join(own, "seg_id").withColumn("width", width)
    part = lambda n: F.lit(n).alias("part")
    zero = F.lit(0).cast("long").alias("at")
    head = own.select("component").distinct().select("component", part(0), zero, F.lit("SUBGRAPH node name length coverage copyEstd copyIncl copyDiff").alias("line"))
    body = rows.select("component", part(1), F.col("seg_id").alias("at"), F.concat(F.format_string("[%4d] ", "seg_id"), F.lpad("name", F.col("width"), F.lit(" ")), F.format_string(" %10d %10d %4d %4d %4d", "len", "cov", "copy_estd", "copy_incl", "copy_diff")).alias("line"))
    title = F.format_string("PATH node name [source=%s target=%s nv=%d len=%d wlen=%.0f ec=%d circ=%s]", F.lit(source or "NULL"), F.lit(target or "NULL"), "nv", "len", "wlen", "ec", F.when(F.col("circ"), "true").otherwise("false"))
    top = paths.select("component", part(2), zero, title.alias("line"))
    steps = paths.select("component", F.posexplode("v").alias("at", "x")).withColumn("seg_id", segment_of("x")).join(graph.segments.select("seg_id", "name"), "seg_id")
    steps = steps.select("component", part(3), F.col("at").cast("long").alias("at"), F.concat(F.format_string("[%4d] ", F.col("at").cast("long")), "name", strand_sign("x")).alias("line"))
    return head.unionByName(body).unionByName(top).unionByName(steps)


def path_stats_lines(paths: DataFrame) -> DataFrame:
    """``path_id, line``: figures of each path, numbers padded to the widest."""
    fields = ["nv", "len", "wlen", "ec"]
    text = {c: F.format_string("%.0f" if c == "wlen" else "%d", c) for c in fields}
    widths = paths.agg(*[F.coalesce(F.max(F.length(text[c])), F.lit(1)).alias(f"_{c}") for c in fields])
    rows = paths.join(F.broadcast(widths))
    parts = [F.concat(F.lit(f"{c}="), F.lpad(text[c], F.col(f"_{c}"), F.lit(" "))) for c in fields]
    kind = F.when(F.col("circ"), "circular").otherwise("linear")
    return rows.select("path_id", F.concat_ws(" ", F.format_string("path %d", "path_id"), *parts, kind, F.when(F.col("best"), "*")).alias("line"))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Write ``line`` as text files whose concatenation is in order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def vertex_names(graph: AssemblyGraph) -> DataFrame:
    return graph.segments.select("seg_id", "name")
