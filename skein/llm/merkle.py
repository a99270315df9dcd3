"""A Merkle manifest of a dataset: a digest for each row, source and the whole, and a proof for each row.

Rows are the leaves of one tree for each source; the sources' roots are the leaves of one
more tree. Every node has up to ``ARITY`` children. A tree's shape follows from its number
of leaves alone, so a node knows its parent's place and how many siblings to wait for.

* Leaves are sorted by range and numbered within their source without a single sorting
  task: each range counts its rows, and the counts before it are added.
* Nodes climb as events: each task keeps partial parents, which gather the digests of
  their children by place; one that has all of them becomes a node itself and is passed
  on to its own parent at once. What a task cannot complete, the frontier along the ends
  of its range, is dealt anew by the ancestor of a higher level, until no node is left.
* Each finished parent keeps its children's digests. These links are followed downwards by
  equi-joins, one a level, and carry the path: what stands left and right of each node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import materialise

BITS = 4
ARITY = 1 << BITS
#: A later round's task joins the frontiers of about so many tasks, and so many levels more each round.
TASKS_JOINED = 64
LEVELS_JOINED = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODES = "tree string, level int, place long, size long, digest string, children array<string>, top boolean"
_NODE = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string())), ("top", pa.bool_())])


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values one after the other: ``-`` for a null, else the byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a range with the range's number and their number within their tree there."""
    part, tree, turn = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        turns = []
        for name in batch.column("tree").to_pylist():
            turn = turn + 1 if name == tree else 0
            tree = name
            turns.append(turn)
        extra = [pa.array([part] * len(turns), pa.int32()), pa.array(turns, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "part", "turn"])


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int, int]:
    """``rows`` with each one's ``place`` in its ``tree`` by ``order`` and the tree's ``size``; the largest size, and the rows of a range."""
    # Equal rows differ in where they were read, so a row repeated without end fills many ranges.
    dealt = rows.withColumn("_read", F.monotonically_increasing_id())
    keys = ["tree", *order, "_read"]
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("turn", T.LongType())])
    ranged, _ = materialise(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read").mapInArrow(_counted, schema), "merkle-ranges")
    counts = ranged.groupBy("part", "tree").agg((F.max("turn") + 1).alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = materialise(counts.select("part", "tree", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("size")), "merkle-starts")
    seen = starts.agg(F.coalesce(F.max("size"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.countDistinct("part").alias("parts")).first()
    placed = ranged.join(starts.drop("n"), ["part", "tree"]).withColumn("place", F.col("start") + F.col("turn")).drop("part", "turn", "start")
    return placed, seen["most"], -(-seen["rows"] // max(1, seen["parts"]))


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished parents with their children, and at last the nodes whose parents lack other children.

    A parent waits in ``partial``, its children by place, for as many as the tree's size
    gives it. Rows come tree by tree, so only one tree's parents wait at a time.
    """
    out: list[tuple] = []
    partial: dict[tuple[int, int], dict[int, str]] = {}
    tree, size = None, 0

    def batch_of() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _NODE, strict=True)], schema=_NODE)

    def leave() -> None:
        for (level, parent), children in partial.items():
            out.extend((tree, level, parent * ARITY + turn, size, digest, None, False) for turn, digest in children.items())
        partial.clear()

    for batch in batches:
        for name, level, place, count, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if name != tree:
                leave()
                tree, size = name, count
            width = -(-size // (1 << BITS * level))  # nodes of this level
            if width == 1:
                out.append((tree, level, place, size, digest, None, True))
            while width > 1:
                parent, turn = divmod(place, ARITY)
                children = partial.setdefault((level, parent), {})
                children[turn] = digest
                arity = min(ARITY, width - parent * ARITY)
                if len(children) < arity:
                    break
                del partial[level, parent]
                found = [children[k] for k in range(arity)]
                digest = hashlib.sha256("".join(found).encode()).hexdigest()
                level, place, width = level + 1, parent, -(-width // ARITY)
                out.append((tree, level, place, size, digest, found, width == 1))
        if out:
            yield batch_of()
    leave()
    if out:
        yield batch_of()


def _grown(leaves: DataFrame, most: int, rows_a_task: int) -> DataFrame:
    """All nodes above the leaves ``tree, place, size, digest`` with their children, and the trees of one leaf.

    ``most`` is the size of the largest tree, ``rows_a_task`` what a task has of the leaves in order.
    """
    columns = ["tree", "level", "place", "size", "digest"]
    state = leaves.select("tree", F.lit(0).alias("level"), "place", "size", "digest").sortWithinPartitions("tree", "place")
    level, found = 0, []
    while 1 << BITS * level < rows_a_task * TASKS_JOINED:
        level += 1
    while True:
        state, _ = materialise(state.mapInArrow(_climb, _NODES), "merkle-nodes")
        found.append(state.where("children IS NOT NULL OR top"))
        frontier = state.where("children IS NULL AND NOT top").select(*columns)
        if frontier.isEmpty():
            break
        # Nodes below this level meet where their ancestor there is formed.
        ancestor = F.expr(f"shiftright(place, {BITS} * greatest({level} - level, 0))")
        state = frontier.withColumn("_above", ancestor).repartition("tree", "_above").sortWithinPartitions("tree", "_above").drop("_above")
        level += LEVELS_JOINED
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def _depth(size: int) -> int:
    """The levels above the leaves of a tree of ``size`` leaves."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


_STEP = "struct<left:string,right:string>"


def _step(children: str, turn: Column) -> Column:
    """What stands left and right of the child number ``turn``."""
    left = F.array_join(F.slice(children, F.lit(1), turn), "")
    right = F.array_join(F.slice(children, turn + 2, F.lit(ARITY)), "")
    return F.array(F.struct(left.alias("left"), right.alias("right")))


def _with_paths(leaves: DataFrame, nodes: DataFrame, tops: DataFrame, depth: int) -> DataFrame:
    """``leaves`` with their ``path``: the steps from the leaf upwards, then those of the tree's root.

    ``tops`` has each tree's top node, ``tree, level, path, subroot``. ``subroot`` comes along.
    """
    known = None
    for level in range(depth, 0, -1):
        here = tops.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("place"), "path", "subroot")
        here = here.unionByName(known) if known is not None else here
        links = nodes.where((F.col("level") == level) & F.col("children").isNotNull()).select("tree", "place", "children")
        above = links.join(here, ["tree", "place"])
        each = above.select("*", F.posexplode("children").alias("_turn", "_child"))
        known = each.select("tree", (F.col("place") * ARITY + F.col("_turn")).alias("place"), F.concat(_step("children", F.col("_turn")), "path").alias("path"), "subroot")
    alone = tops.where("level = 0").select("tree", F.lit(0).cast("long").alias("_parent"), F.lit(None).cast("array<string>").alias("children"), "path", "subroot")
    parents = above.withColumnRenamed("place", "_parent").unionByName(alone) if depth else alone
    joined = leaves.withColumn("_parent", F.shiftright("place", BITS)).join(parents, ["tree", "_parent"])
    own = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat(_step("children", (F.col("place") % ARITY).cast("int")), "path"))
    return joined.withColumn("path", own).drop("_parent", "children")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None) -> DataFrame:
    """Every row's ``id, source, leaf, place, subroot, root, path``, and the columns ``also``.

    ``leaf`` is the digest of ``fields``; ``place`` counts a source's leaves by id, from 0.
    ``path`` has a step for each level, through the source's root ``subroot`` up to ``root``:
    the digests ``left`` and ``right`` of the node. ``also`` names columns made from the row.

    A null source is a source of its own, before the others. Null ids come first, equal ids
    go by their digests, and repeated rows are leaves each. A null in a field has a mark of
    its own, which no value has. An empty table gives an empty result. Columns of ``docs``
    that are not named are ignored.
    """
    also = also or {}
    tree = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit(""))
    leaf = leaf_digest([F.col(f"`{c}`") for c in fields])
    rows = docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("_id"), leaf.alias("digest"), *[c.alias(f"_also_{name}") for name, c in also.items()])
    leaves, most, a_task = _placed(rows, ["_id", "digest"])
    nodes = _grown(leaves, most, a_task)
    subroots = nodes.where("top").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("level").alias("_level"), "digest")
    sources, n_sources, a_source_task = _placed(subroots, ["source"])
    above = _grown(sources, n_sources, a_source_task)
    top = above.where("top").select("level", "digest").first()
    tops = above.where("top").select("tree", "level", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("digest").alias("subroot"))
    by_source = _with_paths(sources, above, tops, _depth(n_sources))
    tops = by_source.select(F.col("source").alias("tree"), F.col("_level").alias("level"), "path", F.col("digest").alias("subroot"))
    found = _with_paths(leaves, nodes, tops, _depth(most))
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return found.select(
        F.col("_id").alias(id_col), source.alias(source_col), F.col("digest").alias("leaf"), "place", "subroot",
        F.lit(top["digest"] if top else None).cast("string").alias("root"), "path", *[F.col(f"_also_{name}").alias(name) for name in also],
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Each row's place in the manifest and what its proof says of it, a fifth of the rows having been changed since.

    Rows whose id's checksum 5 divides lose their capital letters A to Z.
    """
    changed = F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0
    lowered = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    later = leaf_digest([F.when(changed, lowered).otherwise(F.col(f"`{text_col}`")) if c == text_col else F.col(f"`{c}`") for c in fields])
    found = merkle_manifest(docs, id_col, source_col, fields, {"_later": later})
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    report = found.select(F.col(id_col), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("_later"), F.col("path")).alias("folded_root"))
    return report.withColumn("verified", F.col("folded_root") == F.col("root"))
