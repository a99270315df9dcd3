"""Embedding near-duplicates over an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of codes form
the grid's cells. Every vector is indexed in the cell of its nearest codes, and
visits cells by the multi-sequence order, nearest first, as many as reach the
target recall on a sample. What meets in a cell is verified in double precision.

Equal vectors are one node. Cells are cut into chunks, so a crowded cell is many
tasks; within a task vectors are compared by matrix products, and only counts and
a spanning forest of the links leave it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import materialise
from skein.plans.components import connected_components
from skein.plans.hot import hot_join

THRESHOLD = 0.98
TARGET_RECALL = 0.9995
SAMPLE = 10_000
CELL_ROWS = 16
CHUNK = 2_048
MIN_CODES = 4
MAX_CODES = 1_024


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(x: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """k-means with a fixed start."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(codes, len(x)), replace=False)].copy()
    for _ in range(12):
        near = _distances(x, centres).argmin(axis=1)
        for k in range(len(centres)):
            own = x[near == k]
            if len(own):
                centres[k] = own.mean(axis=0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None])


def multi_sequence(first: np.ndarray, second: np.ndarray, cells: int) -> list[int]:
    """The nearest cells of one vector, by the sum of its halves' distances.

    ``first`` and ``second`` are its distances to the codes of either half. The
    heap holds the frontier of the grid in sorted order, so only the cells that
    come out are ever looked at. A cell's number is code * len(second) + code.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[a[0]] + second[b[0]], 0, 0)]
    out: list[int] = []
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * len(b) + int(b[j]))
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return out


class Grid:
    """Codebooks of one dimension count, and the number of cells to visit."""

    def __init__(self, x: np.ndarray, codes: int, threshold: float, target: float):
        self.half = x.shape[1] // 2
        self.books = [_codebook(part, codes, seed) for seed, part in enumerate(self._halves(x))]
        self.cells = len(self.books[0]) * len(self.books[1])
        self.visits = self._visits_for(x[:2000], threshold, target)

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def _visits_for(self, x: np.ndarray, threshold: float, target: float) -> int:
        """The fewest visits after which ``target`` of neighbours just at the threshold are found.

        A neighbour is a sampled vector turned by the threshold's angle in a random
        direction: the hardest link there is. Either end may find the other. Up to all
        cells are looked at until the target is reached.
        """
        rng = np.random.default_rng(7)
        step = rng.normal(size=x.shape)
        step -= (step * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(step, axis=1, keepdims=True)
        other = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * step / np.where(size > 0, size, 1)
        homes = [self.order(side, 1) for side in (x, other)]
        limit = 16
        while True:
            limit = min(limit, self.cells)
            ranks = []
            for side, there in ((x, homes[1]), (other, homes[0])):
                ranks.append([row.index(cell) if cell in row else self.cells for row, [cell] in zip(self.order(side, limit), there)])
            need = np.sort(np.minimum(*map(np.array, ranks)))
            visits = int(need[min(len(need) - 1, math.ceil(target * len(need)))]) + 1
            if visits <= limit or limit == self.cells:
                return min(visits, self.cells)
            limit *= 4

    def order(self, x: np.ndarray, cells: int) -> list[list[int]]:
        first, second = (_distances(part, book) for part, book in zip(self._halves(x), self.books))
        return [multi_sequence(a, b, cells) for a, b in zip(first, second)]


def _compare(queries: pa.Table, index: pa.Table, threshold: float) -> pa.Table:
    """Links between a chunk's visitors and its residents: counts and a spanning forest.

    A resident counts a visitor as well unless it visits that one's cell, where
    the visitor is the resident and the link is counted again.
    """
    empty = pa.table({"node": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if not queries.num_rows or not index.num_rows:
        return empty
    take = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    vectors = lambda t: _units(np.array(t.column("vector").to_pylist(), dtype=np.float64))
    q, r = vectors(queries), vectors(index)
    qn, rn, qm, rm, qk, rk = take(queries, "node"), take(index, "node"), take(queries, "mark"), take(index, "mark"), take(queries, "copies"), take(index, "copies")
    home = take(queries, "home")
    seen = [set(v) for v in index.column("visits").to_pylist()]
    pairs = []
    for at in range(0, len(q), 512):
        i, j = np.nonzero(q[at : at + 512] @ r.T >= threshold)
        i += at
        other = (qn[i] != rn[j]) | (qm[i] != rm[j])
        pairs.append(np.column_stack([i[other], j[other]]))
    i, j = np.vstack(pairs).T
    if not len(i):
        return empty
    q_links, r_links = np.bincount(i, rk[j], len(q)), np.zeros(len(r))
    homes, place = np.unique(home[i], return_inverse=True)
    alone = np.array([[h not in s for h in homes.tolist()] for s in seen], dtype=bool)[j, place]
    r_links += np.bincount(j[alone], qk[i[alone]], len(r))
    # Components of the links, by least root, with shortcuts.
    nodes, back = np.unique(np.concatenate([qn, rn]), return_inverse=True)
    a, b = back[: len(qn)][i], back[len(qn) :][j]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    counted: dict[tuple[int, int], int] = {}
    for node, mark, links in [*zip(qn.tolist(), qm.tolist(), q_links.tolist()), *zip(rn.tolist(), rm.tolist(), r_links.tolist())]:
        if links:
            counted[node, mark] = counted.get((node, mark), 0) + int(links)
    out = [(node, mark, links, None) for (node, mark), links in counted.items()]
    ends = np.unique(np.concatenate([a, b]))
    ends = ends[root[ends] != ends]
    out += [(node, None, 0, top) for node, top in zip(nodes[ends].tolist(), nodes[root[ends]].tolist())]
    if not out:
        return empty
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("node", "mark", "links", "root"), zip(*out))})


def _place(grids: dict[int, Grid]):
    def run(batches):
        for batch in batches:
            rows = batch.column("vector").to_pylist()
            homes, visits = [0] * len(rows), [[0]] * len(rows)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                by_size.setdefault(len(v), []).append(i)
            for size, own in by_size.items():
                if size in grids:
                    grid = grids[size]
                    for at in range(0, len(own), 1024):
                        part = own[at : at + 1024]
                        cells = grid.order(_units(np.array([rows[i] for i in part], dtype=np.float64)), grid.visits)
                        for i, found in zip(part, cells):
                            homes[i], visits[i] = found[0], found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "home", "visits"])

    return run


def _grids(nodes: DataFrame, threshold: float, target: float, sample: int, cell_rows: int) -> dict[int, Grid]:
    """A grid for each dimension count in a sample of at most ``sample`` vectors, taken by hash.

    The number of codes follows the largest label, so that its cells hold about
    ``cell_rows`` vectors; a half has ``MIN_CODES`` codes at least. Dimension counts
    that a sample lacks are sampled in turn.
    """
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    codes = min(MAX_CODES, max(MIN_CODES, math.ceil(math.sqrt(most / cell_rows))))
    grids: dict[int, Grid] = {}
    rest = nodes.where("size > 1").select("mark", "node", "size", "vector")
    while True:
        rows = [np.array(r.vector, dtype=np.float64) for r in rest.where(~F.col("size").isin(list(grids))).orderBy("mark", "node").limit(sample).select("vector").collect()]
        if not rows:
            return grids
        for n in sorted({len(v) for v in rows}):
            grids[n] = Grid(_units(np.array([v for v in rows if len(v) == n])), codes, threshold, target)


def embedding_links(nodes: DataFrame, threshold: float, grids: dict[int, Grid], chunk: int = CHUNK) -> DataFrame:
    """``node, mark, links, root`` from all cells: partial link counts, or an edge node - root."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])
    placed, path = materialise(nodes.mapInArrow(_place(grids), schema), "multi-index")
    visiting = placed.sparkSession.read.schema(schema).parquet(path)  # the other side of a self-join
    cell = ["label", "size", "cell"]
    visitors = placed.select("label", "size", F.explode("visits").alias("cell")).groupBy(cell).agg(F.count(F.lit(1)).alias("visitors"))
    residents = placed.groupBy("label", "size", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("residents"))
    parts = residents.join(visitors, cell).select(*cell, "residents", "visitors", F.ceil(F.col("residents") / chunk).alias("chunks"), F.ceil(F.col("visitors") / chunk).alias("parts"))
    key = [*cell, "chunk", "part"]
    own = F.xxhash64("node", "mark")
    # A crowded cell's rows are dealt by their own hash as well.
    parts, _ = materialise(parts, "cells")
    total = parts.agg(F.coalesce(F.sum("residents"), F.lit(0)).alias("r"), F.coalesce(F.sum("visitors"), F.lit(0)).alias("v")).first()
    sized = lambda rows, n, all_: hot_join(rows, parts.withColumn("_n", F.col(n)).select(*cell, "chunks", "parts", "_n"), cell, "_n", all_, own)
    index = sized(placed.withColumn("cell", F.col("home")), "residents", total["r"]).select("*", F.pmod(own, "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    queries = sized(visiting.withColumn("cell", F.explode("visits")), "visitors", total["v"]).select("*", F.pmod(own, "parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    queries = queries.select(*key, "node", "mark", "copies", "vector", "home")
    index = index.select(*key, "node", "mark", "copies", "vector", "visits")
    return queries.groupBy(key).cogroup(index.groupBy(key)).applyInArrow(lambda q, r: _compare(q, r, threshold), "node long, mark long, links long, root long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, target: float = TARGET_RECALL, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Link vectors of one label by their cosine; one row for each vector.

    Returns id, ``n_links`` (other vectors linked directly), ``component_id``
    (least id reachable) and ``kept`` (id = component_id). Null labels, null ids
    and vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are kept; vectors of different sizes don't link. Copies
    link with each other; rows repeated with one id are one node, and both count.
    An empty table gives none; further columns are ignored.
    """
    # Adding 0.0 makes one of the two zeros, so equal vectors have equal keys.
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").withColumn("mark", F.xxhash64("label", "vector"))
    grouped = good.groupBy("label", "mark", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes, _ = materialise(grouped.withColumn("size", F.size("vector")), "vectors")
    found, _ = materialise(embedding_links(nodes, threshold, _grids(nodes, threshold, target, sample, cell_rows), chunk), "vector-links")
    links = found.where("mark is not null").groupBy("node", "mark").agg(F.sum("links").alias("links"))
    # A node is named by its least id; the ids of its copies reach each other through it.
    copies = good.join(nodes.where("copies > 1").select("label", "mark", "vector", "node"), ["label", "mark", "vector"]).where("id <> node").select(F.col("id").alias("node"), F.col("node").alias("root"))
    edges = found.where("root is not null").select("node", "root").unionByName(copies)
    components = connected_components(edges, "node", "root")
    counted = nodes.join(links, ["node", "mark"], "left").select("label", "mark", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = good.join(counted, ["label", "mark", "vector"]).select("id", "n_links")
    out = linked.join(components.withColumnRenamed("node", "id"), "id", "left").select("id", "n_links", F.coalesce("component", "id").alias("component_id"))
    rest = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = out.unionByName(rest)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
