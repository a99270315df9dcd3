"""A document quality classifier by co-training two views.

The text view sees a text's words, pairs of words and look, whatever its length; the
metadata view its language, source and length. Over some rounds each view labels the
unlabelled documents that it is surest of for the other one. Each view's score is then
calibrated on labelled documents that took no part in training; their combination,
which scores every document, is fitted on others again.

Labelled documents are a bounded sample on the driver (``MAX_LABELLED``, taken by a
hash of the id). All unlabelled ones take part: their features are written once, and
tasks count their scores by bins and sum the gradients and Hessians of the fits.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import drop_path, materialise
from skein.llm.line_sets import SLICE_BYTES, Words

MAX_LABELLED = 20_000
ROUNDS = 4
PER_ROUND = 0.05
SURE = 0.9
HELD_OUT = 0.25
SPLIT = 10
THRESHOLD = 0.5
BINS = 64
DIRECT_PARTS = 256
NGRAM_BUCKETS = 32
_LIMIT = 35
_FOUND = "part int, found binary"

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SOURCE_BUCKETS = 32
_LANG_BUCKETS = 16
_SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "text_score", "metadata_score")])


def ngram_features(texts: list[bytes], buckets: int = NGRAM_BUCKETS) -> np.ndarray:
    """Shares of the words and of the pairs of words of each text in hashed ``buckets``, as square roots."""
    words = Words.of(texts)
    row = np.searchsorted(words.first_lines, words.lines, side="right") - 1
    pair = (words.hashes[:-1] * _PAIR ^ words.hashes[1:]) * _PAIR
    together = row[:-1] == row[1:]
    n = np.maximum(1, np.bincount(row, minlength=len(texts)))
    out = []
    for own, hashes in ((row, words.hashes), (row[:-1][together], pair[together])):
        at = own * buckets + (hashes >> np.uint64(33)).astype(np.int64) % buckets
        out.append(np.bincount(at, minlength=len(texts) * buckets).reshape(len(texts), buckets) / n[:, None])
    return np.sqrt(np.hstack(out))


def text_matrix(texts: list[bytes | None]) -> np.ndarray:
    """The text view's features, a row for each text; a null text is empty."""
    if not len(texts):
        return np.zeros((0, len(text_features(b"")) + 2 * NGRAM_BUCKETS))
    data = [t or b"" for t in texts]
    grams = np.vstack([ngram_features(part) for part in _slices(data)])
    return np.hstack([np.array([text_features(t) for t in data], dtype=float), grams])


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_features(text: bytes | None) -> list[float]:
    """Shares of kinds of bytes, and how varied and repetitive words and lines are."""
    data = text or b""
    size = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n = max(1, len(words))
    lines = data.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:]))
    lower, upper = counts[97:123].sum(), counts[65:91].sum()
    found = [
        len(data) / n / 10,
        len(set(words)) / n,
        again / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        upper / size,
        upper / max(1, lower + upper),
        counts[48:58].sum() / size,
        counts[128:].sum() / size,
        counts[[9, 10, 13, 32]].sum() / size,
        counts[:9].sum() / size,
    ]
    found += np.sqrt(counts[list(_PUNCTUATION)] / n).tolist()
    return found


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    found = [0.0] * (_LANG_BUCKETS + _SOURCE_BUCKETS)
    if lang is not None:
        found[zlib.crc32(lang.encode()) % _LANG_BUCKETS] = 1.0
    if source is not None:
        found[_LANG_BUCKETS + zlib.crc32(source.encode()) % _SOURCE_BUCKETS] = 1.0
    known = n_chars is not None and n_chars == n_chars
    size = np.log1p(max(0.0, n_chars)) if known else 0.0
    return [*found, float(known), size, size * size / 10]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    """Regularised logistic regression on standardised features, by Newton's method."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        weights = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], l2)
        ridge[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(z @ weights)
            slope = z.T @ (p - y) + ridge * weights
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(curve, slope)
            weights -= step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, weights)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -35, 35)


def _platt(logits: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt's scaling: targets drawn in by the classes' counts bound the slopes, hardly any ridge does.

    A view that ranks these few rows the wrong way round weighs nothing.
    """
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    used = np.ones(logits.shape[1], dtype=bool)
    while True:
        found = Logistic.fit(np.where(used, logits, 0.0), target, 1e-3)
        wrong = used & (found.weights[:-1] < 0)
        if not wrong.any():
            return found
        used &= ~wrong


@dataclass
class CoTrained:
    """Two views, their calibrations and the combination of the calibrated scores."""

    views: tuple[Logistic, Logistic]
    calibrations: tuple[Logistic, Logistic]
    combination: Logistic

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibrations, (text, metadata))]
        return np.column_stack([_sigmoid(self.combination.logit(np.column_stack(logits))), *map(_sigmoid, logits)])


@dataclass
class _Pick:
    """What one view chose for the other in a round: per class, whole bins above ``cut`` and a share of that bin."""

    model: Logistic
    cuts: dict[float, tuple[int, float]]


@dataclass
class _Rows:
    """Some of the pool: both views' features and a number in [0, 1) by the id's hash."""

    views: tuple[np.ndarray, np.ndarray]
    turn: np.ndarray


#: Runs a function over all parts of the pool and returns what it gave for each.
_Pass = Callable[[Callable[[_Rows], object]], list]


def _bins(model: Logistic, x: np.ndarray, label: float, sure: float) -> np.ndarray:
    """How sure the model is of ``label``, in bins of the logit; -1: not ``sure``."""
    z = model.logit(x) * (1 if label else -1)
    return np.where(_sigmoid(z) >= sure, np.floor(z * BINS), -1).astype(np.int64)


def _given(picks: list[_Pick], x: np.ndarray, turn: np.ndarray, sure: float) -> np.ndarray:
    """The pseudo-labels that the picks gave to rows with the other view's features ``x``; NaN: none."""
    y = np.full(len(x), np.nan)
    for pick in picks:
        for label, (cut, part) in pick.cuts.items():
            b = _bins(pick.model, x, label, sure)
            y[np.isnan(y) & (b >= 0) & ((b > cut) | ((b == cut) & (turn < part)))] = label
    return y


def _cut(counts: np.ndarray, quota: int) -> tuple[int, float]:
    """The bin in which the quota ends, from the surest on, and the share of it that is taken."""
    above = np.cumsum(counts[::-1])[::-1]
    full = np.flatnonzero(above >= quota)
    if not len(full):
        return 0, 1.0
    cut = int(full[-1])
    return cut, float((quota - (above[cut] - counts[cut])) / counts[cut])


def _slopes(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _sigmoid(z @ weights)
    return z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z


def _fit_over(sets: list[np.ndarray], y: np.ndarray, picks: list[list[_Pick]], run: _Pass, sure: float, l2: float = 1.0) -> list[Logistic]:
    """``Logistic.fit`` of both views on the labelled rows and all pseudo-labelled ones."""
    centre = [x.mean(axis=0) for x in sets]

    def moments(rows: _Rows) -> list:
        found = []
        for k in (0, 1):
            x = rows.views[k][~np.isnan(_given(picks[k], rows.views[1 - k], rows.turn, sure))] - centre[k]
            found.append((len(x), x.sum(axis=0), (x * x).sum(axis=0)))
        return found

    parts, models = run(moments), []
    for k in (0, 1):
        own = sets[k] - centre[k]
        n = len(own) + sum(p[k][0] for p in parts)
        mean = (own.sum(axis=0) + sum(p[k][1] for p in parts)) / n
        square = ((own * own).sum(axis=0) + sum(p[k][2] for p in parts)) / n
        scale = np.sqrt(np.maximum(0, square - mean * mean))
        models.append(Logistic(centre[k] + mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(sets[k].shape[1] + 1)))

    def standard(k: int, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - models[k].mean) / models[k].scale, np.ones(len(x))])

    todo = [0, 1]
    for _ in range(25):

        def slopes(rows: _Rows) -> dict:
            found = {}
            for k in todo:
                label = _given(picks[k], rows.views[1 - k], rows.turn, sure)
                known = ~np.isnan(label)
                found[k] = _slopes(standard(k, rows.views[k][known]), label[known], models[k].weights)
            return found

        parts = run(slopes)
        for k in list(todo):
            weights = models[k].weights
            ridge = np.full(len(weights), l2)
            ridge[-1] = 1e-6
            slope, curve = _slopes(standard(k, sets[k]), y, weights)
            slope = slope + sum(p[k][0] for p in parts) + ridge * weights
            curve = curve + sum(p[k][1] for p in parts) + np.diag(ridge)
            step = np.linalg.solve(curve, slope)
            models[k].weights = weights - step
            if np.abs(step).max() < 1e-8:
                todo.remove(k)
        if not todo:
            break
    return models


def _co_train(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, held_out: np.ndarray, run: _Pass, rounds: int, per_round: float, sure: float) -> CoTrained:
    sets, train = (text, metadata), ~held_out
    own = [x[train] for x in sets]
    share = y[train].mean()
    picks: list[list[_Pick]] = [[], []]
    models = [Logistic.fit(x, y[train]) for x in own]
    for _ in range(rounds):

        def count(rows: _Rows) -> tuple:
            found = {}
            for view in (0, 1):
                free = np.isnan(_given(picks[1 - view], rows.views[view], rows.turn, sure))
                for label in (1.0, 0.0):
                    b = _bins(models[view], rows.views[view][free], label, sure)
                    found[view, label] = np.bincount(b[b >= 0], minlength=_LIMIT * BINS + 1)
            return len(rows.turn), found

        parts = run(count)
        n = sum(p[0] for p in parts)
        if not n:
            break
        new = 0
        for view in (0, 1):
            cuts = {}
            for label, part in ((1.0, share), (0.0, 1 - share)):
                counts = sum(p[1][view, label].astype(np.int64) for p in parts)
                cuts[label] = _cut(counts, int(per_round * part * n) + 1)
                new += int(counts.sum())
            picks[1 - view].append(_Pick(models[view], cuts))
        if not new:
            break
        models = _fit_over(own, y[train], picks, run, sure)
    logits, known = [m.logit(x[held_out])[:, None] for m, x in zip(models, sets)], y[held_out]
    # Every other one of a class calibrates, the rest combine; under ``SPLIT`` of a class do both.
    turn = np.zeros(len(known), np.int64)
    for label in (0.0, 1.0):
        own = np.flatnonzero(known == label)
        turn[own] = np.arange(len(own)) % 2 if len(own) >= SPLIT else 2
    first, second = turn != 1, turn != 0
    calibrations = [_platt(z[first], known[first]) for z in logits]
    both = np.column_stack([c.logit(z) for c, z in zip(calibrations, logits)])
    return CoTrained(tuple(models), tuple(calibrations), _platt(both[second], known[second]))


def co_train(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_metadata: np.ndarray, held_out: np.ndarray, rounds: int = ROUNDS, per_round: float = PER_ROUND, sure: float = SURE) -> CoTrained:
    """Fit both views, exchanging pseudo-labels; calibrate on the ``held_out`` rows.

    In each round a view picks, for each class and in the labelled classes'
    proportion, the pool rows that it is surest of (``sure`` at least), up to
    ``per_round`` of the pool; the other view learns from them. Rows in the bin of
    scores where the quota ends are taken by turn.
    """
    rows = _Rows((pool_text, pool_metadata), np.arange(len(pool_text)) * 0.6180339887 % 1)
    return _co_train(text, metadata, y, held_out, lambda f: [f(rows)] if len(pool_text) else [], rounds, per_round, sure)


def _plus(a: object, b: object) -> object:
    """The sum of two results of the same form: numbers and arrays in lists, tuples and dictionaries."""
    if isinstance(a, dict):
        return {k: _plus(a[k], b[k]) for k in a}
    if isinstance(a, (list, tuple)):
        return type(a)(_plus(x, y) for x, y in zip(a, b))
    return a + b


def _found(part: int, found: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], ["part", "found"])


def _over(pool: DataFrame) -> _Pass:
    """Passes over a table of features, a sum for each task; those of very many tasks are summed in groups."""
    many = pool.rdd.getNumPartitions() > DIRECT_PARTS

    def run(f: Callable[[_Rows], object]) -> list:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stack = lambda b, c: np.asarray(b.column(c).flatten()).astype(float).reshape(b.num_rows, -1)
            each = (f(_Rows((stack(b, "text_x"), stack(b, "metadata_x")), b.column("turn").to_numpy())) for b in batches if b.num_rows)
            first = next(each, None)
            if first is not None:
                yield _found(TaskContext.get().partitionId() % DIRECT_PARTS, functools.reduce(_plus, each, first))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, object] = {}
            for b in batches:
                for part, found in zip(b.column("part").to_pylist(), b.column("found")):
                    one = pickle.loads(found.as_py())
                    held[part] = _plus(held[part], one) if part in held else one
            for part, found in held.items():
                yield _found(part, found)

        out = pool.mapInArrow(work, _FOUND)
        if many:
            out = out.repartition("part").mapInArrow(merge, _FOUND)
        return [pickle.loads(x) for x in out.toArrow().column("found").to_pylist()]

    return run


def _features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns with the arrays ``text_x`` and ``metadata_x``."""
    rows = docs.select(*columns, F.col("text").cast("binary").alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("n_chars").cast("double").alias("_chars"))
    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField(n, T.ArrayType(T.FloatType())) for n in ("text_x", "metadata_x")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[columns].copy()
            out["text_x"] = list(text_matrix(list(f["_text"])).astype(np.float32))
            out["metadata_x"] = [np.array(metadata_features(*x), np.float32) for x in zip(f["_lang"], f["_source"], f["_chars"])]
            yield out

    return rows.mapInPandas(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> CoTrained | None:
    """Fit on documents whose ids ``labels`` covers; None unless both classes occur.

    Several labels of one document count as their majority (ties: good); null
    labels and ids don't count. All other documents with an id are the pool.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("_y"))
    # Of rows with the same id, one counts.
    own = docs.select(F.col(id_col).alias("_id"), "text", "lang", "source", "n_chars").where("_id is not null")
    one = _features(own, ["_id"]).groupBy("_id").agg(F.min(F.struct("text_x", "metadata_x")).alias("x")).select("_id", "x.*").join(known, "_id", "left")
    one, path = materialise(one.withColumn("turn", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / (1 << 30)), "quality-features")
    try:
        labelled = one.where("_y is not null").orderBy(F.xxhash64("_id"), "_id").limit(max_labelled).select("_id", "_y", "text_x", "metadata_x")
        pool = one.where("_y is null").select("text_x", "metadata_x", "turn")
        return _train(labelled.toArrow().to_pandas().sort_values(["_id"], kind="stable"), _over(pool))
    finally:
        drop_path(docs.sparkSession, path)


def _train(labelled: pd.DataFrame, run: _Pass) -> CoTrained | None:
    y = labelled["_y"].to_numpy(dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    # Every fourth document of a class in the ids' hash order is held out, one of each class at least.
    spread = labelled["_id"].map(lambda i: zlib.crc32(str(i).encode())).to_numpy()
    held_out = np.zeros(len(y), dtype=bool)
    for label in (0.0, 1.0):
        own = np.flatnonzero(y == label)
        held_out[own[np.argsort(spread[own], kind="stable")][: max(1, int(HELD_OUT * len(own)))]] = True
    if len(set(y[~held_out].tolist())) < 2:
        held_out = np.zeros(len(y), dtype=bool)
    sets = [np.array(labelled[n].tolist(), dtype=float) for n in ("text_x", "metadata_x")]
    if not held_out.any():  # too few to hold out: calibrate on what trains
        sets, held_out, y = [np.vstack([x] * 2) for x in sets], np.repeat([False, True], len(y)), np.tile(y, 2)
    return _co_train(*sets, y, held_out, run, ROUNDS, PER_ROUND, SURE)


def score_column(model: CoTrained | None) -> Column:
    """A struct ``score, text_score, metadata_score`` from text, lang, source and n_chars."""
    if model is None:
        return F.lit(None).cast(_SCORES)

    @F.pandas_udf(_SCORES)
    def scored(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        x = text_matrix(list(text)).astype(np.float32).astype(float)
        m = np.array([metadata_features(*r) for r in zip(lang, source, n_chars)], dtype=float)
        return pd.DataFrame(model.scores(x, m), columns=["score", "text_score", "metadata_score"])

    return scored(F.col("text").cast("binary"), F.col("lang"), F.col("source"), F.col("n_chars").cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``score`` (probability of good quality), both views' scores and ``kept``.

    Documents need text, lang, source and n_chars; nulls there are values like
    others (a null text is empty). Without labels of both classes scores are null
    and every row is kept; with too few of a class to hold any out, those that train
    calibrate as well, and with under ``SPLIT`` held out of a class those that calibrate
    combine. Rows repeated get the same score; an empty table gives none; further
    columns are ignored.
    """
    model = train(docs, labels, id_col)
    rows = docs.select(F.col(id_col), score_column(model).alias("_s"))
    return rows.select(id_col, "_s.score", "_s.text_score", "_s.metadata_score", F.coalesce(F.col("_s.score") >= threshold, F.lit(True)).alias("kept"))


def quality_keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that ``quality_scores`` keeps, with all their columns."""
    return docs.where(F.coalesce(score_column(train(docs, labels, id_col))["score"] >= threshold, F.lit(True)))
