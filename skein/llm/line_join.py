"""The kernels of the exact set-similarity join of lines.

Three passes over groups of sets that share a prefix word. The first looks at sizes,
places and sketches only and finds which entries have a candidate in their group;
the second gets the prefixes of those and leaves the groups in which a pair counts;
the third gets the texts and verifies on the words. A word that very many
prefixes hold is joined by pairs of words: two similar sets of two words or more
have their second common word within one more place than the prefix.

A pair may meet in several groups and counts in one: that of its first common word
(and, where that word is frequent, of the second one). So numbers of links add up,
and a task gives a row for each set, never one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from skein.llm.line_sets import MEDIUM, SMALL, parities
from skein.plans.components import least_roots

#: Larger groups pass the first pass as they are; the others split them into chunks.
CHUNK = 2_048
#: Groups beyond this are compared by matrix products.
FEW = 64
PAIRS_AT_ONCE = 200_000
VALUES_AT_ONCE = 500_000
_ROWS = 512
_COLUMNS = 1_024
_SKETCH = ["s0", "s1", "s2", "s3"]
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: What the first pass's entries consist of, the other ones' entries, and their sets.
ENTRY = {"group": "<u8", "sid": "<i8", "size": "<i4", "place": "<i4", "second": "<i4", **dict.fromkeys(_SKETCH, "<u8")}
MEETING = {"group": "<u8", "a": "<i4", "b": "<i4", "own": "<i4", "member": "<i4", "place": "<i4", "second": "<i4", "m": "<i8"}
SKETCHED = {"sid": "<i8", "size": "<i4", "tokens": "<i4", **dict.fromkeys(_SKETCH, "<u8")}
TEXTS = {"sid": "<i8", "id": "<i8", "number": "<i8", "mark": "<i8", "tokens": "<i4", "bytes": "<i4"}


def homes(*keys: np.ndarray, ranges: int) -> np.ndarray:
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = (h ^ k.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return (h * _MIX >> np.uint64(33)).astype(np.int64) % ranges


def pack_columns(columns: dict[str, np.ndarray], kinds: dict[str, str]) -> bytes:
    return zstandard.compress(b"".join(columns[c].astype(k).tobytes() for c, k in kinds.items()), 1)


def unpack_columns(data: bytes, n: int, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    data, out, at = zstandard.decompress(data), {}, 0
    for c, k in kinds.items():
        out[c] = np.frombuffer(data, k, n, at)
        at += n * np.dtype(k).itemsize
    return out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def entries(tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray, prefix: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups that sets belong to: set, group, place, second place (-1: by one word).

    ``tokens`` holds each set's prefix and one more word, zero for words that no
    other set can have; ``hot`` says by class which words are joined in pairs.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(tokens)) - np.repeat(starts, counts)
    ends = np.repeat(starts + counts, counts)
    wide = tokens.astype(np.uint64) << np.uint64(32)
    begin = np.flatnonzero((place < prefix[owner]) & (tokens != 0))
    often = hot[tokens[begin] % np.uint32(len(hot))]
    cold, first = begin[~often], begin[often]
    times = ends[first] - first - 1
    later, first = spans(first + 1, times), np.repeat(first, times)
    both = tokens[later] != 0
    later, first = later[both], first[both]
    group = np.concatenate([wide[cold], wide[first] | tokens[later].astype(np.uint64)])
    second = np.concatenate([np.full(len(cold), -1), place[later]])
    at = np.concatenate([cold, first])
    return owner[at], group, place[at], second


def _with_folds(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    even, odd = c["s0"] ^ c["s2"], c["s1"] ^ c["s3"]
    return c | {"even": even, "odd": odd, "all": even ^ odd}


def _passes(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of entries of one word that the filters leave."""
    size, place = c["size"], c["place"]
    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[ok], j[ok]
    need = np.ceil(threshold / (1 + threshold) * (size[i] + size[j]) - 1e-9)
    # Words before the shared one are common at most up to the smaller place.
    ok = np.minimum(size[i] - place[i], size[j] - place[j]) + np.minimum(place[i], place[j]) >= need
    i, j, need = i[ok], j[ok], need[ok]
    for words, beyond in ((("all",), 0), (("even", "odd"), SMALL), (_SKETCH, MEDIUM)):
        apart = sum(np.bitwise_count(c[w][i] ^ c[w][j]).astype(np.int64) for w in words)
        ok = (np.minimum(size[i], size[j]) <= beyond) | (size[i] + size[j] - apart >= 2 * need)
        i, j, need = i[ok], j[ok], need[ok]
    return i, j


def _pairs(rank: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within groups, by distance; ``rank`` counts within each group, by size.

    The farther a smaller set is, the smaller it is: beyond the length filter a set
    has no more partners.
    """
    active, away = np.flatnonzero(rank > 0), 1
    least = threshold * size - 1e-9
    active = active[size[active - 1] >= least[active]]
    while len(active):
        steps = max(1, min(PAIRS_AT_ONCE // len(active), 64))
        for at in range(0, len(active), PAIRS_AT_ONCE):
            part = active[at : at + PAIRS_AT_ONCE]
            i, back = np.repeat(part, steps), np.tile(np.arange(away, away + steps), len(part))
            inside = rank[i] >= back
            yield i[inside], i[inside] - back[inside]
        away += steps
        active = active[rank[active] >= away]
        active = active[size[active - away] >= least[active]]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def candidates(c: dict[str, np.ndarray], threshold: float, chunk: int) -> dict[str, np.ndarray]:
    """The entries that have a candidate in their group, and how many of these it has."""
    order = np.lexsort((c["size"], c["group"]))
    order = order[np.repeat(*(lambda s, n: (n > 1, n))(*_runs(c["group"][order])))] if len(order) else order
    c = _with_folds({k: x[order].astype(np.int64) if x.dtype.itemsize == 4 else x[order] for k, x in c.items()})
    starts, sizes = _runs(c["group"])
    take = np.repeat(sizes > chunk, sizes)
    rank = np.where(take, 0, np.arange(len(take)) - np.repeat(starts, sizes))
    for i, j in _pairs(rank, c["size"], threshold):
        open_ = ~(take[i] & take[j])
        i, j = _passes(c, i[open_], j[open_], threshold)
        take[i] = take[j] = True
    m = np.repeat(np.add.reduceat(take.astype(np.int64), starts), sizes) if len(starts) else np.zeros(0, np.int64)
    return {"sid": c["sid"][take], "group": c["group"][take], "place": c["place"][take], "second": c["second"][take], "m": m[take]}


class Groups:
    """Sets with their prefixes, and the pairs among those that meet in a task."""

    def __init__(self, members: dict[str, np.ndarray], tokens: np.ndarray, threshold: float, sizes: np.ndarray, sketches: list[np.ndarray]):
        self.threshold, self.sid, self.sizes = threshold, members["sid"], sizes.astype(np.int64)
        self.sketches = _with_folds(dict(zip(_SKETCH, sketches)))
        # Prefix words by number; one that no other set has is like none.
        counts = members["tokens"].astype(np.int64)
        self.first = np.cumsum(counts) - counts
        distinct, self.prefix = np.unique(tokens, return_inverse=True)
        alone = np.flatnonzero(tokens == 0)
        self.prefix[alone] = len(distinct) + np.arange(len(alone))
        self.kinds = len(distinct) + len(alone) + 1

    @staticmethod
    def _common(values: np.ndarray, kinds: int, si: np.ndarray, ni: np.ndarray, sj: np.ndarray, nj: np.ndarray) -> np.ndarray:
        """How many values each pair of runs has in common."""
        out = np.zeros(len(si), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(ni + nj) // VALUES_AT_ONCE, prepend=0))
        for part in np.split(np.arange(len(si)), cuts):
            if len(part):
                sides = [np.repeat(np.arange(len(part)), n[part]) * kinds + values[spans(s[part], n[part])] for s, n in ((si, ni), (sj, nj))]
                keys = np.sort(np.concatenate(sides))
                out[part] = np.bincount(keys[1:][keys[1:] == keys[:-1]] // kinds, minlength=len(part))
        return out

    @staticmethod
    def _products(values: np.ndarray, kinds: int, sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """The same for all pairs of a run of either side."""
        sides = [(np.repeat(np.arange(len(n)), n), values[spans(s, n)]) for s, n in ((sa, na), (sb, nb))]
        shared = np.intersect1d(sides[0][1], sides[1][1])
        column = np.full(kinds, -1)
        column[shared] = np.arange(len(shared))
        out = np.zeros((len(na), len(nb)), np.float32)
        for at in range(0, len(shared), _COLUMNS):
            both = []
            for (row, value), n in zip(sides, (len(na), len(nb))):
                x = np.zeros((n, min(_COLUMNS, len(shared) - at)), np.float32)
                own = (column[value] >= at) & (column[value] < at + x.shape[1])
                x[row[own], column[value[own]] - at] = 1
                both.append(x)
            out += both[0] @ both[1].T
        return out

    def _check(self, e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        """Take those of the pairs of entries that count here."""
        x, y = e["member"][i], e["member"][j]
        for begin, end in (("zero", "place"), ("next", "second")):
            if len(i):
                runs = [(self.first[m] + e[begin][k], np.maximum(0, e[end][k] - e[begin][k])) for m, k in ((x, i), (y, j))]
                ok = self._common(self.prefix, self.kinds, *runs[0], *runs[1]) == 0
                i, j, x, y = i[ok], j[ok], x[ok], y[ok]
        if len(i):
            self._take(e, i, j)

    def _check_all(self, e: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """The same for many pairs of an entry of ``a`` and one of ``b`` (both ascending)."""
        mask = np.zeros((len(a), len(b)), dtype=bool)
        mask[np.searchsorted(a, i), np.searchsorted(b, j)] = True
        x, y = e["member"][a], e["member"][b]
        for begin, end in (("zero", "place"), ("next", "second")):
            runs = [(self.first[m] + e[begin][k], np.maximum(0, e[end][k] - e[begin][k])) for m, k in ((x, a), (y, b))]
            mask &= self._products(self.prefix, self.kinds, *runs[0], *runs[1]) == 0
        i, j = np.nonzero(mask)
        if len(i):
            self._take_all(e, a, b, a[i], b[j])

    def run(self, e: dict[str, np.ndarray]) -> None:
        """Go through the members of each group (and pair of chunks)."""
        e = e | {"size": self.sizes[e["member"]]}
        order = np.lexsort((e["member"], e["size"], e["own"], e["b"], e["a"], e["group"]))
        e = {k: x[order] if x.dtype.itemsize == 8 else x[order].astype(np.int64) for k, x in e.items()}
        # An entry counts once in a group, whatever a word's hash does.
        starts, _ = _runs(e["group"], e["a"], e["b"], e["member"])
        e = {k: x[starts] for k, x in e.items()}
        e |= {"zero": np.zeros(len(starts), np.int64), "next": np.where(e["second"] < 0, 0, e["place"] + 1)}
        e |= {k: x[e["member"]] for k, x in self.sketches.items()}
        starts, sizes = _runs(e["group"], e["a"], e["b"])
        many = (sizes > FEW) | (e["a"][starts] != e["b"][starts])
        rank = np.where(np.repeat(many, sizes), 0, np.arange(len(e["group"])) - np.repeat(starts, sizes))
        for i, j in _pairs(rank, e["size"], self.threshold):
            self._check(e, *_passes(e, i, j, self.threshold))
        for s, n in zip(starts[many].tolist(), sizes[many].tolist()):
            own = np.arange(s, s + n)
            split = e["a"][s] != e["b"][s]
            left = own[e["own"][own] == e["a"][s]] if split else own
            right = own[e["own"][own] == e["b"][s]] if split else own
            for at in range(0, len(left), _ROWS):
                part = left[at : at + _ROWS]
                i, j = np.repeat(part, len(right)), np.tile(right, len(part))
                if not split:
                    i, j = i[i < j], j[i < j]
                i, j = _passes(e, i, j, self.threshold)
                if len(i) > 8 * (len(part) + len(right)):
                    self._check_all(e, part, right, i, j)
                else:
                    self._check(e, i, j)



class Pruner(Groups):
    """Finds the entries that a pair counts for, as far as sketches and prefixes tell."""

    def __init__(self, members: dict[str, np.ndarray], tokens: np.ndarray, threshold: float):
        super().__init__(members, tokens, threshold, members["size"], [members[s] for s in _SKETCH])
        self.parts: list[np.ndarray] = []

    def _take(self, e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        at = np.unique(np.concatenate([i, j]))
        self.parts.append(np.column_stack([self.sid[e["member"][at]], e["group"][at].view(np.int64), e["place"][at], e["second"][at], e["m"][at]]))

    def _take_all(self, e: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        self._take(e, i, j)

    def found(self) -> pa.RecordBatch:
        rows = np.unique(np.vstack([*self.parts, np.zeros((0, 5), np.int64)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["sid", "group", "place", "second", "m"])


class Verifier(Groups):
    """Sets with their words, and the links among those that meet in a task."""

    def __init__(self, members: dict[str, np.ndarray], tokens: np.ndarray, texts: list[bytes], threshold: float):
        self.rank = np.empty(len(texts), np.int64)  # earlier lines first
        self.rank[np.lexsort((members["mark"], members["number"], members["id"]))] = np.arange(len(texts))
        # Words get their numbers by the bytes themselves.
        words = [t.lower().split() for t in texts]
        known = dict.fromkeys(w for x in words for w in x)
        known.update(zip(known, range(len(known))))
        lengths = np.array([len(x) for x in words])
        flat = np.array([known[w] for x in words for w in x], np.int64)
        self.words = max(1, len(known))
        keys = np.sort(np.repeat(np.arange(len(texts)), lengths) * self.words + flat)
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        self.values, owner = keys % self.words, keys // self.words
        sizes = np.bincount(owner, minlength=len(texts))
        self.starts = np.cumsum(sizes) - sizes
        super().__init__(members, tokens, threshold, sizes, parities((self.values.astype(np.uint64) + np.uint64(1)) * _MIX, self.starts, sizes))
        self.links = np.zeros(len(texts), np.int64)
        self.lost = np.zeros(len(texts), dtype=bool)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def _enough(self, both: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return both >= self.threshold * (sizes - both) - 1e-9

    def _keep(self, i: np.ndarray, j: np.ndarray) -> None:
        self.links += np.bincount(i, minlength=len(self.links)) + np.bincount(j, minlength=len(self.links))
        self.lost[np.where(self.rank[i] > self.rank[j], i, j)] = True
        self.edges.append((i, j))
        if sum(len(a) for a, _ in self.edges) > 10 * PAIRS_AT_ONCE:
            nodes, roots = least_roots(*map(np.concatenate, zip(*self.edges)))
            self.edges = [(nodes, roots)]

    def _take(self, e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        x, y = e["member"][i], e["member"][j]
        both = self._common(self.values, self.words, self.starts[x], self.sizes[x], self.starts[y], self.sizes[y])
        ok = self._enough(both, self.sizes[x] + self.sizes[y])
        self._keep(x[ok], y[ok])

    def _take_all(self, e: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        x, y = e["member"][a], e["member"][b]
        both = self._products(self.values, self.words, self.starts[x], self.sizes[x], self.starts[y], self.sizes[y])
        x, y = e["member"][i], e["member"][j]
        ok = self._enough(both[np.searchsorted(a, i), np.searchsorted(b, j)], self.sizes[x] + self.sizes[y])
        self._keep(x[ok], y[ok])

    def found(self) -> pa.RecordBatch:
        """A row for each linked set: number of links, whether an earlier one is similar, least set reached here."""
        own = np.flatnonzero(self.links)
        root = np.arange(len(self.sid))
        if self.edges:
            a, b = map(np.concatenate, zip(*self.edges))
            # By the sets' own numbers, so that the least one is the same everywhere.
            nodes, tops = least_roots(self.sid[a], self.sid[b])
            root = tops[np.minimum(np.searchsorted(nodes, self.sid[own]), len(nodes) - 1)]
        columns = [pa.array(self.sid[own]), pa.array(self.links[own]), pa.array(self.lost[own]), pa.array(root[: len(own)].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["sid", "links", "lost", "root"])
