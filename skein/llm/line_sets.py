"""Lines as sets of word hashes, for whole slices of texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Small enough for a slice's arrays to stay in a core's cache.
SLICE_BYTES = 400_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LONG = 64
#: Sets of up to so many words have sketches of 64 or 128 bits; larger ones, of 256.
SMALL, MEDIUM = 48, 150
_32, _29 = np.uint64(32), np.uint64(29)


def _mix(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> _32)) * by
    return h ^ (h >> _29)


def slices(ids: pa.Array, texts: pa.Array, marks: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Rows in slices of about ``size`` bytes of text."""
    out: tuple[list, list, list] = ([], [], [])
    held = 0
    for row in zip(ids.to_pylist(), texts, marks.to_pylist()):
        text = row[1].as_py() or b""
        for column, value in zip(out, (row[0], text, row[2])):
            column.append(value)
        held += len(text)
        if held >= size:
            yield out
            out, held = ([], [], []), 0
    if out[0]:
        yield out


@dataclass
class Words:
    """The words of some texts: hash, and the line each is in; lines count through the texts."""

    hashes: np.ndarray
    lines: np.ndarray
    first_lines: np.ndarray  # of each text

    @staticmethod
    def _spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The texts as one, its bytes, and where its words start and end."""
        joined = b"\n".join(texts).lower()
        data = np.frombuffer(joined + b"\n" + b"\0" * 8, dtype=np.uint8)
        space = np.concatenate([[True], _SPACE[data[: len(joined) + 1]]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        return joined, data, edges[::2], edges[1::2]

    @classmethod
    def hashes_of(cls, texts: list[bytes]) -> np.ndarray:
        joined, data, starts, ends = cls._spans(texts)
        return cls._hash(joined, data, starts, ends - starts)

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        joined, data, starts, ends = cls._spans(texts)
        breaks = np.flatnonzero(data[: len(joined)] == 10)
        lengths = np.array([0] + [len(t) + 1 for t in texts], dtype=np.int64)
        first = np.searchsorted(breaks, np.cumsum(lengths)[:-1])
        return cls(cls._hash(joined, data, starts, ends - starts), np.searchsorted(breaks, starts), first)

    @staticmethod
    def _hash(joined: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """64 bits from length and bytes, eight at a time; xxHash for the longest words."""
        at_byte = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        out = sizes.astype(np.uint64) * _ODD[3]
        own = np.flatnonzero(sizes <= _LONG)
        at = 0
        while len(own):
            here = at_byte[starts[own] + at] & _MASKS[np.minimum(sizes[own] - at, 8)]
            out[own] = _mix(out[own] ^ (here * _ODD[0]), _ODD[1])
            at += 8
            own = own[sizes[own] > at]
        for i in np.flatnonzero(sizes > _LONG).tolist():
            out[i] = xxhash.xxh64_intdigest(joined[starts[i] : starts[i] + sizes[i]])
        return _mix(out, _ODD[2])


def parities(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Four words of parities for each run of hashes: sets differ in as many elements at least as these in bits.

    Small sets have them folded into two words or one; the others are zero.
    """
    if not len(starts):
        return [np.zeros(0, np.uint64)] * 4
    bit = np.uint64(1) << (hashes >> np.uint64(56) & np.uint64(63))
    word = hashes >> np.uint64(62)
    w = [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), starts) for k in range(4)]
    for limit, folds in ((MEDIUM, ((0, 2), (1, 3))), (SMALL, ((0, 1),))):
        few = sizes <= limit
        for into, out in folds:
            w[into] = np.where(few, w[into] ^ w[out], w[into])
            w[out] = np.where(few, np.uint64(0), w[out])
    return w


@dataclass
class Sets:
    """Lines with words as sets: each set's words adjacent, rarest first."""

    hashes: np.ndarray
    starts: np.ndarray  # of each set in hashes
    sizes: np.ndarray
    rows: np.ndarray  # of each set, the text
    numbers: np.ndarray  # and the line in it

    @classmethod
    def of(cls, texts: list[bytes], counts: np.ndarray | None = None) -> Sets:
        words = Words.of(texts)
        used, line = np.unique(words.lines, return_inverse=True)
        rarity = np.zeros(len(line), np.uint64) if counts is None else (np.log2(1.0 + counts[(words.hashes % np.uint64(len(counts))).astype(np.int64)]) * 1024).astype(np.uint64)
        h = words.hashes
        bits = max(1, len(used).bit_length())
        # One sort key holds the line, the rarity (16 bits) and what fits of the hash.
        key = line.astype(np.uint64) << np.uint64(64 - bits)
        if bits < 48:
            key |= rarity << np.uint64(48 - bits)
            key |= h >> np.uint64(16 + bits)
        order = np.argsort(key)
        tied = key[order[1:]] == key[order[:-1]]
        if bits >= 48 or (tied & (h[order[1:]] != h[order[:-1]])).any():
            order = np.lexsort((h, rarity, line))
        line, h = line[order], h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        line, h = line[new], h[new]
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        rows = np.searchsorted(words.first_lines, used, side="right") - 1
        return cls(h, starts, np.diff(np.append(starts, len(h))), rows, used - words.first_lines[rows])

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name a set whatever its order."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(_mix(np.add.reduceat(_mix(self.hashes ^ c, d), self.starts) + self.sizes.astype(np.uint64), c).view(np.int64) for c, d in ((_ODD[0], _ODD[1]), (_ODD[2], _ODD[3])))

    def sketches(self) -> list[np.ndarray]:
        """``parities`` of each set, as signed numbers."""
        return [x.view(np.int64) for x in parities(self.hashes, self.starts, self.sizes)]
