"""All runs of a sequence over any ordered alphabet, in linear time (Ellert and Fischer, 2021).

A run's Lyndon roots are longest Lyndon words at their places, in one of the two orders
of the alphabet. So it is enough to find, for both orders, each place's next smaller
suffix: the Lyndon array. Every such pair of places (i, j) is a candidate of period
j - i; how far the text agrees to the right of both and to the left of both says
whether it lies in a run. Symbols are only compared, never numbered or hashed.

Places are passed once from left to right, with a stack of those whose next smaller
suffix is not yet known. Extensions that have been matched are reused in two ways: the
common prefix of a place with the next one on the stack follows from those with the
one above it, and within a stretch known to repeat an earlier one the comparisons of
the earlier one hold. So symbols are matched from the rightmost matched place on only.
The extensions to the left are reused alike, from right to left.
"""

from __future__ import annotations

from collections.abc import Sequence


class _End:
    """What stands before and after the text: neither smaller nor greater than a symbol, nor equal to one."""

    def __eq__(self, other: object) -> bool:
        return False

    __lt__ = __gt__ = __eq__
    __hash__ = None


def smaller_suffixes(text: Sequence, up: bool = True) -> list[tuple[int, int, int]]:
    """``(i, j, length)`` for each place i whose next smaller suffix, at j, begins with the same symbol.

    ``length`` is that of the two suffixes' common prefix. The order of symbols is turned
    round unless ``up``; a proper prefix is smaller in both.
    """
    n = len(text)
    text = [*text, _End()]
    following, shared = [n] * n, [0] * n  # the next smaller suffix, the prefix common with it
    before, own = [-1] * n, [0] * n  # the previous smaller suffix, the prefix common with it
    left = right = end = 0  # the last match: text[left:] and text[right:] agree up to the place end
    pairs = []
    above = text[0]
    for j in range(1, n):
        symbol, i, other, known = text[j], j - 1, above, 0
        above = symbol
        while True:
            if up:
                while other > symbol:
                    i = before[i]
                    other = text[i]
            else:
                while other < symbol:
                    i = before[i]
                    other = text[i]
            if other != symbol:
                break
            if known and own[last] != known:
                # j shares ``known`` symbols with the place last, which shares own[last] with i.
                length = min(known, own[last])
            else:
                length, inside = max(known, 1), False
                if j < end:
                    # The same comparison, where this stretch was read before.
                    shift = right - left
                    a, b = (i - shift if i >= right else i), j - shift
                    seen = shared[a] if following[a] == b else own[b] if before[b] == a else 0
                    if seen:
                        length, inside = min(seen, end - j), j + seen < end
                if not inside:
                    while text[i + length] == text[j + length]:
                        length += 1
                    if j + length >= end:
                        left, right, end = i, j, j + length
            first, second = text[i + length], text[j + length]
            if first < second if up else first > second:
                own[j] = length
                break
            following[i], shared[i] = j, length
            pairs.append((i, j, length))
            known, last, i = length, i, before[i]
            other = text[i]
        before[j] = i
    return pairs


def _runs_of(text: Sequence, up: bool) -> set[tuple[int, int, int]]:
    reach: dict[int, tuple[int, int]] = {}  # by left place: the right one, how far the text agrees to the left of both
    found = set()
    low = high = start = len(text)  # the last match: text[:low] and text[:high] agree down to the place start
    for i, j, common in sorted(smaller_suffixes(text, up), reverse=True):
        length, inside = 0, False
        if start < i <= low:
            shift = high - low
            b, seen = reach.get(i + shift, (-1, 0))
            if b == (j + shift if j <= low else j):
                length, inside = min(seen, i - start), i - seen > start
        if not inside:
            while length < i and text[i - length - 1] == text[j - length - 1]:
                length += 1
            if i - length <= start:
                low, high, start = i, j, i - length
        reach[i] = j, length
        if length < j - i <= length + common:
            found.add((i - length, j + common - i + length, j - i))
    return found


def runs(text: Sequence, least: int = 2) -> list[tuple[int, int, int]]:
    """Every run of at least ``least`` symbols as ``(start, length, period)``, in this order."""
    return sorted(r for r in _runs_of(text, True) | _runs_of(text, False) if r[1] >= least)
