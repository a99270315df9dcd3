"""Oriented vertex ids: ``seg_id * 2``, plus 1 for the reverse strand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flip(v: Column | str) -> Column:
    """The same segment on the other strand."""
    return _col(v).bitwiseXOR(F.lit(1).cast("long"))


def segment_of(v: Column | str) -> Column:
    return F.shiftright(_col(v), 1)


def is_reverse(v: Column | str) -> Column:
    return _col(v).bitwiseAND(F.lit(1).cast("long")) == 1


def oriented(seg: Column | str, strand: Column | str) -> Column:
    """``seg`` with strand '+' or '-'."""
    return F.shiftleft(_col(seg), 1) + F.when(_col(strand) == "-", 1).otherwise(0).cast("long")


def flip_path(path: Column | str) -> Column:
    """A path read from its other end: reversed, all strands flipped."""
    return F.reverse(F.transform(_col(path), flip))


def strand_sign(v: Column | str) -> Column:
    return F.when(is_reverse(v), "-").otherwise("+")
