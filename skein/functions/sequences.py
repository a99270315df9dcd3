"""Sequence columns: reverse complement, wrapping, CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters and their complements.
IUPAC = "ACGTUBVDHKMRYSWN"
COMPLEMENTS = "TGCAAVBHDMKYRSWN"


def reverse_complement(seq: Column) -> Column:
    """Upper-cased, reversed, every IUPAC letter replaced by its complement."""
    return F.reverse(F.translate(F.upper(seq), IUPAC, COMPLEMENTS))


def wrap(seq: Column, width: int = 60) -> Column:
    """Line breaks after every ``width`` letters, none at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def _cigar_sum(cigar: Column, kinds: str) -> Column:
    counts = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n.cast("long"))


def overlap_length(cigar: Column) -> Column:
    """Bases of the first segment in an overlap: M, D and N; ``a:b`` gives a, ``*`` 0.

    Anything malformed is null.
    """
    return (
        F.when(cigar == "*", F.lit(0).cast("long"))
        .when(cigar.rlike(r"^(\d+[MIDNSHPX=])+$"), _cigar_sum(cigar, "MDN"))
        .when(cigar.rlike(r"^\d+:\d*$"), F.regexp_extract(cigar, r"^(\d+):", 1).try_cast("long"))
    )


def overlap_query_length(cigar: Column) -> Column:
    """Bases of the second segment in an overlap: M, I and S; ``a:b`` gives b."""
    return (
        F.when(cigar == "*", F.lit(0).cast("long"))
        .when(cigar.rlike(r"^(\d+[MIDNSHPX=])+$"), _cigar_sum(cigar, "MIS"))
        .when(cigar.rlike(r"^\d*:\d+$"), F.regexp_extract(cigar, r":(\d+)$", 1).try_cast("long"))
    )
