"""Whole runs on sample graphs, if a folder of them is named in ``SKEIN_SAMPLE_GRAPHS``: known results by size."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from skein.plans.resolve import resolve
from skein.sources.fasta import read_any

FOLDER = os.environ.get("SKEIN_SAMPLE_GRAPHS", "")
#: Segments and bases of a graph; nv, len, wlen, ec, circular and the sum of copy numbers of its result.
KNOWN = {(17, 487_981): (27, 523_284, 63_725_707, 3_676, True, 27), (49, 120_044): (40, 45_156, 4_150_052, 4_410, False, 61)}


@pytest.mark.skipif(not FOLDER, reason="no sample graphs here")
def test_known_results(spark):
    seen = set()
    for path in sorted(glob.glob(f"{FOLDER}/*.gfa")):
        graph = read_any(spark, f"file://{path}")
        size = tuple(graph.segments.agg(F.count(F.lit(1)), F.sum("len")).first())
        if size in KNOWN:
            found = resolve(graph)
            best = found.paths.first()
            copies = found.copies.agg(F.sum("copy")).first()[0]
            assert (best.nv, best.len, best.wlen, best.ec, best.circ, copies) == KNOWN[size]
            seen.add(size)
    assert seen
