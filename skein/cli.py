"""Command line: ``python -m skein.cli graph.gfa [source[+-]] [target[+-]]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from skein.config import Config
from skein.plans.resolve import resolve
from skein.sources.fasta import read_any
from skein.sources.gfa import GfaOptions
from skein.sources.sinks import report_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein", description="Find the best path through an assembly graph.")
    p.add_argument("file")
    p.add_argument("source", nargs="?")
    p.add_argument("target", nargs="?")
    p.add_argument("-c", "--min-copy", type=int, default=1, help="least copy number; 0 also leaves zero coverages alone")
    p.add_argument("-C", "--max-copy", type=int, default=10)
    p.add_argument("-e", "--lift-arcs", type=int, default=1, help="0 leaves zero coverages of arcs alone")
    p.add_argument("-X", "--floor", type=float, default=0.0, help="lower limit of the average coverage; copy numbers round up")
    p.add_argument("-d", "--circular-share", type=float, default=1.0)
    p.add_argument("-N", "--max-path", type=int, default=10_000_000)
    p.add_argument("-p", "--partition", action="store_true", help="search between dominators (needs source and target)")
    p.add_argument("-a", "--adjust", action="store_true", help="refit copy numbers to the layout")
    p.add_argument("-o", "--output", help="folder for the report; without it, lines go to the screen")
    p.add_argument("--edge-c-tag", default="EC:i")
    p.add_argument("--kmer-c-tag")
    p.add_argument("--seq-c-tag")
    p.add_argument("--min-edge-cov", type=int, default=0)
    p.add_argument("--min-seq-cov", type=float, default=0.0)
    p.add_argument("--neighbour-steps", type=int, default=0)
    p.add_argument("-L", "--neighbour-len", type=int, default=0)
    p.add_argument("--bub-check", action="store_true")
    p.add_argument("--edge-to-seq", action="store_true")
    return p


def config_of(args: argparse.Namespace) -> Config:
    gfa = GfaOptions(args.edge_c_tag, args.kmer_c_tag, args.seq_c_tag, args.min_copy != 0, args.lift_arcs != 0)
    if args.partition and not (args.source and args.target):
        print("warning: partitioning needs a source and a target", file=sys.stderr)
    return Config(
        gfa=gfa, min_copy=args.min_copy, max_copy=args.max_copy, floor=args.floor, circular_share=args.circular_share, max_paths=args.max_path,
        partition=args.partition and bool(args.source and args.target), adjust=args.adjust, min_arc_cov=args.min_edge_cov, min_seg_cov=args.min_seq_cov,
        neighbour_steps=args.neighbour_steps, neighbour_len=args.neighbour_len, bubbles=args.bub_check, arcs_to_segments=args.edge_to_seq,
        source=args.source, target=args.target,
    )


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = config_of(args)
    spark = SparkSession.builder.appName("skein").getOrCreate()
    found = resolve(read_any(spark, args.file, config.gfa), config)
    lines = report_lines(found.copies, found.paths.withColumnRenamed("path", "v"), found.graph, config.source, config.target)
    order = ["component", "part", "at"]
    if args.output:
        lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(args.output)
    else:
        for row in lines.orderBy(*order).toLocalIterator():
            print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
