"""Reading FASTA and FASTQ.

Both are read as lines, in parts, and records are put together by running counts: of
headers in FASTA, of lines in FASTQ with four lines a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.graph import AssemblyGraph
from skein.plans.dense import dense_index
from skein.plans.scratch import materialise
from skein.sources.gfa import GfaOptions, read_gfa

SCHEMA = "file string, record long, name string, comment string, seq string, qual string"


def _records(name: str, lines: Iterator[str]) -> Iterator[tuple]:
    """Parse one file's lines; sequences and qualities may be wrapped."""
    number, head, seq, qual, state = -1, None, [], [], "seq"
    size = 0

    def made() -> tuple:
        title, _, comment = head.partition(" ") if "\t" not in head.split(" ")[0] else head.partition("\t")
        bases = "".join(seq)
        quality = "".join(qual) if state == "qual" else None
        if quality is not None and len(quality) != len(bases):
            raise ValueError(f"{name}: record {title!r} has a quality of another length")
        return name, number, title, comment or None, bases, quality

    for line in lines:
        line = line.rstrip("\r")
        if state == "qual" and size < sum(map(len, seq)):
            qual.append(line)
            size += len(line)
        elif line[:1] in (">", "@"):
            if head is not None:
                yield made()
            number, head, seq, qual, size, state = number + 1, line[1:], [], [], 0, "seq"
        elif line[:1] == "+" and head is not None:
            state = "qual"
        elif head is not None:
            seq.append(line)
    if head is not None:
        yield made()


def ordered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, block, at, line``: lines in the order of blocks and then ``at``; large files are read by many tasks."""
    text = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = text.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    return materialise(lines, "lines")[0]


def _running(lines: DataFrame, counted: Column, name: str) -> DataFrame:
    """``lines`` with the number of ``counted`` lines of their file up to and with each."""
    rows = lines.withColumn("_c", counted.cast("long"))
    blocks = rows.groupBy("file", "block").agg(F.sum("_c").alias("_n"))
    # A row for each block read: small windows.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.sum("_c").over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.withColumn("_in", inside).join(starts, ["file", "block"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_c", "_in", "_start")


def _title(head: Column) -> list[Column]:
    """``name, comment`` of a header: up to the first blank or tab, and what follows it."""
    return [F.regexp_extract(head, r"(?s)^.([^ \t]*)", 1).alias("name"), F.nullif(F.regexp_extract(head, r"(?s)^.[^ \t]*[ \t](.*)$", 1), F.lit("")).alias("comment")]


def _fasta(lines: DataFrame) -> DataFrame:
    head = F.substring("line", 1, 1).isin(">", "@")
    rows = _running(lines, head, "_n").where("_n > 0")
    parts = rows.groupBy("file", (F.col("_n") - 1).alias("record")).agg(F.max(F.when(head, F.col("line"))).alias("head"), F.sort_array(F.collect_list(F.when(~head, F.struct("block", "at", "line")))).alias("parts"))
    return parts.select("file", "record", *_title(F.col("head")), F.array_join(F.transform("parts", lambda p: p["line"]), "").alias("seq"), F.lit(None).cast("string").alias("qual"))


def _fastq(numbered: DataFrame) -> DataFrame:
    """Records of four lines each, by the lines' numbers ``n`` from 1."""
    at = (F.col("n") - 1) % 4
    line = lambda k: F.max(F.when(at == k, F.col("line")))
    rows = numbered.groupBy("file", F.floor((F.col("n") - 1) / 4).cast("long").alias("record")).agg(line(0).alias("head"), line(1).alias("seq"), line(3).alias("qual"))
    return rows.select("file", "record", *_title(F.col("head")), "seq", "qual")


def kinds_of(lines: DataFrame) -> DataFrame:
    """``file, kind`` by the first character of the first line that isn't empty: fasta, fastq, gfa; else null."""
    first = lines.where("line <> ''").groupBy("file").agg(F.min_by("line", F.struct("block", "at")).alias("line"))
    mark = F.substring("line", 1, 1)
    gfa = F.col("line").rlike("^([HSLPWCJEGOUF]\t|#|H$)")
    return first.select("file", F.when(mark == ">", "fasta").when(mark == "@", "fastq").when(gfa, "gfa").alias("kind"))


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, record, name, comment, seq, qual`` of FASTA or FASTQ files, gzip included.

    FASTA files, and FASTQ files of four lines a record, are read in parts by many
    tasks: records are found again by running counts of headers or lines. Only files with
    wrapped qualities, where a record's end depends on all lines before, are read by a task
    each. Qualities shorter or longer than their sequence raise an error; files without
    a header give no rows.
    """
    lines = ordered_lines(spark, paths)
    marks = lines.groupBy("file").agg(F.max(F.substring("line", 1, 1) == "+").alias("plus"))
    kinds = kinds_of(lines).join(marks, "file")
    plain = kinds.where("kind IS DISTINCT FROM 'fastq' AND NOT plus").select("file")
    rest = lines.join(plain, "file", "left_anti")
    numbered, _ = materialise(_running(rest, F.lit(True), "n"), "numbered-lines")
    at = (F.col("n") - 1) % 4
    # Lines of a record are neighbours, so a window by record holds four.
    own = Window.partitionBy("file", F.floor((F.col("n") - 1) / 4))
    size = lambda k: F.max(F.when(at == k, F.length("line"))).over(own)
    odd = ((at == 0) & ~F.col("line").startswith("@")) | ((at == 2) & ~F.col("line").startswith("+")) | F.coalesce(size(1) != size(3), F.lit(True))
    wrapped, _ = materialise(numbered.withColumn("odd", odd).where("odd").select("file").distinct(), "wrapped")
    found = _fasta(lines.join(plain, "file", "left_semi")).unionByName(_fastq(numbered.join(wrapped, "file", "left_anti")))
    names = [r["file"] for r in wrapped.collect()]
    if names:
        files = spark.read.text(names, wholetext=True).select(F.input_file_name().alias("file"), "value")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for file, text in zip(frame["file"], frame["value"]):
                    yield pd.DataFrame(list(_records(file, iter(text.split("\n")))), columns=[c.split()[0] for c in SCHEMA.split(", ")])

        found = found.unionByName(files.mapInPandas(run, SCHEMA))
    return found


def read_any(spark: SparkSession, paths: str | list[str], options: GfaOptions = GfaOptions()) -> AssemblyGraph:
    """A graph from GFA files, or segments from FASTA or FASTQ files, as their first lines say."""
    kinds = {r["kind"] for r in kinds_of(ordered_lines(spark, paths)).collect()}
    if kinds <= {"gfa"}:
        return read_gfa(spark, paths, options)
    if kinds <= {"fasta", "fastq"}:
        return sequences_as_graph(read_sequences(spark, paths))
    raise ValueError(f"neither GFA nor sequences, or both: {sorted(map(str, kinds))}")


def sequences_as_graph(records: DataFrame) -> AssemblyGraph:
    """Sequences as segments without coverage or arcs, in the order of files and records."""
    numbered = dense_index(records.select("file", "record", "name", "seq"), ["file", "record"], "seg_id")
    segments = numbered.select("seg_id", "name", "seq", F.length("seq").cast("long").alias("len"), F.lit(0).cast("long").alias("cov"))
    arcs = records.sparkSession.createDataFrame([], "v long, w long, ln long, ls long, cov long, link_id long, comp boolean")
    return AssemblyGraph(segments, arcs)
