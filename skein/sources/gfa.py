"""Reading GFA into an assembly graph.

Lines are parsed with string functions. Segments get dense ids in the order in
which names first appear, in S or in L lines; Spark reads a file in parts, so a
line's place is the pair of its file and its row number in reading order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.ids import oriented
from skein.functions.sequences import overlap_length
from skein.operators.graph import AssemblyGraph, normalise
from skein.plans.dense import dense_index
from skein.plans.scratch import materialise

#: A tag is two letters (the second may be a digit) and a type.
TAG = re.compile(r"[A-Za-z][A-Za-z0-9]:[AifZB]")


def is_valid_tag(tag: str) -> bool:
    return TAG.fullmatch(tag) is not None


@dataclass(frozen=True)
class GfaOptions:
    """Which tags hold coverages; zero coverages become one where the floor is set.

    ``kmer_tag`` counts k-mers (divided by the length); without it ``seq_tag`` is
    the coverage itself; without both, KC:i and then FC:i are k-mer counts.
    """

    edge_tag: str = "EC:i"
    kmer_tag: str | None = None
    seq_tag: str | None = None
    lift_segments: bool = True
    lift_arcs: bool = True

    def __post_init__(self):
        for tag in (self.edge_tag, self.kmer_tag, self.seq_tag):
            if tag is not None and not is_valid_tag(tag):
                raise ValueError(f"not a tag: {tag!r}")


def _from(text: Column, place: int) -> Column:
    """``text`` from a place (of 1, 2, ...) to its end."""
    return F.substring(text, F.lit(place), F.length(text))


def tag_value(fields: Column, tag: str) -> Column:
    """The first field ``TG:t:value`` with that name and type, as a double; else null.

    The first field of that name decides: of another type, it gives null.
    """
    name = F.filter(fields, lambda f: f.startswith(tag[:2] + ":"))
    first = F.get(name, F.lit(0))
    return F.when(F.substring(first, 1, 5) == tag + ":", _from(first, 6).try_cast("double"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: in a lambda, Spark works out an expression again wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_tags(fields: Column) -> Column:
    """The fields that are tags, of repeated names the first ones only."""

    def first(good: Column, names: Column) -> Column:
        return F.transform(F.array_distinct(names), lambda name: F.get(good, (F.array_position(names, name) - 1).cast("int")))

    good = F.filter(fields, lambda f: f.rlike(r"^[A-Za-z][A-Za-z0-9]:[AifZB]:"))
    return _once(good, lambda good: _once(F.transform(good, lambda f: F.substring(f, 1, 2)), lambda names: first(good, names)))


def _tag_map(fields: Column, value: Callable[[Column, Column], Column]) -> Column:
    """A map of tag name to ``value`` of its type and text."""
    entry = lambda f: F.struct(F.substring(f, 1, 2).alias("key"), value(F.substring(f, 4, 1), _from(f, 6)).alias("value"))
    return F.map_from_entries(F.transform(_first_tags(fields), entry))


def all_tags(fields: Column) -> Column:
    """A map of tag name to ``type, value``; of repeated names the first counts."""
    return _tag_map(fields, lambda kind, text: F.struct(kind.alias("type"), text.alias("value")))


def _typed(kind: Column, text: Column) -> Column:
    """A tag's value as a VARIANT, by its type; null if it isn't of that type."""
    # JSON has no numbers for NaN and infinities: they are text.
    finite = lambda x: ~(F.isnan(x) | (F.abs(x) == float("inf")))
    real = lambda t: _once(t.try_cast("double"), lambda x: F.when(finite(x), x.cast("variant")).otherwise(x.cast("string").cast("variant")))
    # No number starts with ":" to "~"; a cast that fails is an exception inside, which takes long.
    whole = lambda t: F.when((t < ":") | (t > "~"), t.try_cast("bigint")).cast("variant")
    # B: a letter for the numbers' size, then the numbers; f are reals, all others whole.
    items = F.split(_from(text, 3), ",")
    sub = F.substring(text, 1, 1)
    values = F.when(sub == "f", F.transform(items, real)).when(sub.isin(*"cCsSiI"), F.transform(items, whole))
    array = _once(values, lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.to_variant_object(F.struct(sub.alias("subtype"), v.alias("values")))))
    return F.when(kind == "i", whole(text)).when(kind == "f", real(text)).when(kind == "B", array).otherwise(text.cast("variant"))


def typed_tags(fields: Column) -> Column:
    """A map of tag name to its value as a VARIANT, whole: integers, doubles, text, or for B ``{subtype, values}``.

    Of repeated names the first counts; a value that its type doesn't allow is null.
    """
    return _tag_map(fields, _typed)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``line`` (fields are split later) and its ``place``, gzip files included."""
    text = spark.read.text(paths).where("value <> ''")
    return text.select(F.regexp_replace("value", r"\r$", "").alias("line"), F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")).alias("place"))


def segment_rows(lines: DataFrame, options: GfaOptions) -> DataFrame:
    """``place, name, seq, len, cov, fields`` of the S lines."""
    rows = lines.where(F.col("line").startswith("S\t")).select("place", F.split("line", "\t").alias("f"))
    tags = F.slice("f", 4, F.greatest(F.lit(0), F.size("f") - 3))
    seq = F.when(F.get("f", F.lit(2)) != "*", F.get("f", F.lit(2)))
    rows = rows.select(
        "place",
        F.get("f", F.lit(1)).alias("name"),
        F.when(F.size("f") < 3, F.raise_error(F.concat(F.lit("S line without a sequence field: "), F.get("f", F.lit(1))))).otherwise(seq).alias("seq"),
        tags.alias("tags"),
    )
    rows = rows.withColumn("len", F.coalesce(F.length("seq").cast("long"), tag_value(F.col("tags"), "LN:i").cast("long"), F.lit(0).cast("long")))
    per_base = lambda tag: F.try_divide(tag_value(F.col("tags"), tag), F.nullif(F.col("len"), F.lit(0)))
    counted = lambda tag: F.when(F.col("len") > 0, per_base(tag)).otherwise(tag_value(F.col("tags"), tag))
    if options.kmer_tag:
        cov = counted(options.kmer_tag)
    elif options.seq_tag:
        cov = tag_value(F.col("tags"), options.seq_tag)
    else:
        cov = F.coalesce(counted("KC:i"), counted("FC:i"))
    cov = F.coalesce(F.floor(cov).cast("long"), F.lit(0).cast("long"))
    if options.lift_segments:
        cov = F.greatest(cov, F.lit(1).cast("long"))
    return rows.withColumn("cov", cov)


def link_rows(lines: DataFrame, options: GfaOptions) -> DataFrame:
    """``place, a, a_strand, b, b_strand, ls, cov`` of the L lines.

    With a missing or malformed overlap the overlap is 0 and the tags are not
    read, so the coverage is that of a link without one.
    """
    rows = lines.where(F.col("line").startswith("L\t")).select("place", F.split("line", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    overlap = overlap_length(at(5))
    cov = F.when(overlap.isNotNull(), tag_value(F.slice("f", 7, F.greatest(F.lit(0), F.size("f") - 6)), options.edge_tag))
    cov = F.coalesce(F.floor(cov).cast("long"), F.lit(0).cast("long"))
    if options.lift_arcs:
        cov = F.greatest(cov, F.lit(1).cast("long"))
    return rows.select("place", at(1).alias("a"), at(2).alias("a_strand"), at(3).alias("b"), at(4).alias("b_strand"), F.coalesce(overlap, F.lit(0).cast("long")).alias("ls"), cov.alias("cov"))


def _graph(segments: DataFrame, links: DataFrame) -> AssemblyGraph:
    seen = segments.select("name", F.struct("place", F.lit(0).alias("field")).alias("at"))
    for field, column in enumerate(("a", "b"), 1):
        seen = seen.unionByName(links.select(F.col(column).alias("name"), F.struct("place", F.lit(field).alias("field")).alias("at")))
    ids, _ = materialise(dense_index(seen.groupBy("name").agg(F.min("at").alias("at")), ["at"], "seg_id").select("name", "seg_id"), "names")
    zero = F.lit(0).cast("long")
    own = segments.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.min_by(F.struct("seq", "len", "cov"), "place").alias("s"))
    checked = own.withColumn("s", F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("duplicate segment "), F.col("name")))).otherwise(F.col("s")))
    table = ids.join(checked, "name", "left").select("seg_id", "name", "s.seq", F.coalesce("s.len", zero).alias("len"), F.coalesce("s.cov", zero).alias("cov"))
    a, b = (ids.select(F.col("name").alias(c), F.col("seg_id").alias(f"{c}_id")) for c in ("a", "b"))
    arcs = links.join(a, "a").join(b, "b").select(oriented("a_id", "a_strand").alias("v"), oriented("b_id", "b_strand").alias("w"), zero.alias("ln"), "ls", "cov")
    return normalise(AssemblyGraph(table, arcs))


def read_gfa(spark: SparkSession, paths: str | list[str], options: GfaOptions = GfaOptions()) -> AssemblyGraph:
    """Read GFA files (plain or gzip) as one graph, with symmetric arcs and link ids.

    Lines other than S and L are skipped, Windows line ends too. A second S line
    of a name and an S line without a sequence field raise an error; a segment
    that only L lines name has no length and no coverage.
    """
    lines = read_lines(spark, paths)
    return _graph(segment_rows(lines, options).select("place", "name", "seq", "len", "cov"), link_rows(lines, options))


def node_spec(graph: AssemblyGraph, name: str | None) -> tuple[int | None, str | None]:
    """An oriented id from ``name``, ``name+`` or ``name-``, and the strand that was said.

    An exact name comes before one with a strand sign. Unknown names raise.
    """
    if name is None or name == "":
        return None, None
    wanted = {name: None} | ({name[:-1]: name[-1]} if name[-1] in "+-" else {})
    found = {r["name"]: r["seg_id"] for r in graph.segments.where(F.col("name").isin(list(wanted))).select("name", "seg_id").collect()}
    for base, strand in wanted.items():
        if base in found:
            return found[base] * 2 + (strand == "-"), strand
    raise ValueError(f"no such segment: {name!r}")
