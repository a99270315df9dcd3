import gzip

import pytest
from pyspark.sql import functions as F

from skein.functions.sequences import overlap_length, overlap_query_length, reverse_complement, wrap
from skein.operators import graph as g
from skein.sources.fasta import ordered_lines, read_any, read_sequences, sequences_as_graph
from skein.sources.gfa import GfaOptions, all_tags, is_valid_tag, node_spec, read_gfa, typed_tags
from skein.sources.sinks import fasta_lines, gfa_lines, path_fasta_lines, path_pieces, path_sequences, path_stats_lines, report_lines, write_lines
from skein.streaming.gfa_stream import name_counts, stream_lines

GFA = "H\tVN:Z:1.0\nS\ta\tACGTACGTAC\tLN:i:10\tKC:i:205\nS\tb\t*\tLN:i:8\tKC:i:80\nL\ta\t+\tb\t-\t3M\tEC:i:7\nL\tb\t+\ta\t-\t3M\tEC:i:9\nL\tb\t+\tc\t+\t*\nS\tc\tGGG\nL\tc\t+\tc\t+\t1M\tEC:i:4\n"


def put(tmp_path, text, name="x.gfa"):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def test_reading(spark, tmp_path):
    graph = read_gfa(spark, put(tmp_path, GFA))
    segments = {r["name"]: r for r in graph.segments.collect()}
    assert {n: (r.seg_id, r.len, r.cov) for n, r in segments.items()} == {"a": (0, 10, 20), "b": (1, 8, 10), "c": (2, 3, 1)}
    arcs = {(r.v, r.w): r for r in graph.arcs.collect()}
    # Both directions of a-b keep their own coverage, and share a link.
    assert arcs[0, 3].cov == 7 and arcs[2, 1].cov == 9 and arcs[0, 3].link_id == arcs[2, 1].link_id
    assert not arcs[0, 3].comp and arcs[2, 1].comp
    assert arcs[2, 4].cov == 1 and arcs[5, 3].ls == 0 and (5, 5) in arcs and len(arcs) == 6
    assert sorted({r.link_id for r in arcs.values()}) == [0, 1, 2]


def test_options_and_line_ends(spark, tmp_path):
    text = "S\ta\t*\tLN:i:10\tFC:i:99\tXX:i:33\r\nS\tb\t*\tLN:i:0\tSC:f:5.5\r\nL\ta\t+\tb\t+\tnonsense\tEC:i:5\r\n"
    path = tmp_path / "x.gfa.gz"
    path.write_bytes(gzip.compress(text.encode()))
    rows = lambda o: {r["name"]: r.cov for r in read_gfa(spark, f"file://{path}", o).segments.collect()}
    assert rows(GfaOptions()) == {"a": 9, "b": 1}
    assert rows(GfaOptions(lift_segments=False)) == {"a": 9, "b": 0}
    assert rows(GfaOptions(kmer_tag="XX:i")) == {"a": 3, "b": 1}
    assert rows(GfaOptions(seq_tag="SC:f")) == {"a": 1, "b": 5}
    assert rows(GfaOptions(kmer_tag="XX:f", lift_segments=False)) == {"a": 0, "b": 0}
    cov = lambda o: {r.cov for r in read_gfa(spark, f"file://{path}", o).arcs.collect()}
    assert cov(GfaOptions()) == {1} and cov(GfaOptions(lift_arcs=False)) == {0}
    assert is_valid_tag("KC:i") and not is_valid_tag("1C:i") and not is_valid_tag("KC:H")
    with pytest.raises(ValueError):
        GfaOptions(edge_tag="EC")


def test_duplicates_raise(spark, tmp_path):
    with pytest.raises(Exception, match="duplicate segment a"):
        read_gfa(spark, put(tmp_path, "S\ta\tAC\nS\ta\tAC\n")).segments.collect()
    with pytest.raises(Exception, match="without a sequence"):
        read_gfa(spark, put(tmp_path, "S\ta\n", "y.gfa")).segments.collect()


def test_node_names(spark, tmp_path):
    graph = read_gfa(spark, put(tmp_path, "S\tu-\t*\tLN:i:5\nS\tv\t*\tLN:i:5\n"))
    assert node_spec(graph, "u-") == (0, None) and node_spec(graph, "v-") == (3, "-") and node_spec(graph, "v") == (2, None) and node_spec(graph, None) == (None, None)
    with pytest.raises(ValueError):
        node_spec(graph, "w+")


def test_hairpins_and_parallel_arcs(spark):
    arcs = spark.createDataFrame([(0, 1, 0, 5, 3), (2, 4, 0, 9, 1), (2, 4, 0, 7, 2), (5, 3, 0, 8, 6)], "v long, w long, ln long, ls long, cov long")
    out = sorted((r.v, r.w, r.ls, r.cov, r.comp) for r in g.symmetrise(arcs).collect())
    assert out == [(0, 1, 5, 3, True), (2, 4, 7, 2, False), (2, 4, 9, 1, False), (5, 3, 7, 6, True), (5, 3, 9, 1, True)]


def test_tags_and_sequences(spark):
    row = spark.createDataFrame([(["LN:i:5", "KC:i:7", "KC:i:8", "bad"], "acgtnR", "3M1I2D4S", "5:7")], "f array<string>, s string, c string, p string").select(
        all_tags(F.col("f")).alias("t"), reverse_complement(F.col("s")).alias("rc"), overlap_length(F.col("c")).alias("own"), overlap_query_length(F.col("c")).alias("other"),
        overlap_length(F.col("p")).alias("a"), overlap_query_length(F.col("p")).alias("b"), overlap_length(F.lit("x")).alias("bad"), wrap(F.lit("abcdefg"), 3).alias("w"),
    ).first()
    assert row.t["KC"].value == "7" and set(row.t) == {"LN", "KC"} and row.rc == "YNACGT"
    assert (row.own, row.other, row.a, row.b, row.bad, row.w) == (5, 8, 5, 7, None, "abc\ndef\ng")


def test_fasta_and_fastq(spark, tmp_path):
    path = put(tmp_path, ">a first\nAC\nGT\n>b\n\nTT\n", "x.fa")
    rows = sorted((r.name, r.comment, r.seq, r.qual) for r in read_sequences(spark, path).collect())
    assert rows == [("a", "first", "ACGT", None), ("b", None, "TT", None)]
    fastq = put(tmp_path, "@r1 x\nACGT\n+\n@III\n@r2\nAC\nGT\n+r2\nII\nII\n", "x.fq")
    assert sorted((r.name, r.seq, r.qual) for r in read_sequences(spark, fastq).collect()) == [("r1", "ACGT", "@III"), ("r2", "ACGT", "IIII")]
    with pytest.raises(Exception, match="another length"):
        read_sequences(spark, put(tmp_path, "@r1\nACGT\n+\nII\n", "bad.fq")).collect()
    graph = sequences_as_graph(read_sequences(spark, path))
    assert [(r.seg_id, r.name, r.len) for r in graph.segments.orderBy("seg_id").collect()] == [(0, "a", 4), (1, "b", 2)]


def test_large_files_are_read_in_parts(spark, tmp_path):
    records = [(f"r{k}", "ACGTTGCA" * (1 + k % 5)) for k in range(400)]
    fasta = put(tmp_path, "".join(f">{n} c\td\n" + "\n".join(q[i : i + 7] for i in range(0, len(q), 7)) + "\n" for n, q in records), "big.fa")
    fastq = put(tmp_path, "".join(f"@{n}\tc d\n{q}\n+\n{'@' * len(q)}\n" for n, q in records), "big.fq")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert ordered_lines(spark, fasta).select("block").distinct().count() > 10
        for path, mark, comment in ((fasta, None, "c\td"), (fastq, "@", "c d")):
            rows = sorted(read_sequences(spark, path).collect(), key=lambda r: r.record)
            assert [(r.name, r.seq) for r in rows] == records and [r.record for r in rows] == list(range(400))
            assert {r.comment for r in rows} == {comment} and all(r.qual == (mark and mark * len(r.seq)) for r in rows)
        assert read_any(spark, [fasta, fastq]).segments.count() == 800
        assert read_any(spark, put(tmp_path, GFA)).arcs.count() > 0
        with pytest.raises(ValueError):
            read_any(spark, [fasta, put(tmp_path, GFA, "x.gfa")])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_typed_tags(spark):
    long = "x" * 20_000
    row = spark.createDataFrame([(["KC:i:+7", "KC:i:8", "XF:f:-1.5e3", "XN:f:NaN", f"XZ:Z:{long}\"\\", "XA:A:c", "XB:B:c,1,-2", "XR:B:f,1.5,2", "XX:i:no", "XY:B:q,1", "XE:Z:", "bad"],)], "f array<string>").select(typed_tags(F.col("f")).alias("t")).first()
    got = {k: v and v.toPython() for k, v in row.t.items()}
    assert got.pop("XZ") == long + '"\\'
    assert {k: (v if k in ("XB", "XX", "XY", "XE", "XN", "XA") else float(v)) for k, v in got.items() if k != "XR"} == {"KC": 7.0, "XF": -1500.0, "XN": "NaN", "XA": "c", "XB": {"subtype": "c", "values": [1, -2]}, "XX": None, "XY": None, "XE": ""}
    assert got["XR"]["subtype"] == "f" and [float(x) for x in got["XR"]["values"]] == [1.5, 2.0]


def test_tags_are_taken_from_a_line_once(spark):
    """Fields are worked out once a line, not again for each name; doubles stay doubles, and text where they are no JSON numbers."""
    calls = spark.sparkContext.accumulator(0)

    def fields(line):
        calls.add(1)
        return line.split("\t")

    lines = spark.createDataFrame([("KC:i:7\tno tag\tXP:f:0.1\tKC:f:8\tXR:B:f,1.5,NaN,-inf",), ("XX:i:no\tXX:i:1",)], "line string")
    rows = lines.select(typed_tags(F.udf(fields, "array<string>")("line")).alias("t")).collect()
    got = [{k: v and v.toPython() for k, v in r.t.items()} for r in rows]
    assert got == [{"KC": 7, "XP": 0.1, "XR": {"subtype": "f", "values": [1.5, "NaN", "-Infinity"]}}, {"XX": None}]
    assert calls.value == 2


def test_sinks(spark, tmp_path):
    graph = read_gfa(spark, put(tmp_path, GFA))
    text = [r.line for r in gfa_lines(graph).orderBy("part", "a", "b").collect()]
    assert text[1] == "S\ta\tACGTACGTAC\tLN:i:10\tKC:i:200\tSC:f:20.000" and text[-1].startswith("L\tc\t+\tc\t+") and len(text) == 7
    write_lines(gfa_lines(graph), ["part", "a", "b"], f"file://{tmp_path}/out")
    again = read_gfa(spark, f"file://{tmp_path}/out")
    assert sorted((r.v, r.w, r.ls) for r in again.arcs.collect()) == sorted((r.v, r.w, r.ls) for r in graph.arcs.collect())
    assert {r.line for r in fasta_lines(graph.segments, 4).collect()} == {">a\nACGT\nACGT\nAC", ">c\nGGG"}
    paths = spark.createDataFrame([(0, None, [0, 3], False, 2, 15, 270.0, 7, True), (1, "p", [4], True, 1, 2, 3.0, 4, False), (2, None, [1, 4], False, 2, 13, 9.0, 0, False)], "path_id int, sid string, v array<long>, circ boolean, nv int, len long, wlen double, ec long, best boolean")
    seqs = {r.path_id: r.seq for r in path_sequences(paths, graph, gap=2).collect()}
    assert seqs == {0: "ACGTACGTAC" + "N" * 5, 1: "GG", 2: "GTACGTACGT" + "NN" + "GGG"}
    records = path_fasta_lines(paths, graph).collect()
    heads = {r.path_id: r.line for r in records if r.piece < 0}
    assert {r.path_id: r.line for r in records if r.piece == 0}[2] == seqs[2].replace("NN", "N" * 100)[:60] + "\n" + seqs[2].replace("NN", "N" * 100)[60:]
    assert {r.path_id for r in path_fasta_lines(paths, graph, best_only=True).collect()} == {0}
    pieces = sorted((r.path_id, r.start, r.seq) for r in path_pieces(paths, graph, gap=2, piece=4).collect())
    assert all(len(x[2]) == 4 or x[1] + 4 > len(seqs[x[0]]) for x in pieces)
    assert {p: "".join(x[2] for x in pieces if x[0] == p) for p in seqs} == seqs
    assert heads[0] == ">ctg000001l length=15 wlength=270 nv=2 ec=7 circular=false path=a+,b-" and heads[1].startswith(">p ")
    lines = {r.path_id: r.line for r in path_stats_lines(paths).collect()}
    assert lines[0] == "path 0 nv=2 len=15 wlen=270 ec=7 linear *" and lines[1] == "path 1 nv=1 len= 2 wlen=  3 ec=4 circular"
    copies = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 0, None)], "seg_id long, component long, copy int")
    report = [r.line for r in report_lines(copies, paths.where("path_id = 0").withColumn("component", F.lit(0).cast("long")), graph, "a", None).orderBy("component", "part", "at").collect()]
    assert report[0].startswith("SUBGRAPH") and report[1].split() == ["[", "0]", "a", "10", "20", "1", "1", "0"] and report[2].split()[-1] == "-1"
    assert "source=a target=NULL nv=2" in report[4] and report[5].endswith("a+") and report[6].endswith("b-")


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", GFA)
    running = name_counts(stream_lines(spark, f"file://{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("names").start()
    running.processAllAvailable()
    running.stop()
    assert {r["name"]: (r.segments, r.links, r.mass) for r in spark.table("names").collect()} == {"a": (1, 2, 200), "b": (1, 3, 80), "c": (1, 3, 3)}
