"""WARC archives: writing captures and assembling them again.

Writing: a capture is a request, a response (or a revisit that refers to the
response of an equal payload) and a metadata record, tied together by
WARC-Concurrent-To. Records are strings of UTF-8 text and every WARC record ends
with an empty line, so Spark's own text sink writes the archives: its line
separator is the records' end.

Reading: files are parsed record by record, by Content-Length, in tasks; the
records of a capture meet in equi-joins on the response's record id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import drop_path, materialise, new_path
from skein.plans.hot import hot_join

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Namespace of this module's record ids.
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:skein:warc")
CAPTURES_PER_FILE = 4_000

_RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "date string, payload_digest string, payload_bytes long, page_id long, payload binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> str:
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>"]
    head += [f"{k}: {v}" for k, v in fields]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head) + "\r\n\r\n" + block.decode("utf-8")


def _header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _response_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMESPACE, f'response {page_id} {digest}')}"


def _capture(row: dict, name: str, date: str) -> list[str]:
    """The three records of one page."""
    payload = (row["html"] or "").encode()
    digest = payload_digest(payload)
    uri = _header_safe(row["url"]) if row["url"] else f"urn:page:{row['page_id']}"
    main = _response_id(row["page_id"], row["sha"]) if row["leads"] else f"urn:uuid:{uuid.uuid5(_NAMESPACE, name + ' revisit')}"
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    where = re.match(r"\w+://([^/?#]*)([^#]*)", uri)
    host, path = (where[1], where[2] or "/") if where else ("", uri)
    asked = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    said = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = f"page-id: {'' if row['page_id'] is None else row['page_id']}\r\n".encode()
    out = [_record("request", f"urn:uuid:{uuid.uuid5(_NAMESPACE, name + ' request')}", [*common, ("WARC-Concurrent-To", f"<{main}>"), ("Content-Type", "application/http; msgtype=request")], asked)]
    answer = [*common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if row["leads"]:
        out.append(_record("response", main, answer, said + payload))
    else:
        first = _response_id(row["lead_id"], row["sha"])
        out.append(_record("revisit", main, [*answer, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{first}>")], said))
    out.append(_record("metadata", f"urn:uuid:{uuid.uuid5(_NAMESPACE, name + ' metadata')}", [*common, ("WARC-Concurrent-To", f"<{main}>"), ("Content-Type", "application/warc-fields")], about))
    return out


def with_leads(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, sha, leads, lead_id, tag``: of equal payloads the smallest page leads.

    Only payloads that occur twice take part in the join, which carries one row
    for each; a payload of very many pages is spread by the pages' ids. Rows get
    their tag once: the table of tags is written before it meets itself, so a row
    read again after a lost executor keeps its own. Among rows repeated with one
    page id and payload, the lowest tag decides.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows, _ = materialise(pages.select("page_id", "url", "html", F.sha2(html, 256).alias("sha"), F.monotonically_increasing_id().alias("tag")), "warc-pages", "zstd")
    order = F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id").alias("page_id"), F.col("tag").alias("tag"))
    first, _ = materialise(rows.groupBy("sha").agg(F.min(order).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-leads")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    joined = hot_join(rows, first, ["sha"], "n", total, F.col("tag"), how="left")
    leads = F.col("lead").isNull() | (F.col("lead.tag") == F.col("tag"))
    return joined.select("page_id", "url", "html", "sha", leads.alias("leads"), F.col("lead.page_id").alias("lead_id"), "tag")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", captures_per_file: int = CAPTURES_PER_FILE) -> None:
    """Write one capture for each row of ``pages`` (page_id, url, html) under ``path``.

    The payload is the html in UTF-8 (null: empty). Files are gzip-compressed
    and hold whole records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200).to_pylist()
                records = [r for row in rows for r in _capture(row, f"{row['tag']} {row['page_id']} {row['sha']}", date)]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])

    records = with_leads(pages).mapInArrow(run, "value string")
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def _inflate(content: bytes) -> bytes:
    """A file's bytes; gzip files may have any number of members."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content) + member.flush())
        content = member.unused_data.lstrip(b"\0")
    return b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: header fields (names in lower case) and block."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields.setdefault(key.strip().lower(), value.strip())
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"a WARC record at byte {at} is cut short")
        yield fields, block
        at = end + 4 + size


def _row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    bare = lambda key: fields.get(key, "").strip("<>") or None
    kind = fields.get("warc-type")
    digest = size = page = payload = None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = payload_digest(payload), len(payload)
        said = fields.get("warc-payload-digest", "")
        if said.startswith("sha1:") and said[5:] != digest:
            raise ValueError(f"the payload of {bare('warc-record-id')} does not match its digest")
    elif kind == "revisit":
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    elif kind == "metadata" and (found := re.search(rb"^page-id: *(-?\d+)\r?$", block, re.M)):
        page = int(found[1])
    return kind, bare("warc-record-id"), bare("warc-concurrent-to"), bare("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-date"), digest, size, page, payload if with_payload else None


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``, a row each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    types = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, block in parse_records(_inflate(content.as_py())):
                    rows.append(_row(fields, block, with_payload))
                    if len(rows) == 600:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.mapInArrow(run, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id, response, request, metadata``.

    A capture is a response or revisit record; the request and the metadata name
    it in WARC-Concurrent-To (captures without either keep a null there). Of
    several that name the same capture, the one with the smallest record id is
    taken.
    """
    main = records.where(F.col("record_type").isin("response", "revisit"))
    nested = main.select(F.col("record_id").alias("capture_id"), F.struct("record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "payload").alias("response"))
    for kind in ("request", "metadata"):
        part = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        one = part.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "target_uri", "date", "page_id")).alias(kind))
        nested = nested.join(one, "capture_id", "left")
    return nested


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back and report every capture.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``:
    a revisit has the figures of the response that it refers to, and that
    response's page as ``refers_to``. Null html is an empty payload; equal
    payloads, empty ones too, have one response, that of the smallest page_id
    (null ids rank last; rows repeated in full revisit one of their own).
    An empty table gives none; further columns are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)
    records, _ = materialise(read_records(spark, path, with_payload=False), "warc-records")
    drop_path(spark, path)
    captures, _ = materialise(assemble(records).select(
        "capture_id",
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("first"),
        F.col("response.payload_bytes").alias("bytes"),
        F.col("response.payload_digest").alias("digest"),
    ), "warc-captures")
    firsts = captures.where("record_type = 'response'").select(F.col("capture_id").alias("first"), F.col("page_id").alias("first_page"), F.col("bytes").alias("first_bytes"), F.col("digest").alias("first_digest"))
    responses = captures.where("first IS NULL").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = captures.where("first IS NOT NULL")
    asked = revisits.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    found = hot_join(revisits, firsts.join(asked, "first"), ["first"], "n", revisits.count(), F.col("capture_id"))
    return responses.unionByName(found.select("page_id", F.col("first_bytes").alias("payload_bytes"), F.col("first_digest").alias("payload_digest"), "record_type", F.col("first_page").alias("refers_to")))
