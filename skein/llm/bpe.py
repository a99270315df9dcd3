"""BPE encoding and decoding over a table of distinct words.

Texts are dealt into blocks by a hash of their row. Every block gives its
distinct words, dealt into ranges by their hash; a range meets the words of all
blocks, encodes each distinct word once and sends the ids back to the blocks
that asked. There they are joined to the words' positions. Decoding joins ids to
pieces; the table of pieces is the vocabulary (49,408 rows here), so that join is
made within the tasks.

Only texts and distinct words are shuffled, never a row for each position: words
travel as one compressed row for each block and range.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import blocks_for
from skein.llm.words import encode_words, tokenizer, vocabulary_path

BLOCK_BYTES = 32_000_000


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes | None]:
    """The id-to-piece table, dense in the id."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    table: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, at in vocabulary.items():
        table[at] = piece.encode()
    return table


@lru_cache(maxsize=2)
def _check_decoder(path: str) -> None:
    """Raise unless the tokenizer decodes by joining pieces with blanks, as the join does."""
    pieces, known = _pieces(path), tokenizer(path)
    for text in ("a probe, of 3 words", "it's wonderfully un-known", "été 北京 ok"):
        ids = known.encode(text, add_special_tokens=False).ids
        if known.decode(ids, skip_special_tokens=False) != b" ".join(pieces[i] for i in ids).decode():
            raise ValueError(f"{path} does not decode by joining pieces with blanks")


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _by_range(words: set[bytes], ranges: int) -> list[list[bytes]]:
    """The words of each range in byte order; the same wherever it is computed."""
    dealt: list[list[bytes]] = [[] for _ in range(ranges)]
    crc = zlib.crc32
    for w in words:
        dealt[crc(w) % ranges].append(w)
    for part in dealt:
        part.sort()
    return dealt


def _distinct(texts: pa.ChunkedArray) -> set[bytes]:
    found: set[bytes] = set()
    for t in texts:
        text = t.as_py()
        if text:
            found.update(text.split())
    return found


def _ask(table: pa.Table, ranges: int) -> pa.Table:
    """A block's distinct words, a row for each range that has any."""
    block = table.column("block")[0].as_py()
    dealt = [(r, _pack(b"\n".join(part))) for r, part in enumerate(_by_range(_distinct(table.column("text")), ranges)) if part]
    return pa.table({"block": pa.array([block] * len(dealt), pa.int64()), "range": pa.array([r for r, _ in dealt], pa.int64()), "words": pa.array([w for _, w in dealt], pa.binary())})


def _answer(table: pa.Table, path: str) -> pa.Table:
    """Encode a range's distinct words once; a row of ids for each block that asked."""
    asked = [_unpack(w.as_py()).split(b"\n") for w in table.column("words")]
    distinct = list(set().union(*asked))
    ids: dict[bytes, bytes] = {}
    for at in range(0, len(distinct), 8192):
        part = distinct[at : at + 8192]
        ids.update(zip(part, encode_words(path, part)))
    answers = []
    for words in asked:
        found = [ids[w] for w in words]
        lengths = np.array([len(x) >> 2 for x in found], dtype="<u4")
        answers.append(_pack(lengths.tobytes() + b"".join(found)))
    return pa.table({"block": table.column("block"), "range": table.column("range"), "n": pa.array([len(w) for w in asked], pa.int64()), "ids": pa.array(answers, pa.binary())})


def _join_back(rows: pa.Table, answers: pa.Table, ranges: int, path: str, with_texts: bool) -> pa.Table:
    """Place each word's ids at its positions, and each id's piece at its place."""
    pieces = _pieces(path)
    dealt = _by_range(_distinct(rows.column("text")), ranges)
    ids: dict[bytes, bytes] = {}
    spelled: dict[bytes, bytes] = {}
    for r, n, packed in zip(answers.column("range").to_pylist(), answers.column("n").to_pylist(), answers.column("ids")):
        words = dealt[r]
        if len(words) != n:
            raise RuntimeError("a block's words have changed between two reads of its texts")
        data = _unpack(packed.as_py())
        lengths = np.frombuffer(data, dtype="<u4", count=n)
        ends = (np.cumsum(lengths, dtype=np.int64) + n) * 4
        values = np.frombuffer(data, dtype="<u4", offset=4 * n).tolist()
        begin, at = 4 * n, 0
        for w, end in zip(words, ends.tolist()):
            ids[w] = data[begin:end]
            k = (end - begin) >> 2
            spelled[w] = b" ".join([pieces[v] for v in values[at : at + k]])
            begin, at = end, at + k
    silent = any(not s for s in spelled.values())
    names, counts, id_marks, text_marks, all_ids, texts = [], [], [], [], [], []
    for name, text in zip(rows.column("id").to_pylist(), rows.column("text")):
        words = (text.as_py() or b"").split()
        found = b"".join([ids[w] for w in words])
        decoded = b" ".join([s for w in words if (s := spelled[w])] if silent else [spelled[w] for w in words])
        names.append(name)
        counts.append(len(found) >> 2)
        id_marks.append(hashlib.sha256(found).hexdigest())
        text_marks.append(hashlib.sha256(decoded).hexdigest())
        if with_texts:
            all_ids.append(np.frombuffer(found, dtype="<u4").astype(np.int64))
            texts.append(decoded.decode())
    out = {"id": pa.array(names, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_marks, pa.string()), "decoded_sha256": pa.array(text_marks, pa.string())}
    if with_texts:
        out |= {"ids": pa.array(all_ids, pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
    return pa.table(out)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id, ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256``; with ``with_texts`` also
    ``ids`` and ``decoded``. Ids are those of the tokenizers library without
    added special tokens, truncation or padding; special tokens that stand in a
    text are encoded as such, and decoding keeps them. A null text counts as
    empty (no ids); null ids and repeated rows stay; an empty table gives none;
    further columns are ignored. A block holds whole texts, one at least. A vocabulary
    whose decoder does anything but join pieces with blanks is refused.
    """
    path = vocabulary or vocabulary_path()
    _check_decoder(path)
    blocks = blocks_for(docs, text_col, block_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(blocks, "block")
    asked = rows.groupBy("block").applyInArrow(lambda t: _ask(t, blocks), "block long, range long, words binary")
    answered = asked.groupBy("range").applyInArrow(lambda t: _answer(t, path), "block long, range long, n long, ids binary")
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_texts else "")
    out = rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lambda left, right: _join_back(left, right, blocks, path, with_texts), schema)
    return out.withColumnRenamed("id", id_col)
