"""Encoding words with a public tokenizer inside a task."""

from __future__ import annotations

import os
import struct
from functools import lru_cache

VOCABULARY = "word_bpe_49k.json"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHED_WORDS = 300_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its own
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """Each word's ids as little-endian unsigned 32-bit integers.

    A word is a run without ASCII white space. The tokenizer drops white space
    and nothing in it looks across, so a text's ids are those of its words. It
    also lowers letters and splits them from punctuation, so words of ASCII letters
    with punctuation behind go to its BPE model straight away.
    """
    out: list[bytes] = [b""] * len(words)
    rest = []
    bpe = tokenizer(path).model.tokenize
    for i, w in enumerate(words):
        core = w.rstrip(PUNCTUATION)
        if core.isalpha():
            ids = [t.id for t in bpe(core.lower().decode())]
            if len(core) < len(w):
                ids += [t.id for t in bpe(w[len(core) :].decode())]
            out[i] = struct.pack(f"<{len(ids)}I", *ids)
        else:
            rest.append(i)
    texts = [words[i].decode("utf-8", "replace") for i in rest]
    for i, e in zip(rest, tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)):
        out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
    return out


class WordCache:
    """Encodes texts, each distinct word once while it stays in the cache.

    Two generations bound the memory: when the younger is full, it replaces the
    older one; words in use move back to the younger.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        self.path, self.limit = path, max(1, limit // 2)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, text: bytes | None) -> bytes:
        text = text or b""
        if text.isascii() and b"<|" not in text:
            text = text.lower()  # as the tokenizer does; upper case is then no word of its own
        words = text.split()
        young = self.young
        try:
            return b"".join([young[w] for w in words])
        except KeyError:
            pass
        here: dict[bytes, bytes] = {}
        missing = []
        for w in set(words):
            ids = young.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is None:
                    missing.append(w)
                    continue
                young[w] = ids
            here[w] = ids
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            here.update(zip(part, encode_words(self.path, part)))
        for w in missing:
            young[w] = here[w]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return b"".join([here[w] for w in words])


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    """The Python worker's cache; workers live on from task to task."""
    return WordCache(path)
