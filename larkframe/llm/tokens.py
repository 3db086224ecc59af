"""Byte-level BPE ids and counts of whole texts, by pre-token pieces that are encoded once.

A text is cut before every space; byte-level BPE never merges over such a cut
(texts where white space runs meet a space are encoded as a whole). Most pieces
repeat, so a bounded cache of piece -> ids does nearly all of the work.

Very long runs of white space overflow the stack of the faster of the two
libraries; pieces with such runs go to the other one, which has the same ids.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from larkframe.llm.common import vocabulary_path

#: Pieces kept by a worker; a full cache is emptied, which costs time but never changes a result.
CACHE = 400_000
#: White space next to a space: there the cut could move a pre-token's edge.
UNSAFE = re.compile(r"\s | \s")
#: White space from which on a run is long.
LONG_RUN = re.compile(r"(?<!\s)\s{20000}")
#: Pieces of more characters are not kept in a cache.
KEPT = 256
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


class _Pieces(dict):
    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece: str):
        got = self.encode(self.prefix + piece)
        if len(piece) <= KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = got
        return got


class ByteBpe:
    """Ids of the 50k byte-level vocabulary as little-endian unsigned 32-bit bytes."""

    def __init__(self, root: str | None = None, name: str = "byte_bpe_50k.tiktoken", slow: str = "byte_bpe_50k.json"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(name, root), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._fast, self._slow, self._slow_path = own.encode_ordinary, None, vocabulary_path(slow, root)
        self._lengths = _Pieces(lambda piece: len(self._ids(piece)), "")
        #: Tokens of a run, by a cache of its own; special tokens' strings are ordinary text here.
        self.count_run = self._lengths.__getitem__
        self._first = _Pieces(self._bytes, "")
        self._rest = _Pieces(self._bytes, " ")

    def _ids(self, piece: str) -> list[int]:
        if len(piece) < 20000 or not LONG_RUN.search(piece):
            return self._fast(piece)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._slow_path)
            self._slow.encode_special_tokens = True  # their strings are ordinary text here
        return self._slow.encode(piece, add_special_tokens=False).ids

    def _bytes(self, piece: str) -> bytes:
        return np.array(self._ids(piece), "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if UNSAFE.search(text):
            return self._bytes(text)
        first, *rest = text.split(" ")
        return self._first[first] + b"".join(map(self._rest.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a text; the special token's string becomes its id, as in the vocabulary's own definition."""
        if SPECIAL not in text:
            return self.plain(text)
        return SPECIAL_ID.to_bytes(4, "little").join(self.plain(x) if x else b"" for x in text.split(SPECIAL))


_OWN: dict = {}


def byte_bpe(root: str | None = None) -> ByteBpe:
    """The worker's one encoder."""
    if root not in _OWN:
        _OWN[root] = ByteBpe(root)
    return _OWN[root]
