"""Words of a batch of texts as 64-bit hashes, by array arithmetic over their UTF-8 bytes.

A word is a run of anything but ASCII white space, with A-Z lowered. Its hash is
a polynomial over its bytes, taken from running sums modulo 2^64, then mixed: no
Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the words of all texts in order, and how many each text has; a null text has none."""
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    counts = np.zeros(len(texts), np.int64)
    if not len(texts) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint64), counts
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_SPACE[raw]
    # Words end where white space or another text begins.
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    starts[heads] = inside[heads]
    first = np.flatnonzero(starts)
    if not len(first):
        return np.zeros(0, np.uint64), counts
    power, inverse = _powers(len(raw) + 1)
    running = np.zeros(len(raw) + 1, np.uint64)
    # Bytes of white space add nothing, so a word's sum may run up to the next word.
    np.cumsum(np.where(inside, _LOWER[raw] + np.uint64(1), np.uint64(0)) * power[:-1], out=running[1:])
    bounds = np.append(first, len(raw))
    hashes = mixed((running[bounds[1:]] - running[bounds[:-1]]) * inverse[first])
    at = np.searchsorted(first, ends)
    return hashes, np.diff(at)
