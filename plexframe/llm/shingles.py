"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case. A
text's set holds its distinct shingles of ``width`` words; with fewer words
the whole sequence is one shingle; without words the set is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from plexframe.llm.batches import text_views

WIDTH = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: another order of the hashes for every seed."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: Horner's rule over all words at once, longest words last to end."""
    out = np.zeros(len(starts), np.uint64)
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    at, lens = starts[order], lens[order]
    h = np.full(len(order), 0x243F6A8885A308D3, np.uint64)
    bound = np.searchsorted(-lens, -np.arange(1, (int(lens[0]) if len(lens) else 0) + 1), "right")
    with np.errstate(over="ignore"):
        for k, n in enumerate(bound):  # the n words longer than k bytes
            h[:n] = (h[:n] ^ data[at[:n] + k]) * _P
            h[:n] ^= h[:n] >> np.uint64(29)
    out[order] = h
    return mix(out)


def shingle_hashes(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all rows (repeats included), and the n + 1 offsets of the rows among them."""
    data, offsets = text_views(column)
    n = len(offsets) - 1
    word = ~_SPACE[data]
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    cut = offsets[1:-1]
    before[cut[cut < len(data)]] = False  # a text's first byte begins a word whatever the last text ended with
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    hashes = _word_hashes(_LOWER[data], starts, ends)
    first = np.searchsorted(starts, offsets)  # words of row i: first[i] to first[i + 1]
    words = np.diff(first)
    made = np.where(words == 0, 0, np.maximum(words - width + 1, 1))
    out_offsets = np.r_[0, np.cumsum(made)]
    begin = np.repeat(first[:-1], made) + np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], made)
    stop = np.repeat(first[1:], made)
    h = np.full(len(begin), width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            here = begin + k
            inside = here < stop
            step = np.zeros(len(begin), np.uint64)
            step[inside] = hashes[here[inside]]
            h = mix(h * _Q + step + np.uint64(k))
    return h, out_offsets


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Each row's set as a sorted array."""
    h, offsets = shingle_hashes(column, width)
    return [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def fingerprint(own: np.ndarray) -> int:
    """A signed 64-bit number for a set: equal sets agree."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([own.sum(dtype=np.uint64) + np.bitwise_xor.reduce(mix(own, 7)) * _P + np.uint64(len(own))], np.uint64)).view(np.int64)[0])
