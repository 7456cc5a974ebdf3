"""Words of UTF-8 texts as arrays: where they are, and 64-bit hashes of them.

A word is a run of bytes other than space and the controls 9 to 13; A to Z count
as a to z. Everything works on many texts at once, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Bytes whose words are hashed together.
BLOCK_BYTES = 1 << 16

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)
_STEP = _U64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = _U64(pow(int(_BASE), -1, 1 << 64))
            one = np.ones(1, _U64)
            self.up = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE))])
            self.down = np.concatenate([one, np.cumprod(np.full(size - 1, inverse))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of neighbouring texts; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        low = int(offsets[first])
        yield first, end, data[low:int(offsets[end])], offsets[first:end + 1] - low
        first = end


#: Bytes of words without signs: ASCII letters and digits, and all others beyond ASCII.
ALPHANUMERIC = np.array([chr(b).isalnum() or b > 127 for b in range(256)])


def word_bounds(data: np.ndarray, offsets: np.ndarray,
                of_words: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words come before each offset.
    ``of_words`` tells for each byte whether it is one of a word."""
    inside = of_words[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, wherever it stands. Words are hashed block by
    block, so what is held beside a text doesn't grow with it, but for words beyond a block."""
    found = np.empty(len(starts), _U64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        end = max(first + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, side="right")))
        block = data[low:int(ends[end - 1])]
        up, down = _POWERS.upto(len(block) + 1)
        sums = np.zeros(len(block) + 1, _U64)
        np.cumsum((_LOWER[block].astype(_U64) + _U64(1)) * up[:-1], out=sums[1:])
        a, b = starts[first:end] - low, ends[first:end] - low
        found[first:end] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U64) * _STEP)
        first = end
    return found


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; what crosses texts is for the caller to leave out."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, _U64(size))
    for k in range(size):
        total = total * _STEP + words[k:k + n]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``size`` words; of
    a shorter text all words as one; of none, an empty array."""
    for first, end, data, offsets in text_slices(texts):
        starts, ends, counts = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = gram_hashes(words, size)
        for k in range(end - first):
            a, b = counts[k], counts[k + 1]
            if b - a >= size:
                yield np.unique(grams[a:b - size + 1])
            else:
                yield gram_hashes(words[a:b], int(b - a)) if b > a else grams[:0]
