"""Words and word shingles of Arrow string columns as 64-bit hashes, by numpy on the raw bytes.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Words are
hashed by a sum of byte values times a fixed random multiplier per place
(multilinear hashing modulo 2^64) and a final mix, so a hash depends on the
word alone and not on the batch, the partition or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes, to bound the size of the arrays made on the way.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLDED = np.arange(1, 257, dtype=np.uint64)
_FOLDED[ord("A") : ord("Z") + 1] = _FOLDED[ord("a") : ord("z") + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits; one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """The first n odd random multipliers of a seed; a longer list begins with the shorter."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows as (bytes, offsets); a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def breaks(characters: str) -> np.ndarray:
    """A table of bytes that separate words: white space and the given ASCII characters."""
    found = _SPACE.copy()
    found[list(characters.encode("ascii"))] = True
    return found


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where the words of each row begin in them.

    The letters A to Z count as a to z.
    """
    if len(data) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~space[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    gaps = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, gaps)
    products = np.where(space, np.uint64(0), _FOLDED)[data[starts[0] :]] * multipliers(int(gaps.max()), 17)[place]
    return mix(np.add.reduceat(products, starts - starts[0])), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the hashes of its shingles, in order and with repetitions.

    A row with fewer words than ``size`` has all its words as one shingle, a
    row without words has none.
    """
    factors = multipliers(size, 29)
    rolled = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    for first, last in zip(firsts[:-1], firsts[1:], strict=True):
        n = last - first
        if n >= size:
            yield rolled[first : last - size + 1]
        elif n:
            yield mix((words[first:last] * factors[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield words[:0]
