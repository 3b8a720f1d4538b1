"""Texts cut into chunks between neighbouring bytes, by numpy on the raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are cut in slices of about so many bytes.
SLICE_BYTES = 1 << 22

# Classes of bytes: letters and digits of ASCII, marks, the space, other white space of ASCII, and the rest.
REST, ALNUM, MARK, SPACE, BREAK = range(5)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[k for k in range(128) if chr(k).isalnum()]] = ALNUM
_CLASS[list(b".,;:!?")] = MARK
_CLASS[list(b"\t\n\v\f\r")] = BREAK
_CLASS[ord(" ")] = SPACE


class Cutter:
    """Where chunks begin, by the classes of two neighbours: ``second[a, b]`` cuts between them, ``first[a, b]`` before the first."""

    def __init__(self) -> None:
        self.second, self.first = np.zeros((5, 5), dtype=bool), np.zeros((5, 5), dtype=bool)

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks in order, and where those of each text begin. The chunks are a view of the bytes of the texts (large strings)."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2] or pa.py_buffer(b"")
        data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
        begins, starts = np.zeros(len(data) + 1, dtype=bool), offsets - offsets[0]
        if len(data) > 1:
            kinds = _CLASS[data]
            pairs = 5 * kinds[:-1] + kinds[1:]
            begins[1:-1] = self.second.reshape(-1)[pairs]
            before = self.first.reshape(-1)[pairs]
            before[starts[(starts > 0) & (starts < len(data))] - 1] = False  # the last of a text has no neighbour
            begins[:-2] |= before
        begins[starts] = True
        places = np.append(np.flatnonzero(begins[:-1]), len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places + offsets[0]), buffer)
        return chunks, np.searchsorted(places, starts)


def runs(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of texts of about ``size`` bytes, as large strings; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    first = 0
    while first < len(texts):
        last = min(max(int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1, first + 1), len(texts))
        yield texts.slice(first, last - first)
        first = last


def gather(known: list[bytes], places: np.ndarray, firsts: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of texts: the ids of their chunks one after the other. ``known`` holds the ids of each different chunk, ``places`` which one each chunk is."""
    flat = np.frombuffer(b"".join(known), dtype=kind)
    sizes = np.array([len(k) for k in known], dtype=np.int64) // flat.itemsize
    each = sizes[places]
    stops = np.concatenate([[0], np.cumsum(each)])
    return flat[np.repeat((np.cumsum(sizes) - sizes)[places] - stops[:-1], each) + np.arange(stops[-1])], stops[firsts]


def replaced(ids: np.ndarray, cuts: np.ndarray, anew: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) with the ids of some texts put in anew."""
    if not anew:
        return ids, cuts
    parts = [anew.get(k, ids[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
