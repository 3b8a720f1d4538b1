"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallyframe.llm import cuts
from tallyframe.llm.memory import Memory, kept, release

_MASK = (1 << 64) - 1
_STRIDE = 0x9E3779B97F4A7C15


@dataclass
class PerfectHash:
    """A minimal perfect hash of byte strings: n keys to the places 0 to n - 1, by hash and displace.

    Keys fall into buckets; buckets are placed from the largest to the smallest, each
    by the first displacement that sends its keys to free places. A key outside the
    set also gets a place, so the caller compares the key kept there.
    """

    displacement: np.ndarray
    size: int

    @staticmethod
    def build(keys: list[bytes]) -> PerfectHash:
        size = len(keys)
        codes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(codes)) != size:
            raise ValueError("two keys are equal or have the same hash")
        count = max(1, size // 3)
        bucket = (codes % np.uint64(count)).astype(np.int64) if size else np.zeros(0, dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        members = np.split(order, np.searchsorted(bucket[order], np.arange(1, count)))
        taken, displacement = np.zeros(size, dtype=bool), np.zeros(count, dtype=np.int64)
        for b in sorted(range(count), key=lambda k: -len(members[k])):
            own = [int(c) for c in codes[members[b]]]
            shift = 0
            while own:
                places = [_place(c, shift, size) for c in own]
                if len(set(places)) == len(places) and not any(taken[p] for p in places):
                    taken[places] = True
                    break
                shift += 1
            displacement[b] = shift
        return PerfectHash(displacement, size)

    def place(self, key: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(key)
        return _place(code, int(self.displacement[code % len(self.displacement)]), self.size)


def _place(code: int, shift: int, size: int) -> int:
    mixed = (code ^ (shift * _STRIDE & _MASK)) * 0xD6E8FEB86659FD93 & _MASK
    return (mixed ^ mixed >> 32) % size


@dataclass
class Codec:
    """Ranks as tables: tokens and ids by their place in the perfect hash, and tokens by id."""

    pattern: str
    hashed: PerfectHash
    tokens: list[bytes]
    ids: list[int]
    by_id: dict[int, bytes] = field(repr=False)
    stamp: int = 0

    @staticmethod
    def load(lines: bytes, pattern: str) -> Codec:
        """From the content of a rank file: a base64 token and its rank in each line."""
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        hashed = PerfectHash.build(list(ranks))
        tokens, ids = [b""] * len(ranks), [0] * len(ranks)
        for token, rank in ranks.items():
            at = hashed.place(token)
            tokens[at], ids[at] = token, rank
        return Codec(pattern, hashed, tokens, ids, {r: t for t, r in ranks.items()}, hash((lines, pattern)))

    def rank(self, key: bytes) -> int | None:
        at = self.hashed.place(key)
        return self.ids[at] if self.tokens[at] == key else None


class Encoder:
    """Encodes with a codec; remembers chunks. One per worker process."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.split = regex.compile(codec.pattern)
        self.memory = Memory()
        self.tokens = _tokens_by_id(codec)
        self.ranks = dict(zip(codec.tokens, codec.ids, strict=True))
        # ranks of all pairs of bytes, by which every merge begins; -1 where there is none
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: the pair of lowest rank, the leftmost of equals, merges first.

        Parts are linked by where they end and where the one before begins. The heap
        holds rank, begin and end of pairs in one number; entries of parts that have
        changed since are passed over.
        """
        n = len(piece)
        shift = n.bit_length()
        high, mask = 2 * shift, (1 << shift) - 1
        rank_of, pairs = self.ranks.get, self.pairs
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << high) | (k << shift) | (k + 2) for k, (a, b) in enumerate(zip(piece, piece[1:], strict=False)) if (r := pairs[a << 8 | b]) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            k, stop = entry >> shift & mask, entry & mask
            middle = end[k]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
                rank = rank_of(piece[k : end[stop]])
                if rank is not None:
                    heappush(heap, (rank << high) | (k << shift) | end[stop])
            first = before[k]
            if first >= 0:
                rank = rank_of(piece[first:stop])
                if rank is not None:
                    heappush(heap, (rank << high) | (first << shift) | stop)
        found, k = [], 0
        while k < n:
            found.append(rank_of(piece[k : end[k]]))
            k = end[k]
        return found

    def token(self, token: str) -> bytes:
        """Ids of a pre-token: by the perfect hash if it is in the vocabulary, else merged."""
        raw = token.encode("utf-8")
        rank = self.codec.rank(raw)
        return array("i", self.merge(raw) if rank is None else (rank,)).tobytes()

    def pieces(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers; its pre-tokens are remembered."""
        memory, found = self.memory, []
        for token in self.split.findall(text):
            ids = memory.get(token) or memory.older.get(token) or self.token(token)
            memory[token] = ids
            found.append(ids)
        return b"".join(found)

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of texts as (ids, offsets).

        Different chunks of a run are looked up once and their ids gathered; a text
        with other white space than that of ASCII is taken as a whole.
        """
        for run in cuts.runs(texts, cuts.SLICE_BYTES):
            odd = pc.match_substring_regex(run, _ODD_SPACE)
            chunks, firsts = _CUT(pc.if_else(odd, "", run))
            coded = chunks.dictionary_encode()
            self.memory.renew()
            get, older, pieces = self.memory.get, self.memory.older.get, self.pieces
            known = []
            for chunk in coded.dictionary.to_pylist():
                found = get(chunk)
                if found is None:
                    found = self.memory[chunk] = older(chunk) or pieces(chunk)
                known.append(found)
            anew = {int(k): np.frombuffer(pieces(run[int(k)].as_py()), dtype="<i4") for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
            yield cuts.replaced(*cuts.gather(known, coded.indices.to_numpy(), firsts, "<i4"), anew)


#: White space beyond that of ASCII, and what is white space to Python alone.
_ODD_SPACE = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Cuts where a pre-token begins whatever stands beyond; a chunk may hold several pre-tokens.
_CUT = cuts.Cutter()
_CUT.second[: cuts.SPACE, cuts.SPACE :] = True  # a run of white space begins
_CUT.first[cuts.SPACE :, : cuts.SPACE] = True  # its last character stands apart from the others
_CUT.second[cuts.BREAK, : cuts.SPACE] = True  # and goes with the word only if it is a space
_CUT.second[cuts.ALNUM, cuts.MARK] = _CUT.second[cuts.MARK, cuts.ALNUM] = True


def _encoder(codec: Codec) -> Encoder:
    return kept(("bytepair", codec.stamp), lambda: Encoder(codec))


def _encoded(own: Encoder, texts: pa.Array) -> pa.Array:
    runs = list(own.ids(texts))
    sizes = np.concatenate([np.zeros(1, dtype=np.int64), *(np.diff(cuts) for _, cuts in runs)])
    values = np.concatenate([np.zeros(0, dtype=np.int32), *(ids for ids, _ in runs)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values))


def _tokens_by_id(codec: Codec) -> pa.Array:
    """The bytes of every id, null where there is none."""
    return pa.array([codec.by_id.get(k) for k in range(max(codec.by_id, default=-1) + 1)], pa.large_binary())


def _decoded(tokens: pa.Array, lists: pa.Array) -> pa.Array:
    """The bytes of all lists of ids, gathered together; a list ends where the bytes of its last id do."""
    if len(lists) == 0:
        return pa.array([], pa.large_binary())
    ids = lists.flatten()
    if ids.null_count or len(ids) and (pc.min(ids).as_py() < 0 or pc.max(ids).as_py() >= len(tokens)):
        raise KeyError("an id that is not in the vocabulary")
    taken = tokens.take(ids)
    if taken.null_count:
        raise KeyError("an id that is not in the vocabulary")
    stops = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(lists), 0).to_numpy()]))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset : taken.offset + len(taken) + 1][stops] if len(ids) else np.zeros(len(stops), dtype=np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends)), taken.buffers()[2] or pa.py_buffer(b"")])


def encode(spark: SparkSession, codec: Codec, text: Column) -> Column:
    """The ids of a text column as array<int>; a null is an empty text, an empty text has no ids.

    Each match of the codec's pattern is encoded on its own: a pre-token that is in
    the vocabulary takes its rank by the perfect hash, others are merged. Whole texts
    are read; there are no special tokens. The codec is broadcast, its size is that
    of the vocabulary.
    """
    shared = spark.sparkContext.broadcast(codec)

    @arrow_udf("array<int>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _encoder(shared.value)
        for texts in batches:
            yield _encoded(own, texts)

    return apply(text)


def decode(spark: SparkSession, codec: Codec, ids: Column) -> Column:
    """The bytes of an array of ids as binary; a null or empty array gives no bytes, an unknown id raises an error."""
    shared = spark.sparkContext.broadcast(codec)

    @arrow_udf("binary")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        tokens = _tokens_by_id(shared.value)
        for lists in batches:
            yield _decoded(tokens, lists).cast(pa.binary())

    return apply(ids)


def round_trip(spark: SparkSession, codec: Codec, text: Column) -> Column:
    """struct<ids, decoded>: the ids of a text column, and the bytes these ids decode to.

    As ``decode`` after ``encode``, in one worker and without sending the ids there twice.
    """
    shared = spark.sparkContext.broadcast(codec)

    @arrow_udf("struct<ids:array<int>,decoded:binary>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _encoder(shared.value)
        for texts in batches:
            ids = _encoded(own, texts)
            yield pa.StructArray.from_arrays([ids, _decoded(own.tokens, ids).cast(pa.binary())], names=["ids", "decoded"])

    return apply(text)


def digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
