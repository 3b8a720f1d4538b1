"""Packing into windows of one size: best fit by a segment tree over free room, gaps filled by cut documents."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import vocabulary
from tallyframe.session import cut_lineage

LIMIT = 2048
END = 1
#: Expected rows in a block, which one task packs.
BLOCK = 16_384
#: A gap below one part in so many of a window is left as padding.
SLACK = 128

#: A stretch of a row: which row, from where in it, how long.
Part = tuple[int, int, int]


# ---- documents to pieces


def pieces(docs: DataFrame, definition: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, doc_tokens, start, length, ids_crc32): each document's ids and the end id, cut every ``limit`` ids.

    ``definition`` is the content of a tokenizer file, ``digest`` the MD5 of the text,
    ``doc_tokens`` the number of its ids. A null or empty text is the end id alone.
    Only numbers leave the task, no ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    closing = np.array([end], dtype="<u4").tobytes()
    schema = "doc_id long, digest string, doc_tokens long, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for ids, cuts in vocabulary.encode_slices(batch.column(2), shared.value):
                raw, found = memoryview(ids.tobytes()), []
                for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    tokens = last - first + 1
                    for start in range(0, tokens, limit):
                        stop = min(start + limit, tokens)
                        crc = zlib.crc32(raw[4 * (first + start) : 4 * min(first + stop, last)])
                        found.append((row, tokens, start, stop - start, crc if stop < tokens else zlib.crc32(closing, crc)))
                    row += 1
                rows, *numbers = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *numbers], names=["doc_id", "digest", "doc_tokens", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _digest(text_col), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, schema)


def _digest(text_col: str):
    return F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("digest")


# ---- one block


class Rooms:
    """Open windows by their free room, found by a segment tree.

    A leaf counts the windows with one free room and an inner node those below it, so
    the tightest window that has room for a piece is the first counted leaf from the
    piece's length on.
    """

    def __init__(self, limit: int) -> None:
        self.leaves = 1 << limit.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(limit + 1)]

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``size``, and its room; it is no longer offered."""
        tree, node = self.tree, self.leaves + size
        if not tree[node]:
            while node & 1 or not tree[node + 1]:  # up to where a counted neighbour lies to the right
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return self.windows[room].pop(), room

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Windows as lists of places in ``lengths``, the longest piece first, each into the tightest open window."""
    rooms, windows = Rooms(limit), []
    for place in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[place])
        if found is None:
            found = len(windows), limit
            windows.append([])
        window, room = found
        windows[window].append(place)
        if room > lengths[place]:
            rooms.put(window, room - lengths[place])
    return windows


def filled(windows: list[list[int]], lengths: list[int], limit: int) -> tuple[list[list[Part]], list[Part]]:
    """(windows, rest): the windows whose gap is too small to matter, others filled up by cutting, and what is left of one window.

    The emptiest window gives: the longest piece that fits a gap, or else a stretch cut
    off its longest piece, so that the gap closes. A gap below the slack stays.
    """
    slack = max(1, limit // SLACK)
    parts = [[(p, 0, lengths[p]) for p in w] for w in windows]
    room = [limit - sum(lengths[p] for p in w) for w in windows]
    done = [w for w, r in zip(parts, room, strict=True) if r < slack]
    left = sorted((k for k, r in enumerate(room) if r >= slack), key=lambda k: room[k])
    giving: list[Part] = sorted(parts[left.pop()], key=lambda p: p[2]) if left else []
    for place, taker in enumerate(left):
        gap = room[taker]
        while gap >= slack:
            if not giving:
                if place == len(left) - 1:  # no other window is left to give
                    return done, parts[taker]
                giving = sorted(parts[left.pop()], key=lambda p: p[2])
            fits = bisect_right(giving, gap, key=lambda p: p[2])
            if fits:
                part = giving.pop(fits - 1)
            else:
                row, start, length = giving.pop()  # the longest
                part = row, start, gap
                insort(giving, (row, start + gap, length - gap), key=lambda p: p[2])
            parts[taker].append(part)
            gap -= part[2]
        done.append(parts[taker])
    return done, giving


def powers(rest: list[Part]) -> list[list[Part]]:
    """Windows whose fills are powers of two, which need no padding."""
    left, windows = list(reversed(rest)), []
    total = sum(p[2] for p in rest)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        windows.append([])
        while room:
            row, start, length = left.pop()
            taken = min(length, room)
            windows[-1].append((row, start, taken))
            room -= taken
            if taken < length:
                left.append((row, start + taken, length - taken))
    return windows


# ---- the operator


def pack(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``, some cut into several: no sequence longer than ``limit``, no gaps, no overlaps.

    ``rows`` has ``start`` and ``length`` (1 to ``limit``; others and nulls raise an
    error) and other columns, which go along; ``uncut`` tells pieces that are the whole of
    their row. Rows of ``limit`` are a sequence each and are not shuffled. The others are
    dealt at random into blocks of bounded size. A block packs by best fit, fills what
    gaps are left by cutting the emptiest window, and hands on what remains of one
    window; all remains meet in fewer blocks, level by level. The last ones end in
    sequences of powers of two. Less than one part in ``SLACK`` of a sequence is padding.

    Input columns named ``sequence_id``, ``offset`` or ``uncut`` are replaced. Equal rows
    are packed as often as they come. An empty table gives an empty result.
    """
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset", "uncut", "_block", "_open")]
    given = cut_lineage(rows.select(*[F.col(f"`{c}`") for c in kept]))
    if given.where(f"length is null or length < 1 or length > {limit} or start is null").limit(1).count():
        raise ValueError(f"a length is not between 1 and {limit}, or a start is null")
    left = given.where(F.col("length") < limit).withColumn("uncut", F.lit(True))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
    done = given.where(F.col("length") == limit).select(*kept, F.lit(True).alias("uncut"), (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    block = max(BLOCK, 4 * limit)  # so what remains of the blocks is always less than they had
    level, count = 0, left.count()
    while count:
        blocks = math.ceil(count / block)
        last, start = blocks == 1, level << 56

        def fill(key: tuple, table: pa.Table) -> pa.Table:
            lengths = table.column("length").to_pylist()
            windows, rest = filled(best_fit(lengths, limit), lengths, limit)
            if last:  # noqa: B023 - runs within this round
                windows, rest = windows + powers(rest), []
            found = [(*p, number, bool(rest) and number == len(windows)) for number, w in enumerate([*windows, rest]) for p in w]
            place, begin, size, number, is_open = (np.array(c) for c in zip(*found, strict=True))
            into = np.cumsum(size) - size
            offset = into - into[np.searchsorted(number, number)]
            table = table.drop_columns(["_block"]).take(pa.array(place))
            uncut = np.asarray(table.column("uncut")) & (size == np.array(table.column("length")))
            for name, values in (("start", np.array(table.column("start")) + begin), ("length", size), ("uncut", uncut)):
                table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
            for name, values in (("sequence_id", start + (key[0].as_py() << 28) + number), ("offset", offset), ("_open", is_open)):  # noqa: B023
                table = table.append_column(name, pa.array(values))
            return table

        dealt = left.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(blocks)))
        placed = cut_lineage(dealt.groupBy("_block").applyInArrow(fill, f"{columns}, sequence_id long, offset long, _open boolean"))
        done = done.unionByName(placed.where("not _open").drop("_open"))
        if last:
            break
        left = placed.where("_open").select(*kept, "uncut")
        level, count = level + 1, left.count()
    return done


def pack_documents(docs: DataFrame, definition: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every document.

    Every id lies in one piece: documents longer than ``limit`` are cut into full windows
    and a rest, a few rests into more pieces, where that closes a gap. The texts of these
    are read and encoded once more for the digests of their pieces, one of each
    equal text. Documents with equal ids each have their own pieces.
    """
    placed = pack(pieces(docs, definition, limit, end, id_col, text_col), limit)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    anew = placed.where("not uncut").drop("ids_crc32", "uncut")
    # written first, so that its size is known and few stretches are broadcast
    known = _crc_of_stretches(docs, cut_lineage(anew.select("digest", "start", "length").distinct()), definition, limit, end, text_col)
    mended = anew.join(known, ["digest", "start", "length"], "left")
    return placed.where("uncut").select(columns).unionByName(mended.select(columns))


def _crc_of_stretches(docs: DataFrame, stretches: DataFrame, definition: str, limit: int, end: int, text_col: str) -> DataFrame:
    """``stretches`` (digest, start, length) with the CRC-32 of these ids of the text; all lie in the last window of it."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    closing = np.array([end], dtype="<u4")

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, found = [], []
            for ids, cuts in vocabulary.encode_slices(batch.column(1), shared.value):
                for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    begun.append((last - first) // limit * limit)
                    found.append(np.append(ids[first + begun[-1] : last], closing).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begun, pa.int64()), pa.array(found, pa.binary())], names=["digest", "begun", "ids"])

    texts = docs.select(_digest(text_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(stretches.select("digest").distinct(), "digest", "left_semi")
    tails = texts.groupBy("digest").agg(F.any_value("text").alias("text")).mapInArrow(tail, "digest string, begun long, ids binary")
    at, size = (4 * (F.col("start") - F.col("begun")) + 1).cast("int"), (4 * F.col("length")).cast("int")
    return stretches.join(tails, "digest").select("digest", "start", "length", F.crc32(F.substring("ids", at, size)).alias("ids_crc32"))
