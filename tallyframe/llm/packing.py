"""Packing of token pieces into sequences: best fit, then swaps that empty bins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import vocabulary
from tallyframe.session import cut_lineage

LIMIT = 4096
END = 1
#: Expected pieces in a block, which one task packs.
BLOCK = 16_384
#: Bins filled below this share go on to the next level.
SETTLED = 0.98


# ---- pieces


def pieces(docs: DataFrame, definition: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, cut every ``limit`` ids.

    ``definition`` is the content of a tokenizer file. ``ids`` holds little-endian
    unsigned 32-bit numbers. A null or empty text is the end id alone. Rows with
    equal ids each give their own pieces; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing, width = np.array([end], dtype="<u4").tobytes(), 4 * limit
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for row, ids in enumerate(vocabulary.encode_texts(batch.column(1), shared.value)):
                ids += closing
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    rows.append((row, k // width, k // 4, len(part) // 4, part))
                size += len(ids)
                if size > 1 << 24:
                    yield _record(batch.column(0), rows)
                    rows, size = [], 0
            if rows:
                yield _record(batch.column(0), rows)

    def _record(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        row, piece, start, length, part = zip(*rows, strict=True)
        columns = [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(part, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


# ---- one block


def pack_lengths(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins as lists of places in ``lengths``: best fit by decreasing length, then local search."""
    free_bins: list[list[int]] = [[] for _ in range(limit + 1)]
    offered = 0  # bit f is set while some bin has exactly f free
    bins: list[list[int]] = []
    for place in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[place]
        fitting = offered >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = free_bins[free].pop()
            if not free_bins[free]:
                offered &= ~(1 << free)
        else:
            free, chosen = limit, len(bins)
            bins.append([])
        bins[chosen].append(place)
        if free - size > 0:
            free_bins[free - size].append(chosen)
            offered |= 1 << (free - size)
    return _improve(bins, lengths, limit)


def _improve(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Empty bins by moves and swaps between underfull bins.

    The least filled bin gives. A document moves to the bin it fits best; or it is
    exchanged for a smaller one, or two of its documents for one smaller than both
    together, so that the taking bin fills up as far as it can. Each step raises
    the sum of squared fills, since what is taken is fuller than what gives, so the
    search ends. It stops at the fewest bins that the total length allows.
    """
    fewest = math.ceil(sum(lengths) / limit)
    fills = [sum(lengths[p] for p in b) for b in bins]
    count = len(bins)
    open_bins = sorted((k for k in range(len(bins)) if fills[k] < limit), key=lambda k: fills[k])
    for giver in open_bins:
        if count <= fewest:
            break
        taking = [k for k in open_bins if k != giver and bins[k] and fills[k] < limit and fills[k] >= fills[giver]]
        if not taking:
            continue
        while bins[giver] and _step(bins, fills, lengths, limit, giver, taking):
            pass
        if not bins[giver]:
            count -= 1
    return [b for b in bins if b]


def _step(bins: list[list[int]], fills: list[int], lengths: list[int], limit: int, giver: int, taking: list[int]) -> bool:
    free = np.array([limit - fills[k] for k in taking])
    own = sorted(bins[giver], key=lambda p: -lengths[p])
    for place in own:  # move
        room = np.where(free >= lengths[place], free, limit + 1)
        k = int(room.argmin())
        if room[k] <= limit:
            _carry(bins, fills, lengths, giver, taking[k], [place], None)
            return True
    at = [(k, p) for k, b in enumerate(taking) for p in bins[b]]
    rows, sizes = np.array([k for k, _ in at]), np.array([lengths[p] for _, p in at])
    singles = [[p] for p in own]
    doubles = [[p, q] for i, p in enumerate(own[:40]) for q in own[i + 1 : 40]]
    for offer in singles + doubles:
        gain = sum(lengths[p] for p in offer) - sizes
        gain[gain > free[rows]] = 0
        k = int(gain.argmax())
        if gain[k] > 0:
            _carry(bins, fills, lengths, giver, taking[at[k][0]], offer, at[k][1])
            return True
    return False


def _carry(bins: list[list[int]], fills: list[int], lengths: list[int], giver: int, taker: int, offer: list[int], back: int | None) -> None:
    for place in offer:
        bins[giver].remove(place)
        bins[taker].append(place)
    if back is not None:
        bins[taker].remove(back)
        bins[giver].append(back)
    moved = sum(lengths[p] for p in offer) - (lengths[back] if back is not None else 0)
    fills[giver] -= moved
    fills[taker] += moved


# ---- the operator


def pack(rows: DataFrame, limit: int = LIMIT, length_col: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: no sequence longer than ``limit``, no gaps, no overlaps.

    Rows are dealt at random into blocks of bounded size. Each block packs by best
    fit and local search; rows of bins that stay below ``SETTLED`` meet again in fewer
    blocks, level by level, until one block or no gain is left, so the loss does not
    grow with the number of blocks. Only what ``rows`` holds is shuffled: leave out
    the ids and join them on afterwards, or see ``assemble``.

    Lengths lie between 1 and ``limit``; others, and nulls, raise an error. Input
    columns named ``sequence_id`` or ``offset`` are replaced. Equal rows are packed as
    often as they come. An empty table gives an empty result.
    """
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset", "_block", "_fill")]
    left = cut_lineage(rows.select(*[F.col(f"`{c}`") for c in kept]))
    places = [f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields]
    schema = ", ".join([*places, "sequence_id long", "offset long", "_fill long"])
    done: DataFrame | None = None
    level, count = 0, left.count()
    while True:
        blocks = max(1, math.ceil(count / BLOCK))
        last = blocks == 1
        start = level << 56

        def fill(key: tuple, table: pa.Table) -> pa.Table:
            lengths = table.column(length_col).to_pylist()
            if any(n is None or not 0 < n <= limit for n in lengths):
                raise ValueError(f"a length is not between 1 and {limit}")
            sequence, offset, fills = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
            for number, members in enumerate(pack_lengths(lengths, limit)):
                sizes = np.array([lengths[p] for p in members])
                sequence[members] = start + (key[0].as_py() << 28) + number  # noqa: B023 - runs within this round
                offset[members] = np.cumsum(sizes) - sizes
                fills[members] = sizes.sum()
            for name, values in (("sequence_id", sequence), ("offset", offset), ("_fill", fills)):
                table = table.append_column(name, pa.array(values))
            return table.drop_columns(["_block"])

        dealt = left.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(blocks)))
        placed = cut_lineage(dealt.groupBy("_block").applyInArrow(fill, schema))
        rest = placed.where(F.col("_fill") < SETTLED * limit)
        again = 0 if last else rest.count()
        last = last or again == 0 or again > 0.7 * count
        settled = (placed if last else placed.where(F.col("_fill") >= SETTLED * limit)).drop("_fill")
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        left, count, level = rest.drop("sequence_id", "offset", "_fill"), again, level + 1


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from rows with ``sequence_id``, ``offset`` and ``ids``; a sequence is of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), "")).alias("ids"))


def pack_documents(docs: DataFrame, definition: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    cut = pieces(docs, definition, limit, end).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut, limit)
