"""Ranked lexical search turned round: an inverted index of the items' terms meets a stream of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import words
from tallyframe.session import cut_lineage

#: Best documents kept for an item.
KEPT = 20
#: Postings in one index. Items with more than that together are searched in several passes over the documents.
MAX_POSTINGS = 1 << 20
#: Sums held at once by a task while it scores.
CELLS = 1 << 21

#: Terms are runs of ASCII letters, digits and everything beyond ASCII.
_BREAKS = words.breaks("".join(c for c in map(chr, range(128)) if not c.isalnum()))


@dataclass
class Index:
    """Terms of some items by hash, each with its postings: which item holds it and how often.

    ``items`` numbers the items by their place in ``numbers``.
    """

    terms: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    repeats: np.ndarray
    numbers: np.ndarray

    @staticmethod
    def build(postings: pa.Table) -> Index:
        """From rows (item, term, repeats), one for each item and term."""
        item, term, repeats = (postings.column(c).to_numpy() for c in ("item", "term", "repeats"))
        numbers, place = np.unique(item, return_inverse=True)
        order = np.argsort(term, kind="stable")
        terms, first = np.unique(term[order], return_index=True)
        return Index(terms, np.append(first, len(order)).astype(np.int64), place[order].astype(np.int64), repeats[order].astype(np.int64), numbers)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms of the index, and the places of these terms."""
        if len(self.terms) == 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.searchsorted(self.terms, hashes)
        place[place == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[place] == hashes)
        return hit, place[hit]


# ---- terms


def _terms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of rows: the hashes of all their terms, and where each row begins in them."""
    for data, offsets in words.slices(texts):
        hashes, firsts = words.word_hashes(data, offsets, _BREAKS)
        yield hashes.view(np.int64), firsts


def postings(items: DataFrame, number_col: str, text_col: str = "text") -> DataFrame:
    """(item, term, repeats): how often each item holds each of its terms, terms as 64-bit hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for hashes, firsts in _terms(batch.column(1)):
                for first, last in zip(firsts[:-1], firsts[1:], strict=True):
                    terms, repeats = np.unique(hashes[first:last], return_counts=True)
                    item = np.full(len(terms), batch.column(0)[row].as_py(), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(terms), pa.array(repeats.astype(np.int64))], names=["item", "term", "repeats"])
                    row += 1

    return items.select(F.col(number_col).cast("long"), F.col(f"`{text_col}`")).mapInArrow(count, "item long, term long, repeats long")


# ---- documents


_COUNTED = "doc_id long, n long, terms binary, counts binary, held long"


def term_counts(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with a term: its number of terms ``n``, and the places and counts of those in the index.

    Each task adds a row in which ``held`` is its number of documents, ``n`` their
    number of terms, and ``counts`` the documents holding each of ``terms``. In the
    other rows ``held`` is null. ``terms`` and ``counts`` are little-endian 32 and 64-bit numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width = max(len(own.terms), 1)
        holding, held, total = np.zeros(width, dtype=np.int64), 0, 0
        for batch in batches:
            row = 0
            for hashes, firsts in _terms(batch.column(1)):
                hit, place = own.find(hashes)
                doc = np.searchsorted(firsts, hit, side="right") - 1
                pair, counts = np.unique(doc * width + place, return_counts=True)
                place = (pair % width).astype("<i4")
                n = np.diff(firsts)
                cuts = np.searchsorted(pair, np.arange(len(n) + 1) * width)
                some = np.flatnonzero(n)
                holding += np.bincount(place, minlength=width)
                held, total = held + len(some), total + int(n.sum())
                if len(some):
                    terms, counts = place.tobytes(), counts.astype("<i8").tobytes()
                    columns = [
                        batch.column(0).take(pa.array(some + row)),
                        pa.array(n[some]),
                        pa.array([terms[4 * cuts[k] : 4 * cuts[k + 1]] for k in some], pa.binary()),
                        pa.array([counts[8 * cuts[k] : 8 * cuts[k + 1]] for k in some], pa.binary()),
                        pa.nulls(len(some), pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                row += len(n)
        if held:
            there = np.flatnonzero(holding)
            columns = [[None], [total], [there.astype("<i4").tobytes()], [holding[there].astype("<i8").tobytes()], [held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names, types = ["doc_id", "n", "terms", "counts", "held"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`")).mapInArrow(run, _COUNTED)


def _document_frequencies(parts: DataFrame, size: int) -> np.ndarray:
    """For each term of the index the documents holding it; as many numbers reach the driver as the index has terms."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, "<i4")), pa.array(np.frombuffer(counts, "<i8"))], names=["term", "n"])

    found = parts.select("terms", "counts").mapInArrow(spread, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(size, dtype=np.int64)
    sums[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return sums


def weight(documents: int, holding: int) -> int:
    """The weight of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _rates(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """For each length of a document the 12 m of its scores."""
    if int(n.max(initial=0)) * documents * 25 < 1 << 63:
        share = 25 * n * documents // total
    else:  # beyond 64 bits
        share = np.array([25 * int(k) * documents // total for k in n], dtype=np.int64)
    return 12 * (75 + share)


class Heaps:
    """The best documents of each item, at most ``size`` each; of equal scores the smaller id is better, null comes last."""

    def __init__(self, items: int, size: int) -> None:
        self.size = size
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(items)]
        # the worst that is kept, once a heap is full
        self.score = np.zeros(items, dtype=np.int64)
        self.doc = np.full(items, np.iinfo(np.int64).min)

    def offer(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        """Take in scores above 0, a row for each document and a column for each item; ``known`` tells ids from nulls."""
        better = (scores > self.score) | ((scores == self.score) & (scores > 0) & known[:, None] & (docs[:, None] < self.doc))
        for row, item in zip(*(at.tolist() for at in np.nonzero(better)), strict=True):
            heap = self.heaps[item]
            entry = (int(scores[row, item]), int(known[row]), -int(docs[row]))
            if len(heap) < self.size:
                heappush(heap, entry)
            elif entry > heap[0]:
                heapreplace(heap, entry)
            if len(heap) == self.size:
                self.score[item] = heap[0][0]
                self.doc[item] = -heap[0][2] if heap[0][1] else np.iinfo(np.int64).max


def best(counted: DataFrame, index: Index, weights: np.ndarray, documents: int, total: int, kept: int = KEPT) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in each partition of ``term_counts``.

    A document's counts go through the postings of their terms; a task holds a slice of
    the documents times the items, and one heap for each item.
    """
    shared = counted.sparkSession.sparkContext.broadcast((index, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        items = len(own.numbers)
        if items == 0:
            return
        heaps = Heaps(items, kept)
        worth = own.repeats * np.repeat(weights, np.diff(own.starts))
        # a score stays below the sum of an item's weights times a million; doubles add it up exactly below 2^53
        exact = bool((np.bincount(own.items, worth.astype(np.float64), items) * 1e6 < 1 << 53).all())
        step = max(1, CELLS // items)
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy()
            known = np.asarray(batch.column(0).is_valid())
            rates = _rates(batch.column(1).to_numpy(), documents, total)
            terms, counts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at in range(0, batch.num_rows, step):
                rows = slice(at, at + step)
                place = np.frombuffer(b"".join(terms[rows]), "<i4")
                tf = np.frombuffer(b"".join(counts[rows]), "<i8")
                doc = np.repeat(np.arange(len(terms[rows])), [len(t) // 4 for t in terms[rows]])
                gain = 1_000_000_000 * tf // (1000 * tf + rates[rows][doc])
                sums = np.zeros(len(terms[rows]) * items, dtype=np.float64 if exact else np.int64)
                for some in _runs(own.starts[place + 1] - own.starts[place]):
                    first = own.starts[place[some]]
                    sizes = own.starts[place[some] + 1] - first
                    posting = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    cell = np.repeat(doc[some] * items, sizes) + own.items[posting]
                    add = np.repeat(gain[some], sizes) * worth[posting]
                    if exact:
                        sums += np.bincount(cell, add, len(sums))
                    else:
                        np.add.at(sums, cell, add)
                heaps.offer(sums.astype(np.int64).reshape(-1, items), ids[rows], known[rows])
        found = [(int(own.numbers[k]), -doc if there else None, score) for k, heap in enumerate(heaps.heaps) for score, there, doc in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["item", "doc_id", "score"])

    return counted.where("held is null").mapInArrow(run, "item long, doc_id long, score long")


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of about ``CELLS`` in sum."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, side="right")))
        yield slice(first, last)
        first = last


# ---- the operator


def search(docs: DataFrame, items: DataFrame, kept: int = KEPT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``kept`` highest scoring documents of each item, best first.

    Terms, weights and scores are those of the module's functions: whole numbers that
    do not depend on the order of the rows. The terms of the items become an inverted
    index, which is broadcast: at most ``MAX_POSTINGS`` postings, or those of one item;
    more items take further passes over the documents. Each document is read whole, its
    term counts go through the index, and each task keeps the best of every item in a
    heap; the heaps of all tasks are merged by rank. A term counts as equal by its
    64-bit hash.

    A null text has no terms; a document without terms does not count and is never
    found. Only scores above 0 are given, so an item may have fewer rows, or none. Equal
    scores go by document id, null last. Documents with equal ids, and items with equal
    ids, are each on their own. Other columns are not read. No documents or no items
    give an empty result.
    """
    asked = cut_lineage(items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"), F.monotonically_increasing_id().alias("item")))
    held = cut_lineage(postings(asked, "item"))
    parts = _parts(held)
    found: DataFrame | None = None
    for part in range(parts):
        index = Index.build(held.where(_part(parts) == part).toArrow())
        counted = cut_lineage(term_counts(docs, index, id_col, text_col))
        sums = counted.where("held is not null")
        row = sums.agg(F.sum("held").alias("documents"), F.sum("n").alias("total")).first()
        documents, total = row.documents or 0, row.total or 0
        holding = _document_frequencies(sums, len(index.terms))
        weights = np.array([weight(documents, int(n)) for n in holding], dtype=np.int64)
        some = best(counted, index, weights, documents, total, kept)
        found = some if found is None else found.unionByName(some)
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= kept)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _part(parts: int):
    return F.pmod(F.xxhash64("item"), F.lit(parts))


def _parts(held: DataFrame) -> int:
    """Into how many parts the items are dealt, so that none has too many postings unless it is one item."""
    parts = max(1, math.ceil(held.count() / MAX_POSTINGS))
    while held.groupBy(_part(parts).alias("part")).agg(F.count("*").alias("n"), F.min("item").alias("a"), F.max("item").alias("b")).where(f"n > {MAX_POSTINGS} and a < b").limit(1).count():
        parts *= 2
    return parts
