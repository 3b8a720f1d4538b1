"""Approximate nearest neighbours by inner product: probed lists, scanned dimension by dimension."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

#: Expected number of vectors the lists are fitted on, and the number of lists.
MAX_SAMPLE, LISTS = 20_000, 32
#: Share of the lists that a query probes.
PROBED = 0.8
#: Rotated dimensions looked at before each test, and its strictness in standard deviations: larger abandons fewer.
COLUMNS, STRICTNESS = 16, 3.0
#: Rows on either side of a block; queries scanned together.
BLOCK_ROWS, TOGETHER = 8192, 64
_ROUNDS = 10


@dataclass
class Index:
    """Centres of the lists and the random rotation."""

    centres: np.ndarray
    rotation: np.ndarray


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(values) != len(column) * len(column[0]) or len(np.unique(np.diff(column.offsets))) > 1:
        raise ValueError("vectors must be of one length")
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit(vectors: DataFrame, count: int) -> Index:
    """``LISTS`` lists for ``count`` distinct vectors: k-means on a sample of about ``MAX_SAMPLE``, in one task, and a rotation.

    ``vectors`` has vec_id and embedding. An index is of bounded size.
    """
    lists = max(1, LISTS)
    draw = F.pmod(F.xxhash64(F.lit("lists"), "vec_id"), F.lit(1_000_003)) / 1_000_003
    sample = vectors.where(draw < min(1.0, MAX_SAMPLE / max(count, 1)))

    def cluster(table: pa.Table) -> pa.Table:
        rows = _matrix(table.sort_by("vec_id").column("embedding"))
        random = np.random.default_rng(5)
        centres = rows[random.choice(len(rows), min(lists, len(rows)), replace=False)]
        for _ in range(_ROUNDS):
            nearest = (rows @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            sums, sizes = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
            np.add.at(sums, nearest, rows)
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        return pa.table({"centre": pa.array(list(centres), pa.list_(pa.float64()))})

    found = sample.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(cluster, "centre array<double>").collect()
    first = vectors.select(F.size("embedding").alias("n")).first()
    size = first["n"] if first else 1
    centres = np.array([r["centre"] for r in found]) if found else np.zeros((1, size))
    rotation, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((size, size)))
    return Index(centres, rotation)


def _spread(rows: DataFrame, index: Index, probes: int) -> DataFrame:
    """``rows`` once for each of the ``probes`` lists whose centre has the largest inner product or lies nearest."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.centres
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                score = _matrix(part.column(1)) @ centres.T - (0.5 * (centres**2).sum(axis=1) if probes == 1 else 0.0)
                lists = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                take = pa.array(np.repeat(np.arange(len(part)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(lists.ravel().astype(np.int32))], names=["key", "embedding", "list"])

    return rows.select("key", "embedding").mapInArrow(assign, f"key long, embedding {rows.schema['embedding'].dataType.simpleString()}, list int")


def scan(queries: np.ndarray, rows: np.ndarray, columns: int, strictness: float, k: int) -> list[np.ndarray]:
    """For each query the places of rows that may be among the k with the largest inner product; the others were abandoned.

    By |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, a row reaches the inner product t just if its
    squared distance is at most |q|^2 + |x|^2 - 2 t. After a random rotation the first
    d of D columns hold a Beta(d/2, (D-d)/2) share of the squared distance, with mean
    d / D and known variance. After every block of columns the partial squared
    distance, scaled up to all columns, is held against the bound plus ``strictness``
    standard deviations; a row beyond is abandoned, for it would be within the bound
    with a small chance only. t starts without limit; at every test the k-th best of
    the most hopeful rows, looked at in full, raises it. The first half of the
    columns is looked at for all rows and queries together, the rest for what is left.
    """
    size, dense = rows.shape[1], rows.shape[1] // 2 // columns * columns
    lengths = (rows**2).sum(axis=1)
    own = (queries**2).sum(axis=1)
    threshold = np.full(len(queries), -np.inf)
    left: list[np.ndarray] = [np.arange(len(rows))] * len(queries)
    partial: list[np.ndarray] = [np.zeros(len(rows))] * len(queries)
    begin = 0
    for end in range(columns, size, columns):
        part = slice(begin, end)
        near = (rows[:, part] ** 2).sum(axis=1)
        dots = queries[:, part] @ rows[:, part].T if end <= dense else None
        spread = math.sqrt(2 * (size - end) / (end * (size + 2)))
        for q, query in enumerate(queries):
            here = left[q]
            dot = dots[q, here] if dots is not None else rows[here, part] @ query[part]
            far = partial[q] + near[here] + query[part] @ query[part] - 2 * dot
            scaled, reach = far * (size / end), lengths[here] + own[q]
            if len(here) > 2 * k:
                hopeful = here[np.argpartition(scaled - reach, 2 * k)[: 2 * k]]
                threshold[q] = max(threshold[q], np.partition(rows[hopeful] @ query, k)[k])
            stay = scaled <= np.maximum(reach - 2 * threshold[q], 0.0) * (1 + strictness * spread)
            left[q], partial[q] = here[stay], far[stay]
        begin = end
    return left


def search(vectors: DataFrame, asked: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``asked`` its k rows with the largest inner product.

    ``asked`` is a condition over ``vec_id``. A row is no candidate for queries with its
    own id. Ties go to the smaller id; scores are inner products of the original
    vectors in double precision. With fewer candidates all are returned.

    Equal vectors are scanned as one: of each the k + 1 smallest ids can be among the
    results of a query, so these are all that is kept, and they are cut down before
    the shuffle. Each distinct vector lies in the list of its nearest centre, each
    distinct query probes the share ``probed`` of the lists. Lists and their queries
    are dealt out in blocks of bounded size; a block gives its best for each query.

    Rows that are null, zero, or hold null or non-finite components take no part, nor
    do rows without an id. Repeated rows count once. Vectors must be of one length.
    An empty table gives an empty result; no other columns are read.
    """
    # floats stay floats, which halves what is shuffled; other numbers keep their value as doubles
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast(kind).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("asks", asked)
    by_vector = Window.partitionBy("embedding")
    ranked = rows.withColumn("place", F.dense_rank().over(by_vector.orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place", "asks").distinct()
    grouped = ranked.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = cut_lineage(grouped.select(F.col("ids")[0].alias("key"), "ids", "embedding"))
    asking = cut_lineage(rows.where("asks").select("vec_id", "embedding").distinct())
    # a distinct query vector is scanned once, under its smallest id
    askers = cut_lineage(asking.groupBy("embedding").agg(F.min("vec_id").alias("key")))
    count = classes.count()
    index = fit(classes.select(F.col("key").alias("vec_id"), "embedding"), count)
    probes = max(1, math.ceil(probed * len(index.centres)))
    placed, probing = cut_lineage(_spread(classes, index, 1)), _spread(askers, index, probes)
    sizes = placed.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    loads = probing.groupBy("list").agg(F.count(F.lit(1)).alias("asks"))
    # one row per list, at most LISTS
    blocks = F.broadcast(cut_lineage(sizes.join(loads, "list").select("list", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("n"), F.ceil(F.col("asks") / BLOCK_ROWS).cast("int").alias("m"))))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    given = placed.join(blocks, "list").withColumn("col", own("n")).withColumn("row", every("m")).withColumn("asks", F.lit(False))
    wanted = probing.join(blocks, "list").withColumn("row", own("m")).withColumn("col", every("n")).withColumn("asks", F.lit(True))
    columns = ["list", "row", "col", "asks", "key", "embedding"]
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        keys, plain = table.column("key").to_numpy(), _matrix(table.column("embedding"))
        turned = plain @ shared.value.rotation
        rows, ids = turned[~asks], keys[~asks]
        order = np.argsort(ids)
        rows, ids, raw = rows[order], ids[order], plain[~asks][order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asking = np.flatnonzero(asks)
        for first in range(0, len(asking), TOGETHER):
            some = asking[first : first + TOGETHER]
            for place, near in zip(some, scan(turned[some], rows, COLUMNS, STRICTNESS, k + 1), strict=True):
                score = raw[near] @ plain[place]
                top = np.lexsort((ids[near], -score))[: k + 1]
                found.append((np.full(len(top), keys[place]), ids[near][top], score[top]))
        asker, key, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"asker": asker, "key": key, "score": score})

    local = given.select(*columns).unionByName(wanted.select(*columns)).groupBy("list", "row", "col").applyInArrow(best, "asker long, key long, score double")
    # every distinct vector has at least one id, so the best k + 1 vectors hold the best k rows besides the query's own
    top = Window.partitionBy("asker").orderBy(F.desc("score"), "key")
    nearest = local.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1).select("asker", "key", "score")
    named = asking.join(askers.withColumnRenamed("key", "asker"), "embedding").select(F.col("vec_id").alias("query_id"), "asker")
    pairs = named.join(nearest, "asker").join(classes.select("key", "ids"), "key").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
