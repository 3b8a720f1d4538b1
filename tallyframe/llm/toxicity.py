"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallyframe.llm import words
from tallyframe.llm.memory import release

#: Single words, neighbours, and words with one between them, hashed to 2^BITS buckets.
BITS = 20
#: Expected numbers of labelled rows the weights are fitted on.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
EPOCHS = 5
#: Rate per coordinate ALPHA / (BETA + root of its summed squared gradients); absolute and squared penalty.
ALPHA, BETA, ABSOLUTE, SQUARED = 0.5, 1.0, 8.0, 0.1
#: Scores from here on count as toxic.
THRESHOLD = 0.3

_BREAKS = words.breaks("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_A, _B, _C, _D, _E = words.multipliers(5, 47)


def _buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For slices of rows: the rows, the buckets of all their features, and the number of rows."""
    for data, offsets in words.slices(texts):
        hashes, firsts = words.word_hashes(data, offsets, _BREAKS)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
        codes, rows = [hashes * _A], [row]
        for gap, one, two in ((1, _B, _C), (2, _D, _E)):
            near = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, dtype=bool)
            codes.append((hashes[: len(near)] * one + hashes[gap : gap + len(near)] * two)[near])
            rows.append(row[: len(near)][near])
        yield np.concatenate(rows), (words.mix(np.concatenate(codes)) >> np.uint64(64 - BITS)).astype(np.int64), len(offsets) - 1


def _per_row(rows: np.ndarray, buckets: np.ndarray, count: int) -> list[np.ndarray]:
    """The distinct buckets of each row."""
    both = np.unique((rows << BITS) | buckets)
    return np.split(both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(1, count)))


@dataclass
class Model:
    """The buckets with a weight, in order, and the weights: L1 leaves few of them."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        found = [np.zeros(0)]
        for rows, buckets, count in _buckets(texts):
            at = np.searchsorted(self.places, buckets)
            known = np.flatnonzero(self.places[np.minimum(at, len(self.places) - 1)] == buckets) if len(self.places) else np.zeros(0, dtype=np.int64)
            both = np.unique(rows[known] * len(self.places) + at[known])
            total = np.bincount(both // max(len(self.places), 1), weights=self.weights[both % max(len(self.places), 1)], minlength=count) if len(both) else np.zeros(count)
            found.append(1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40))))
        return np.concatenate(found)


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) by FTRL-proximal over rows of distinct buckets with label 0 or 1."""
    size = 1 << BITS
    total, squares = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, ABSOLUTE)
    penalty[size] = 0.0  # the bias is free

    def leader(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + SQUARED))

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            place, label = rows[k]
            place = np.append(place.astype(np.int64), size)
            z, n = total[place], squares[place]
            w = leader(z, n, penalty[place])
            error = 1 / (1 + math.exp(-min(max(float(w.sum()), -40.0), 40.0))) - label
            grown = n + error * error
            total[place] = z + error - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
            squares[place] = grown
    weights = leader(total, squares, penalty)
    places = np.flatnonzero(weights[:size])
    return places, weights[places], float(weights[size])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model from the labels whose id is in ``docs``.

    Fitted on about ``max_toxic`` toxic and ``max_clean`` clean rows, drawn by a hash
    of the id; scores refer to this mixture, which leans towards catching. An id
    with several labels is toxic if one of them says so; null labels do not count.
    The drawn labels are broadcast, at most the two numbers of rows, so the texts
    are not shuffled; of the texts that share an id one is learned from. Without labels of both kinds all scores equal the share of
    toxic labels, or 0 without any.
    """
    marked = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    marked = marked.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(F.max((F.col(f"`{label_col}`") == 1).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 40.0 if toxic else -40.0)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    shares = min(1.0, max_toxic / toxic), min(1.0, max_clean / clean)
    drawn = marked.where(draw < F.when(F.col("label") == 1, shares[0]).otherwise(shares[1]))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    met = source.join(F.broadcast(drawn), "doc_id")
    sample = met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [p for part in _buckets(batch.column(2)) for p in _per_row(*part)]
            columns = [batch.column(0), batch.column(1), pa.array([p.astype("<u4").tobytes() for p in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "places"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        rows = [(np.frombuffer(p.as_buffer(), "<u4"), n.as_py()) for n, p in zip(table.column("label"), table.column("places"), strict=True)]
        places, weights, bias = fit(rows)
        return pa.table({"bucket": pa.array(np.append(places, -1)), "weight": pa.array(np.append(weights, bias))})

    features = sample.mapInArrow(extract, "doc_id long, label int, places binary")
    fitted = features.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "bucket long, weight double").toPandas().sort_values("bucket")
    bias = float(fitted["weight"].iloc[0]) if len(fitted) else math.log(toxic / clean)
    return Model(fitted["bucket"].to_numpy()[1:], fitted["weight"].to_numpy()[1:], bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_out: str = "score", predicted_out: str = "predicted") -> DataFrame:
    """``docs`` with the chance of being toxic and whether it reaches ``THRESHOLD``.

    The whole text is read; a null or empty text gets the score of a text without
    known features. All columns are kept; input columns with the names of the
    results are replaced. The broadcast model holds the weights that are not zero,
    at most 2^20 of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (score_out, predicted_out)]
    found = docs.select(*kept, apply(F.col(f"`{text_col}`")).alias(score_out))
    return found.withColumn(predicted_out, (F.col(f"`{score_out}`") >= THRESHOLD).cast("int"))
