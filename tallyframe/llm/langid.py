"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

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

#: n-grams of 1 to 3 characters, words wrapped in blanks, hashed to so many buckets.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
UNKNOWN = "und"
#: Expected number of labelled rows the weights are fitted on. Document frequencies count all rows.
MAX_TRAINING_ROWS = 6000
EPOCHS = 3
#: Learning rate, and the elastic net: absolute and squared penalty.
RATE, ABSOLUTE, SQUARED = 1.0, 0.02, 0.02

_BLANK = ord(" ")


def _fold_table() -> np.ndarray:
    """For each code point below 0x3000 the lower-case letter it counts as, or a blank. Others are kept if they are letters."""
    table = np.full(0x3000, _BLANK, dtype=np.uint32)
    for point in range(0x3000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


_FOLD = _fold_table()


def _points(text: str) -> np.ndarray:
    """Folded code points: letters in lower case, every run of other characters as one blank, a blank at each end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = raw < len(_FOLD)
    folded = _FOLD[np.where(low, raw, 0)] if low.all() else np.where(low, _FOLD[np.where(low, raw, 0)], raw)
    if not low.all():
        far = np.flatnonzero(~low)
        folded[far[[not chr(p).isalpha() for p in folded[far]]]] = _BLANK
    folded = np.concatenate([[_BLANK], folded, [_BLANK]]).astype(np.uint64)
    blank = folded == _BLANK
    return folded[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of a text, with repetitions; empty if it has no letter."""
    points = _points(text)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    found = []
    for n in ORDERS:
        code = points[: len(points) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint64(0x110000) + points[k : len(points) - n + 1 + k]
        found.append(words.mix(code + np.uint64(n << 60)) >> np.uint64(64 - 15))
    return np.concatenate(found).astype(np.int64)


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of unit length; the term frequency is damped by a logarithm."""
    counts = np.bincount(grams(text), minlength=BUCKETS)
    place = np.flatnonzero(counts)
    value = (1 + np.log(counts[place])) * idf[place]
    length = math.sqrt(float(value @ value))
    return place, value / length if length else value


# ---- counting and fitting


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): in how many texts of the whole table each bucket occurs; bucket -1 counts texts with a letter.

    Every task adds up its rows in one array and sends one row per bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, texts = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen = np.bincount(grams(text.as_py() or ""), minlength=BUCKETS) > 0
                total += seen
                texts += bool(seen.any())
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(place, -1)), pa.array(np.append(total[place], texts))], names=["bucket", "n"])

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # language x bucket
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray | None:
        """Calibrated probabilities of the languages; None if the text has no letter."""
        place, value = _features(text, self.idf)
        return None if len(place) == 0 else _softmax((self.weights[:, place] @ value + self.bias) / self.temperature)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def _closed_form(total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The leader's weights for summed gradients: zero within the absolute penalty, else shrunk by the squared one."""
    return np.where(np.abs(total) <= ABSOLUTE, 0.0, -(total - np.sign(total) * ABSOLUTE) / ((1.0 + np.sqrt(squares)) / RATE + SQUARED))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], held: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and temperature by follow-the-regularised-leader over sparse rows.

    ``held`` rows take no part in the weights; the temperature is the one that
    makes their labels likeliest, found by golden section between 1/4 and 4: rows that
    are told apart perfectly would else drive it to zero.
    """
    total, squares = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            place, value, label = rows[k]
            place, value = np.append(place.astype(np.int64), BUCKETS), np.append(value.astype(float), 1.0)
            z, n = total[:, place], squares[:, place]
            w = _closed_form(z, n)
            error = _softmax(w @ value)
            error[label] -= 1
            gradient = error[:, None] * value
            grown = n + gradient**2
            total[:, place] = z + gradient - (np.sqrt(grown) - np.sqrt(n)) / RATE * w
            squares[:, place] = grown
    weights = _closed_form(total, squares)
    logits = np.array([weights[:, :-1][:, p] @ v + weights[:, -1] for p, v, _ in held]).reshape(len(held), classes)
    truth = np.array([label for _, _, label in held], dtype=np.int64)

    def loss(log_t: float) -> float:
        chance = _softmax(logits / math.exp(log_t))[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(chance, 1e-12)).mean())

    return weights[:, :-1], weights[:, -1], math.exp(_golden(loss, math.log(0.25), math.log(4.0))) if len(held) else 1.0


def _golden(loss, low: float, high: float) -> float:
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(40):
        if loss(a) < loss(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return (low + high) / 2


def _up_to(share: float) -> int:
    """The long below which this share of all longs lies."""
    return (1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from the rows of ``docs`` with a language, all of which count for the document frequencies.

    The weights are fitted on a sample of about ``max_rows`` rows, an equal share of
    each language, drawn by a hash of id and text; a fifth of it sets the temperature.
    Equal rows are one draw and learned from once, and of every language at least one
    row is drawn, so neither copies nor repeated or null ids empty the sample or fill it.
    A row with more letters costs no more: it is at most one value per bucket.
    Without labelled rows the model has no languages and answers ``und``.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    known = known.withColumn("draw", F.xxhash64(F.lit("langid"), "doc_id", "text"))
    sizes = {r["lang"]: r for r in known.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0), 1.0)
    seen = {r["bucket"]: r["n"] for r in document_frequencies(known).collect()}
    idf = np.zeros(BUCKETS)
    for bucket, n in seen.items():
        if bucket >= 0:
            idf[bucket] = 1 + math.log((1 + seen[-1]) / (1 + n))
    share = max(1, max_rows // len(languages))
    # draws are spread evenly over all longs; the smallest one is always in
    limits = F.create_map(*[F.lit(x) for lang in languages for x in (lang, max(sizes[lang]["least"], _up_to(share / max(1, sizes[lang]["n"]))))])
    sample = known.where(F.col("draw") <= limits[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"])
    number = {lang: k for k, lang in enumerate(languages)}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_features(t.as_py() or "", idf) for t in batch.column(1)]
            columns = [batch.column(3), pa.array([number[lang.as_py()] for lang in batch.column(2)], pa.int32())]
            columns += [pa.array([p.astype("<u2").tobytes() for p, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["draw", "label", "place", "value"])

    drawn = sample.mapInArrow(extract, "draw long, label int, place binary, value binary").where(F.length("place") > 0)

    def learn(table: pa.Table) -> pa.Table:
        rows, held = [], []
        table = table.sort_by([("draw", "ascending"), ("label", "ascending")])
        for k, (label, place, value) in enumerate(zip(table.column("label"), table.column("place"), table.column("value"), strict=True)):
            row = (np.frombuffer(place.as_buffer(), "<u2"), np.frombuffer(value.as_buffer(), "<f4"), label.as_py())
            (held if k % 5 == 4 else rows).append(row)
        weights, bias, temperature = fit(rows, held, len(languages))
        lang, bucket = np.nonzero(weights)
        spare = np.full(len(languages), -1), np.arange(len(languages))
        columns = [np.concatenate([lang, spare[1], [-1]]), np.concatenate([bucket, spare[0], [-1]]), np.concatenate([weights[lang, bucket], bias, [temperature]])]
        return pa.table({"language": pa.array(columns[0], pa.int32()), "bucket": pa.array(columns[1], pa.int32()), "weight": pa.array(columns[2])})

    fitted = drawn.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "language int, bucket int, weight double").collect()
    model = Model(languages, idf, np.zeros((len(languages), BUCKETS)), np.zeros(len(languages)), 1.0)
    for language, bucket, weight in fitted:
        if language < 0:
            model.temperature = weight
        elif bucket < 0:
            model.bias[language] = weight
        else:
            model.weights[language, bucket] = weight
    return model


# ---- applying


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability.

    The whole text is read. A null text and one without letters give ``und`` with
    score 0, and so does a model without languages. All columns are kept; input
    columns with the names of the results are replaced. Ties go to the language
    that comes first by name. The model is broadcast: its size is languages times
    2^15 numbers, whatever the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        release()
        best = shared.value
        langs, scores = [], []
        for text in texts:
            chance = best.probabilities(text.as_py() or "") if best.languages else None
            k = None if chance is None else int(chance.argmax())
            langs.append(UNKNOWN if k is None else best.languages[k])
            scores.append(0.0 if k is None else float(chance[k]))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    found = docs.select(*kept, predict(F.col(f"`{text_col}`")).alias("_found"))
    return found.select(*kept, F.col("_found.lang").alias(lang_out), F.col("_found.score").alias(score_out))
