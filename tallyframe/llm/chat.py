"""Chat conversations from event logs: fold the events, render a template, read it back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template: marks around every turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Roles whose texts are trained on.
LEARNED = ("assistant",)


# ---- events


def events_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """An event log that rebuilds ``rows`` (conv_id, role, text and the columns of ``order``).

    Every row opens a message. The text of an assistant is streamed in halves, taken
    back by a regeneration, and streamed again; other texts are streamed without
    their second half and then put right by an edit. A null role or text is empty.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    half = F.floor(F.length("text") / 2).cast("int")
    base = rows.select("conv_id", *order, role.alias("role"), text.alias("text"))
    head, tail = F.substr(F.col("text"), F.lit(1), half), F.substr(F.col("text"), half + 1)
    event = lambda seq, kind, part: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), part.alias("part"))
    nothing = F.lit(None).cast("string")
    streamed = F.array(event(0, "open", F.col("role")), event(1, "delta", tail), event(2, "regenerate", nothing), event(3, "delta", head), event(4, "delta", tail))
    edited = F.array(event(0, "open", F.col("role")), event(1, "delta", head), event(2, "edit", F.col("text")))
    log = base.select("conv_id", *order, F.explode(F.when(F.col("role").isin(*LEARNED), streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", *order, "e.seq", "e.kind", "e.part")


def fold(events: DataFrame, order: list[str]) -> DataFrame:
    """(conv_id, place, role, text): the final messages of every conversation, from 0.

    ``events`` has conv_id, the columns of ``order`` that name and order a message,
    ``seq`` within the message, ``kind`` and ``part``. ``open`` begins a message with the
    role in ``part``, ``delta`` appends, ``edit`` replaces the text, ``regenerate`` empties
    it, ``delete`` takes the message out; another kind raises an error. A message that
    was never opened has an empty role; a null part is empty; a null conv_id is a
    conversation of its own. The log is partitioned by conversation and sorted, and
    one message is held at a time, so a conversation of any length goes through in
    bounded memory. The messages of a conversation come out together and in order.
    """
    width = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts, alive = None, "", [], False
        conv, place, begun, rows = None, 0, False, []

        def finish() -> None:
            nonlocal place
            if alive:
                rows.append((conv, place, role, "".join(parts)))
                place += 1

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now, kind, part = values[: 1 + width], values[-2], values[-1] or ""
                if not begun or now != key:
                    finish()
                    if not begun or now[0] != conv:
                        conv, place = now[0], 0
                    key, role, parts, alive, begun = now, "", [], True, True
                if kind == "open":
                    role = part
                elif kind == "delta":
                    parts.append(part)
                elif kind == "edit":
                    parts = [part]
                elif kind == "regenerate":
                    parts = []
                elif kind == "delete":
                    alive = False
                else:
                    raise ValueError(f"unknown kind of event: {kind}")
            if rows:
                yield _messages(rows)
                rows = []
        finish()
        if rows:
            yield _messages(rows)

    dealt = events.repartition("conv_id").sortWithinPartitions("conv_id", *order, "seq", "kind", "part")
    return dealt.select("conv_id", *order, "kind", "part").mapInArrow(run, "conv_id long, place long, role string, text string")


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", "place", "role", "text"])


# ---- template


def escape(text: Column) -> Column:
    """Text in which no mark of the template can stand: every & is written out, and every <| begins with &lt;."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: str) -> str:
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, place, segment): each message in the template. The text of a conversation is its segments in order."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    segment = F.concat(F.lit(OPEN), role, F.lit("\n"), escape(F.col("text")), F.lit(CLOSE + "\n"))
    return messages.select("conv_id", "place", segment.alias("segment"))


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered message."""
    if not (segment.startswith(OPEN) and segment.endswith(CLOSE + "\n")):
        raise ValueError("a segment does not begin or end with its mark")
    role, _, text = segment[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return unescape(role.replace("&#10;", "\n")), unescape(text)


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation with counts and digests of what its segments say.

    Takes the result of ``render``, whose conversations come together and in order,
    and reads every segment once: the digests grow as it goes, so no conversation is
    held. The loss mask covers the texts of ``LEARNED`` roles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, learned, counts, begun = None, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], False

        def row() -> pa.RecordBatch:
            values = [conv, counts[0], turns.hexdigest(), counts[1], learned.hexdigest(), counts[2]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[pa.RecordBatch] = []
        for batch in batches:
            for now, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or now != conv:
                    if begun:
                        done.append(row())
                    conv, turns, learned, counts, begun = now, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], True
                role, text = parse(segment)
                turns.update(f"{role}\n{text}\n".encode())
                if role in LEARNED:
                    learned.update(text.encode())
                    counts[1] += len(text)
                counts[0] += 1
                counts[2] += len(segment)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if begun:
            yield row()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return segments.select("conv_id", "segment").mapInArrow(run, schema)
