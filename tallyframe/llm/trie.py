"""The prefix trie of conversations: a count-min sketch of prefix digests keeps unshared tails out of the shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import words
from tallyframe.llm.meeting import meet
from tallyframe.session import cut_lineage

#: Rows of the sketch, cells of a row for each prefix, and bounds of a row's cells; a cell takes two bits.
ROWS = 3
CELLS_PER_PREFIX = 8
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 26
#: Cells that are merged together.
SLICE = 1 << 16
#: Conversation ids written out at once.
CHUNK = 8192

_NODE = ["depth", "s1", "s2"]


# ---- turns in order


def numbered(rows: DataFrame, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Turns in order, as (turns, spans).

    ``turns`` has conv_id, ``mark`` (a digest of role and text), ``bytes`` of the text,
    ``at``, which rises with conversation and turn, and its ``span``. ``spans`` has for
    each conversation and span the ``first`` at, the number ``n`` of its turns, those
    ``before`` it and in ``total``; so a turn has the place at - first + before + 1.

    Turns go by turn, null first, then role and a digest of the text; a null role or
    text is empty, a null conv_id is left out. Only digests are shuffled. The rows are
    cut by ranges of conversation and turn, so a long conversation is many spans.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    keyed = rows.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        F.md5(text).alias("text"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),  # equal turns, which have no order, in several ranges
    )
    order = ["conv_id", "turn", "role", "text", "spread"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.md5(F.concat(F.md5("role"), "text"))
    turns = cut_lineage(ranged.select("conv_id", mark.alias("mark"), "bytes", F.monotonically_increasing_id().alias("at")).withColumn("span", F.shiftright("at", 33)))
    spans = turns.groupBy("conv_id", "span").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns, spans.withColumn("before", before).withColumn("total", F.sum("n").over(whole))


def _steps(depth: Column, mark: Column) -> list[Column]:
    """Two digests of a turn at its depth; the exclusive or of those of all turns up to a depth names the prefix."""
    depth = depth.cast("long")
    return [F.xxhash64(depth, mark).alias("x1"), F.xxhash64(mark, depth).alias("x2")]


def branched(rows: DataFrame, base: Column, head: Column, most: int, **columns: str) -> DataFrame:
    """Prefixes of rebuilt conversations: the first ``head`` turns of conversation ``base``, then the own turns after the first ``head``.

    ``base`` and ``head`` (0 to ``most``) are expressions over conv_id; of a base that is
    shorter all turns are taken, of an absent one none, and a conversation that is its
    own base stays as it is. The result has a row for every conversation and depth
    from 0 to its ``whole`` number of turns: the digests ``x1, x2`` of the turn and
    ``s1, s2`` of the prefix, the ``bytes`` of the turn and ``upto`` it.
    """
    turns, spans = numbered(rows, **columns)
    spans = cut_lineage(spans)
    convs = spans.where("before = 0").select("conv_id", "total", base.cast("long").alias("base"), F.when(base == F.col("conv_id"), 0).otherwise(head).cast("long").alias("cut"))
    early = turns.join(spans.where(F.col("before") < most).select("conv_id", "span", "first", "before"), ["conv_id", "span"])
    early = early.withColumn("depth", F.col("at") - F.col("first") + F.col("before") + 1).where(F.col("depth") <= most)
    early = early.join(convs.where("cut > 0").select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi")
    heads = early.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("depth", *_steps(F.col("depth"), F.col("mark")), "bytes"))).alias("turns"))

    taken = F.coalesce(F.slice("turns", F.lit(1), F.col("cut").cast("int")), F.array().cast("array<struct<depth:bigint,x1:bigint,x2:bigint,bytes:bigint>>"))
    convs = convs.join(heads, "base", "left").select("conv_id", "total", "cut", taken.alias("taken"))
    summed = lambda parts, c: F.aggregate(parts, F.lit(0).cast("long"), lambda a, e: a + e[c] if c == "bytes" else a.bitwiseXOR(e[c]))
    convs = convs.select(
        "conv_id", "cut", "taken", F.size("taken").cast("long").alias("kept"), (F.size("taken") + F.greatest(F.col("total") - F.col("cut"), F.lit(0))).alias("whole"),
        *[summed(F.col("taken"), c).alias(n) for c, n in (("x1", "s1"), ("x2", "s2"), ("bytes", "upto"))],
    )
    convs = cut_lineage(convs)

    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("s1"), zero.alias("s2"), zero.alias("bytes"), zero.alias("upto"), "whole")
    upto = lambda e, c: summed(F.filter("taken", lambda o: o["depth"] <= e["depth"]), c)
    cumulated = F.transform("taken", lambda e: F.struct(e["depth"], e["x1"], e["x2"], upto(e, "x1").alias("s1"), upto(e, "x2").alias("s2"), e["bytes"], upto(e, "bytes").alias("upto")))
    first = convs.select("conv_id", "whole", F.inline(cumulated)).select(roots.columns)

    placed = turns.join(spans.join(convs.drop("taken"), "conv_id"), ["conv_id", "span"])
    placed = placed.withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1).where("place > cut").withColumn("depth", F.col("kept") + F.col("place") - F.col("cut"))
    own = cut_lineage(placed.select("conv_id", "span", "at", "depth", *_steps(F.col("depth"), F.col("mark")), "bytes", "whole", "s1", "s2", "upto", (F.col("n") < F.col("total")).alias("parted")))
    # what earlier spans of the same conversation add up to; only the conversations at the bounds of ranges have several
    sums = own.where("parted").groupBy("conv_id", "span").agg(F.bit_xor("x1").alias("o1"), F.bit_xor("x2").alias("o2"), F.sum("bytes").alias("o3"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conv_id", "span", F.bit_xor("o1").over(earlier).alias("o1"), F.bit_xor("o2").over(earlier).alias("o2"), F.sum("o3").over(earlier).alias("o3"))
    along = Window.partitionBy("conv_id", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({"l1": F.bit_xor("x1").over(along), "l2": F.bit_xor("x2").over(along), "l3": F.sum("bytes").over(along)})
    own = own.join(F.broadcast(offsets), ["conv_id", "span"], "left")  # at most two spans for each range
    joined = lambda s, part, o: F.col(s).bitwiseXOR(F.col(part)).bitwiseXOR(F.coalesce(F.col(o), zero)).alias(s)
    later = own.select("conv_id", "depth", "x1", "x2", joined("s1", "l1", "o1"), joined("s2", "l2", "o2"), "bytes", (F.col("upto") + F.col("l3") + F.coalesce("o3", zero)).alias("upto"), "whole")
    return roots.unionByName(first).unionByName(later)


# ---- the sketch


class Sketch:
    """A count-min sketch that tells 0, 1 and more: each cell holds the smaller of its count and 2.

    The estimate of a digest is the smallest of its cells and never too small, so 1
    proves that it was counted once.
    """

    def __init__(self, width: int, packed: np.ndarray) -> None:
        self.width, self.packed = width, packed

    @staticmethod
    def cells(s1: np.ndarray, s2: np.ndarray, width: int) -> np.ndarray:
        """The cells of each digest, one in each row of the sketch."""
        a, b = words.mix(s1.view(np.uint64)), words.mix(s2.view(np.uint64)) | np.uint64(1)
        return np.stack([np.int64(width * k) + ((a + np.uint64(k) * b) >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64) for k in range(ROWS)])

    def estimate(self, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
        cells = self.cells(s1, s2, self.width)
        return (self.packed[cells >> 2] >> (2 * (cells & 3)).astype(np.uint8) & 3).min(axis=0)


def sketch(prefixes: DataFrame) -> Sketch:
    """The sketch of all prefixes but the root, as wide as their number asks for and the bounds allow.

    Tasks send the cells they meet, two bytes each, by slices; every slice is added
    up in one place.
    """
    counted = prefixes.where("depth > 0").select("s1", "s2")
    width = MIN_CELLS
    wanted = min(CELLS_PER_PREFIX * counted.count(), MAX_CELLS)
    while width < wanted:
        width *= 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.sort(Sketch.cells(*(c.to_numpy() for c in batch.columns), width), axis=None)
            numbers, first = np.unique(cells // SLICE, return_index=True)
            within = (cells % SLICE).astype("<u2").tobytes()
            stops = [*first[1:].tolist(), len(cells)]
            parts = [within[2 * a : 2 * b] for a, b in zip(first.tolist(), stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(parts, pa.binary())], names=["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, waiting, size = None, None, [], 0

        def settle() -> None:
            nonlocal counts, size
            found = np.bincount(np.frombuffer(b"".join(waiting), "<u2"), minlength=SLICE)
            counts = np.minimum(found if counts is None else counts + found, 2)
            waiting.clear()
            size = 0

        def row() -> pa.RecordBatch:
            settle()
            quarters = counts.astype(np.uint8).reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
            packed = np.bitwise_or.reduce(quarters, axis=1).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed], pa.binary())], names=["slice", "packed"])

        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number != now:
                    if now is not None:
                        yield row()
                    now, counts = number, None
                waiting.append(cells)
                size += len(cells)
                if size > 8 * SLICE:
                    settle()
        if now is not None:
            yield row()

    sent = counted.mapInArrow(send, "slice long, cells binary")
    slices = sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice long, packed binary").toArrow()
    packed = np.zeros((ROWS * width // SLICE, SLICE // 4), dtype=np.uint8)
    for number, part in zip(slices.column("slice").to_pylist(), slices.column("packed").to_pylist(), strict=True):
        packed[number] = np.frombuffer(part, np.uint8)
    return Sketch(width, packed.reshape(-1))


def screened(prefixes: DataFrame, found: Sketch) -> DataFrame:
    """``prefixes`` with ``single`` (the sketch proves that one conversation has it) and ``above`` (the same of the prefix before)."""
    shared = prefixes.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            depth, x1, x2, s1, s2 = (batch.column(c).to_numpy() for c in ("depth", "x1", "x2", "s1", "s2"))
            single = (own.estimate(s1, s2) == 1) & (depth > 0)
            above = (own.estimate(s1 ^ x1, s2 ^ x2) == 1) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(above)], names=[*batch.schema.names, "single", "above"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema.fields)
    return prefixes.mapInArrow(run, f"{fields}, single boolean, above boolean")


# ---- grouping


def _ends(rows: DataFrame) -> DataFrame:
    """For each node the digest of its conversation ids, in ascending order and joined by commas.

    Ids are put into texts of ``CHUNK`` ids by ranges; the texts of a node then run
    through one digest, in order and one at a time.
    """
    schema = "depth long, s1 long, s2 long, first long, ids string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def row() -> pa.RecordBatch:
            values = [*now, ids[0], ",".join(map(str, ids))]
            return pa.RecordBatch.from_pydict(dict(zip([*_NODE, "first", "ids"], ([v] for v in values), strict=True)), pa.schema([(c, pa.int64()) for c in (*_NODE, "first")] + [("ids", pa.string())]))

        for batch in batches:
            done = []
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now or len(ids) == CHUNK:
                    if ids:
                        done.append(row())
                    now, ids = node, []
                ids.append(conv)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done = []
            for *node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now:
                    if now is not None:
                        done.append((*now, running.hexdigest()))
                    now, running = node, hashlib.sha256(text.encode())
                else:
                    running.update(f",{text}".encode())
            if done:
                yield _digests(done)
        if now is not None:
            yield _digests([(*now, running.hexdigest())])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*_NODE, "ends_sha256"])

    order = [*_NODE, "conv_id"]
    texts = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, schema)
    dealt = texts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return dealt.select(*_NODE, "ids").mapInArrow(digest, "depth long, s1 long, s2 long, ends_sha256 string")


def trie(prefixes: DataFrame) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``prefixes`` is the result of ``branched``, or has its columns. A node is a
    distinct sequence of turns, the root the empty one; conv_id is its smallest member.
    A count-min sketch of all digests is broadcast, of bounded size. Where it proves
    that one conversation alone has a prefix, the node follows from that row; the
    others, and whatever a full sketch cannot tell, are grouped exactly by depth and a
    digest of 128 bits.

    No tree is walked. A node belongs to its smallest member, which owns a path from
    some depth down to its end; so children, leaves and bytes below a node are sums over
    the members, of the paths that begin right below it, of those that end in a leaf,
    and of the bytes of the turns before a member's own path. A prefix that a third of
    all conversations share is summed up before it is shuffled. An empty table has no
    nodes, not even a root.
    """
    marked = cut_lineage(screened(prefixes, sketch(prefixes)))
    shared = marked.where("not single").drop("single", "above", "x1", "x2")
    groups = cut_lineage(shared.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.max("whole").alias("deepest"), F.count("*").alias("n")))
    members = cut_lineage(meet(shared, groups, _NODE, "n"))
    strange, ending = F.col("owner") != F.col("conv_id"), F.col("depth") == F.col("whole")
    paths = members.groupBy("conv_id").agg(
        F.count_if(strange).alias("begins"),  # the first depth it owns
        F.expr("max_by(owner, depth) filter (where owner <> conv_id)").alias("from_conv"),
        F.coalesce(F.max(F.when(strange, F.col("upto"))), F.lit(0)).alias("foreign"),
        (~F.bool_or(ending) | F.bool_or(ending & ~strange & (F.col("deepest") == F.col("depth")))).alias("leaf"),
        F.count("*").alias("n"),
    )
    paths = cut_lineage(paths)

    parent = F.when(F.col("depth") > F.col("begins"), F.col("conv_id")).when(F.col("depth") > 0, F.col("from_conv"))
    told = meet(members.drop("deepest"), paths, ["conv_id"], "n")
    begun = (F.col("whole") > F.col("depth")) & (F.col("begins") <= F.col("depth") + 1)
    nodes = told.groupBy(*_NODE).agg(
        F.min("owner").alias("conv_id"),
        F.max(F.when(~strange, parent)).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if(begun).alias("n_children"),
        F.count_if(F.col("leaf")).alias("n_leaves"),
        F.sum(F.greatest(F.col("foreign") - F.col("upto") + F.col("bytes"), F.lit(0))).alias("saved_tokens"),
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.sha2(F.lit(b""), 256)
    grouped = nodes.join(_ends(members.where(ending)), _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).select(columns)

    one = F.lit(1).cast("long")
    own_end = F.when(ending, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing)
    alone = [one.alias("n_convs"), (F.col("whole") > F.col("depth")).cast("long").alias("n_children"), one.alias("n_leaves"), (one - one).alias("saved_tokens"), own_end.alias("ends_sha256")]
    tails = marked.where("single and above").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *alone)
    tops = marked.where("single and not above").join(paths.select("conv_id", "begins", "from_conv"), "conv_id").select("conv_id", "depth", parent.alias("parent_conv_id"), *alone)
    return grouped.unionByName(tails).unionByName(tops)
