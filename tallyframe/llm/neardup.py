"""Near-duplicate documents by MinHash bands and sequential Bayesian verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import words
from tallyframe.llm.components import components
from tallyframe.llm.held import Held
from tallyframe.llm.memory import release
from tallyframe.session import cut_lineage

SHINGLE = 5
SIMILARITY = 75  # percent
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
#: Hashes compared before each look at the posterior.
BATCH = 32
#: A pair is pruned when the chance that it is similar enough falls below this.
MISS = 1e-6
#: Rounds that compare bucket members with one of them, before what is left is compared in full.
STAR_ROUNDS = 1
#: Bits of the filter by which a scan skips texts that no candidate pair needs. Fixed, so it may be broadcast.
FILTER_BITS = 24
#: Rows on either side of a block of full comparisons.
BLOCK_ROWS = 1024

_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"
_SETS = "doc_id long, shingles binary"
_PAIR = "a long, b long"


# ---- signatures


def _signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 256):
        np.minimum(least, (shingles[k : k + 256, None] * factors + shifts).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """(ids of the batch, row, sorted distinct shingles) for every row."""
    for batch in batches:
        row = 0
        for data, offsets in words.slices(batch.column(1)):
            for shingles in words.shingle_hashes(*words.word_hashes(data, offsets), SHINGLE):
                yield batch.column(0), row, np.unique(shingles)
                row += 1


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size of its shingle set, two 64-bit digests of the set, its MinHash signature.

    Texts without words have size 0, digests 0 and a null signature. Only the two
    named columns are read. A set is summed into each digest, so that order and
    repetitions do not matter.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        factors, shifts = words.multipliers(HASHES, 101), words.multipliers(HASHES, 211)
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])

        def rows() -> Iterator[tuple]:
            for ids, row, shingles in _shingle_sets(batches):
                if len(shingles):
                    digests = [int(words.mix(shingles ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (0x5A5A, 0xC3C3C3)]
                    yield ids[row].as_py(), len(shingles), *digests, _signature(shingles, factors, shifts).tobytes()
                else:
                    yield ids[row].as_py(), 0, 0, 0, None

        yield from _batched(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, _SIGNED)


# ---- verification


def least_matches(similarity: float, miss: float = MISS) -> list[int]:
    """For each batch the least number of equal hashes with which a pair goes on.

    With a uniform prior the similarity after m equal of n hashes is distributed as
    Beta(m + 1, n - m + 1); its chance to reach the threshold t is that of at most
    m successes in n + 1 draws with probability t.
    """
    limits = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        limits.append(m)
    return limits


def _survivors(left: np.ndarray, right: np.ndarray, limits: list[int]) -> np.ndarray:
    """Places of the row pairs that stay after every batch; later batches see survivors only."""
    rows = np.arange(len(left))
    equal = np.zeros(len(left), dtype=np.int64)
    for k, limit in enumerate(limits):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (left[rows, part] == right[rows, part]).sum(axis=1)
        rows, equal = rows[equal >= limit], equal[equal >= limit]
    return rows


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, HASHES)


def prune(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) that survive the sequential comparison of their signatures."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = least_matches(SIMILARITY / 100)
        for batch in batches:
            if len(batch):
                stay = _survivors(_unpack(batch.column(2)), _unpack(batch.column(3)), limits)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(stay)) for k in (0, 1)], names=["a", "b"])

    side = lambda c, s: signed.select(F.col("doc_id").alias(c), F.col("signature").alias(s))
    joined = pairs.join(side("a", "sig_a"), "a").join(side("b", "sig_b"), "b")
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(compare, _PAIR)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def wanted_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the documents whose ids are in ``wanted``, and of a few others.

    The ids are folded into a bitmap of fixed size that every task of the scan
    holds, so texts that are not needed are dropped where they are read. A document
    let through by chance is harmless, as sets are joined by id afterwards.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    folded = wanted.select(F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("low"))
    folded = folded.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("low"))).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bitmap[folded.column("word").to_numpy()] = folded.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63)) & 1
            found = batch.filter(pa.array(hit.astype(bool)))
            if len(found):
                yield pa.RecordBatch.from_arrays(found.columns[:2], names=["doc_id", "text"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
        yield from _batched(((ids[row].as_py(), s.tobytes()) for ids, row, s in _shingle_sets(let_through(batches))), schema, 500)

    return docs.where("doc_id is not null").select("doc_id", "text", bit.alias("bit")).mapInArrow(gather, _SETS)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = []
            for k, (one, two) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                sides = [[np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in side.values] for side in (one, two)]
                if any(_similar(x, y) for x in sides[0] for y in sides[1]):
                    stay.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(stay, pa.int64())) for k in (0, 1)], names=["a", "b"])

    # both ends take their sets in one join, so the texts are read once; an id has one set, or several if rows share it
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    joined = ends.join(wanted_sets(docs, ends.select("doc_id")), "doc_id")
    side = lambda c: F.collect_list(F.when(F.col("doc_id") == F.col(c), F.col("shingles"))).alias(f"set_{c}")
    return joined.groupBy("a", "b").agg(side("a"), side("b")).mapInArrow(check, _PAIR)


# ---- candidates


def buckets(signed: DataFrame) -> DataFrame:
    """(bucket, doc_id, size) for every band of every signature that at least two documents share."""
    bands = [F.xxhash64(F.lit(k), F.substring("signature", 1 + 4 * BAND_ROWS * k, 4 * BAND_ROWS)) for k in range(BANDS)]
    rows = signed.select("doc_id", F.explode(F.array(*bands)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "bucket").select("bucket", "doc_id", "size")


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that still hold different components."""
    spread = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return members.join(spread.select("bucket"), "bucket", "left_semi")


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each open bucket picks one member; all members of other components are paired with it.

    The first turn picks the member that shares most buckets with others, which in a
    group of copies is one near their common origin; later turns draw one at random.
    """
    met = F.sum("size").alias("met")
    ranked = members.join(members.groupBy("doc_id").agg(met), "doc_id") if turn == 0 else members.withColumn("met", F.lit(0).cast("long"))
    first = F.max(F.struct("met", F.xxhash64("doc_id", "bucket", F.lit(turn)).alias("h"), F.col("doc_id").alias("hub"), F.col("component").alias("hub_component")))
    hubs = ranked.groupBy("bucket").agg(first.alias("d")).select("bucket", "d.hub", "d.hub_component")
    found = members.join(hubs, "bucket").where("component <> hub_component")
    return found.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """Rows of open buckets dealt out to blocks (bucket, row, col) of bounded size.

    In every bucket the rows outside its most frequent component, marked ``asks``,
    meet all rows of the bucket; a pair of rows meets in one block of its bucket.
    """
    per = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("total"))
    main = main.select("bucket", F.col("m.component").alias("main"), "total", (F.col("total") - F.col("m.n")).alias("others"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    every = lambda n: F.sequence(F.lit(0), parts(n) - 1)
    held = members.join(main, "bucket")
    held = held.withColumn("row", F.pmod(F.xxhash64("doc_id"), parts("others")).cast("int")).withColumn("col", F.pmod(F.xxhash64("doc_id", F.lit(1)), parts("total")).cast("int"))
    base = ["bucket", "doc_id", "component"]
    asked = held.where(F.col("component") != F.col("main")).select(*base, F.lit(True).alias("asks"), "row", F.explode(every("total")).alias("col"))
    given = held.select(*base, F.lit(False).alias("asks"), F.explode(every("others")).alias("row"), "col")
    return asked.unionByName(given).select("bucket", "row", "col", "asks", "doc_id", "component")


def _partners(table: pa.Table, limits: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row of a block the rows of other components that survive the comparison of signatures."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    component = table.column("component").to_numpy()
    signatures = _unpack(table.column("signature").combine_chunks())
    given = np.flatnonzero(~asks)
    for k in np.flatnonzero(asks):
        others = given[component[given] != component[k]]
        yield k, others[_survivors(np.broadcast_to(signatures[k], (len(others), HASHES)), signatures[others], limits)]


def block_links(members: DataFrame, signed: DataFrame, docs: DataFrame, held: Held) -> DataFrame:
    """Links that join the components of open buckets wherever any pair of theirs is similar enough.

    Two passes over the blocks: the first leaves the rows with a surviving partner,
    the second takes their full sets and confirms pairs, skipping those that earlier
    links of the block have joined already. Pairs never leave a block; links do, at
    most one less than the components in it.
    """
    limits = least_matches(SIMILARITY / 100)
    kind = "bucket long, row int, col int, asks boolean, doc_id long, component long, signature binary"

    def thin(table: pa.Table) -> pa.Table:
        stay = np.zeros(len(table), dtype=bool)
        for k, partners in _partners(table, limits):
            stay[partners] = True
            stay[k] |= len(partners) > 0
        return table.filter(pa.array(stay))

    def link(table: pa.Table) -> pa.Table:
        ids, component = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table.column("shingles").combine_chunks()]
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for k, partners in _partners(table, limits):
            for j in partners:
                one, two = find(int(component[k])), find(int(component[j]))
                if one != two and _similar(sets[k], sets[j]):
                    root[one] = two
                    found.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rows = _blocks(members).join(signed, "doc_id").select("bucket", "row", "col", "asks", "doc_id", "component", "signature")
    left = held(rows.groupBy("bucket", "row", "col").applyInArrow(thin, kind))
    sets = wanted_sets(docs, left.select("doc_id").distinct())
    return left.join(sets, "doc_id").groupBy("bucket", "row", "col").applyInArrow(link, _PAIR).distinct()


# ---- the operator


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when their sets of five-word shingles have a Jaccard
    similarity of at least 0.75; ``component_id`` is the smallest id reachable over
    links and ``kept`` marks the document that bears it.

    Equal sets fold into the class of their smallest id before anything is compared,
    so copies never meet pairwise. Classes that share a band of the signature are
    candidates. First, the members of each bucket are compared with one of them, and
    linked ones join; buckets within one component are done. What is then left open
    is compared in full, in blocks. A pair is pruned by its signature once
    its posterior chance of being similar is below ``MISS``; all others are confirmed
    on their full sets.

    A null or empty text, or one without words, has no shingles and stands alone.
    Rows with one id count as one document. A row without an id is linked with
    nothing, has no component and is kept. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut_lineage(signatures(source))
    key = ["set_a", "set_b", "n_shingles"]
    slim = signed.where("doc_id is not null").select("doc_id", *key)
    classes = cut_lineage(slim.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id")))
    member = slim.join(classes, key, "left").select("doc_id", "n_shingles", "class_id")
    # An id that heads several classes has several signatures and sets; these classes are one document's, so one node.
    heads = signed.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").where("n_shingles > 0").select("doc_id", "signature")
    same = member.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b").select("a", "b")
    with Held() as held:
        found = components(_links(held(heads), source, held).unionByName(same)).withColumnRenamed("node", "class_id")
    placed = member.join(found, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"))
    unnamed = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return placed.unionByName(unnamed).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(heads: DataFrame, texts: DataFrame, held: Held) -> DataFrame:
    """Confirmed links that connect everything that is connected."""
    members = cut_lineage(buckets(heads).withColumn("component", F.col("doc_id")))
    signed = held(heads.join(members.select("doc_id").distinct(), "doc_id", "left_semi"))
    links = None
    for turn in range(STAR_ROUNDS):
        found = cut_lineage(confirm(cut_lineage(prune(star_pairs(members, turn), signed)), texts))
        links = found if links is None else links.unionByName(found)
        # a bucket of two has had its only pair compared
        members = cut_lineage(_open(_relabel(members.where("size > 2"), components(links))))
        if members.isEmpty():
            return links
    return links.unionByName(block_links(members, signed, texts, held))


def _relabel(members: DataFrame, found: DataFrame) -> DataFrame:
    label = found.select(F.col("node").alias("doc_id"), F.col("component").alias("joined"))
    return members.join(label, "doc_id", "left").select("bucket", "doc_id", "size", F.coalesce("joined", "doc_id").alias("component"))
