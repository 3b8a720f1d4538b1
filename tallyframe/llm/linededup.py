"""Removal of boilerplate lines that spread over many sites, by sketches of the sites of each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.meeting import meet
from tallyframe.session import cut_lineage

#: A line found on at least so many sites is boilerplate.
MIN_SITES = 10
#: A line of so many words is hardly written twice by chance, so fewer sites tell that it was copied.
LONG_WORDS = 20
#: A long line found on at least so many sites is boilerplate.
LONG_SITES = 3
#: Sketches have 2^8 registers, a standard error of about 6.5 percent.
SKETCH_BITS = 8
#: Estimates within this share of the threshold, three standard errors, are counted exactly.
MARGIN = 0.2
_BLANKS = " \t\x0b\x0c\r"


def _key(line: Column) -> Column:
    """What makes two lines the same: the text between blanks, as a 64-bit hash; null for blank lines."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def _is_long(line: Column) -> Column:
    """Whether a line has ``LONG_WORDS`` words; lines with too few characters for that are not split."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.length(bare) >= 2 * LONG_WORDS - 1, F.size(F.split(bare, r"\s+")) >= LONG_WORDS).otherwise(F.lit(False))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """(line, holder, n) for each line found on at least ``min_sites`` distinct sites, or ``long_sites`` if it is long.

    ``lines`` has ``line`` (a hash), ``site`` (a hash), ``doc_id`` and ``long``; ``holder`` is the
    smallest doc_id with the line, ``n`` how often it stands. Each map task folds a line into one HyperLogLog
    sketch, and sketches merge, so a line that fills a third of the table costs one
    small row per task. Lines whose estimate is near the threshold get their exact
    number of distinct sites; all others are decided by the estimate.
    """
    needed = F.when(F.max("long"), F.lit(min(long_sites, min_sites))).otherwise(F.lit(min_sites))
    merged = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min("doc_id").alias("holder"), needed.alias("needed"), F.count("*").alias("n"))
    estimated = merged.select("line", "holder", "needed", "n", F.hll_sketch_estimate("sketch").alias("estimate"))
    # what is left is few lines, used twice
    sketched = cut_lineage(estimated.where(F.col("estimate") >= F.col("needed") * (1 - MARGIN)))
    surely = F.col("estimate") >= F.col("needed") * (1 + MARGIN)
    near = sketched.where(~surely).select("line", "n")
    exact = meet(lines.select("line", "site"), near, ["line"], "n").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("one").alias("sites"))
    decided = sketched.join(exact, "line", "left")
    return decided.where(F.coalesce(F.col("sites") >= F.col("needed"), surely)).select("line", "holder", "n")


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, long_sites: int = LONG_SITES
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus ``n_lines`` and ``n_removed``.

    Lines end at a line feed and are compared without the blanks around them; blank
    lines are never removed. A line on ``min_sites`` distinct sites, or a line of
    ``LONG_WORDS`` words on ``long_sites`` if these are fewer, is removed
    everywhere but where it first stands in the document with the smallest id, so
    no passage is lost altogether. With ``long_sites = min_sites`` all lines are held to one number. Rows are never dropped: a text may become empty.

    A null text stays null with no lines; a null site counts as one site of its own.
    Rows that share id and text get the same result. Without an id a row holds
    nothing, so all its boilerplate goes, unless no row with the line has an id:
    then each keeps its lines. All columns are kept; input columns named ``n_lines`` or
    ``n_removed`` are replaced. An empty table gives an empty result.
    """
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept_columns])
    mark = F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("text"))
    split = F.split(F.col(f"`{text_col}`"), "\n", -1)
    numbered = rows.select(F.xxhash64(F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0"))).alias("site"), mark.alias("row"), F.posexplode(split).alias("place", "text"))
    lines = numbered.select("site", "row", "place", _key(F.col("text")).alias("line"), F.col("row.doc_id").alias("doc_id"), _is_long(F.col("text")).alias("long")).where("line is not null")
    spread = spread_lines(lines.select("line", "site", "doc_id", "long"), min_sites, long_sites)
    # the most frequent lines are met by broadcast, so no line gathers its rows in one task
    found = meet(lines.select("row", "place", "line"), cut_lineage(spread.where("holder is not null")), ["line"], "n")
    per_line = found.groupBy("row", "line", "holder").agg(F.min("place").alias("first"), F.collect_set("place").alias("places"))
    gone = F.when(F.col("row.doc_id") == F.col("holder"), F.array_except("places", F.array("first"))).otherwise(F.col("places"))
    per_row = per_line.select("row", gone.alias("gone")).groupBy("row").agg(F.flatten(F.collect_list("gone")).alias("_gone"))
    per_row = per_row.select(F.col("row.doc_id").alias("_id"), F.col("row.text").alias("_text"), "_gone").where(F.size("_gone") > 0)
    marked = rows.withColumn("_lines", split).withColumn("_hash", F.xxhash64(f"`{text_col}`"))
    met = marked.join(per_row, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    cleaned = F.when(F.col("_gone").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.transform(stay, lambda k: F.get(F.col("_lines"), k)), "\n"))
    out = [cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept_columns]
    n_lines = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")
    return met.select(*out, n_lines.alias("n_lines"), n_removed.alias("n_removed"))
