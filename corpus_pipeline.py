"""From raw documents to packed training sequences: five stages, each one of the text operators.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and
read again as the docs of the next. All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import langid, linededup, neardup, packing, toxicity
from tallyframe.llm.registry import prepare, table
from tallyframe.session import cut_lineage

#: Documents whose language is less certain than this are rejected.
LEAST_CERTAIN = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters and uncertain ones go.

    If no document has a language there is nothing to judge by, and all with a text stay.
    """
    prepare(spark)
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").isNotNull())
    found = langid.identify(docs, model, lang_out="_lang", score_out="_score")
    return found.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_score") >= LEAST_CERTAIN)).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic stays below the threshold of the operator."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, score_out="_score", predicted_out="_toxic")
    return found.where("_toxic = 0").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites; ``n_chars`` follows the text."""
    cleaned = linededup.remove_boilerplate(docs)
    length = F.when(F.col("text").isNotNull(), F.length("text")).cast("long")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Every row is a document of its own here, so of equal rows one stays, rows that share an
    id stay if their texts differ, and those without an id are compared like others and come last
    in their group.
    """
    prepare(spark)
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = neardup.near_duplicates(rows.select("_row", "text"), id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    grouped = rows.select("_row", "doc_id").join(found, "_row")
    order = lambda row, doc: F.struct(doc.isNull().alias("none"), doc.alias("doc"), row.alias("row"))
    first = grouped.groupBy("_group").agg(F.min(order(F.col("_row"), F.col("doc_id"))).alias("_first"))
    return rows.join(first.select(F.col("_first.row").alias("_row")), "_row", "left_semi").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence."""
    prepare(spark)
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return packing.pack_documents(docs, definition)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
