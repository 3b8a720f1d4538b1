"""Connected components of an edge table, by contracting along edges until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.held import Held
from tallyframe.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge; the component is its smallest node.

    ``edges`` has two long columns ``a`` and ``b`` in any order, with repetitions and
    loops or without. In each round every node moves to the neighbour, or itself,
    that comes first in an order drawn anew for the round, which shortens chains by
    a constant factor on average and folds a star at once. Only edges between
    different groups go on, written to the shared folder for each round; the labels
    follow from the moves of all rounds. Rows with a null end are left out. No edges
    give an empty table.
    """
    with Held() as held:
        left = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
        turn = 0
        while not left.isEmpty():
            both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
            order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("n"))  # noqa: E731, B023
            best = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("best"))
            moves = held(best.select(F.col("a").alias("old"), F.least("best", order(F.col("a")))["n"].alias("new")))
            to = lambda c: moves.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new"))  # noqa: E731, B023
            met = left.join(to("a"), "a").join(to("b"), "b").where("a_new <> b_new")
            left = cut_lineage(met.select(F.least("a_new", "b_new").alias("a"), F.greatest("a_new", "b_new").alias("b")).distinct())
            labels = labels.join(to("root"), "root", "left").select("node", F.coalesce("root_new", "root").alias("root"))
            turn += 1
        smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
        return cut_lineage(labels.join(smallest, "root").select("node", "component"))
