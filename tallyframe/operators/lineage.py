"""Dependencies between SQL objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import sqltext
from tallyframe.session import cut_lineage


def extract_dependencies(objects: DataFrame, strict: bool = False, scoped: bool = False) -> DataFrame:
    """Direct dependencies ``(object_name, dependency, dependency_kind)`` of ``object_name, definition`` rows.

    Tables are found by pattern, as :func:`sqltext.table_references` does, or with ``scoped`` by
    reading each statement with its scopes (:func:`sqltext.scoped_table_references`).
    """
    code = objects.select("object_name", "definition", sqltext.code_only(F.col("definition")).alias("code"))
    found = code.select(
        "object_name",
        (sqltext.scoped_table_references(F.col("definition")) if scoped else sqltext.table_references(F.col("code"), strict)).alias("t"),
        sqltext.function_references(F.col("code")).alias("f"),
    )
    entries = F.concat(
        F.transform("t", lambda x: F.struct(x.alias("dependency"), F.lit("table").alias("dependency_kind"))),
        F.transform("f", lambda x: F.struct(x.alias("dependency"), F.lit("function").alias("dependency_kind"))),
    )
    return found.select("object_name", F.inline(entries))


def resolve_dependencies(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Tell views from base tables by looking names up among the known objects; Spark picks the join."""
    known = objects.select(F.col("object_name").alias("dependency"), F.lit(True).alias("_known")).distinct()
    kind = F.when((F.col("dependency_kind") == "table") & F.col("_known"), "view").otherwise(F.col("dependency_kind"))
    return edges.join(known, "dependency", "left").select(
        "object_name", "dependency", kind.alias("dependency_kind"), F.coalesce("_known", F.lit(False)).alias("is_known")
    )


def lineage_closure(resolved: DataFrame, max_level: int | None = None) -> DataFrame:
    """All direct and indirect dependencies ``(root, dependency, dependency_kind, level)``, with the smallest level of each.

    Every round doubles the depth that is known. A shortest way longer than 2^k
    passes an object exactly 2^k steps from its root, and goes on from there by a way
    that is known already; so each round joins the pairs at exactly that distance with
    all pairs, and a dependency comes up once for each such object in between, however
    many ways there are. Cycles add no shorter way and end by themselves. Written
    are the pairs new in a round, as many rounds as the logarithm of the depth.
    """
    direct = resolved.filter("object_name is not null").select(F.col("object_name").alias("root"), "dependency", "dependency_kind", "is_known").distinct()
    found = cut_lineage(direct.withColumn("level", F.lit(1)))
    reach = 1
    while max_level is None or reach < max_level:
        nearest = found.filter("is_known").groupBy("root", "dependency").agg(F.min("level").alias("level"))
        middle = cut_lineage(nearest.filter(F.col("level") == reach).select("root", F.col("dependency").alias("_at")))
        if middle.isEmpty():
            break
        onward = found.withColumnRenamed("root", "_at")
        further = middle.join(onward, "_at").groupBy("root", "dependency", "dependency_kind", "is_known").agg((F.min("level") + reach).alias("level"))
        new = cut_lineage(further.join(found, ["root", "dependency", "dependency_kind"], "left_anti").select(found.columns))
        if new.isEmpty():
            break
        found, reach = found.unionByName(new), 2 * reach
    kept = found if max_level is None else found.filter(F.col("level") <= max_level)
    return kept.select("root", "dependency", "dependency_kind", "level")
