"""Rows joined with what is known about their group, also where one group holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

#: Groups that are met by broadcast, the largest ones; a smaller group has at most one part in so many of the rows.
HOT = 4096


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the one row of ``facts`` that has their keys; ``size`` in ``facts`` counts the rows of a key.

    The facts of the largest groups are broadcast, ``HOT`` at most, so no key that is
    shuffled has more than one part in ``HOT`` of the rows.
    """
    hot = cut_lineage(facts.orderBy(F.desc(size)).limit(HOT))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.drop(size), keys)
    return rows.join(F.broadcast(hot.drop(size)), keys).unionByName(rest)
