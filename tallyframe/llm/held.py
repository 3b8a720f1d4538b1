"""Frames that one operator uses several times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Held:
    """Keeps frames on the executors' disks until released; a lost part is computed again from its lineage.

    For what is small or used within one call only. What later work rests on is
    written to the shared folder instead.
    """

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self._frames.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def __enter__(self) -> Held:
        return self

    def __exit__(self, *_: object) -> None:
        for df in self._frames:
            df.unpersist()
