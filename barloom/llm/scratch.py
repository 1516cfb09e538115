"""Sums over tasks of any number, beside the staging of tables that the whole library shares."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.staging import drop, stage, stage_parts

__all__ = ["drop", "stage", "stage_parts", "sum_in_tree"]

#: Partial sums that are added up in one group.
FAN = 64


def sum_in_tree(parts: DataFrame, keys: list[str], task: str, add: Callable[[pa.Table], pa.Table], schema: str, fan: int | None = None) -> DataFrame:
    """One row for each value of keys: add() of the partial sums that tasks have made of it, at most FAN of them at a time.

    parts has a column with the number of the task that made a row; add() makes one such row of several with
    the same keys. So no group grows with the number of tasks.
    """
    fan = fan or FAN
    parts = stage(parts, "parts")
    top = parts.agg(F.coalesce(F.max(task), F.lit(0))).first()[0] + 1
    while top > fan:
        # a task's number becomes that of the group it is in
        level = parts.withColumn(task, F.expr(f"{task} div {fan}")).groupBy(*keys, task).applyInArrow(add, schema)
        level = stage(level, "parts")
        drop(parts)
        parts, top = level, -(-top // fan)
    out = stage(parts.groupBy(*keys).applyInArrow(add, schema), "sums")
    drop(parts)
    return out
