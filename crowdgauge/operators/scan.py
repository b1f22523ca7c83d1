"""Ordered scans over groups of any size.

``Window.partitionBy(key)`` sends a whole key to one task, which a key with a third of all rows
does not survive. ``OrderedGroups`` measures the largest group first. Groups that fit one task use
the plain window. Otherwise the rows are range-partitioned by key and order, every partition is a
block, the scan runs inside (key, block) and one small row per (key, block) carries the state from
block to block. Both ways give the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdgauge.runtime import clearing, pin, shuffle_partitions

ROWS_PER_TASK = 4_000_000
BLOCK = "_block"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group: one partial aggregation, one number to the driver."""
    with clearing(df.sparkSession):
        return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


class OrderedGroups:
    """Rows grouped by ``keys`` and ordered by ``order`` (unique within the group)."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        rows_per_task: int = ROWS_PER_TASK,
    ):
        self.keys, self.order = list(keys), list(order)
        if largest_group(df, keys) <= rows_per_task:
            self.df, self.blocked = df, False
        else:
            parts = max(2, shuffle_partitions(df.sparkSession))
            ranged = df.repartitionByRange(parts, *keys, *order)
            self.df, self.blocked = pin(ranged.withColumn(BLOCK, F.spark_partition_id())), True

    def _with(self, df: DataFrame) -> OrderedGroups:
        other = object.__new__(OrderedGroups)
        other.keys, other.order, other.blocked, other.df = self.keys, self.order, self.blocked, df
        return other

    @property
    def _local(self):
        keys = [*self.keys, BLOCK] if self.blocked else self.keys
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _carry(self, summary: DataFrame) -> DataFrame:
        return self.df.join(summary, [*self.keys, BLOCK], "left")

    def with_lag(self, column: str, name: str) -> OrderedGroups:
        """The previous row's value, null on the first row of a group."""
        lagged = F.lag(column).over(self._local)
        if not self.blocked:
            return self._with(self.df.withColumn(name, lagged))
        last = self.df.groupBy(*self.keys, BLOCK).agg(
            F.max_by(F.struct(F.col(column).alias("v")), F.struct(*self.order)).alias("_last")
        )
        before = Window.partitionBy(*self.keys).orderBy(BLOCK)
        summary = last.select(
            *self.keys, BLOCK, F.lag("_last").over(before)["v"].alias("_carried")
        )
        df = (
            self._carry(summary)
            .withColumn("_first", F.row_number().over(self._local) == 1)
            .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(lagged))
            .drop("_first", "_carried")
        )
        return self._with(df)

    def with_running_sum(self, value: Column, name: str) -> OrderedGroups:
        """Inclusive cumulative sum of a numeric expression."""
        frame = self._local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = F.sum(value).over(frame)
        if not self.blocked:
            return self._with(self.df.withColumn(name, running))
        totals = self.df.groupBy(*self.keys, BLOCK).agg(F.sum(value).alias("_total"))
        before = (
            Window.partitionBy(*self.keys)
            .orderBy(BLOCK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        summary = totals.select(
            *self.keys,
            BLOCK,
            F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"),
        )
        df = self._carry(summary).withColumn(name, running + F.col("_carried")).drop("_carried")
        return self._with(df)

    def with_position(self, name: str) -> OrderedGroups:
        """Zero-based position inside the group."""
        if not self.blocked:
            return self._with(self.df.withColumn(name, F.row_number().over(self._local) - 1))
        counted = self.with_running_sum(F.lit(1).cast("bigint"), name)
        return counted._with(counted.df.withColumn(name, F.col(name) - 1))

    def map(self, function) -> OrderedGroups:
        """Apply a row-wise DataFrame function, keeping the blocks."""
        return self._with(function(self.df))

    @property
    def result(self) -> DataFrame:
        return self.df.drop(BLOCK) if self.blocked else self.df
