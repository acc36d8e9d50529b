"""Running totals and prefixes of an order, without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.storage import materialise

RANGE_ROWS = 100_000  # rows a task sorts, about; their number never changes a result


def with_start(rows: DataFrame, group: list[str], order: str, weight: Column,
               ranges: int, below: int | None = None) -> DataFrame:
    """Add ``start``: the total ``weight`` of the rows before each one in its group's order.

    Rows are range-partitioned by (group, order). A row's start is what the ranges before
    hold of its group, from one small row per group and range, plus a running total inside
    its range; so a group of any size is spread over all tasks. Range bounds come from a
    sample, hence the ranges are written down before they are used twice. With ``below`` only
    rows that start before it are returned, and ranges behind it are not sorted.
    """
    ranged = materialise(
        rows.withColumn("_weight", weight.cast("long"))
        .repartitionByRange(max(1, ranges), *group, order)
        .withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [*group, "_range"]
    totals = ranged.groupBy(*keys).agg(F.sum("_weight").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    if below is not None:
        before = before.where(F.col("_before") < below)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    started = (
        ranged.join(before, keys)
        .withColumn("start", F.col("_before") + F.coalesce(
            F.sum("_weight").over(inside), F.lit(0)))
        .drop("_weight", "_range", "_before"))
    return started if below is None else started.where(F.col("start") < below)


def numbered(rows: DataFrame, order: str, below: int | None = None) -> DataFrame:
    """Rows with their number in the order as ``start``, from 0. ``rows`` should be a written
    table: they are counted first, so that ranges hold about as many rows at every size."""
    return with_start(rows, [], order, F.lit(1), rows.count() // RANGE_ROWS + 1, below)


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows. They are numbered: a limit would put them all into one task."""
    return numbered(rows, order, n).drop("start")
