"""Running sums, medians and windows in the order of a value: by ranges of the sorted values, so no group meets in one task."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillstat.plans.moments import join_groups
from quillstat.sources.tables import settled_groups, written


def counted_before(counts: DataFrame, by: list[str], value: str, count: str, name: str) -> DataFrame:
    """Rows of distinct (by, value) with ``name``: the sum of ``count`` over the group's smaller values.

    One range sort; the sum inside a range is a window, and what lies before a
    range comes from the ranges' totals (a row per group and range it touches).
    The sorted rows are stored, as a second sort might cut its ranges elsewhere.
    """
    ranges = written(counts.orderBy(*by, value).withColumn("__range", F.spark_partition_id()), "sorted")
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*by, "__range").agg(F.sum(count).alias("__t")).withColumn("__before", F.coalesce(F.sum("__t").over(earlier), F.lit(0))).drop("__t")
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranges.withColumn(name, F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return join_groups(summed, totals, [*by, "__range"]).withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the exact median of each group."""
    counts = rows.groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    n = counts.groupBy(*by).agg(F.sum("__c").alias("__all"))
    j = join_groups(counted_before(counts, by, "__v", "__c", "__less"), n, by)
    at = lambda i: F.max(F.when((F.col("__less") < i) & (F.col("__less") + F.col("__c") >= i), F.col("__v")))
    return j.groupBy(*by).agg(((at(F.floor((F.col("__all") + 1) / 2)) + at(F.floor(F.col("__all") / 2) + 1)) / 2).alias(name))


#: Rows of a group that a block of a window holds, beside those of its frames.
BLOCK = 16_384
#: Rows that a task of a window's sorts gets.
TASK_ROWS = 262_144


def tasks(rows: DataFrame) -> int:
    """Partitions for the counted rows.  With a number given Spark merges none, so a task's share doesn't rise with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS))


def in_order(df: DataFrame, by: list[str], order_by: list[str]) -> DataFrame:
    """One range sort into partitions of about TASK_ROWS rows."""
    return df.repartitionByRange(tasks(df), *by, *order_by).sortWithinPartitions(*by, *order_by)


def by_blocks(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows of ``blocked`` dealt to n tasks by whole blocks."""
    return rows.repartition(n, *by, "__block")


def placed(df: DataFrame, by: list[str], order_by: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows with __pos, their place in the group from 0 on.

    One range sort, stored with the rows' numbers in their range; what lies
    before a range is counted per group and range.  With ``keep`` only those
    columns and ``by`` are stored, so what the order alone needs ends with the
    sort.
    """
    rows = in_order(df, by, order_by).withColumn("__id", F.monotonically_increasing_id())
    rows = written(rows if keep is None else rows.select(*dict.fromkeys([*by, *keep, "__id"])), "placed", clean=True)
    rows = rows.withColumn("__range", F.shiftright("__id", 33))
    ranges = rows.groupBy(*by, "__range").agg(F.min("__id").alias("__from"), F.count(F.lit(1)).alias("__m"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = settled_groups(ranges.withColumn("__before", F.coalesce(F.sum("__m").over(earlier), F.lit(0))).drop("__m"))
    j = join_groups(rows, ranges, [*by, "__range"])
    return j.withColumn("__pos", F.col("__id") - F.col("__from") + F.col("__before")).drop("__id", "__range", "__from", "__before")


def halo(frame: tuple[int | None, int]) -> tuple[int, int]:
    """Rows behind and ahead that a frame (start, end) reaches; a start of None is met by carried sums."""
    start, end = (0 if frame[0] is None else frame[0]), frame[1]
    return max(0, -start, -end), max(0, start, end)


def block_size(behind: int, ahead: int) -> int:
    return max(BLOCK, behind, ahead)


def blocked(rows: DataFrame, behind: int, ahead: int) -> DataFrame:
    """Rows of ``placed`` by __block, with copies (not __own) of the rows before and after that frames of the block's rows reach."""
    size = block_size(behind, ahead)
    at = F.pmod(F.col("__pos"), F.lit(size))
    shifts = [F.lit(0)]
    if behind:
        shifts.append(F.when(at >= size - behind, 1))
    if ahead:
        shifts.append(F.when(at < ahead, -1))
    copies = rows.withColumn("__shift", F.explode(F.array_compact(F.array(*shifts))))
    return copies.withColumn("__block", F.floor(F.col("__pos") / size) + F.col("__shift")).withColumn("__own", F.col("__shift") == 0).drop("__shift")


def carried(rows: DataFrame, by: list[str], cols: list[str], behind: int, ahead: int) -> DataFrame:
    """A row per group and __block, placed before its rows: the sums of ``cols`` over all rows before those that ``blocked`` copies."""
    size = block_size(behind, ahead)
    early = F.pmod(F.col("__pos"), F.lit(size)) < size - behind
    sums = [F.sum(c).alias(c) for c in cols] + [F.sum(F.when(early, F.col(c))).alias(f"__early{i}") for i, c in enumerate(cols)]
    totals = rows.groupBy(*by, F.floor(F.col("__pos") / size).alias("__block")).agg(*sums)
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = [(F.coalesce(F.sum(c).over(before), F.lit(0.0)) + F.coalesce(f"__early{i}", F.lit(0.0))).alias(c) for i, c in enumerate(cols)]
    return totals.select(*by, (F.col("__block") + 1).alias("__block"), F.lit(-1).cast("long").alias("__pos"), F.lit(False).alias("__own"), *carry)


def over_frames(df: DataFrame, by: list[str], order_by: list[str], frame: tuple[int, int], columns: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """All rows with columns over their frame of (start, end) rows, bounded on both sides."""
    rows = placed(df, by, order_by)
    rows = by_blocks(blocked(rows, *halo(frame)), by, tasks(rows))
    w = Window.partitionBy(*by, "__block").orderBy("__pos").rowsBetween(*frame)
    return rows.withColumns({k: c(w) for k, c in columns.items()}).where("__own").select(*df.columns, *columns)
