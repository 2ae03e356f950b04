"""Industry rotation measures: flow and turnover over several windows, members that cover most turnover, weekly heat grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashlens.session import cut_lineage

c = F.col
WIDTHS = (5, 20, 60)
COVER, LEAST, MOST = 0.8, 5, 20
GRID_WEEKS = 12


def window_sums(daily: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str], widths: Sequence[int] = WIDTHS) -> DataFrame:
    """Adds ``measure_width`` for every measure and width: the sum over that many calendar days, the row's day included.

    ``daily`` has one row per key and day. Days without a row are put in, so that each window is the difference of two
    running sums: one window pass per key serves all widths, over as many rows as the calendar has days.
    """
    span = daily.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    every = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day))
    dense = every.join(daily.withColumn("_given", F.lit(True)), [*keys, day], "left")
    along = Window.partitionBy(*keys).orderBy(day)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    running = dense.withColumns({f"_r_{m}": F.sum(F.coalesce(c(m), F.lit(0))).over(so_far) for m in measures})
    sums = {f"{m}_{n}": c(f"_r_{m}") - F.coalesce(F.lag(f"_r_{m}", n).over(along), F.lit(0)) for m in measures for n in widths}
    return running.withColumns(sums).where("_given").select(*daily.columns, *sums)


def covering_members(
    totals: DataFrame, keys: Sequence[str], member: str, value: str, cover: float = COVER, least: int = LEAST, most: int = MOST
) -> DataFrame:
    """The largest members of each key until ``cover`` of its value is reached, at least ``least`` and at most ``most``.

    ``totals`` has one row per key and member. Adds rank and running (value of the members up to this one). Members are
    sorted by ranges over all keys, so one huge key is spread over many tasks; a task adds up its own part of a key, and
    a table with one row per key and task gives each part the sum and the count of those before it.
    Members without a value are left out; equal values are ranked by member.
    """
    order: list[Column] = [F.desc(value), c(member).asc()]
    known = totals.where(c(value).isNotNull())
    ranged = cut_lineage(known.repartitionByRange(*[c(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ranked"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"),
    )
    # parts behind the last wanted rank are not opened
    opened = ranged.join(carry.where(c("_ranked") < most), [*keys, "_part"])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    placed = opened.withColumns(
        {
            "rank": (c("_ranked") + F.row_number().over(inside)).cast("int"),
            "running": c("_before") + F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    open_before = c("running") - c(value) < F.lit(str(cover)).cast("decimal(6,4)") * c("_total")
    return placed.where((c("rank") <= most) & ((c("rank") <= least) | open_before)).select(*totals.columns, "rank", "running")


def heat_grid(weekly: DataFrame, keys: Sequence[str], week: str, value: str, last: Column, weeks: int = GRID_WEEKS) -> DataFrame:
    """One row per key: w01 to w12 (the weeks up to ``last``, oldest first), their sum, and the change to the weeks before.

    The list of weeks is fixed, so the pivot is one aggregate; only the weeks of both windows are read. A week without
    rows is null; the change is null without a sum before.
    """
    back = F.datediff(last, c(week)) / 7
    numbered = weekly.where(back.between(0, 2 * weeks - 1)).withColumn("_at", (weeks - back).cast("int"))
    names = {n: f"w{n:02d}" for n in range(1, weeks + 1)}
    grid = numbered.groupBy(*keys).pivot("_at", list(names)).agg(F.sum(value))
    grid = grid.withColumnsRenamed({str(n): name for n, name in names.items()})
    sums = numbered.groupBy(*keys).agg(F.sum(F.when(c("_at") >= 1, c(value))).alias("total"), F.sum(F.when(c("_at") < 1, c(value))).alias("before"))
    both = grid.join(sums, list(keys))
    return both.withColumn("change", F.when(c("before") != 0, c("total").cast("double") / c("before").cast("double") - 1))
