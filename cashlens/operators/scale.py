"""Building blocks that stay balanced when one key holds a large share of the rows.

None of them gathers a raw group into one task: rows are first reduced by map-side
aggregation, or split along a bucket of the ordering column whose count per key is bounded
by the clock or the value range, and only the reduced rows meet per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the one with the largest order tuple.

    An aggregate with map-side combine instead of ``row_number() = 1``; a hot key is reduced on
    every mapper before the shuffle.
    """
    payload = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As ``latest_by`` with the smallest order tuple."""
    payload = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null equals a null, keeping the left side's key columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def lag_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    out: str,
) -> DataFrame:
    """``lag(value)`` per key over ``order`` without putting a whole key into one task.

    ``bucket`` must not decrease along ``order`` (an hour or a day of a timestamp).  Rows are
    lagged inside (key, bucket); the first row of a bucket takes the last value of the nearest
    earlier bucket, found on a table with one row per key and bucket.
    """
    staged = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = staged.withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    tails = staged.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_tail")
    )
    carry = tails.select(
        *keys,
        "_bucket",
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"),
    )
    joined = join_null_safe(local, carry, [*keys, "_bucket"], "left")
    return joined.select(*df.columns, F.coalesce(F.col("_lag"), F.col("_carry"))["v"].alias(out))


def running_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    measures: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Inclusive running ``sum`` or ``max`` per key in two levels (inside a bucket, then across buckets)."""
    fold = {"sum": F.sum, "max": F.max}
    staged = df.withColumn("_bucket", bucket)
    for name, (_, column) in measures.items():
        staged = staged.withColumn(f"_m_{name}", column)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(*keys, "_bucket").agg(
        *[fold[kind](f"_m_{name}").alias(f"_t_{name}") for name, (kind, _) in measures.items()]
    )
    carry = totals.select(
        *keys,
        "_bucket",
        *[fold[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in measures.items()],
    )
    local = staged.select(
        *df.columns,
        "_bucket",
        *[fold[kind](f"_m_{name}").over(inner).alias(f"_l_{name}") for name, (kind, _) in measures.items()],
    )
    merged = []
    for name, (kind, _) in measures.items():
        here, earlier = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            merged.append((F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))).alias(name))
        else:
            merged.append(F.greatest(here, earlier).alias(name))
    return join_null_safe(local, carry, [*keys, "_bucket"], "left").select(*df.columns, *merged)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median (mean of the two middle values) per key, safe for a hot key.

    1. Count equal values per key, which combines on the map side.
    2. Count per key and magnitude cell; the number of cells per key is bounded by the double
       format, so ranking cells inside a key is bounded work.
    3. Only the one or two cells that hold the middle positions are opened.
    """
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    magnitude = F.floor(F.log2(F.abs(F.col("_v")) + F.lit(1e-12)) * 64)
    cell = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v") * (magnitude + F.lit(4096)))
    celled = counted.withColumn("_cell", cell.cast("bigint"))
    cells = celled.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn"))
    along = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    ranked = cells.select(
        *keys,
        "_cell",
        "_cn",
        F.coalesce(F.sum("_cn").over(along), F.lit(0)).alias("_before"),
        F.sum("_cn").over(whole).alias("_total"),
    )
    low = F.floor((F.col("_total") + 1) / 2)
    high = F.floor((F.col("_total") + 2) / 2)
    middle = ranked.withColumn("_low", low).withColumn("_high", high).where(
        ((F.col("_low") > F.col("_before")) & (F.col("_low") <= F.col("_before") + F.col("_cn")))
        | ((F.col("_high") > F.col("_before")) & (F.col("_high") <= F.col("_before") + F.col("_cn")))
    )
    opened = join_null_safe(celled, middle.select(*keys, "_cell", "_before", "_low", "_high"), [*keys, "_cell"])
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = opened.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    covers = lambda p: (F.col(p) > F.col("_from")) & (F.col(p) <= F.col("_from") + F.col("_n"))
    return placed.groupBy(*keys).agg(
        ((F.max(F.when(covers("_low"), F.col("_v"))) + F.max(F.when(covers("_high"), F.col("_v")))) / 2).alias(out)
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_at_or_after(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str) -> DataFrame:
    """The first non-null ``value`` at or behind each row per key, in two levels as ``lag_in_buckets``."""
    staged = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    local = staged.withColumn("_here", F.first(value, ignorenulls=True).over(inner))
    heads = staged.groupBy(*keys, "_bucket").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_head"))
    later = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    carry = heads.select(*keys, "_bucket", F.first("_head", ignorenulls=True).over(later).alias("_later"))
    joined = join_null_safe(local, carry, [*keys, "_bucket"], "left")
    return joined.select(*df.columns, F.coalesce("_here", "_later").alias(out))
