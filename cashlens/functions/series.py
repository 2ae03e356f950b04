"""Short yearly series held as arrays (at most ten values): medians, trends, variation.

The arrays are bounded by the newest-N-years rule, so everything here stays inside one row and
needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashlens.functions.numeric import clip, lit_null


def doubles(arr: Column) -> Column:
    return F.transform(arr, lambda x: x.cast("double"))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def mean(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, total(arr) / F.size(arr))


def median(arr: Column) -> Column:
    """Mean of the two middle values; null for an empty array."""
    return middle(F.array_sort(arr))


def relative_changes(oldest_first: Column) -> Column:
    """(next - previous) / |previous| for neighbours whose previous value is not zero."""
    n = F.size(oldest_first)
    before = F.slice(oldest_first, F.lit(1), F.greatest(n - 1, F.lit(0)))
    after = F.slice(oldest_first, F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(before, after, lambda a, b: F.when(a != 0, (b - a) / F.abs(a)))
    return F.filter(pairs, lambda x: x.isNotNull())


def compound_rate(oldest_first: Column) -> Column:
    first, last = F.get(oldest_first, F.lit(0)), F.get(oldest_first, F.size(oldest_first) - 1)
    return F.pow(last / first, F.lit(1.0) / (F.size(oldest_first) - 1)) - 1


TREND_LIMIT = 0.20


def middle(ordered: Column) -> Column:
    """Median of an array that is already sorted."""
    n = F.size(ordered)
    lower, upper = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, lower - 1) + F.get(ordered, upper - 1)) / 2)


def trend_raw(oldest_first: Column, ordered_changes: Column) -> Column:
    """Compound rate when both end points are positive, else the median change; unlimited."""
    n = F.size(oldest_first)
    first, last = F.get(oldest_first, F.lit(0)), F.get(oldest_first, n - 1)
    return (
        F.when(n < 2, F.lit(0.0))
        .when((first > 0) & (last > 0), compound_rate(oldest_first))
        .otherwise(F.coalesce(middle(ordered_changes), F.lit(0.0)))
    )


def trend_clip(raw: Column) -> Column:
    return clip(raw, -TREND_LIMIT, TREND_LIMIT)


def trend(oldest_first: Column) -> Column:
    """The limited trend as one expression, for a single series."""
    return trend_clip(trend_raw(oldest_first, F.array_sort(relative_changes(oldest_first))))


def organic_growth(oldest_first: Column, floor: float, ceiling: float) -> Column:
    """Compound rate only when every value is positive, else the median change; null if not comparable."""
    n = F.size(oldest_first)
    raw = F.when(n < 2, lit_null()).when(
        F.forall(oldest_first, lambda x: x > 0), compound_rate(oldest_first)
    ).otherwise(median(relative_changes(oldest_first)))
    return clip(raw, floor, ceiling)


def variation(arr: Column) -> Column:
    """Population standard deviation over the absolute mean; all zeros give 0, a zero mean otherwise null."""
    mu = mean(arr)
    var = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mu) * (x - mu)) / F.size(arr)
    return F.when(F.forall(arr, lambda x: x == 0), F.lit(0.0)).when(mu != 0, F.sqrt(var) / F.abs(mu))


def positive_ratio(arr: Column) -> Column:
    n = F.size(arr)
    return F.when(n > 0, F.size(F.filter(arr, lambda x: x > 0)) / n)
