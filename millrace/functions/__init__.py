"""Column functions beyond the built-in ones' names; all are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_year(date: Column, year: int) -> Column:
    """As a range of dates, which file statistics can prune."""
    return (date >= F.make_date(F.lit(year), F.lit(1), F.lit(1))) & (date < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1)))


def strictly_between(value: Column, low: Column, high: Column) -> Column:
    return (value > low) & (value < high)


def length_first(text: Column) -> list[Column]:
    """Sort keys for byte strings by length, then bytewise."""
    return [F.octet_length(text).asc(), text.asc()]


def capped_distinct(value: Column) -> Column:
    """Aggregate: 0, 1 or 2, for no, one or more distinct values; a two-number partial state whatever the group."""
    return F.when(F.min(value).isNull(), 0).when(F.min(value) == F.max(value), 1).otherwise(2)


def capped_distinct_partial(value: Column) -> Column:
    """Aggregate: the partial state of capped_distinct."""
    return F.struct(F.min(value).alias("low"), F.max(value).alias("high"))


def capped_distinct_final(state: str) -> Column:
    """Aggregate over partial states."""
    low, high = F.min(F.col(f"{state}.low")), F.max(F.col(f"{state}.high"))
    return F.when(low.isNull(), 0).when(low == high, 1).otherwise(2)


def inverse_fit(y: Column, degree: Column) -> tuple[Column, Column]:
    """Aggregates: a and b of the least-squares line y = a / degree + b."""
    x = 1.0 / degree
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def charged_ms(pre: Column, read1: Column, read2: Column, compute: Column, write: Column, shared: tuple[bool, bool, bool], cap_ms: int = 600) -> Column:
    """Billed time of a task: transfers through shared memory are billed up to ``cap_ms`` each."""
    cost = pre + compute
    for part, is_shared in zip((read1, read2, write), shared, strict=True):
        cost = cost + (F.least(part, F.lit(cap_ms)) if is_shared else part)
    return cost
