"""Rates, remaining time and counters over a stream of progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(events: DataFrame, by: str, order: str) -> DataFrame:
    """The newest event of each session; aggregated before it is shuffled."""
    return events.groupBy(by).agg(F.max(F.struct(order, *[c for c in events.columns if c not in (by, order)])).alias("e")).select(by, "e.*")


def rolling_rate(events: DataFrame, by: str, millis: str, amount: str, window_ms: int = 5000) -> DataFrame:
    """events with the amount of the window up to each one, and that by the second."""
    w = Window.partitionBy(by).orderBy(millis).rangeBetween(-window_ms, 0)
    total = F.sum(amount).over(w)
    return events.withColumn("window_amount", total).withColumn("per_second", F.floor(total * 1000 / F.lit(window_ms)))


def eta_seconds(total: Column, done: Column, per_second: Column) -> Column:
    """Whole seconds until done, rounded up; null at no speed."""
    rest = F.greatest(total - done, F.lit(0))
    return F.when(per_second > 0, F.ceil(rest / per_second))


def basis_points(done: Column, total: Column) -> Column:
    """Ten-thousandths done, at most all; nothing to do counts as done."""
    return F.when(total == 0, F.lit(10_000)).otherwise(F.least(F.lit(10_000), F.floor(done * 10_000 / total)))


def monotonic(events: DataFrame, by: str, order: str, counters: tuple[str, ...]) -> DataFrame:
    """events whose counters never fall: each is the largest so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({f"max_{c}": F.max(c).over(w) for c in counters})
