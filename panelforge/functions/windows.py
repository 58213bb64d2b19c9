"""Column builders over ordered windows of one entity, and cross-sections of one date."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec, functions as F


def by(entity="ticker", time="date") -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else entity
    return Window.partitionBy(*keys).orderBy(time)


def change(x: Column, n: int, w: WindowSpec) -> Column:
    return x - F.lag(x, n).over(w)


def pct_change(x: Column, n: int, w: WindowSpec) -> Column:
    """x / x n rows before - 1, missing values carried forward first."""
    filled = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -n))
    return filled / before - 1


def full_window(agg, x: Column, n: int, w: WindowSpec) -> Column:
    """Aggregate over the last n rows, null unless all n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return full_window(F.avg, x, n, w)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    return full_window(F.stddev_samp, x, n, w)


def ema(x: Column, span: int, w: WindowSpec) -> Column:
    """Exponential moving average seeded with the first value: y = (1 - alpha) y + alpha x.

    The fold looks back far enough that what it leaves out is below 1e-15.
    Missing values are skipped.
    """
    alpha = 2 / (span + 1)
    reach = math.ceil(36 / -math.log(1 - alpha))
    seen = F.collect_list(x).over(w.rowsBetween(-reach, 0))
    tail = F.slice(seen, F.lit(2), F.greatest(F.size(seen) - 1, F.lit(0)))
    return F.when(F.size(seen) > 0, F.aggregate(tail, F.element_at(seen, 1), lambda y, v: y * (1 - alpha) + v * alpha))


def rsi(ret: Column, span: int, w: WindowSpec) -> Column:
    """Relative strength index on returns; null without losses."""
    gain, loss = ema(F.when(ret > 0, ret).when(ret.isNotNull(), 0.0), span, w), ema(F.when(ret < 0, -ret).when(ret.isNotNull(), 0.0), span, w)
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss))


def forward_return(ret: Column, h: int, w: WindowSpec) -> Column:
    """Compounded return of the next h rows; null if one is missing or there are fewer."""
    out = F.lit(1.0)
    for k in range(1, h + 1):
        out = out * (1 + F.lead(ret, k).over(w))
    return out - 1


def forward_realised_vol(ret: Column, h: int, w: WindowSpec) -> Column:
    """Root of the summed squared log returns of h rows from this one on."""
    frame = w.rowsBetween(0, h - 1)
    logs = F.log1p(ret)
    return F.when(F.count(logs).over(frame) == h, F.sqrt(F.sum(logs * logs).over(frame)))


def average_rank(x: str, *keys: str) -> Column:
    """Rank within the keys, ties averaged; null for null."""
    w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
    return F.when(F.col(x).isNotNull(), F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2)


def rank_scaled(x: str, *keys: str) -> Column:
    """Average rank as a share of the group, on [-1, 1]."""
    return average_rank(x, *keys) / F.count(F.col(x)).over(Window.partitionBy(*keys)) * 2 - 1


def demean(x: str, *keys: str) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(*keys))


def equity(ret: Column, w: WindowSpec) -> Column:
    """Compounded wealth of one unit."""
    return F.exp(F.sum(F.log1p(ret)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(wealth: str, w: WindowSpec) -> Column:
    return F.col(wealth) / F.max(wealth).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1


def level_rank(x: Column, w: WindowSpec, n: int = 252) -> Column:
    """Place of x between the least and largest of its last n values; null before there are n, or where they are equal. Rows without x go first."""
    last = w.rowsBetween(-(n - 1), 0)
    lo, hi = F.min(x).over(last), F.max(x).over(last)
    return F.when((F.count(x).over(last) == n) & (hi > lo), (x - lo) / (hi - lo))


def to_recent_mean(x: Column, w: WindowSpec, n: int = 20, least: int = 5) -> Column:
    """x over the mean of the up to n values before it; null with fewer than ``least``."""
    before = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(before) >= least, x / F.avg(x).over(before))


def step_change(x: Column, w: WindowSpec) -> Column:
    """x over its value one row before, less 1."""
    return x / F.lag(x).over(w) - 1


def realised_vol(ret: Column, w: WindowSpec, n: int = 30, periods: float = 252.0) -> Column:
    """Annualised deviation of the last n rows' returns, missing ones left out; null before the n-th row."""
    return F.when(F.row_number().over(w) >= n, F.stddev_samp(ret).over(w.rowsBetween(-(n - 1), 0)) * F.sqrt(F.lit(periods)))
