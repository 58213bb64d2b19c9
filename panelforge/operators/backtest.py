"""Portfolio backtests as set operations: ranks, a join with the previous rebalance, and grouped sums.

Target weights depend only on a date's ranks, so the weights before are those
of the rebalance before; nothing is recursive and all cells run in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def effective_spread_cost(change: Column, spread: Column, fraction: Column | float, fallback: float = 0.0005) -> Column:
    """|change| x spread clipped to [5 bp, 1] x fraction; a missing spread costs the fallback."""
    clipped = F.least(F.greatest(spread, F.lit(0.0005)), F.lit(1.0))
    missing = spread.isNull() | F.isnan(spread) | (F.abs(spread) == float("inf"))
    return F.abs(change) * F.when(missing, F.lit(fallback)).otherwise(clipped * fraction)


def borrow_drag(short: Column, annual_fee: float, periods: float) -> Column:
    return F.abs(short) * annual_fee / periods


def long_short(preds: DataFrame, keys: list[str], n: int, horizon: int, fraction: Column | float = 0.15, fee: float = 0.01, pred: str = "pred", y: str = "y_raw", entity: str = "ticker", date: str = "date") -> DataFrame:
    """Top n against bottom n on every horizon-th date, with spread and borrow costs.

    Dates with fewer than 2 n names are skipped. Returns (keys, date,
    portfolio_return, turnover). Ties go by entity.
    """
    dates = preds.select(*keys, date).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1).where(F.col("_i") % horizon == 0)
    day = Window.partitionBy(*keys, date)
    held = preds.join(dates.select(*keys, date), [*keys, date]).withColumn("_m", F.count("*").over(day)).where(F.col("_m") >= 2 * n)
    held = held.withColumn("_up", F.row_number().over(day.orderBy(F.desc(pred), entity))).withColumn("_down", F.row_number().over(day.orderBy(pred, entity)))
    weight = F.when(F.col("_up") <= n, 1.0 / n).when(F.col("_down") <= n, -1.0 / n)
    done = held.select(*keys, date).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(date)))
    today = held.withColumn("_w", weight).join(done, [*keys, date])
    legs = today.where("_w is not null").select(*keys, entity, "_k", "_w")
    before = legs.select(*keys, entity, (F.col("_k") + 1).alias("_k"), F.col("_w").alias("_before"))
    moves = legs.join(before, [*keys, entity, "_k"], "full").withColumn("_change", F.coalesce("_w", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))
    # a name that is absent on the date pays no cost, but its exit counts in the turnover
    quotes = today.select(*keys, entity, "_k", y, "spread", F.lit(1).alias("_here"))
    rows = moves.join(quotes, [*keys, entity, "_k"], "left")
    cost = F.when(F.col("_here") == 1, effective_spread_cost(F.col("_change"), F.col("spread"), fraction)).otherwise(0.0)
    periods = 252 / horizon
    net = F.coalesce(F.col("_w") * F.col(y), F.lit(0.0)) - cost - borrow_drag(F.when(F.col("_w") < 0, F.col("_w")).otherwise(0.0), fee, periods)
    out = rows.groupBy(*keys, "_k").agg(F.sum(net).alias("portfolio_return"), F.sum(F.abs("_change")).alias("turnover"))
    return out.join(done, [*keys, "_k"]).select(*keys, date, "portfolio_return", "turnover")


def long_flat_hurdle(preds: DataFrame, keys: list[str], hurdle: float, fraction: float = 0.15, pred: str = "pred", y: str = "y_raw", entity: str = "ticker", date: str = "date") -> DataFrame:
    """Equal weights on the names whose prediction beats the hurdle; flat where there are none."""
    day = Window.partitionBy(*keys, date)
    on = F.when(F.col(pred) > hurdle, 1.0).otherwise(0.0)
    p = preds.withColumn("_on", on).withColumn("_n", F.sum("_on").over(day)).withColumn("_w", F.when(F.col("_n") > 0, F.col("_on") / F.col("_n")).otherwise(0.0))
    p = p.withColumn("_change", F.col("_w") - F.lag("_w", 1, 0.0).over(Window.partitionBy(*keys, entity).orderBy(date)))
    net = F.col("_w") * F.col(y) - effective_spread_cost(F.col("_change"), F.col("spread"), fraction)
    return p.groupBy(*keys, date).agg(F.sum(net).alias("portfolio_return"), F.sum(F.abs("_change")).alias("turnover"))


def long_flat(preds: DataFrame, keys: list[str], cost: float = 0.0005, pred: str = "pred", y: str = "y_raw", entity: str = "ticker", date: str = "date") -> DataFrame:
    """Each name long or flat by the prediction's sign, mean over names, beside buy and hold."""
    w = Window.partitionBy(*keys, entity).orderBy(date)
    p = preds.withColumn("_pos", F.when(F.col(pred) > 0, 1.0).otherwise(0.0)).withColumn("_turn", F.abs(F.col("_pos") - F.lag("_pos", 1, 0.0).over(w)))
    return p.groupBy(*keys, date).agg(F.avg(F.col("_pos") * F.col(y) - cost * F.col("_turn")).alias("portfolio_return"), F.avg(y).alias("hold_return"), F.avg("_turn").alias("turnover"))


def summary(pnl: DataFrame, keys: list[str], periods: Column | float = 252.0, value: str = "portfolio_return", date: str = "date") -> DataFrame:
    """Annual return (1 + mean)^periods - 1, volatility (ddof 1), their ratio, drawdown, total return, win rate."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    r = F.greatest(F.col(value), F.lit(-0.99))
    c = pnl.withColumn("_wealth", F.exp(F.sum(F.log1p(r)).over(w))).withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(w)))
    per = F.lit(periods) if isinstance(periods, float) else periods
    out = c.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.min(F.col("_wealth") / F.col("_peak") - 1).alias("max_drawdown"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.count("*").alias("periods"))
    annual, vol = F.pow(1 + F.col("_m"), per) - 1, F.col("_s") * F.sqrt(per)
    return out.select(*keys, annual.alias("annual_return"), vol.alias("annual_vol"), F.when(vol > 0, annual / vol).alias("sharpe"), "max_drawdown", "total_return", "win_rate", "periods")


def yearly(pnl: DataFrame, keys: list[str], value: str = "portfolio_return", date: str = "date") -> DataFrame:
    """Compounded return of each calendar year."""
    return pnl.groupBy(*keys, F.year(date).alias("year")).agg((F.exp(F.sum(F.log1p(F.greatest(F.col(value), F.lit(-0.99))))) - 1).alias("ret"), F.count("*").alias("n"))
