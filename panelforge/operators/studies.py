"""Robustness studies over prediction and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.operators import inference, metrics, selection


def lookup(df: DataFrame, names: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Add a small table's value by key, with a default for unknown keys."""
    return df.join(F.broadcast(names.select(key, value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def coerce(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; what is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def without_event_crossing(preds: DataFrame, days_to_event: str, horizon: Column | int) -> DataFrame:
    """Rows whose holding period crosses no event; unknown event days stay."""
    crossing = (F.col(days_to_event) >= 0) & (F.col(days_to_event) <= horizon)
    return preds.where(~F.coalesce(crossing, F.lit(False)))


def signal_decay(preds: DataFrame, pred: str, y: str, cell: str, horizon: str, n: int = 3, periods: float = 52.0) -> DataFrame:
    """Pooled IC, R2 and long/short Sharpe ratio of each cell by horizon, and the change of the IC from the shortest horizon."""
    out = metrics.rank_ic(preds, pred, y, [cell, horizon], 11, large=True).join(metrics.regression(preds, pred, y, [cell, horizon]), [cell, horizon])
    out = out.join(gross_sharpe(preds, [cell, horizon], n, periods).select(cell, horizon, "sharpe"), [cell, horizon], "left")
    first = F.first("ic").over(Window.partitionBy(cell).orderBy(horizon))
    return out.withColumn("decay", F.col("ic") - first)


def leg_membership(preds: DataFrame, keys: list[str], member: Column, n: int, pred: str = "pred", entity: str = "ticker", date: str = "date") -> DataFrame:
    """Share of dates on which a group's member stands in the long or the short leg."""
    day = Window.partitionBy(*keys, date)
    legs = preds.withColumn("_up", F.row_number().over(day.orderBy(F.desc(pred), entity))).withColumn("_down", F.row_number().over(day.orderBy(pred, entity)))
    hit = lambda c: F.max(F.when((F.col(c) <= n) & member, 1.0).otherwise(0.0))
    daily = legs.groupBy(*keys, date).agg(hit("_up").alias("u"), hit("_down").alias("d"))
    return daily.groupBy(*keys).agg(F.avg("u").alias("in_long"), F.avg("d").alias("in_short"), F.count("*").alias("dates"))


def gross_sharpe(preds: DataFrame, keys: list[str], n: int, periods: float, pred: str = "pred", y: str = "y_raw", entity: str = "ticker", date: str = "date") -> DataFrame:
    """Annualised Sharpe ratio (ddof 0) of the mean of the top n less the mean of the bottom n, without costs."""
    day = Window.partitionBy(*keys, date)
    legs = preds.withColumn("_up", F.row_number().over(day.orderBy(F.desc(pred), entity))).withColumn("_down", F.row_number().over(day.orderBy(pred, entity))).withColumn("_m", F.count("*").over(day)).where(F.col("_m") >= 2 * n)
    daily = legs.groupBy(*keys, date).agg((F.avg(F.when(F.col("_up") <= n, F.col(y))) - F.avg(F.when(F.col("_down") <= n, F.col(y)))).alias("r"))
    return daily.groupBy(*keys).agg((F.avg("r") / F.stddev_pop("r") * F.sqrt(F.lit(periods))).alias("sharpe"), F.count("*").alias("dates"))


def median_split(preds: DataFrame, by: str, pred: str, y: str, keys: list[str]) -> DataFrame:
    """Daily IC above and below the global median of a column."""
    cut = selection.quantiles(preds, {by: [0.5]}).select(F.get(by, 0).alias("_cut"))
    side = preds.crossJoin(F.broadcast(cut)).withColumn("side", F.when(F.col(by) > F.col("_cut"), "high").otherwise("low"))
    daily = inference.daily_ic(side, pred, y, [*keys, "side", "date"])
    return daily.groupBy(*keys, "side").agg(F.avg("ic").alias("ic"), F.count("*").alias("days"))


def head_to_head(preds: DataFrame, first: str, second: str, cell: str, pred: str, y: str) -> DataFrame:
    """Daily IC of two cells on their common dates: means, mean difference, share of dates won."""
    ic = inference.daily_ic(preds.where(F.col(cell).isin(first, second)), pred, y, [cell, "date"])
    # two correlations that are equal but for float noise are a tie
    of = lambda name: F.round(F.max(F.when(F.col(cell) == name, F.col("ic"))), 9)
    both = ic.groupBy("date").agg(of(first).alias("a"), of(second).alias("b")).dropna()
    return both.agg(F.count("*").alias("dates"), F.avg("a").alias("first"), F.avg("b").alias("second"), F.avg(F.col("a") - F.col("b")).alias("difference"), F.avg(F.when(F.col("a") > F.col("b"), 1.0).otherwise(0.0)).alias("won"))


def equity_summary(pnl: DataFrame, keys: list[str], stake: float, periods: float, value: str = "portfolio_return") -> DataFrame:
    """Final value of a stake, geometric annual return over ddof-0 volatility, drawdown."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = pnl.withColumn("_w", F.exp(F.sum(F.log1p(value)).over(w))).withColumn("_p", F.greatest(F.lit(1.0), F.max("_w").over(w)))
    growth = F.exp(F.sum(F.log1p(value)))
    return c.groupBy(*keys).agg((stake * growth).alias("final"), ((F.pow(growth, periods / F.count("*")) - 1) / (F.stddev_pop(value) * F.sqrt(F.lit(periods)))).alias("sharpe"), F.min(F.col("_w") / F.col("_p") - 1).alias("max_drawdown"))


def survivors(cells: DataFrame, t: str, bar: float) -> DataFrame:
    """Cells whose |t| passes the bar, best first; and their rank."""
    return cells.where(F.abs(t) > bar).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs(t)), *cells.columns[:2])))


def matching(df: DataFrame, label: str, contains: str = "", startswith: str = "") -> DataFrame:
    """Rows whose label holds the one text and begins with the other."""
    return df.where(F.col(label).contains(contains) & F.col(label).startswith(startswith))


def headlines(cells: DataFrame, keys: list[str], name: str, best: dict[str, str], t: str, bar: float) -> DataFrame:
    """For each key the cell that is best by each column (ties go to the first name), its value, the number of cells, and those whose |t| passes the bar."""
    at = [x for c, alias in best.items() for x in (F.min_by(name, F.struct(-F.col(c), F.col(name))).alias(f"best_{alias}"), F.max(c).alias(alias))]
    return cells.groupBy(*keys).agg(*at, F.count("*").alias("cells"), F.count(F.when(F.abs(t) > bar, 1)).alias("passing"))


def carry_over(new: DataFrame, old: DataFrame, keys: list[str], label: str, prefix: str) -> DataFrame:
    """Re-evaluated rows, and those of the old table whose label begins with the prefix and that were not re-evaluated."""
    kept = old.where(F.col(label).startswith(prefix)).join(new.select(*keys), keys, "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def regime_labels(vix: Column, days_to_event: Column, exposure: Column) -> dict[str, Column]:
    """Volatility level, nearness of an event and sign of the gamma exposure; a missing value goes to the last label."""
    return {
        "vix": F.when(vix >= 25, "high_vix").when(vix <= 15, "low_vix").otherwise("normal_vix"),
        "earnings": F.when(days_to_event <= 7, "near_earnings").otherwise("far_earnings"),
        "gex": F.when(exposure > 0, "positive_gex").otherwise("negative_gex"),
    }


def with_regimes(preds: DataFrame, regimes: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with the regime columns of their key; keys without any keep nulls."""
    return preds.join(regimes, keys, "left")


def window_ic(preds: DataFrame, pred: str, y: str, keys: list[str], named: Column, least: int = 11, window: str = "window") -> DataFrame:
    """Mean rank correlation over windows, and their number, of the cells that ``named`` selects."""
    ic = metrics.rank_ic(preds.where(named), pred, y, [*keys, window], least)
    return ic.groupBy(*keys).agg(F.avg("ic").alias("ic"), F.count("ic").alias("windows"))


def top(df: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the largest value, best first; ties go by the given columns."""
    return df.orderBy(F.desc(value), *ties).limit(k)
