"""Metrics of predictions, grouped by any cell keys. Each is one grouping over sums; ranks shuffle by their own group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalars import correlation
from panelforge.functions.windows import average_rank, demean
from panelforge.operators import ordering


def _safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def regression(preds: DataFrame, pred: str, y: str, keys: list[str], train_mean: Column | None = None) -> DataFrame:
    """Out-of-sample R2 against the training mean (0 by default), RMSE, MAE, row count."""
    base = F.lit(0.0) if train_mean is None else train_mean
    e, b = F.col(y) - F.col(pred), F.col(y) - base
    return preds.groupBy(*keys).agg((1 - _safe(F.sum(e * e), F.sum(b * b))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


def cross_sectional_r2(preds: DataFrame, pred: str, y: str, keys: list[str], date: str = "date") -> DataFrame:
    """R2 after both sides lose their date means."""
    c = preds.select(*keys, demean(pred, *keys, date).alias("_p"), demean(y, *keys, date).alias("_y"))
    e = F.col("_y") - F.col("_p")
    return c.groupBy(*keys).agg((1 - _safe(F.sum(e * e), F.sum(F.col("_y") * F.col("_y")))).alias("xs_r2"))


def rank_ic(preds: DataFrame, pred: str, y: str, keys: list[str], least: int = 2, large: bool = False) -> DataFrame:
    """Spearman correlation with averaged ties. ``large``: a group is ranked in parts, not in one task."""
    if large:
        r = ordering.ranked(preds.select(*keys, F.col(pred).alias("_a"), F.col(y).alias("_b")), {"_a": "_p", "_b": "_y"}, keys)
    else:
        r = preds.select(*keys, average_rank(pred, *keys).alias("_p"), average_rank(y, *keys).alias("_y"))
    return r.groupBy(*keys).agg(F.when(F.count("*") >= least, correlation("_p", "_y")).alias("ic"))


def icir(preds: DataFrame, pred: str, y: str, keys: list[str], order: list[str], chunk: int = 63) -> DataFrame:
    """Mean over deviation of the IC of consecutive full chunks of rows in the given order; two chunks at least.

    Rows are numbered by the values of the first order column (an entity) at a time.
    """
    rows = ordering.numbered(preds.select(*dict.fromkeys([*keys, *order, pred, y])), keys, order, "_i")
    numbered = rows.withColumn("_chunk", F.floor(F.col("_i") / chunk)).withColumn("_size", F.count("*").over(Window.partitionBy(*keys, "_chunk"))).where(F.col("_size") == chunk)
    ics = rank_ic(numbered, pred, y, [*keys, "_chunk"])
    return ics.groupBy(*keys).agg(F.when(F.count("ic") >= 2, _safe(F.avg("ic"), F.stddev_pop("ic"))).alias("icir"))


def classification(preds: DataFrame, said: Column, true: Column, keys: list[str]) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1; accuracy and count of the positive calls."""
    n = lambda c: F.count(F.when(c, 1))
    out = preds.groupBy(*keys).agg(n(said & true).alias("tp"), n(said & ~true).alias("fp"), n(~said & true).alias("fn"), n(~said & ~true).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return out.select(*keys, "tp", "fp", "fn", "tn", _share(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), _share(2 * precision * recall, precision + recall).alias("f1"), (tp + fp).alias("n_long"), precision.alias("long_accuracy"))


def roc_auc(preds: DataFrame, score: str, true: Column, keys: list[str]) -> DataFrame:
    """Mann-Whitney form with averaged ties; null for one class. Groups are ranked in parts."""
    r = ordering.ranked(preds.select(*keys, F.col(score).alias("_s"), true.alias("_t")), {"_s": "_r"}, keys)
    s = r.groupBy(*keys).agg(F.sum(F.when(F.col("_t"), F.col("_r"))).alias("_s"), F.count(F.when(F.col("_t"), 1)).alias("_p"), F.count("*").alias("_n"))
    p, n = F.col("_p"), F.col("_n")
    return s.select(*keys, F.when((p > 0) & (p < n), (F.col("_s") - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def economic(preds: DataFrame, signal: Column, y: str, keys: list[str], horizon: int = 1, cost: float = 0.0005, entity: str = "ticker", date: str = "date") -> DataFrame:
    """Long/flat signal held with equal weights: Sharpe, drawdown, return, win rate, win/loss, trades, final wealth."""
    w = Window.partitionBy(*keys, entity).orderBy(date)
    p = preds.withColumn("_pos", F.when(signal, 1.0).otherwise(0.0))
    p = p.withColumn("_turn", F.abs(F.col("_pos") - F.lag("_pos", 1, 0.0).over(w))).withColumn("_pnl", F.col("_pos") * F.col(y) - cost * F.col("_turn"))
    daily = p.groupBy(*keys, date).agg(F.avg("_pnl").alias("r"), F.sum("_turn").alias("_trades"))
    g = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("_wealth", F.exp(F.sum(F.log1p("r")).over(g))).withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(g)))
    win, loss = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.avg(F.when(F.col("r") < 0, F.col("r")))
    return curve.groupBy(*keys).agg(
        _safe(F.avg("r") * F.sqrt(F.lit(252.0 / horizon)), F.stddev_pop("r")).alias("sharpe"), F.min(F.col("_wealth") / F.col("_peak") - 1).alias("max_drawdown"), ((F.exp(F.sum(F.log1p("r"))) - 1) * 100).alias("total_return"),
        F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"), (-win / loss).alias("win_loss"), F.sum("_trades").alias("trades"), F.exp(F.sum(F.log1p("r"))).alias("wealth"),
    )


def evaluate(preds: DataFrame, pred: str, y: str, keys: list[str]) -> DataFrame:
    """The full evaluation row of each cell."""
    said, true = F.col(pred) > 0, F.col(y) > 0
    out = regression(preds, pred, y, keys)
    for part in (cross_sectional_r2(preds, pred, y, keys), rank_ic(preds, pred, y, keys, large=True), classification(preds, said, true, keys), roc_auc(preds, pred, true, keys), economic(preds, said, y, keys)):
        out = out.join(part, keys)
    return out


def base_rate(preds: DataFrame, y: str, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(F.when(F.col(y) > 0, 1.0).otherwise(0.0)).alias("base_rate"))


#: Order of the columns of a comparison table.
ORDER = ("n", "r2", "xs_r2", "rmse", "mae", "ic", "icir", "accuracy", "precision", "recall", "f1", "auc", "n_long", "sharpe", "max_drawdown", "total_return", "win_rate", "trades")


def comparison(table: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """The columns that a result table has, in the fixed order."""
    return table.select(*keys, *[c for c in order if c in table.columns])


def by_label(preds: DataFrame, labels: dict[str, Column], least: int, keys: tuple[str, ...] = ("feature_set",)) -> DataFrame:
    """Rows once for each regime, with its name and the row's ``value``; a value with fewer than ``least`` rows in a cell (``keys``) is left out of that cell."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), c.alias("value")) for n, c in labels.items()]))
    long = preds.withColumn("_l", each).select(*preds.columns, "_l.regime", "_l.value").where("value is not null")
    if least <= 1:
        return long
    cell = [*keys, "regime", "value"]
    enough = long.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return long.join(F.broadcast(enough), cell, "left_semi")  # a row for each cell and value


def by_regime(preds: DataFrame, labels: dict[str, Column], pred: str, y: str, keys: list[str], least: int = 10) -> DataFrame:
    """Metrics for each value of each regime, values with too few rows left out."""
    tagged = preds.select("*", *[c.alias(f"_r_{n}") for n, c in labels.items()])
    long = tagged.unpivot([c for c in preds.columns], [f"_r_{n}" for n in labels], "regime", "value").withColumn("regime", F.substring("regime", 4, 100))
    cell = [*keys, "regime", "value"]
    return regression(long, pred, y, cell).where(F.col("n") >= least).join(rank_ic(long, pred, y, cell, large=True), cell)
