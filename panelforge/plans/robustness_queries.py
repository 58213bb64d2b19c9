"""Queries on regimes, lifts, strategies and tables of all cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import backtest, inference, metrics, panel, studies, surface
from panelforge.plans.evaluation_queries import _CM, _INTERVAL, _difference, _draws, _ic, _long_short, _nw, _rank, CUBE
from panelforge.plans.rounding import rounded, sql_rounded as R
from panelforge.sources.tables import bars, contracts, ctes, materialize, preds

CELL = ["feature_set", "horizon"]
col = F.col
SUMMED = ("vw_iv", "vw_moneyness", "spread", "net_gamma", "net_delta", "max_moneyness")


def regime_metrics(spark, d):
    """Every metric of each value of each regime, for one horizon; values of fewer than 10 rows are left out."""
    p = materialize(preds(spark, d).where("horizon = 1"), "preds")
    labels = studies.regime_labels(col("vix_close"), col("days_to_next_earnings"), col("pred"))
    long = metrics.by_label(p, labels, 10)
    table = metrics.evaluate(materialize(long, "regimes"), "pred", "y_demeaned", ["feature_set", "regime", "value"])
    return rounded(metrics.comparison(table, ["feature_set", "regime", "value"]), 4)


def _sides(spark, d):
    """Daily IC in the high and low side of three regimes: volatility, its premium over the last move, and nearness of earnings.

    The premium is high above its pooled median on strictly earlier dates.
    """
    p = materialize(preds(spark, d).where("horizon = 1"), "preds")
    b = materialize(bars(spark, d).select("ticker", "date", F.round(col("vix_close") / 100 - F.abs("ret"), 9).alias("premium")).where("premium is not null"), "premium")
    level = b.join(F.broadcast(panel.causal_median(b, "premium")), "date").select("ticker", "date", F.when(col("premium") > col("median"), "high").otherwise("low").alias("premium"))
    both = p.join(level, ["ticker", "date"], "left")
    side = {"vix": F.when(col("vix_close") >= 20, "high").otherwise("low"), "premium": F.coalesce("premium", F.lit("low")), "earnings": F.when(col("days_to_next_earnings") <= 7, "high").otherwise("low")}
    long = metrics.by_label(both.select("feature_set", "date", "pred", "y_demeaned", "vix_close", "days_to_next_earnings", "premium"), side, 1)
    return inference.daily_ic(long, "pred", "y_demeaned", ["feature_set", "regime", "value", "date"])


def regime_differences(spark, d):
    """High less low daily IC of three regimes by bootstrap, and how many differences stand before and after Bonferroni's correction."""
    ic = materialize(_sides(spark, d), "sides")
    out = inference.bootstrap_difference(ic, ["feature_set", "regime"], "value", "high", "low", "ic", "date", 2000)
    return rounded(inference.corrected(out, "p"), 4)


def lift_meta(spark, d):
    """Lift of each feature set over the control, and of all together, over cells and windows: mean and interval by drawing quarters."""
    p = preds(spark, d).withColumn("window", F.floor(col("date_idx") / 13)).withColumn("_q", F.concat(F.year("date"), F.lit("Q"), F.quarter("date")))
    ic = metrics.rank_ic(p, "pred", "y_demeaned", [*CELL, "window"], 10)
    first = p.groupBy("window").agg(F.min("_q").alias("quarter"))
    wide = ic.groupBy("horizon", "window").pivot("feature_set", ["A", "B", "C"]).agg(F.avg("ic")).dropna(subset=["A"])
    long = wide.select("horizon", "window", (col("B") - col("A")).alias("B"), (col("C") - col("A")).alias("C")).unpivot(["horizon", "window"], ["B", "C"], "feature_set", "lift").join(F.broadcast(first), "window")
    each = long.where("lift is not null").select("quarter", "lift", F.explode(F.array("feature_set", F.lit("all"))).alias("feature_set"))
    each = materialize(each, "lifts")
    n = each.groupBy("feature_set").agg(F.avg("lift").alias("lift"), F.count("*").alias("n"), F.count_distinct("quarter").alias("quarters"))
    return rounded(inference.bootstrap(each, ["feature_set"], "lift", "quarter", 2000).join(n, "feature_set"))


def headline_cells(spark, d):
    """For each horizon the best cell by mean daily IC and by its t, and the cells whose |t| passes 3."""
    ic = materialize(inference.daily_ic(preds(spark, d), "pred", "y_demeaned", [*CELL, "date"]), "ic")
    t = inference.newey_west(ic, "ic", CELL, "date").withColumns({"mean": F.round("mean", 9), "t": F.round("t", 9)})
    return rounded(studies.headlines(t, ["horizon"], "feature_set", {"mean": "mean", "t": "t"}, "t", 3.0))


def strategy_sweep(spark, d):
    """Three strategies at two spread costs and two horizons: performance, all cells in one table."""
    p = materialize(preds(spark, d), "preds")
    costs = F.explode(F.array(F.lit(0.15), F.lit(0.25)))
    priced = materialize(p.withColumn("fraction", costs), "priced")
    keys = [*CELL, "fraction"]
    parts = [backtest.long_short(priced.where(col("horizon") == h), keys, 3, h, col("fraction")).select(*keys, "date", "portfolio_return").withColumn("strategy", F.lit("long_short")) for h in (1, 3)]
    parts.append(backtest.long_flat_hurdle(priced, keys, 0.005, col("fraction")).select(*keys, "date", "portfolio_return").withColumn("strategy", F.lit("hurdle")))
    flat = backtest.long_flat(p, CELL).select(*CELL, "date", "portfolio_return").withColumn("fraction", costs)
    pnl = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(flat.withColumn("strategy", F.lit("sign"))), "pnl")
    per = F.when(col("strategy") == "long_short", 52.0 / col("horizon")).otherwise(52.0)
    out = backtest.summary(pnl.withColumn("per_year", per), ["strategy", *keys, "per_year"], col("per_year"))
    return rounded(out.drop("per_year"), 3)


def labelled_strategies(spark, d):
    """Mean period return of the strategies whose label contains '15' and begins with 'hurdle': labels are strategy, set, horizon and cost."""
    p = materialize(preds(spark, d), "preds").withColumn("fraction", F.explode(F.array(F.lit(0.15), F.lit(0.25))))
    pnl = backtest.long_flat_hurdle(p, [*CELL, "fraction"], 0.005, col("fraction"))
    label = F.concat_ws("_", F.lit("hurdle"), "feature_set", col("horizon").cast("string"), (col("fraction") * 100).cast("int").cast("string"))
    return rounded(studies.matching(pnl.withColumn("label", label), "label", contains="15", startswith="hurdle").groupBy("label").agg(F.avg("portfolio_return").alias("mean"), F.count("*").alias("n")))


def chain_measures(spark, d):
    """All sixteen measures of every expiry's chain."""
    return rounded(surface.chain_summary(contracts(spark, d)), 6)


def split_matrix(spark, d):
    """Rows, targets and feature sums of the model matrix of each split."""
    b = bars(spark, d).withColumn("target", F.lead("ret").over(panel.Window.partitionBy("ticker").orderBy("date")))
    m = panel.split_matrix(b, panel.temporal_split(b), ["ret", "vol", "vix_close"], "target")
    at = lambda i: F.sum(F.get("x", i))
    return rounded(m.groupBy("split").agg(F.count("*").alias("n"), F.sum("up").alias("ups"), F.sum("y").alias("y"), at(0).alias("ret"), at(1).alias("vol"), at(2).alias("vix"), F.count_distinct("ticker").alias("tickers")), 4)


QUERIES = {f.__name__: f for f in (regime_metrics, regime_differences, lift_meta, headline_cells, strategy_sweep, labelled_strategies, chain_measures, split_matrix)}

B, C, P = ctes("bars"), ctes("contracts"), ctes("preds")
G = "feature_set, regime, value"
_LONG = "SELECT p.*, 'vix' AS regime, CASE WHEN vix_close >= 25 THEN 'high_vix' WHEN vix_close <= 15 THEN 'low_vix' ELSE 'normal_vix' END AS value FROM preds p WHERE horizon = 1 UNION ALL SELECT p.*, 'earnings', CASE WHEN days_to_next_earnings <= 7 THEN 'near_earnings' ELSE 'far_earnings' END FROM preds p WHERE horizon = 1 UNION ALL SELECT p.*, 'gex', CASE WHEN pred > 0 THEN 'positive_gex' ELSE 'negative_gex' END FROM preds p WHERE horizon = 1"
_SAME = "a.feature_set = {0}.feature_set AND a.regime = {0}.regime AND a.value = {0}.value"


def _performance(source: str, keys: str) -> str:
    """Summary of period returns ``r`` with ``per`` periods a year."""
    return f"""cu AS (SELECT *, EXP(SUM(LN(1 + GREATEST(r, -0.99))) OVER (PARTITION BY {keys} ORDER BY date)) AS wealth FROM {source}), pk AS (SELECT *, GREATEST(1, MAX(wealth) OVER (PARTITION BY {keys} ORDER BY date)) AS peak FROM cu),
sm AS (SELECT {keys}, POWER(1 + AVG(r), MAX(per)) - 1 AS annual_return, STDDEV_SAMP(r) * SQRT(MAX(per)) AS annual_vol, MIN(wealth / peak - 1) AS max_drawdown, EXP(SUM(LN(1 + GREATEST(r, -0.99)))) - 1 AS total_return, AVG(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate, COUNT(*) AS periods FROM pk GROUP BY {keys}),
f AS (SELECT *, CASE WHEN annual_vol > 0 THEN annual_return / annual_vol END AS sharpe FROM sm)"""


_HURDLE = """ho AS (SELECT p.*, c.fraction, CASE WHEN pred > 0.005 THEN 1.0E0 ELSE 0 END AS o FROM preds p CROSS JOIN (SELECT 0.15E0 AS fraction UNION ALL SELECT 0.25E0) c), hn AS (SELECT *, SUM(o) OVER (PARTITION BY feature_set, horizon, fraction, date) AS n FROM ho), hw AS (SELECT *, CASE WHEN n > 0 THEN o / n ELSE 0 END AS w FROM hn),
hc AS (SELECT *, w - COALESCE(LAG(w) OVER (PARTITION BY feature_set, horizon, fraction, ticker ORDER BY date), 0) AS ch FROM hw), hp AS (SELECT feature_set, horizon, fraction, date, SUM(w * y_raw - ABS(ch) * LEAST(GREATEST(spread, 0.0005), 1.0) * fraction) AS r FROM hc GROUP BY 1, 2, 3, 4)"""
_SUM = "SUM(CASE WHEN {} THEN {} ELSE 0 END)"

ORACLES = {
    "regime_metrics": f"""{P}, l AS ({_LONG}), pos AS (SELECT *, CASE WHEN pred > 0 THEN 1.0E0 ELSE 0 END AS pos FROM l), mv AS (SELECT *, ABS(pos - COALESCE(LAG(pos) OVER (PARTITION BY {G}, ticker ORDER BY date), 0)) AS turn FROM pos),
pnl AS (SELECT {G}, date, AVG(pos * y_demeaned - 0.0005 * turn) AS r, SUM(turn) AS trades FROM mv GROUP BY {G}, date), cu AS (SELECT *, EXP(SUM(LN(1 + r)) OVER (PARTITION BY {G} ORDER BY date)) AS wealth FROM pnl), pk AS (SELECT *, GREATEST(1, MAX(wealth) OVER (PARTITION BY {G} ORDER BY date)) AS peak FROM cu),
e AS (SELECT {G}, AVG(r) * SQRT(252.0E0) / NULLIF(STDDEV_POP(r), 0) AS sharpe, MIN(wealth / peak - 1) AS max_drawdown, (EXP(SUM(LN(1 + r))) - 1) * 100 AS total_return, AVG(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate, SUM(trades) AS trades FROM pk GROUP BY {G}),
o AS (SELECT * REPLACE (y_demeaned AS y_raw) FROM l), a AS (SELECT {G}, {_CM}, COUNT(*) AS n, 1 - SUM((y_raw - pred) * (y_raw - pred)) / SUM(y_raw * y_raw) AS r2, SQRT(AVG((y_raw - pred) * (y_raw - pred))) AS rmse, AVG(ABS(y_raw - pred)) AS mae FROM o GROUP BY {G} HAVING COUNT(*) >= 10), {_ic('c', 'o', 'pred', 'y_raw', G, 2)},
x AS (SELECT {G}, pred - AVG(pred) OVER w AS p, y_raw - AVG(y_raw) OVER w AS y FROM o WINDOW w AS (PARTITION BY {G}, date)), b AS (SELECT {G}, 1 - SUM((y - p) * (y - p)) / SUM(y * y) AS xs_r2 FROM x GROUP BY {G}),
r AS (SELECT {G}, y_raw, {_rank('pred', G)} AS r FROM o), u AS (SELECT {G}, (SUM(CASE WHEN y_raw > 0 THEN r END) - SUM(CASE WHEN y_raw > 0 THEN 1 END) * (SUM(CASE WHEN y_raw > 0 THEN 1 END) + 1) / 2.0E0) / (CAST(SUM(CASE WHEN y_raw > 0 THEN 1 END) AS DOUBLE) * SUM(CASE WHEN y_raw > 0 THEN 0 ELSE 1 END)) AS auc FROM r GROUP BY {G}),
f AS (SELECT a.*, xs_r2, ic, auc, sharpe, max_drawdown, total_return, win_rate, trades, CAST(tp + tn AS DOUBLE) / a.n AS accuracy, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2.0E0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fp AS n_long
 FROM a JOIN b ON {_SAME.format('b')} JOIN c ON {_SAME.format('c')} JOIN u ON {_SAME.format('u')} JOIN e ON {_SAME.format('e')})
SELECT {G}, n, n_long, {R('r2 xs_r2 rmse mae ic accuracy precision recall f1 auc sharpe max_drawdown total_return win_rate trades', 4)} FROM f""",
    "regime_differences": f"""{ctes('bars', 'preds')}, v AS (SELECT ticker, date, ROUND(vix_close / 100 - ABS(ret), 9) AS premium FROM bars WHERE ret IS NOT NULL), t AS (SELECT a.date, QUANTILE_CONT(b.premium, 0.5) AS median FROM (SELECT DISTINCT date FROM v) a LEFT JOIN v b ON b.date < a.date GROUP BY 1),
w AS (SELECT v.ticker, v.date, CASE WHEN premium > median THEN 'high' ELSE 'low' END AS premium FROM v JOIN t ON v.date = t.date), o AS (SELECT p.*, w.premium FROM preds p LEFT JOIN w ON p.ticker = w.ticker AND p.date = w.date WHERE horizon = 1),
l AS (SELECT *, 'vix' AS regime, CASE WHEN vix_close >= 20 THEN 'high' ELSE 'low' END AS value FROM o UNION ALL SELECT *, 'premium', COALESCE(premium, 'low') FROM o UNION ALL SELECT *, 'earnings', CASE WHEN days_to_next_earnings <= 7 THEN 'high' ELSE 'low' END FROM o), {_ic('i', 'l', 'pred', 'y_demeaned', f'{G}, date', 5)},
{_draws('d', 'i', G, 'ic', 'date', 2000, 'value')}, h AS (SELECT * FROM (SELECT feature_set, regime, rep, MAX(CASE WHEN value = 'high' THEN m END) - MAX(CASE WHEN value = 'low' THEN m END) AS m FROM d GROUP BY 1, 2, 3) x WHERE m IS NOT NULL), q AS (SELECT feature_set, regime, {_INTERVAL} FROM h GROUP BY 1, 2),
f AS (SELECT *, COUNT(*) OVER () AS tests, p < 0.05 AS stands, p < 0.05 / COUNT(*) OVER () AS corrected FROM q) SELECT feature_set, regime, tests, stands, corrected, COUNT(CASE WHEN stands THEN 1 END) OVER () AS n_stand, COUNT(CASE WHEN corrected THEN 1 END) OVER () AS n_corrected, {R('mean lo hi p', 4)} FROM f""",
    "lift_meta": f"""{P}, w AS (SELECT *, CAST(FLOOR(date_idx / 13) AS INT) AS win, CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) AS q FROM preds), g AS (SELECT win, MIN(q) AS quarter FROM w GROUP BY 1), {_ic('i', 'w', 'pred', 'y_demeaned', 'feature_set, horizon, win', 10)},
j AS (SELECT b.feature_set, b.win, b.ic - a.ic AS lift FROM i a JOIN i b ON a.horizon = b.horizon AND a.win = b.win WHERE a.feature_set = 'A' AND b.feature_set <> 'A'), l AS (SELECT j.feature_set, quarter, lift FROM j JOIN g ON j.win = g.win UNION ALL SELECT 'all', quarter, lift FROM j JOIN g ON j.win = g.win),
{_draws('d', 'l', 'feature_set', 'lift', 'quarter', 2000)}, m AS (SELECT feature_set, {_INTERVAL} FROM d GROUP BY 1), n AS (SELECT feature_set, AVG(lift) AS lift, COUNT(*) AS n, COUNT(DISTINCT quarter) AS quarters FROM l GROUP BY 1), f AS (SELECT m.*, n.lift, n.n, quarters FROM m JOIN n ON m.feature_set = n.feature_set)
SELECT feature_set, n, quarters, {R('mean lo hi p lift')} FROM f""",
    "headline_cells": f"""{P}, {_ic('ic', 'preds', 'pred', 'y_demeaned', 'feature_set, horizon, date', 5)}, {_nw('na', 'ic', 'ic', 'feature_set, horizon', 'date', CUBE, 'pairs', True)}, t AS (SELECT feature_set, horizon, ROUND(mean, 9) AS mean, ROUND(mean / se, 9) AS t FROM na),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY horizon ORDER BY mean DESC, feature_set) AS a, ROW_NUMBER() OVER (PARTITION BY horizon ORDER BY t DESC, feature_set) AS b FROM t),
f AS (SELECT horizon, MAX(CASE WHEN a = 1 THEN feature_set END) AS best_mean, MAX(mean) AS mean, MAX(CASE WHEN b = 1 THEN feature_set END) AS best_t, MAX(t) AS t, COUNT(*) AS cells, COUNT(CASE WHEN ABS(t) > 3 THEN 1 END) AS passing FROM r GROUP BY 1) SELECT horizon, best_mean, best_t, cells, passing, {R('mean t')} FROM f""",
    "strategy_sweep": f"""{P}, {', '.join(_long_short(3, h, str(c), f'horizon = {h}', f'l{h}{int(c * 100)}') for h in (1, 3) for c in (0.15, 0.25))}, {_HURDLE},
ps AS (SELECT *, CASE WHEN pred > 0 THEN 1.0E0 ELSE 0 END AS pos FROM preds), mv AS (SELECT *, ABS(pos - COALESCE(LAG(pos) OVER (PARTITION BY feature_set, horizon, ticker ORDER BY date), 0)) AS turn FROM ps), sg AS (SELECT feature_set, horizon, date, AVG(pos * y_raw - 0.0005 * turn) AS r FROM mv GROUP BY 1, 2, 3),
z AS ({' UNION ALL '.join(f"SELECT 'long_short' AS strategy, feature_set, horizon, {c}E0 AS fraction, date, r, 52.0E0 / {h} AS per FROM l{h}{int(c * 100)}" for h in (1, 3) for c in (0.15, 0.25))} UNION ALL SELECT 'hurdle', feature_set, horizon, fraction, date, r, 52.0E0 FROM hp UNION ALL SELECT 'sign', feature_set, horizon, c.fraction, date, r, 52.0E0 FROM sg CROSS JOIN (SELECT 0.15E0 AS fraction UNION ALL SELECT 0.25E0) c),
{_performance('z', 'strategy, feature_set, horizon, fraction')} SELECT strategy, feature_set, horizon, {R('fraction annual_return annual_vol sharpe max_drawdown total_return win_rate', 3)}, periods FROM f""",
    "labelled_strategies": f"""{P}, {_HURDLE}, f AS (SELECT 'hurdle_' || feature_set || '_' || horizon || '_' || CAST(CAST(fraction * 100 AS INT) AS VARCHAR) AS label, AVG(r) AS mean, COUNT(*) AS n FROM hp GROUP BY 1) SELECT label, n, {R('mean')} FROM f WHERE contains(label, '15') AND starts_with(label, 'hurdle')""",
    "chain_measures": f"""{C}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, date, dte ORDER BY ABS(moneyness - 1), strike, is_call) AS ra, ROW_NUMBER() OVER (PARTITION BY ticker, date, dte, is_call ORDER BY ABS(delta + CASE WHEN is_call = 1 THEN -0.25 ELSE 0.25 END), strike) AS rd FROM contracts),
f AS (SELECT ticker, date, dte, dte / 365.0E0 AS tau, COUNT(*) AS contracts, SUM(volume) AS volume, SUM(open_interest) AS open_interest, CASE WHEN {_SUM.format('is_call = 1', 'volume')} > 0 THEN CAST({_SUM.format('is_call = 0', 'volume')} AS DOUBLE) / {_SUM.format('is_call = 1', 'volume')} END AS pc_volume,
 CASE WHEN {_SUM.format('is_call = 1', 'open_interest')} > 0 THEN CAST({_SUM.format('is_call = 0', 'open_interest')} AS DOUBLE) / {_SUM.format('is_call = 1', 'open_interest')} END AS pc_oi, MAX(CASE WHEN ra = 1 THEN impl_volatility END) AS atm_iv,
 COALESCE(MAX(CASE WHEN is_call = 0 AND rd = 1 THEN impl_volatility END) - MAX(CASE WHEN is_call = 1 AND rd = 1 THEN impl_volatility END), 0) AS skew25, AVG(impl_volatility) AS mean_iv, STDDEV_POP(impl_volatility) AS std_iv,
 CASE WHEN SUM(volume) > 0 THEN SUM(volume * impl_volatility) / SUM(volume) END AS vw_iv, CASE WHEN SUM(volume) > 0 THEN SUM(volume * moneyness) / SUM(volume) END AS vw_moneyness, AVG(spread_pct) AS spread, SUM(open_interest * gamma * CASE WHEN is_call = 1 THEN 1 ELSE -1 END) AS net_gamma, SUM(volume * delta) AS net_delta, MAX(moneyness) AS max_moneyness FROM r GROUP BY 1, 2, 3)
SELECT ticker, date, dte, {R('tau contracts volume open_interest pc_volume pc_oi atm_iv skew25 mean_iv std_iv vw_iv vw_moneyness spread net_gamma net_delta max_moneyness')} FROM f""",
    "split_matrix": f"""{B}, n AS (SELECT COUNT(DISTINCT date) AS n FROM bars), s AS (SELECT b.*, LEAD(ret) OVER (PARTITION BY ticker ORDER BY date) AS target, FLOOR(n * 0.6) AS a, FLOOR(n * 0.6) + FLOOR(n * 0.2) AS c FROM bars b CROSS JOIN n),
l AS (SELECT *, CASE WHEN date_idx < a - 5 THEN 'train' WHEN date_idx >= a AND date_idx < c - 5 THEN 'val' WHEN date_idx >= c THEN 'test' END AS split FROM s WHERE target IS NOT NULL),
f AS (SELECT split, COUNT(*) AS n, SUM(CASE WHEN target > 0 THEN 1 ELSE 0 END) AS ups, SUM(target) AS y, SUM(COALESCE(ret, 0)) AS ret, SUM(vol) AS vol, SUM(vix_close) AS vix, COUNT(DISTINCT ticker) AS tickers FROM l WHERE split IS NOT NULL GROUP BY 1) SELECT split, n, tickers, {R('ups y ret vol vix', 4)} FROM f""",
}
