"""Queries over prediction tables: metrics, tests, regimes, lifts, backtests, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelforge.functions.scalars import normal_quantile_sql
from panelforge.operators import backtest, inference, metrics
from panelforge.plans.rounding import rounded, sql_rounded as R
from panelforge.sources.tables import ctes, materialize, preds

CELL = ["feature_set", "horizon"]
col = F.col


def metrics_regression(spark, d):
    """R2, RMSE, MAE, cross-sectional R2, rank IC and ICIR of every cell."""
    p = materialize(preds(spark, d), "preds")
    out = metrics.regression(p, "pred", "y_raw", CELL)
    for part in (metrics.cross_sectional_r2(p, "pred", "y_raw", CELL), metrics.rank_ic(p, "pred", "y_raw", CELL, large=True), metrics.icir(p, "pred", "y_raw", CELL, ["ticker", "date"])):
        out = out.join(part, CELL)
    return rounded(out)


def metrics_classification(spark, d):
    p = materialize(preds(spark, d), "preds")
    said, true = col("pred") > 0, col("y_raw") > 0
    return rounded(metrics.classification(p, said, true, CELL).join(metrics.roc_auc(p, "pred", true, CELL), CELL).join(metrics.base_rate(p, "y_raw", CELL), CELL))


def economic_metrics(spark, d):
    return rounded(metrics.economic(preds(spark, d), col("pred") > 0, "y_raw", CELL), 4)


def evaluation_table(spark, d):
    """All metrics of every cell in one row."""
    return rounded(metrics.evaluate(materialize(preds(spark, d).where("horizon = 1"), "preds"), "pred", "y_demeaned", CELL).select(*CELL, "r2", "xs_r2", "ic", "accuracy", "auc", "win_rate"))


def daily_rank_ic(spark, d):
    return rounded(inference.daily_ic(preds(spark, d), "pred", "y_demeaned", [*CELL, "date"]))


def nw_tstats(spark, d):
    """Both HAC estimators of every cell's mean daily IC, with significance flags."""
    ic = materialize(inference.daily_ic(preds(spark, d), "pred", "y_demeaned", [*CELL, "date"]))
    a = inference.newey_west(ic, "ic", CELL, "date")
    b = inference.newey_west(ic, "ic", CELL, "date", divisor_n=True).select(*CELL, col("se").alias("se_n"))
    return rounded(a.join(b, CELL).withColumn("over2", F.abs("t") > 1.96).withColumn("over3", F.abs("t") > 3).drop("lags"))


def forecast_tests(spark, d):
    """Clark-West, Diebold-Mariano and McNemar between the naive zero and each feature set."""
    p = materialize(preds(spark, d).withColumn("zero", F.lit(0.0)).withColumn("name", F.concat("ticker", F.lit("|"))), "preds")
    cw = inference.clark_west(p, "zero", "pred", "y_demeaned", CELL, ["name", "date"]).select(*CELL, "n", col("t").alias("cw_t"), col("p").alias("cw_p"))
    dm = inference.diebold_mariano(p, "zero", "pred", "y_demeaned", CELL, ["name", "date"], 3).select(*CELL, col("t").alias("dm_t"), col("p").alias("dm_p"))
    mc = inference.mcnemar(p, (col("pred") > 0) == (col("y_raw") > 0), col("y_raw") > 0, CELL)
    return rounded(cw.join(dm, CELL).join(mc, CELL), 4)


def deflated_sharpe(spark, d):
    pnl = backtest.long_flat(preds(spark, d), CELL)
    s = pnl.groupBy(*CELL).agg((F.avg("portfolio_return") / F.stddev_samp("portfolio_return")).alias("sharpe"))
    return rounded(inference.deflated_sharpe(s, "sharpe"))


def sharpe_probability(spark, d):
    """Probability of each cell's Sharpe ratio against the bar of the trials made, and of 192 and 252 trials."""
    pnl = backtest.long_flat(preds(spark, d), CELL)
    s = materialize(pnl.groupBy(*CELL).agg((F.avg("portfolio_return") / F.stddev_samp("portfolio_return")).alias("sharpe"), F.count("portfolio_return").alias("periods")))
    made = s.where("sharpe is not null").count()
    out = [inference.sharpe_probability(s, "sharpe", "periods", n).withColumn("trials", F.lit(n)) for n in (made, 192, 252)]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))


def pbo_cscv(spark, d):
    pnl = backtest.long_flat(preds(spark, d).where("horizon = 1"), ["feature_set"])
    return rounded(inference.pbo(pnl, "feature_set", "date", "portfolio_return"))


def bootstrap_regimes(spark, d):
    """Bootstrap of the daily IC in high and low volatility: whole dates drawn, and blocks of quarters.

    Also of the high-low difference: volatility regimes drawn independently, as
    a date is in one of them, wide and narrow spreads paired by date.
    """
    p = preds(spark, d).where("horizon = 1")
    ic = materialize(inference.daily_ic(p, "pred", "y_demeaned", ["feature_set", "date", "vix_close"]))
    ic = ic.withColumn("regime", F.when(col("vix_close") >= 20, "high").otherwise("low")).withColumn("quarter", F.concat(F.year("date"), F.quarter("date")))
    by_date = inference.bootstrap(ic, ["feature_set", "regime"], "ic", "date", 5000).withColumn("unit", F.lit("date"))
    by_block = inference.bootstrap(ic, ["feature_set", "regime"], "ic", "quarter", 5000).withColumn("unit", F.lit("quarter"))
    apart = [inference.bootstrap_difference(ic, ["feature_set"], "regime", "high", "low", "ic", unit).withColumn("unit", F.lit(name)) for unit, name in (("date", "date"), ("quarter", "quarter"))]
    sides = p.crossJoin(F.broadcast(p.agg(F.percentile("spread", 0.5).alias("median")))).withColumn("side", F.when(col("spread") > col("median"), "high").otherwise("low"))
    by_side = materialize(inference.daily_ic(sides, "pred", "y_demeaned", ["feature_set", "side", "date"]))
    paired = inference.bootstrap_difference(by_side, ["feature_set"], "side", "high", "low", "ic", "date", paired=True).withColumn("unit", F.lit("date"))
    differences = apart[0].unionByName(apart[1]).withColumn("regime", F.lit("high - low")).unionByName(paired.withColumn("regime", F.lit("spread high - low, paired")))
    return rounded(by_date.unionByName(by_block).unionByName(differences))


def conformal(spark, d):
    p = preds(spark, d).where("horizon = 1")
    cal, test = p.where("date_idx < 200"), p.where("date_idx >= 200")
    return rounded(inference.coverage(inference.conformal(cal, test, "pred", "y_demeaned"), "y_demeaned", ["feature_set"]))


def power_curve(spark, d):
    """Smallest detectable IC over panel sizes, and the names needed for an IC of 0.004."""
    ic = materialize(inference.daily_ic(preds(spark, d), "pred", "y_demeaned", [*CELL, "date"]))
    se = inference.newey_west(ic, "ic", CELL, "date").agg(F.percentile("se", 0.5).alias("se"))
    spread = ic.groupBy(*CELL).agg(F.stddev_samp("ic").alias("s")).agg(F.percentile("s", 0.5).alias("dispersion"))
    grid = spark.createDataFrame([(float(n),) for n in (25, 60, 120, 250, 500, 1000, 2000)], "names double")
    mde = inference.minimum_effect(col("se"))
    out = grid.crossJoin(F.broadcast(se)).crossJoin(F.broadcast(spread))
    return rounded(out.select("names", "dispersion", (1 / F.sqrt(col("names") - 1)).alias("floor"), (mde * F.sqrt(25 / col("names"))).alias("mde"), inference.required_names(F.lit(0.004), mde, F.lit(25.0)).alias("required")))


def regime_eval(spark, d):
    labels = {
        "vix": F.when(col("vix_close") >= 25, "high_vix").when(col("vix_close") <= 15, "low_vix").otherwise("normal_vix"),
        "earnings": F.when(col("days_to_next_earnings") <= 7, "near_earnings").otherwise("far_earnings"),
    }
    return rounded(metrics.by_regime(materialize(preds(spark, d), "preds"), labels, "pred", "y_demeaned", CELL))


def lift_over_control(spark, d):
    """IC of each feature set minus the control's, by 13-week window; mean, error and share above 0."""
    p = preds(spark, d).withColumn("window", F.floor(col("date_idx") / 13))
    ic = metrics.rank_ic(p, "pred", "y_demeaned", ["feature_set", "horizon", "window"], 10)
    wide = ic.groupBy("horizon", "window").pivot("feature_set", ["A", "B", "C"]).agg(F.avg("ic")).dropna(subset=["A"])
    long = wide.select("horizon", "window", (col("B") - col("A")).alias("B"), (col("C") - col("A")).alias("C")).unpivot(["horizon", "window"], ["B", "C"], "feature_set", "lift")
    g = long.groupBy("feature_set", "horizon").agg(F.avg("lift").alias("lift"), (F.stddev_pop("lift") / F.sqrt(F.count("lift"))).alias("se"), F.count("lift").alias("windows"), F.avg(F.when(col("lift") > 0, 1.0).otherwise(0.0)).alias("positive"))
    return rounded(g)


def sector_neutral_ic(spark, d):
    """IC after (date, sector) means are taken from both sides, against the plain one, in blocks of 26 dates."""
    from panelforge.functions.windows import demean

    p = preds(spark, d).where("horizon = 1").withColumn("block", F.floor(col("date_idx") / 26))
    k = ["feature_set", "block"]
    n = p.select(*k, F.round(demean("pred", "feature_set", "date", "sector"), 9).alias("x"), F.round(demean("y_raw", "feature_set", "date", "sector"), 9).alias("y"))
    both = metrics.rank_ic(n, "x", "y", k, 10).withColumnRenamed("ic", "neutral").join(metrics.rank_ic(p, "pred", "y_demeaned", k, 10), k)
    return rounded(both.groupBy("feature_set").agg(F.avg("neutral").alias("neutral"), F.avg("ic").alias("plain"), F.avg(col("neutral") - col("ic")).alias("change"), F.count("*").alias("blocks")))


def universe_ablation(spark, d):
    """Daily IC with and without one sector's names."""
    p = preds(spark, d).where("horizon = 1")
    out = p.agg(F.min("sector").alias("s"))
    less = p.join(F.broadcast(out), p["sector"] == out["s"], "left_anti")
    a, b = (inference.daily_ic(x, "pred", "y_demeaned", ["feature_set", "date"]).groupBy("feature_set").agg(F.avg("ic").alias(n), F.count("*").alias(f"n_{n}")) for x, n in ((p, "full"), (less, "without")))
    return rounded(a.join(b, "feature_set"))


def lf_backtest(spark, d):
    return rounded(backtest.summary(backtest.long_flat(preds(spark, d), CELL), CELL, 52.0), 4)


def lf_hurdle_backtest(spark, d):
    return rounded(backtest.summary(backtest.long_flat_hurdle(preds(spark, d), CELL, 0.005), CELL, 52.0), 4)


def ls_backtest(spark, d):
    """Period returns of the top three against the bottom three names."""
    return rounded(backtest.long_short(materialize(preds(spark, d).where("horizon = 3"), "preds"), CELL, 3, 3))


def cost_sweep(spark, d):
    """Long/short summary over cost levels, all cells in one job."""
    grid = spark.createDataFrame([(0.15,), (0.25,)], "fraction double")
    p = materialize(preds(spark, d).where("horizon = 1"), "preds").crossJoin(F.broadcast(grid))
    keys = ["feature_set", "fraction"]
    return rounded(backtest.summary(backtest.long_short(p, keys, 3, 1, col("fraction")), keys, 52.0), 4)


def yearly_pnl(spark, d):
    return rounded(backtest.yearly(backtest.long_flat(preds(spark, d), CELL), CELL))


QUERIES = {
    f.__name__: f
    for f in (
        metrics_regression, metrics_classification, economic_metrics, evaluation_table, daily_rank_ic, nw_tstats, forecast_tests, deflated_sharpe, sharpe_probability, pbo_cscv, bootstrap_regimes, conformal, power_curve, regime_eval, lift_over_control,
        sector_neutral_ic, universe_ablation, lf_backtest, lf_hurdle_backtest, ls_backtest, cost_sweep, yearly_pnl,
    )
}

P = ctes("preds")


def _rank(x: str, keys: str) -> str:
    return f"RANK() OVER (PARTITION BY {keys} ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0E0"


def _ic(name: str, source: str, x: str, y: str, keys: str, least: int, where: str = "") -> str:
    return f"{name}r AS (SELECT {keys}, {_rank(x, keys)} AS a, {_rank(y, keys)} AS b FROM {source} {where}), {name} AS (SELECT * FROM (SELECT {keys}, CORR(a, b) AS ic, COUNT(*) AS n FROM {name}r GROUP BY {keys}) x WHERE n >= {least} AND ic IS NOT NULL AND NOT isnan(ic))"


def _nw(name: str, source: str, x: str, keys: str, order: str, lags: str, divisor: str, floor: bool) -> str:
    """HAC error of the mean of x by keys; ``divisor`` is n or the number of pairs."""
    on = " AND ".join(f"u.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    us = ", ".join(f"u.{k.strip()}" for k in keys.split(","))
    gs = " AND ".join(f"g.{k.strip()} = h.{k.strip()}" for k in keys.split(","))
    var = "(g0 + COALESCE(s, 0))"
    return f"""{name}e AS (SELECT {keys}, {x} - AVG({x}) OVER (PARTITION BY {keys}) AS e, AVG({x}) OVER (PARTITION BY {keys}) AS m, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source}),
{name}h AS (SELECT {keys}, COUNT(*) AS n, MAX(m) AS mean, SUM(e * e) / COUNT(*) AS g0, {lags} AS l FROM {name}e GROUP BY {keys}),
{name}g AS (SELECT {us}, u.rn - v.rn AS lag, SUM(u.e * v.e) AS c, COUNT(*) AS pairs FROM {name}e u JOIN {name}e v ON {on} AND v.rn BETWEEN u.rn - 40 AND u.rn - 1 GROUP BY {us}, u.rn - v.rn),
{name}s AS (SELECT {', '.join('h.' + k.strip() for k in keys.split(','))}, MAX(n) AS n, MAX(mean) AS mean, MAX(g0) AS g0, SUM(CASE WHEN lag <= l THEN 2 * (1 - lag / (l + 1.0E0)) * c / {divisor} END) AS s FROM {name}h h LEFT JOIN {name}g g ON {gs} GROUP BY {', '.join('h.' + k.strip() for k in keys.split(','))}),
{name} AS (SELECT *, SQRT({'GREATEST(' + var + ', 0)' if floor else var} / n) AS se FROM {name}s)"""


CUBE = "GREATEST(1, CAST(FLOOR(POWER(COUNT(*), 1.0E0 / 3)) AS INT))"


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * ABS({x}) / SQRT(2.0E0)))"
    tail = f"0.5 * EXP(-({x}) * ({x}) / 2) * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return f"(CASE WHEN ({x}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


_ppf = normal_quantile_sql

LF = """pos AS (SELECT *, CASE WHEN pred > 0 THEN 1.0E0 ELSE 0 END AS pos FROM preds), mv AS (SELECT *, ABS(pos - COALESCE(LAG(pos) OVER (PARTITION BY feature_set, horizon, ticker ORDER BY date), 0)) AS turn FROM pos),
pnl AS (SELECT feature_set, horizon, date, AVG(pos * y_raw - 0.0005 * turn) AS r, AVG(y_raw) AS hold, SUM(turn) AS trades FROM mv GROUP BY 1, 2, 3)"""


def _summary(source: str, keys: str, periods: float = 52.0) -> str:
    return f"""cu AS (SELECT *, EXP(SUM(LN(1 + GREATEST(r, -0.99))) OVER (PARTITION BY {keys} ORDER BY date)) AS wealth FROM {source}), pk AS (SELECT *, GREATEST(1, MAX(wealth) OVER (PARTITION BY {keys} ORDER BY date)) AS peak FROM cu),
sm AS (SELECT {keys}, POWER(1 + AVG(r), {periods}) - 1 AS annual_return, STDDEV_SAMP(r) * SQRT({periods}) AS annual_vol, MIN(wealth / peak - 1) AS max_drawdown, EXP(SUM(LN(1 + GREATEST(r, -0.99)))) - 1 AS total_return, AVG(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate, COUNT(*) AS periods FROM pk GROUP BY {keys}),
f AS (SELECT *, CASE WHEN annual_vol > 0 THEN annual_return / annual_vol END AS sharpe FROM sm)
SELECT {keys}, {R('annual_return annual_vol sharpe max_drawdown total_return win_rate', 4)}, periods FROM f"""


def _long_short(n: int, horizon: int, fraction: str, where: str, name: str = "ls") -> str:
    cost = f"CASE WHEN here = 1 THEN ABS(ch) * CASE WHEN spread IS NULL THEN 0.0005 ELSE LEAST(GREATEST(spread, 0.0005), 1.0) * {fraction} END ELSE 0 END"
    return f"""{name}a AS (SELECT *, DENSE_RANK() OVER (PARTITION BY feature_set, horizon ORDER BY date) - 1 AS i FROM preds WHERE {where}),
{name}b AS (SELECT *, COUNT(*) OVER (PARTITION BY feature_set, horizon, date) AS m, ROW_NUMBER() OVER (PARTITION BY feature_set, horizon, date ORDER BY pred DESC, ticker) AS up, ROW_NUMBER() OVER (PARTITION BY feature_set, horizon, date ORDER BY pred, ticker) AS dn FROM {name}a WHERE i % {horizon} = 0),
{name}c AS (SELECT *, CASE WHEN up <= {n} THEN 1.0E0 / {n} WHEN dn <= {n} THEN -1.0E0 / {n} END AS w, DENSE_RANK() OVER (PARTITION BY feature_set, horizon ORDER BY date) AS k FROM {name}b WHERE m >= {2 * n}),
{name}d AS (SELECT COALESCE(a.feature_set, b.feature_set) AS feature_set, COALESCE(a.horizon, b.horizon) AS horizon, COALESCE(a.ticker, b.ticker) AS ticker, COALESCE(a.k, b.k + 1) AS k, a.w, COALESCE(a.w, 0) - COALESCE(b.w, 0) AS ch
 FROM (SELECT * FROM {name}c WHERE w IS NOT NULL) a FULL JOIN (SELECT * FROM {name}c WHERE w IS NOT NULL) b ON a.feature_set = b.feature_set AND a.horizon = b.horizon AND a.ticker = b.ticker AND a.k = b.k + 1),
{name}q AS (SELECT d.*, c.y_raw, c.spread, CASE WHEN c.ticker IS NOT NULL THEN 1 ELSE 0 END AS here FROM {name}d d LEFT JOIN {name}c c ON c.feature_set = d.feature_set AND c.horizon = d.horizon AND c.ticker = d.ticker AND c.k = d.k),
{name}s AS (SELECT feature_set, horizon, k, SUM(COALESCE(w * y_raw, 0) - {cost} - CASE WHEN w < 0 THEN -w ELSE 0 END * 0.01 / (252.0E0 / {horizon})) AS r, SUM(ABS(ch)) AS turnover FROM {name}q GROUP BY 1, 2, 3),
{name} AS (SELECT s.feature_set, s.horizon, t.date, r, turnover FROM {name}s s JOIN (SELECT DISTINCT feature_set, horizon, k, date FROM {name}c) t ON s.feature_set = t.feature_set AND s.horizon = t.horizon AND s.k = t.k)"""


def _poisson(u: str) -> str:
    """Poisson(1) count of a uniform number."""
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(12):
        total += p
        steps.append(f"CASE WHEN {u} > {total!r} THEN 1 ELSE 0 END")
        p /= k + 1
    return " + ".join(steps)


def _draws(name: str, source: str, keys: str, value: str, unit: str, replicates: int, apart: str = "") -> str:
    """Mean ``m`` of each group and replicate, units weighed by hashed counts."""
    of = ", ".join(x for x in (f"CAST({unit} AS VARCHAR)", "CAST(rep AS VARCHAR)", apart, "'42'") if x)
    return f"""{name}u AS (SELECT {keys}, {unit}, SUM({value}) AS s, COUNT({value}) AS c FROM {source} GROUP BY {keys}, {unit}),
{name}w AS (SELECT *, (CAST('0x' || substr(md5(concat_ws('|', {of})), 1, 10) AS BIGINT) + 0.5E0) / {float(1 << 40)!r} AS u FROM {name}u CROSS JOIN range(1, {replicates + 1}) r(rep)),
{name} AS (SELECT * FROM (SELECT {keys}, rep, SUM(({_poisson('u')}) * s) / NULLIF(SUM(({_poisson('u')}) * c), 0) AS m FROM {name}w GROUP BY {keys}, rep) x WHERE m IS NOT NULL)"""


def _difference(name: str, source: str, group: str) -> str:
    """High less low by replicate."""
    return f"{name} AS (SELECT * FROM (SELECT feature_set, rep, MAX(CASE WHEN {group} = 'high' THEN m END) - MAX(CASE WHEN {group} = 'low' THEN m END) AS m FROM {source} GROUP BY 1, 2) x WHERE m IS NOT NULL)"


_INTERVAL = "AVG(m) AS mean, QUANTILE_CONT(m, 0.025) AS lo, QUANTILE_CONT(m, 0.975) AS hi, LEAST(1.0E0, 2 * LEAST(AVG(CASE WHEN m <= 0 THEN 1.0E0 ELSE 0 END), AVG(CASE WHEN m >= 0 THEN 1.0E0 ELSE 0 END))) AS p"

_LABELS = "SELECT p.*, 'vix' AS regime, CASE WHEN vix_close >= 25 THEN 'high_vix' WHEN vix_close <= 15 THEN 'low_vix' ELSE 'normal_vix' END AS value FROM preds p UNION ALL SELECT p.*, 'earnings', CASE WHEN days_to_next_earnings <= 7 THEN 'near_earnings' ELSE 'far_earnings' END FROM preds p"
_DAILY = _ic("ic", "preds", "pred", "y_demeaned", "feature_set, horizon, date", 5)
_CM = "CAST(SUM(CASE WHEN pred > 0 AND y_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(SUM(CASE WHEN pred > 0 AND NOT y_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(SUM(CASE WHEN NOT pred > 0 AND y_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(SUM(CASE WHEN NOT pred > 0 AND NOT y_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"

ORACLES = {
    "metrics_regression": f"""{P}, a AS (SELECT feature_set, horizon, 1 - SUM((y_raw - pred) * (y_raw - pred)) / SUM(y_raw * y_raw) AS r2, SQRT(AVG((y_raw - pred) * (y_raw - pred))) AS rmse, AVG(ABS(y_raw - pred)) AS mae, COUNT(*) AS n FROM preds GROUP BY 1, 2),
x AS (SELECT feature_set, horizon, pred - AVG(pred) OVER w AS p, y_raw - AVG(y_raw) OVER w AS y FROM preds WINDOW w AS (PARTITION BY feature_set, horizon, date)), b AS (SELECT feature_set, horizon, 1 - SUM((y - p) * (y - p)) / SUM(y * y) AS xs_r2 FROM x GROUP BY 1, 2),
{_ic('c', 'preds', 'pred', 'y_raw', 'feature_set, horizon', 2)},
k AS (SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY feature_set, horizon ORDER BY ticker, date) - 1) / 63) AS INT) AS chunk FROM preds), k2 AS (SELECT *, COUNT(*) OVER (PARTITION BY feature_set, horizon, chunk) AS m FROM k),
{_ic('e', 'k2', 'pred', 'y_raw', 'feature_set, horizon, chunk', 2, 'WHERE m = 63')}, i AS (SELECT feature_set, horizon, AVG(ic) / STDDEV_POP(ic) AS icir FROM e GROUP BY 1, 2),
f AS (SELECT a.*, xs_r2, c.ic, icir FROM a JOIN b ON a.feature_set = b.feature_set AND a.horizon = b.horizon JOIN c ON a.feature_set = c.feature_set AND a.horizon = c.horizon JOIN i ON a.feature_set = i.feature_set AND a.horizon = i.horizon)
SELECT feature_set, horizon, n, {R('r2 rmse mae xs_r2 ic icir')} FROM f""",
    "metrics_classification": f"""{P}, a AS (SELECT feature_set, horizon, {_CM}, AVG(CASE WHEN y_raw > 0 THEN 1.0 ELSE 0 END) AS base_rate FROM preds GROUP BY 1, 2),
r AS (SELECT feature_set, horizon, y_raw, {_rank('pred', 'feature_set, horizon')} AS r FROM preds), u AS (SELECT feature_set, horizon, (SUM(CASE WHEN y_raw > 0 THEN r END) - SUM(CASE WHEN y_raw > 0 THEN 1 END) * (SUM(CASE WHEN y_raw > 0 THEN 1 END) + 1) / 2.0E0) / (CAST(SUM(CASE WHEN y_raw > 0 THEN 1 END) AS DOUBLE) * SUM(CASE WHEN y_raw > 0 THEN 0 ELSE 1 END)) AS auc FROM r GROUP BY 1, 2),
f AS (SELECT a.*, auc, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, 2.0E0 * tp / (2 * tp + fp + fn) AS f1, tp + fp AS n_long, CAST(tp AS DOUBLE) / (tp + fp) AS long_accuracy FROM a JOIN u ON a.feature_set = u.feature_set AND a.horizon = u.horizon)
SELECT feature_set, horizon, tp, fp, fn, tn, n_long, {R('accuracy precision recall f1 long_accuracy auc base_rate')} FROM f""",
    "economic_metrics": f"""{P}, {LF}, c AS (SELECT *, EXP(SUM(LN(1 + r)) OVER (PARTITION BY feature_set, horizon ORDER BY date)) AS wealth FROM pnl), k AS (SELECT *, GREATEST(1, MAX(wealth) OVER (PARTITION BY feature_set, horizon ORDER BY date)) AS peak FROM c),
f AS (SELECT feature_set, horizon, AVG(r) * SQRT(252.0E0) / STDDEV_POP(r) AS sharpe, MIN(wealth / peak - 1) AS max_drawdown, (EXP(SUM(LN(1 + r))) - 1) * 100 AS total_return, AVG(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate, -AVG(CASE WHEN r > 0 THEN r END) / AVG(CASE WHEN r < 0 THEN r END) AS win_loss, SUM(trades) AS trades, EXP(SUM(LN(1 + r))) AS wealth FROM k GROUP BY 1, 2)
SELECT feature_set, horizon, {R('sharpe max_drawdown total_return win_rate win_loss trades wealth', 4)} FROM f""",
    "evaluation_table": f"""{P}, o AS (SELECT * REPLACE (y_demeaned AS y_raw) FROM preds WHERE horizon = 1), {LF.replace('FROM preds', 'FROM o')}, w AS (SELECT feature_set, AVG(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM pnl GROUP BY 1),
a AS (SELECT feature_set, horizon, {_CM}, 1 - SUM((y_raw - pred) * (y_raw - pred)) / SUM(y_raw * y_raw) AS r2 FROM o GROUP BY 1, 2), {_ic('c', 'o', 'pred', 'y_raw', 'feature_set', 2)},
x AS (SELECT feature_set, pred - AVG(pred) OVER w AS p, y_raw - AVG(y_raw) OVER w AS y FROM o WINDOW w AS (PARTITION BY feature_set, date)), b AS (SELECT feature_set, 1 - SUM((y - p) * (y - p)) / SUM(y * y) AS xs_r2 FROM x GROUP BY 1),
r AS (SELECT feature_set, y_raw, {_rank('pred', 'feature_set')} AS r FROM o), u AS (SELECT feature_set, (SUM(CASE WHEN y_raw > 0 THEN r END) - SUM(CASE WHEN y_raw > 0 THEN 1 END) * (SUM(CASE WHEN y_raw > 0 THEN 1 END) + 1) / 2.0E0) / (CAST(SUM(CASE WHEN y_raw > 0 THEN 1 END) AS DOUBLE) * SUM(CASE WHEN y_raw > 0 THEN 0 ELSE 1 END)) AS auc FROM r GROUP BY 1),
f AS (SELECT a.feature_set, a.horizon, r2, xs_r2, ic, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, auc, win_rate FROM a JOIN b ON a.feature_set = b.feature_set JOIN c ON a.feature_set = c.feature_set JOIN u ON a.feature_set = u.feature_set JOIN w ON a.feature_set = w.feature_set)
SELECT feature_set, horizon, {R('r2 xs_r2 ic accuracy auc win_rate')} FROM f""",
    "daily_rank_ic": f"{P}, {_DAILY} SELECT feature_set, horizon, date, n, {R('ic')} FROM ic",
    "nw_tstats": f"""{P}, {_DAILY}, {_nw('na', 'ic', 'ic', 'feature_set, horizon', 'date', CUBE, 'pairs', True)}, {_nw('nb', 'ic', 'ic', 'feature_set, horizon', 'date', CUBE, 'n', False)},
f AS (SELECT a.feature_set, a.horizon, a.n, a.mean, a.se, a.mean / a.se AS t, b.se AS se_n FROM na a JOIN nb b ON a.feature_set = b.feature_set AND a.horizon = b.horizon)
SELECT feature_set, horizon, n, {R('mean se t se_n')}, ABS(t) > 1.96 AS over2, ABS(t) > 3 AS over3 FROM f""",
    "forecast_tests": f"""{P}, x AS (SELECT *, ticker || '|' || CAST(date AS VARCHAR) AS id, y_demeaned * y_demeaned - ((y_demeaned - pred) * (y_demeaned - pred) - pred * pred) AS fc, y_demeaned * y_demeaned - (y_demeaned - pred) * (y_demeaned - pred) AS fd FROM preds),
{_nw('na', 'x', 'fc', 'feature_set, horizon', 'id', CUBE, 'n', False)}, {_nw('nb', 'x', 'fd', 'feature_set, horizon', 'id', '2', 'n', False)},
m AS (SELECT feature_set, horizon, CAST(SUM(CASE WHEN (pred > 0) = (y_raw > 0) AND NOT y_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(SUM(CASE WHEN (pred > 0) <> (y_raw > 0) AND y_raw > 0 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM preds GROUP BY 1, 2),
f AS (SELECT a.feature_set, a.horizon, a.n, a.mean / a.se AS cw_t, b.mean / b.se AS dm_t, m.b, m.c, (m.b - m.c) * (m.b - m.c) / CAST(m.b + m.c AS DOUBLE) AS chi2 FROM na a JOIN nb b ON a.feature_set = b.feature_set AND a.horizon = b.horizon JOIN m ON a.feature_set = m.feature_set AND a.horizon = m.horizon),
g AS (SELECT *, 1 - {_cdf('cw_t')} AS cw_p, 2 * (1 - {_cdf('ABS(dm_t)')}) AS dm_p, 2 * (1 - {_cdf('SQRT(chi2)')}) AS p FROM f)
SELECT feature_set, horizon, n, b, c, {R('cw_t cw_p dm_t dm_p chi2 p', 4)} FROM g""",
    "deflated_sharpe": f"""{P}, {LF}, s AS (SELECT feature_set, horizon, AVG(r) / STDDEV_SAMP(r) AS sharpe FROM pnl GROUP BY 1, 2), v AS (SELECT SQRT(VAR_SAMP(sharpe)) AS v, COUNT(*) AS n FROM s),
b AS (SELECT v * ((1 - {inference.EULER}) * {_ppf('1 - 1.0E0 / n')} + {inference.EULER} * {_ppf(f'1 - 1.0E0 / (n * {math.e!r})')}) AS sr0 FROM v), f AS (SELECT s.*, sr0, sharpe - sr0 AS excess FROM s CROSS JOIN b)
SELECT feature_set, horizon, {R('sharpe sr0 excess')}, excess > 0 AS survives FROM f""",
    "sharpe_probability": f"""{P}, {LF}, s AS (SELECT feature_set, horizon, AVG(r) / STDDEV_SAMP(r) AS sharpe, COUNT(r) AS periods FROM pnl GROUP BY 1, 2), v AS (SELECT SQRT(VAR_SAMP(sharpe)) AS v, COUNT(sharpe) AS n FROM s), t AS (SELECT v, CAST(n AS INT) AS trials FROM v UNION ALL SELECT v, 192 FROM v UNION ALL SELECT v, 252 FROM v),
b AS (SELECT trials, v * ((1 - {inference.EULER}) * {_ppf('1 - 1.0E0 / trials')} + {inference.EULER} * {_ppf(f'1 - 1.0E0 / (trials * {math.e!r})')}) AS sr0 FROM t), e AS (SELECT s.*, trials, sr0, sharpe - sr0 AS excess, (sharpe - sr0) * SQRT(GREATEST(periods - 1, 1)) AS z FROM s CROSS JOIN b),
f AS (SELECT *, {_cdf('z')} AS probability FROM e) SELECT feature_set, horizon, periods, trials, {R('sharpe sr0 excess probability')}, excess > 0 AS survives FROM f""",
    "bootstrap_regimes": f"""{P}, o AS (SELECT * FROM preds WHERE horizon = 1), {_ic('i', 'o', 'pred', 'y_demeaned', 'feature_set, date, vix_close', 5)}, q AS (SELECT *, CASE WHEN vix_close >= 20 THEN 'high' ELSE 'low' END AS regime, CAST(year(date) AS VARCHAR) || CAST(quarter(date) AS VARCHAR) AS quarter FROM i),
s AS (SELECT *, CASE WHEN spread > (SELECT QUANTILE_CONT(spread, 0.5) FROM o) THEN 'high' ELSE 'low' END AS side FROM o), {_ic('j', 's', 'pred', 'y_demeaned', 'feature_set, side, date', 5)}, k AS (SELECT * FROM j WHERE (feature_set, date) IN (SELECT (feature_set, date) FROM j GROUP BY feature_set, date HAVING COUNT(DISTINCT side) = 2)),
{_draws('da', 'q', 'feature_set, regime', 'ic', 'date', 5000)}, {_draws('db', 'q', 'feature_set, regime', 'ic', 'quarter', 5000)}, {_draws('ea', 'q', 'feature_set, regime', 'ic', 'date', 5000, 'regime')}, {_draws('eb', 'q', 'feature_set, regime', 'ic', 'quarter', 5000, 'regime')}, {_draws('ec', 'k', 'feature_set, side', 'ic', 'date', 5000)},
{_difference('fa', 'ea', 'regime')}, {_difference('fb', 'eb', 'regime')}, {_difference('fc', 'ec', 'side')},
u AS (SELECT feature_set, regime, m, 'date' AS unit FROM da UNION ALL SELECT feature_set, regime, m, 'quarter' FROM db UNION ALL SELECT feature_set, 'high - low', m, 'date' FROM fa UNION ALL SELECT feature_set, 'high - low', m, 'quarter' FROM fb UNION ALL SELECT feature_set, 'spread high - low, paired', m, 'date' FROM fc),
f AS (SELECT feature_set, regime, unit, {_INTERVAL} FROM u GROUP BY 1, 2, 3) SELECT feature_set, regime, unit, {R('mean lo hi p')} FROM f""",
    "pbo_cscv": f"""{P}, {LF}, t AS (SELECT date, NTILE(8) OVER (ORDER BY date) - 1 AS b FROM (SELECT DISTINCT date FROM pnl WHERE horizon = 1) x), s AS (SELECT feature_set AS t, b, COUNT(*) AS n, SUM(r) AS s, SUM(r * r) AS q FROM pnl JOIN t ON pnl.date = t.date WHERE horizon = 1 GROUP BY 1, 2),
m AS (SELECT i FROM range(0, 256) r(i) WHERE bit_count(i) = 4), a AS (SELECT m.i, s.t, (m.i >> s.b) & 1 AS ins, SUM(n) AS n, SUM(s) AS s, SUM(q) AS q FROM m CROSS JOIN s GROUP BY 1, 2, 3),
z AS (SELECT i, t, ins, ROUND((s / n) / SQRT((q - s * s / n) / (n - 1)), 9) AS sr FROM a), w AS (SELECT i, t, MAX(CASE WHEN ins = 1 THEN sr END) AS si, MAX(CASE WHEN ins = 0 THEN sr END) AS so FROM z GROUP BY 1, 2),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY si DESC, t) AS best, RANK() OVER (PARTITION BY i ORDER BY so) AS below, COUNT(*) OVER (PARTITION BY i) AS m FROM w),
l AS (SELECT LN((below / (m + 1.0E0)) / (1 - below / (m + 1.0E0))) AS logit FROM k WHERE best = 1), f AS (SELECT AVG(CASE WHEN logit <= 0 THEN 1.0 ELSE 0 END) AS pbo, COUNT(*) AS splits, AVG(logit) AS mean_logit FROM l)
SELECT {R('pbo mean_logit')}, splits FROM f""",
    "conformal": f"""{P}, c AS (SELECT ABS(y_demeaned - pred) AS e FROM preds WHERE horizon = 1 AND date_idx < 200), n AS (SELECT e, ROW_NUMBER() OVER (ORDER BY e) - 1 AS i, LEAST(CEIL(0.9E0 * (COUNT(*) OVER () + 1)) / COUNT(*) OVER (), 1.0E0) * (COUNT(*) OVER () - 1) AS pos FROM c), q AS (SELECT SUM(CASE WHEN i = FLOOR(pos) THEN e * (1 - (pos - FLOOR(pos))) WHEN i = FLOOR(pos) + 1 THEN e * (pos - FLOOR(pos)) ELSE 0 END) AS q FROM n),
f AS (SELECT feature_set, AVG(CASE WHEN y_demeaned BETWEEN pred - q AND pred + q THEN 1.0 ELSE 0 END) AS coverage, AVG(2 * q) AS width, COUNT(*) AS n FROM preds CROSS JOIN q WHERE horizon = 1 AND date_idx >= 200 GROUP BY 1)
SELECT feature_set, n, {R('coverage width')} FROM f""",
    "power_curve": f"""{P}, {_DAILY}, {_nw('na', 'ic', 'ic', 'feature_set, horizon', 'date', CUBE, 'pairs', True)}, s AS (SELECT QUANTILE_CONT(se, 0.5) AS se FROM na), d AS (SELECT QUANTILE_CONT(s, 0.5) AS dispersion FROM (SELECT STDDEV_SAMP(ic) AS s FROM ic GROUP BY feature_set, horizon) x),
g AS (SELECT CAST(UNNEST([25, 60, 120, 250, 500, 1000, 2000]) AS DOUBLE) AS names), f AS (SELECT names, dispersion, 1 / SQRT(names - 1) AS floor, 3 * se * SQRT(25 / names) AS mde, CAST(CEIL(25 * POWER(3 * se / 0.004, 2)) AS BIGINT) AS required FROM g CROSS JOIN s CROSS JOIN d)
SELECT {R('names dispersion floor mde')}, required FROM f""",
    "regime_eval": f"""{P}, l AS ({_LABELS}), a AS (SELECT feature_set, horizon, regime, value, 1 - SUM((y_demeaned - pred) * (y_demeaned - pred)) / SUM(y_demeaned * y_demeaned) AS r2, SQRT(AVG((y_demeaned - pred) * (y_demeaned - pred))) AS rmse, AVG(ABS(y_demeaned - pred)) AS mae, COUNT(*) AS n FROM l GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 10),
{_ic('i', 'l', 'pred', 'y_demeaned', 'feature_set, horizon, regime, value', 2)}, f AS (SELECT a.*, ic FROM a JOIN i ON a.feature_set = i.feature_set AND a.horizon = i.horizon AND a.regime = i.regime AND a.value = i.value)
SELECT feature_set, horizon, regime, value, n, {R('r2 rmse mae ic')} FROM f""",
    "lift_over_control": f"""{P}, w AS (SELECT *, CAST(FLOOR(date_idx / 13) AS INT) AS win FROM preds), {_ic('i', 'w', 'pred', 'y_demeaned', 'feature_set, horizon, win', 10)},
j AS (SELECT b.feature_set, b.horizon, b.ic - a.ic AS lift FROM i a JOIN i b ON a.horizon = b.horizon AND a.win = b.win WHERE a.feature_set = 'A' AND b.feature_set <> 'A'),
f AS (SELECT feature_set, horizon, AVG(lift) AS lift, STDDEV_POP(lift) / SQRT(COUNT(*)) AS se, COUNT(*) AS windows, AVG(CASE WHEN lift > 0 THEN 1.0 ELSE 0 END) AS positive FROM j GROUP BY 1, 2)
SELECT feature_set, horizon, windows, {R('lift se positive')} FROM f""",
    "sector_neutral_ic": f"""{P}, b AS (SELECT *, CAST(FLOOR(date_idx / 26) AS INT) AS block, ROUND(pred - AVG(pred) OVER w, 9) AS x, ROUND(y_raw - AVG(y_raw) OVER w, 9) AS y FROM preds WHERE horizon = 1 WINDOW w AS (PARTITION BY feature_set, date, sector)),
{_ic('n', 'b', 'x', 'y', 'feature_set, block', 10)}, {_ic('p', 'b', 'pred', 'y_demeaned', 'feature_set, block', 10)}, f AS (SELECT n.feature_set, AVG(n.ic) AS neutral, AVG(p.ic) AS plain, AVG(n.ic - p.ic) AS change, COUNT(*) AS blocks FROM n JOIN p ON n.feature_set = p.feature_set AND n.block = p.block GROUP BY 1)
SELECT feature_set, blocks, {R('neutral plain change')} FROM f""",
    "universe_ablation": f"""{P}, o AS (SELECT * FROM preds WHERE horizon = 1), s AS (SELECT * FROM o WHERE sector <> (SELECT MIN(sector) FROM o)), {_ic('a', 'o', 'pred', 'y_demeaned', 'feature_set, date', 5)}, {_ic('b', 's', 'pred', 'y_demeaned', 'feature_set, date', 5)},
x AS (SELECT feature_set, AVG(ic) AS fu, COUNT(*) AS n_full FROM a GROUP BY 1), y AS (SELECT feature_set, AVG(ic) AS without, COUNT(*) AS n_without FROM b GROUP BY 1), f AS (SELECT x.feature_set, fu, n_full, without, n_without FROM x JOIN y ON x.feature_set = y.feature_set)
SELECT feature_set, n_full, n_without, {R('fu').replace('AS fu', 'AS "full"')}, {R('without')} FROM f""",
    "lf_backtest": f"{P}, {LF}, {_summary('pnl', 'feature_set, horizon')}",
    "lf_hurdle_backtest": f"""{P}, o AS (SELECT *, CASE WHEN pred > 0.005 THEN 1.0E0 ELSE 0 END AS o FROM preds), n AS (SELECT *, SUM(o) OVER (PARTITION BY feature_set, horizon, date) AS n FROM o), w AS (SELECT *, CASE WHEN n > 0 THEN o / n ELSE 0 END AS w FROM n),
c AS (SELECT *, w - COALESCE(LAG(w) OVER (PARTITION BY feature_set, horizon, ticker ORDER BY date), 0) AS ch FROM w), pnl AS (SELECT feature_set, horizon, date, SUM(w * y_raw - ABS(ch) * LEAST(GREATEST(spread, 0.0005), 1.0) * 0.15) AS r FROM c GROUP BY 1, 2, 3), {_summary('pnl', 'feature_set, horizon')}""",
    "ls_backtest": f"{P}, {_long_short(3, 3, '0.15', 'horizon = 3')}, f AS (SELECT feature_set, horizon, date, r AS portfolio_return, turnover FROM ls) SELECT feature_set, horizon, date, {R('portfolio_return turnover')} FROM f",
    "cost_sweep": f"{P}, {_long_short(3, 1, '0.15', 'horizon = 1', 'lo')}, {_long_short(3, 1, '0.25', 'horizon = 1', 'hi')}, u AS (SELECT *, 0.15E0 AS fraction FROM lo UNION ALL SELECT *, 0.25E0 FROM hi), {_summary('u', 'feature_set, fraction')}",
    "yearly_pnl": f"{P}, {LF}, f AS (SELECT feature_set, horizon, CAST(year(date) AS INT) AS year, EXP(SUM(LN(1 + GREATEST(r, -0.99)))) - 1 AS ret, COUNT(*) AS n FROM pnl GROUP BY 1, 2, 3) SELECT feature_set, horizon, year, n, {R('ret')} FROM f",
}
