"""Robustness studies as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelforge.functions.windows import by, forward_realised_vol, forward_return, level_rank, realised_vol
from panelforge.operators import backtest, chain, inference, metrics, panel, studies, surface, walkforward
from panelforge.plans.evaluation_queries import _DAILY, _INTERVAL, CUBE, LF, _draws, _ic, _nw
from panelforge.plans import chain_queries as CQ
from panelforge.plans.model_queries import _SVI
from panelforge.plans.rounding import rounded, sql_rounded as R
from panelforge.sources.tables import bars, chain_and_bars, contracts, ctes, materialize, preds, scan

col = F.col


def _one(spark, d):
    return preds(spark, d).where("horizon = 1")


def sector_lookup(spark, d):
    """Volume by group, tickers of unknown names under a default."""
    names = scan(spark, d, "nation", ["n_nationkey", "n_name"]).select(col("n_name").alias("ticker"), F.concat(F.lit("group"), (col("n_nationkey") % 5).cast("string")).alias("grp"))
    return studies.lookup(bars(spark, d), names, "ticker", "grp", "etf").groupBy("grp").agg(F.count("*").alias("n"), F.sum("vol").alias("vol"))


def numeric_coercion(spark, d):
    """Phone parts as numbers where they are numbers."""
    c = scan(spark, d, "customer").select("c_custkey", F.when(col("c_custkey") % 3 == 0, F.lit("n/a")).otherwise(col("c_acctbal").cast("string")).alias("x"))
    return studies.coerce(c, ["x"]).agg(F.count("*").alias("n"), F.count("x").alias("numbers"), F.round(F.sum("x"), 2).alias("total"))


def event_exclusion(spark, d):
    p = studies.without_event_crossing(preds(spark, d), "days_to_next_earnings", col("horizon"))
    return p.groupBy("feature_set", "horizon").agg(F.count("*").alias("n"))


def signal_decay(spark, d):
    return rounded(studies.signal_decay(preds(spark, d), "pred", "y_demeaned", "feature_set", "horizon"))


def leg_membership(spark, d):
    first = scan(spark, d, "region", ["r_name"]).agg(F.min("r_name")).first()[0]
    return rounded(studies.leg_membership(_one(spark, d), ["feature_set"], col("sector") == first, 3))


def gross_sharpe(spark, d):
    return rounded(studies.gross_sharpe(_one(spark, d), ["feature_set"], 3, 52.0))


def median_split_ic(spark, d):
    return rounded(studies.median_split(_one(spark, d), "spread", "pred", "y_demeaned", ["feature_set"]))


def head_to_head(spark, d):
    return rounded(studies.head_to_head(_one(spark, d), "A", "C", "feature_set", "pred", "y_demeaned"))


def equity_summary(spark, d):
    return rounded(studies.equity_summary(backtest.long_flat(preds(spark, d), ["feature_set", "horizon"]), ["feature_set", "horizon"], 1000.0, 52.0), 4)


def survivor_cells(spark, d):
    """Cells whose mean daily IC has |t| over 3, re-evaluated for one horizon and carried over for the others."""
    ic = materialize(inference.daily_ic(preds(spark, d), "pred", "y_demeaned", ["feature_set", "horizon", "date"]))
    t = materialize(inference.newey_west(ic, "ic", ["feature_set", "horizon"], "date").select("feature_set", "horizon", "n", "t"))
    table = studies.carry_over(t.where("horizon = 1"), t, ["feature_set", "horizon"], "feature_set", "A")
    return rounded(studies.survivors(table, "t", 3.0))


def vol_grid(spark, d):
    """Walk-forward OLS of the next realised volatility on the current absolute return, all windows in one job."""
    w = by()
    b = bars(spark, d).withColumn("next", forward_return(col("ret"), 1, w))
    p = materialize(b.select("ticker", "date", "date_idx", F.round(F.abs("ret"), 9).alias("x"), F.round(forward_realised_vol(col("next"), 3, w), 9).alias("y")).where("x is not null and y is not null").withColumn("model", F.lit("ols")), "vol")
    wins = walkforward.windows(spark, p.agg(F.max("date_idx")).first()[0] + 1, "rolling", 52, 13, embargo=3)
    fits = walkforward.closed_form(p, wins, "x", "y", ["model"])
    return rounded(fits.select("window", "n", "mean", "alpha", "beta", "t"), 4)


def smile_changes(spark, d):
    """Headline smile parameters and their change from the entity's date before."""
    h = materialize(surface.headline(surface.fit_svi(contracts(spark, d))), "headline")
    return rounded(h.select("ticker", "date", *[(col(c) - F.lag(c).over(by())).alias(f"d_{c}") for c in ("svi_a", "svi_b", "svi_rho", "svi_m", "svi_sigma")]))


def attribution_bootstrap(spark, d):
    """Intervals of each feature's mean absolute contribution and of its rank, dates drawn with replacement."""
    p = _one(spark, d).withColumn("x", F.abs("pred"))
    b = inference.bootstrap(p, ["feature_set"], "x", "date").join(inference.bootstrap_ranks(p, "feature_set", "x", "date"), "feature_set")
    return rounded(b.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean")))))


def implied_minus_realised(spark, d):
    """At-the-money volatility less the realised volatility of the last 30 rows, and the ranks of long windows."""
    iv, b = chain.atm_skew_term(contracts(spark, d)).select("ticker", "date", "atm_iv"), bars(spark, d, "month")
    rv = b.select("ticker", "date", realised_vol(col("ret"), by(), 30, 252.0).alias("rv"))
    return rounded(iv.join(rv, ["ticker", "date"]).select("ticker", "date", (col("atm_iv") - col("rv")).alias("premium"), level_rank(col("atm_iv"), by(), 60).alias("iv_rank60")))


def proxy_returns(spark, d):
    """Return of the name that stands for a sector: its first one."""
    b = bars(spark, d)
    return rounded(panel.proxy_return(b, b.groupBy("sector").agg(F.min("ticker").alias("proxy"))).select("ticker", "date", "proxy", "proxy_return"))


def optional_events(spark, d):
    """Event columns that the bars have, and one that they lack."""
    b = panel.with_optional(bars(spark, d), {"days_to_next_earnings": "double", "days_since_last_earnings": "double"})
    return b.groupBy("ticker").agg(F.count("days_to_next_earnings").alias("next"), F.count("days_since_last_earnings").alias("last"), F.sum("days_to_next_earnings").alias("total"))


def regime_ic(spark, d):
    """Pooled IC by volatility, nearness of earnings and sign of the gamma exposure, which a left join brings by month; values of 30 rows and more."""
    gex = chain.gamma_exposure(*chain_and_bars(spark, d)).select("ticker", col("date").alias("month"), "gex")
    p = studies.with_regimes(preds(spark, d).withColumn("month", F.trunc("date", "month")), gex, ["ticker", "month"])
    labels = studies.regime_labels(col("vix_close"), col("days_to_next_earnings"), col("gex"))
    return rounded(metrics.by_regime(p, labels, "pred", "y_demeaned", ["feature_set", "horizon"], 30).select("feature_set", "horizon", "regime", "value", "n", "ic"))


def named_cells_ic(spark, d):
    """Mean rank correlation over blocks of 13 dates of three named cells."""
    p = preds(spark, d).withColumn("window", F.floor(col("date_idx") / 13))
    named = F.concat("feature_set", F.lit("|"), "horizon").isin("A|1", "B|3", "C|1")
    return rounded(studies.window_ic(p, "pred", "y_demeaned", ["feature_set", "horizon"], named))


def top_names(spark, d):
    """The five names whose predictions are largest in size, best first."""
    by_name = _one(spark, d).groupBy("ticker").agg(F.round(F.avg(F.abs("pred")), 9).alias("attribution"), F.count("*").alias("n"))
    return rounded(studies.top(by_name, "attribution", 5, "ticker"))


QUERIES = {f.__name__: f for f in (sector_lookup, numeric_coercion, event_exclusion, signal_decay, leg_membership, gross_sharpe, median_split_ic, head_to_head, equity_summary, survivor_cells, vol_grid, smile_changes, attribution_bootstrap, implied_minus_realised, proxy_returns, optional_events, regime_ic, named_cells_ic, top_names)}

B, P = ctes("bars"), ctes("preds")
RK = "ROW_NUMBER() OVER (PARTITION BY feature_set, date ORDER BY pred DESC, ticker) AS up, ROW_NUMBER() OVER (PARTITION BY feature_set, date ORDER BY pred, ticker) AS dn"

ORACLES = {
    "sector_lookup": f"{B} SELECT 'group' || CAST(n_nationkey % 5 AS VARCHAR) AS grp, COUNT(*) AS n, SUM(vol) AS vol FROM bars JOIN nation ON n_name = ticker GROUP BY 1",
    "numeric_coercion": "SELECT COUNT(*) AS n, COUNT(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) AS numbers, ROUND(CAST(SUM(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE), 2) AS total FROM customer",
    "event_exclusion": f"{P} SELECT feature_set, horizon, COUNT(*) AS n FROM preds WHERE NOT COALESCE(days_to_next_earnings BETWEEN 0 AND horizon, false) GROUP BY 1, 2",
    "signal_decay": f"""{P}, {_ic('i', 'preds', 'pred', 'y_demeaned', 'feature_set, horizon', 11)}, a AS (SELECT feature_set, horizon, 1 - SUM((y_demeaned - pred) * (y_demeaned - pred)) / SUM(y_demeaned * y_demeaned) AS r2, SQRT(AVG((y_demeaned - pred) * (y_demeaned - pred))) AS rmse, AVG(ABS(y_demeaned - pred)) AS mae, COUNT(*) AS n FROM preds GROUP BY 1, 2),
rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_set, horizon, date ORDER BY pred DESC, ticker) AS up, ROW_NUMBER() OVER (PARTITION BY feature_set, horizon, date ORDER BY pred, ticker) AS dn, COUNT(*) OVER (PARTITION BY feature_set, horizon, date) AS m FROM preds),
q AS (SELECT feature_set, horizon, date, AVG(CASE WHEN up <= 3 THEN y_raw END) - AVG(CASE WHEN dn <= 3 THEN y_raw END) AS r FROM rr WHERE m >= 6 GROUP BY 1, 2, 3), sh AS (SELECT feature_set, horizon, AVG(r) / STDDEV_POP(r) * SQRT(52.0E0) AS sharpe FROM q GROUP BY 1, 2),
f AS (SELECT a.*, ic, sharpe, ic - FIRST_VALUE(ic) OVER (PARTITION BY a.feature_set ORDER BY a.horizon) AS decay FROM a JOIN i ON a.feature_set = i.feature_set AND a.horizon = i.horizon LEFT JOIN sh ON a.feature_set = sh.feature_set AND a.horizon = sh.horizon) SELECT feature_set, horizon, n, {R('ic r2 rmse mae sharpe decay')} FROM f""",
    "leg_membership": f"""{P}, r AS (SELECT *, {RK} FROM preds WHERE horizon = 1), m AS (SELECT feature_set, date, MAX(CASE WHEN up <= 3 AND sector = (SELECT MIN(r_name) FROM region) THEN 1.0 ELSE 0 END) AS u, MAX(CASE WHEN dn <= 3 AND sector = (SELECT MIN(r_name) FROM region) THEN 1.0 ELSE 0 END) AS d FROM r GROUP BY 1, 2),
f AS (SELECT feature_set, AVG(u) AS in_long, AVG(d) AS in_short, COUNT(*) AS dates FROM m GROUP BY 1) SELECT feature_set, dates, {R('in_long in_short')} FROM f""",
    "gross_sharpe": f"""{P}, r AS (SELECT *, {RK}, COUNT(*) OVER (PARTITION BY feature_set, date) AS m FROM preds WHERE horizon = 1), q AS (SELECT feature_set, date, AVG(CASE WHEN up <= 3 THEN y_raw END) - AVG(CASE WHEN dn <= 3 THEN y_raw END) AS r FROM r WHERE m >= 6 GROUP BY 1, 2),
f AS (SELECT feature_set, AVG(r) / STDDEV_POP(r) * SQRT(52.0E0) AS sharpe, COUNT(*) AS dates FROM q GROUP BY 1) SELECT feature_set, dates, {R('sharpe')} FROM f""",
    "median_split_ic": f"""{P}, o AS (SELECT * FROM preds WHERE horizon = 1), s AS (SELECT *, CASE WHEN spread > (SELECT QUANTILE_CONT(spread, 0.5) FROM o) THEN 'high' ELSE 'low' END AS side FROM o), {_ic('i', 's', 'pred', 'y_demeaned', 'feature_set, side, date', 5)},
f AS (SELECT feature_set, side, AVG(ic) AS ic, COUNT(*) AS days FROM i GROUP BY 1, 2) SELECT feature_set, side, days, {R('ic')} FROM f""",
    "head_to_head": f"""{P}, o AS (SELECT * FROM preds WHERE horizon = 1), {_ic('i', 'o', 'pred', 'y_demeaned', 'feature_set, date', 5)}, tied AS (SELECT feature_set, date, ROUND(ic, 9) AS ic FROM i), f AS (SELECT COUNT(*) AS dates, AVG(a.ic) AS f1, AVG(b.ic) AS s1, AVG(a.ic - b.ic) AS difference, AVG(CASE WHEN a.ic > b.ic THEN 1.0 ELSE 0 END) AS won FROM tied a JOIN tied b ON a.date = b.date WHERE a.feature_set = 'A' AND b.feature_set = 'C')
SELECT dates, {R('f1').replace('AS f1', 'AS "first"')}, {R('s1').replace('AS s1', 'AS "second"')}, {R('difference won')} FROM f""",
    "equity_summary": f"""{P}, {LF}, c AS (SELECT *, EXP(SUM(LN(1 + r)) OVER (PARTITION BY feature_set, horizon ORDER BY date)) AS w FROM pnl), k AS (SELECT *, GREATEST(1, MAX(w) OVER (PARTITION BY feature_set, horizon ORDER BY date)) AS p FROM c),
f AS (SELECT feature_set, horizon, 1000 * EXP(SUM(LN(1 + r))) AS final, (POWER(EXP(SUM(LN(1 + r))), 52.0E0 / COUNT(*)) - 1) / (STDDEV_POP(r) * SQRT(52.0E0)) AS sharpe, MIN(w / p - 1) AS max_drawdown FROM k GROUP BY 1, 2) SELECT feature_set, horizon, {R('final sharpe max_drawdown', 4)} FROM f""",
    "survivor_cells": f"""{P}, {_DAILY}, {_nw('na', 'ic', 'ic', 'feature_set, horizon', 'date', CUBE, 'pairs', True)}, f AS (SELECT feature_set, horizon, n, mean / se AS t FROM na WHERE (horizon = 1 OR feature_set LIKE 'A%') AND ABS(mean / se) > 3)
SELECT feature_set, horizon, n, {R('t')}, CAST(ROW_NUMBER() OVER (ORDER BY ABS(t) DESC, feature_set, horizon) AS INT) AS rank FROM f""",
    "vol_grid": f"""{B}, n AS (SELECT *, LN(LEAD(prc, 1) OVER (PARTITION BY ticker ORDER BY date) / prc) AS l FROM bars), v AS (SELECT ticker, date, date_idx, ROUND(ABS(ret), 9) AS x, ROUND(CASE WHEN COUNT(l) OVER q = 3 THEN SQRT(SUM(l * l) OVER q) END, 9) AS y FROM n WINDOW q AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
o AS (SELECT * FROM v WHERE x IS NOT NULL AND y IS NOT NULL), m AS (SELECT MAX(date_idx) + 1 AS n FROM o), w AS (SELECT CAST((t - 52) / 13 AS INT) AS win, t - 52 AS lo, t - 3 AS hi FROM m JOIN range(52, 5000, 13) r(t) ON t < n - 13),
f AS (SELECT w.win, COUNT(*) AS n, AVG(y) AS mean, REGR_INTERCEPT(y, x) AS alpha, REGR_SLOPE(y, x) AS beta, REGR_SLOPE(y, x) / SQRT((REGR_SYY(y, x) - REGR_SLOPE(y, x) * REGR_SXY(y, x)) / (COUNT(*) - 2) / REGR_SXX(y, x)) AS t FROM o JOIN w ON date_idx >= lo AND date_idx < hi GROUP BY 1)
SELECT win AS "window", n, {R('mean alpha beta t', 4)} FROM f""",
    "implied_minus_realised": f"""{CQ.ORACLES['chain_atm_skew_term'].rsplit(chr(10) + 'SELECT', 1)[0]}, rv AS (SELECT ticker, date, CASE WHEN ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) >= 30 THEN STDDEV_SAMP(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) * SQRT(252.0E0) END AS rv FROM bars_m),
ranked AS (SELECT q.ticker, q.date, atm_iv, rv, COUNT(atm_iv) OVER l AS n, MIN(atm_iv) OVER l AS lo, MAX(atm_iv) OVER l AS hi FROM q JOIN rv ON q.ticker = rv.ticker AND q.date = rv.date WINDOW l AS (PARTITION BY q.ticker ORDER BY q.date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
ff AS (SELECT ticker, date, atm_iv - rv AS premium, CASE WHEN n = 60 AND hi > lo THEN (atm_iv - lo) / (hi - lo) END AS iv_rank60 FROM ranked) SELECT ticker, date, {R('premium iv_rank60')} FROM ff""",
    "proxy_returns": f"""{B}, p AS (SELECT sector, MIN(ticker) AS proxy FROM bars GROUP BY 1), f AS (SELECT b.ticker, b.date, proxy, o.ret AS proxy_return FROM bars b JOIN p ON b.sector = p.sector LEFT JOIN bars o ON o.ticker = proxy AND o.date = b.date) SELECT ticker, date, proxy, {R('proxy_return')} FROM f""",
    "optional_events": f"{B} SELECT ticker, COUNT(days_to_next_earnings) AS next, CAST(0 AS BIGINT) AS last, SUM(days_to_next_earnings) AS total FROM bars GROUP BY 1",
    "regime_ic": f"""{ctes('preds', 'contracts')}, gx AS (SELECT ticker, date, SUM(open_interest * gamma * 100 * underlying_price * CASE WHEN is_call = 1 THEN 1 ELSE -1 END) AS gex FROM contracts GROUP BY 1, 2),
l AS (SELECT p.*, CASE WHEN vix_close >= 25 THEN 'high_vix' WHEN vix_close <= 15 THEN 'low_vix' ELSE 'normal_vix' END AS v, CASE WHEN days_to_next_earnings <= 7 THEN 'near_earnings' ELSE 'far_earnings' END AS e, CASE WHEN gex > 0 THEN 'positive_gex' ELSE 'negative_gex' END AS x FROM preds p LEFT JOIN gx ON p.ticker = gx.ticker AND CAST(date_trunc('month', p.date) AS DATE) = gx.date),
u AS (SELECT feature_set, horizon, pred, y_demeaned, 'vix' AS regime, v AS value FROM l UNION ALL SELECT feature_set, horizon, pred, y_demeaned, 'earnings', e FROM l UNION ALL SELECT feature_set, horizon, pred, y_demeaned, 'gex', x FROM l), {_ic('i', 'u', 'pred', 'y_demeaned', 'feature_set, horizon, regime, value', 30)}
SELECT feature_set, horizon, regime, value, n, {R('ic')} FROM i""",
    "named_cells_ic": f"""{P}, w AS (SELECT *, CAST(FLOOR(date_idx / 13) AS BIGINT) AS win FROM preds WHERE feature_set || '|' || horizon IN ('A|1', 'B|3', 'C|1')), {_ic('i', 'w', 'pred', 'y_demeaned', 'feature_set, horizon, win', 11)}, f AS (SELECT feature_set, horizon, AVG(ic) AS ic, COUNT(ic) AS windows FROM i GROUP BY 1, 2) SELECT feature_set, horizon, windows, {R('ic')} FROM f""",
    "attribution_bootstrap": f"""{P}, o AS (SELECT *, ABS(pred) AS x FROM preds WHERE horizon = 1), {_draws('b', 'o', 'feature_set', 'x', 'date', 1000)}, i AS (SELECT feature_set, {_INTERVAL} FROM b GROUP BY 1), k AS (SELECT feature_set, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY m DESC, feature_set) AS r FROM b),
g AS (SELECT feature_set, CAST(FLOOR(QUANTILE_CONT(r, 0.025)) AS INT) AS rank_lo, CAST(FLOOR(QUANTILE_CONT(r, 0.5)) AS INT) AS rank_median, CAST(FLOOR(QUANTILE_CONT(r, 0.975)) AS INT) AS rank_hi FROM k GROUP BY 1),
f AS (SELECT i.*, rank_lo, rank_median, rank_hi, CAST(RANK() OVER (ORDER BY mean DESC) AS INT) AS rank FROM i JOIN g ON i.feature_set = g.feature_set) SELECT feature_set, rank_lo, rank_median, rank_hi, rank, {R('mean lo hi p')} FROM f""",
    "smile_changes": f"""{ctes('contracts')}, {_SVI}, f AS (SELECT ticker, date, {', '.join(f'{c} - LAG({c}) OVER (PARTITION BY ticker ORDER BY date) AS d_svi_{c}' for c in ('a', 'b', 'rho', 'm', 'sigma'))} FROM hd)
SELECT ticker, date, {R('d_svi_a d_svi_b d_svi_rho d_svi_m d_svi_sigma')} FROM f""",
    "top_names": f"""{P}, f AS (SELECT ticker, ROUND(AVG(ABS(pred)), 9) AS attribution, COUNT(*) AS n FROM preds WHERE horizon = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT ticker, n, {R('attribution')} FROM f""",
}
