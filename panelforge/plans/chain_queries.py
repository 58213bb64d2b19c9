"""Queries over option chains (put/call, skew, exposure, moments) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import chain, inference
from panelforge.functions.windows import average_rank, by, demean, forward_return
from panelforge.plans.rounding import rounded, sql_rounded as R
from panelforge.sources.tables import bars, chain_and_bars, contracts, ctes, listed, materialize


def pc_ratio_ic(spark, d):
    """Put/call ratio against the next month's return: daily rank IC and its HAC t-statistic."""
    b = bars(spark, d, "month").withColumn("fwd", forward_return(F.col("ret"), 1, by()))
    pc = chain.sentiment(contracts(spark, d, b.drop("fwd")), b).select("ticker", "date", "pc_volume")
    panel = pc.join(b, ["ticker", "date"]).where("pc_volume is not null and fwd is not null")
    panel = panel.withColumn("y", F.round(demean("fwd", "date"), 9))
    daily = inference.daily_ic(panel, "pc_volume", "y", ["date"])
    return rounded(inference.newey_west(daily, "ic", [], "date").select("n", "mean", "se", "t"))


def chain_sentiment(spark, d):
    return rounded(chain.sentiment(*chain_and_bars(spark, d)))


def chain_atm_skew_term(spark, d):
    return rounded(chain.atm_skew_term(contracts(spark, d)))


def chain_activity(spark, d):
    return rounded(chain.activity(contracts(spark, d)))


def gex(spark, d):
    return rounded(chain.gamma_exposure(*chain_and_bars(spark, d)), 2)


def parity_deviation(spark, d):
    return rounded(chain.parity_deviation(contracts(spark, d)))


def opening_trades(spark, d):
    return rounded(chain.opening_trades(contracts(spark, d), bars(spark, d, "month").select("date", "date_idx").distinct()))


def opening_trades_by_expiry(spark, d):
    """Opening trades of contracts that are followed by strike and expiry from one observation of their entity to the next."""
    return rounded(chain.opening_trades(materialize(listed(spark, d), "listed"), contract=("strike_no", "expiration", "is_call")))


def implied_event_move(spark, d):
    return rounded(chain.event_move(*chain_and_bars(spark, d)))


def bkm_moments(spark, d):
    return rounded(chain.implied_moments(contracts(spark, d)), 4)


def contract_filter(spark, d):
    """Eligible contracts a date, with the derived columns of the model inputs."""
    c = chain.eligible(contracts(spark, d), least=10)
    c = c.select("ticker", "date", (F.col("dte") / 365).alias("tau"), F.log1p(F.greatest("volume", F.lit(0))).alias("log_volume"), F.log1p(F.greatest("open_interest", F.lit(0))).alias("log_oi"))
    return rounded(c.groupBy("ticker", "date").agg(F.count("*").alias("n"), F.sum("tau").alias("tau"), F.sum("log_volume").alias("log_volume"), F.sum("log_oi").alias("log_oi")))


QUERIES = {f.__name__: f for f in (pc_ratio_ic, chain_sentiment, chain_atm_skew_term, chain_activity, gex, parity_deviation, opening_trades, opening_trades_by_expiry, implied_event_move, bkm_moments, contract_filter)}

C = ctes("contracts")
VW = "SUM(CASE WHEN volume > 0 THEN volume * {0} END) / SUM(CASE WHEN volume > 0 THEN volume END)"
NEAR = "MAX(CASE WHEN {rn} = 1 THEN {v} END)"

ORACLES = {
    "pc_ratio_ic": f"""{C}, f AS (SELECT *, LEAD(ret) OVER (PARTITION BY ticker ORDER BY date) AS fwd FROM bars_m),
pc AS (SELECT ticker, date, CAST(SUM(CASE WHEN is_call = 0 THEN volume ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN is_call = 1 THEN volume ELSE 0 END) AS pc FROM contracts GROUP BY 1, 2
 HAVING SUM(CASE WHEN is_call = 1 THEN volume ELSE 0 END) > 0),
p AS (SELECT pc.date, pc, ROUND(fwd - AVG(fwd) OVER (PARTITION BY pc.date), 9) AS y FROM pc JOIN f ON pc.ticker = f.ticker AND pc.date = f.date WHERE fwd IS NOT NULL),
r AS (SELECT date, RANK() OVER (PARTITION BY date ORDER BY pc) + (COUNT(*) OVER (PARTITION BY date, pc) - 1) / 2.0E0 AS a, RANK() OVER (PARTITION BY date ORDER BY y) + (COUNT(*) OVER (PARTITION BY date, y) - 1) / 2.0E0 AS b FROM p),
i AS (SELECT date, CORR(a, b) AS ic FROM r GROUP BY date HAVING COUNT(*) >= 5),
j AS (SELECT ic - AVG(ic) OVER () AS e, ROW_NUMBER() OVER (ORDER BY date) AS rn, COUNT(*) OVER () AS n, AVG(ic) OVER () AS m FROM i WHERE ic IS NOT NULL AND NOT isnan(ic)),
k AS (SELECT GREATEST(1, CAST(FLOOR(POWER(MAX(n), 1.0/3)) AS INT)) AS lags, MAX(n) AS n, MAX(m) AS m, AVG(e * e) AS g0 FROM j),
g AS (SELECT l.i AS lag, AVG(x.e * y.e) AS g FROM (SELECT UNNEST(range(1, 20)) AS i) l JOIN j x ON true JOIN j y ON y.rn = x.rn - l.i GROUP BY 1),
s AS (SELECT n, m, SQRT(GREATEST(0, g0 + (SELECT SUM(2 * (1 - lag / (k.lags + 1.0E0)) * g) FROM g WHERE lag <= k.lags)) / n) AS se FROM k)
SELECT n, {R('mean se t')} FROM (SELECT n, m AS mean, se, m / se AS t FROM s) z""",
    "chain_sentiment": f"""{C}, a AS (SELECT ticker, date, SUM(CASE WHEN is_call = 0 THEN volume ELSE 0 END) AS pv, SUM(CASE WHEN is_call = 1 THEN volume ELSE 0 END) AS cv,
 SUM(CASE WHEN is_call = 0 THEN open_interest ELSE 0 END) AS po, SUM(CASE WHEN is_call = 1 THEN open_interest ELSE 0 END) AS co, SUM(volume) AS v, SUM(volume * delta * 100) AS dv, {VW.format('impl_volatility')} AS vw_iv FROM contracts GROUP BY 1, 2),
q AS (SELECT a.ticker, a.date, CASE WHEN cv > 0 THEN CAST(pv AS DOUBLE) / cv END AS pc_volume, CASE WHEN co > 0 THEN CAST(po AS DOUBLE) / co END AS pc_open_interest, CASE WHEN vol > 0 THEN 100 * v / vol END AS option_stock_volume, CASE WHEN vol > 0 THEN dv / vol END AS net_delta, vw_iv
 FROM a LEFT JOIN bars_m b ON a.ticker = b.ticker AND a.date = b.date)
SELECT ticker, date, {R('pc_volume pc_open_interest option_stock_volume net_delta vw_iv')} FROM q""",
    "chain_atm_skew_term": f"""{C}, x AS (SELECT *, moneyness BETWEEN 0.97 AND 1.03 AS band, moneyness BETWEEN 0.95 AND 1.05 AS wide FROM contracts),
y AS (SELECT *, MIN(CASE WHEN band THEN ABS(dte - 30) END) OVER (PARTITION BY ticker, date) AS least,
 ROW_NUMBER() OVER (PARTITION BY ticker, date, is_call ORDER BY ABS(delta + CASE WHEN is_call = 1 THEN -0.25 ELSE 0.25 END), dte, strike) AS rd,
 ROW_NUMBER() OVER (PARTITION BY ticker, date, band ORDER BY ABS(dte - 30), dte, strike, is_call) AS r30,
 ROW_NUMBER() OVER (PARTITION BY ticker, date, band ORDER BY ABS(dte - 90), dte, strike, is_call) AS r90 FROM x),
z AS (SELECT ticker, date, COALESCE(AVG(CASE WHEN band AND ABS(dte - 30) = least THEN impl_volatility END), SUM(CASE WHEN wide AND volume > 0 THEN volume * impl_volatility END) / SUM(CASE WHEN wide AND volume > 0 THEN volume END), AVG(CASE WHEN wide THEN impl_volatility END)) AS atm_iv,
 MAX(CASE WHEN is_call = 0 AND rd = 1 THEN impl_volatility END) - MAX(CASE WHEN is_call = 1 AND rd = 1 THEN impl_volatility END) AS skew25,
 MAX(CASE WHEN band AND r30 = 1 THEN impl_volatility END) AS i30, MAX(CASE WHEN band AND r90 = 1 THEN impl_volatility END) AS i90, MAX(CASE WHEN band AND r30 = 1 THEN dte END) AS d30, MAX(CASE WHEN band AND r90 = 1 THEN dte END) AS d90,
 SUM(CASE WHEN band THEN 1 ELSE 0 END) AS n FROM y GROUP BY 1, 2),
q AS (SELECT ticker, date, atm_iv, skew25, CASE WHEN n >= 2 AND ABS(d30 - d90) >= 10 THEN i30 - i90 END AS term_slope FROM z)
SELECT ticker, date, {R('atm_iv skew25 term_slope')} FROM q""",
    "chain_activity": f"""{C}, s AS (SELECT *, is_call = 1 AND moneyness > 1.05 AS oc, is_call = 0 AND moneyness < 0.95 AS op, moneyness BETWEEN 0.95 AND 1.05 AS atm FROM contracts),
a AS (SELECT ticker, date, SUM(CASE WHEN oc OR op THEN volume ELSE 0 END) AS o, SUM(CASE WHEN oc THEN volume ELSE 0 END) AS oc, SUM(CASE WHEN op THEN volume ELSE 0 END) AS op,
 SUM(CASE WHEN is_call = 1 AND atm THEN volume ELSE 0 END) AS ac, SUM(CASE WHEN is_call = 0 AND atm THEN volume ELSE 0 END) AS ap, SUM(volume) AS v, SUM(CASE WHEN dte = 0 THEN volume ELSE 0 END) AS z,
 {VW.format('spread_pct')} AS vw_spread, {VW.format('moneyness')} AS vw_moneyness FROM s GROUP BY 1, 2),
q AS (SELECT ticker, date, CASE WHEN v > 0 THEN CAST(o AS DOUBLE) / v END AS otm_share, CASE WHEN ac > 0 THEN CAST(oc AS DOUBLE) / ac END AS otm_call_ratio, CASE WHEN ap > 0 THEN CAST(op AS DOUBLE) / ap END AS otm_put_ratio, vw_spread, vw_moneyness, CASE WHEN v > 0 THEN CAST(z AS DOUBLE) / v END AS zero_dte_share FROM a)
SELECT ticker, date, {R('otm_share otm_call_ratio otm_put_ratio vw_spread vw_moneyness zero_dte_share')} FROM q""",
    "gex": f"""{C}, a AS (SELECT ticker, date, SUM(open_interest * gamma * 100 * underlying_price * CASE WHEN is_call = 1 THEN 1 ELSE -1 END) AS gex FROM contracts GROUP BY 1, 2),
q AS (SELECT a.ticker, a.date, gex, CASE WHEN mktcap > 0 THEN 100 * gex / mktcap END AS gex_to_cap FROM a LEFT JOIN bars_m b ON a.ticker = b.ticker AND a.date = b.date)
SELECT ticker, date, {R('gex gex_to_cap', 2)} FROM q""",
    "parity_deviation": f"""{C}, n AS (SELECT * FROM contracts WHERE moneyness BETWEEN 0.95 AND 1.05),
p AS (SELECT c.ticker, c.date, c.impl_volatility - p.impl_volatility AS gap, c.volume + p.volume AS w FROM n c JOIN n p ON c.ticker = p.ticker AND c.date = p.date AND c.strike = p.strike AND c.dte = p.dte WHERE c.is_call = 1 AND p.is_call = 0),
q AS (SELECT ticker, date, COALESCE(CASE WHEN SUM(w) > 0 THEN SUM(gap * w) / SUM(w) END, AVG(gap)) AS parity_deviation, COUNT(*) AS pairs FROM p GROUP BY 1, 2)
SELECT ticker, date, pairs, {R('parity_deviation')} FROM q""",
    "opening_trades": f"""{C}, n AS (SELECT c.*, date_idx FROM contracts c JOIN (SELECT DISTINCT date, date_idx FROM bars_m) d ON c.date = d.date),
j AS (SELECT a.*, a.open_interest > COALESCE(b.open_interest, 0) AS rose FROM n a LEFT JOIN n b ON a.ticker = b.ticker AND a.moneyness = b.moneyness AND a.dte = b.dte AND a.is_call = b.is_call AND b.date_idx = a.date_idx - 1),
a AS (SELECT ticker, date, SUM(CASE WHEN is_call = 0 AND rose THEN volume ELSE 0 END) AS p, SUM(CASE WHEN is_call = 1 AND rose THEN volume ELSE 0 END) AS c FROM j GROUP BY 1, 2),
q AS (SELECT ticker, date, CASE WHEN c > 0 THEN CAST(p AS DOUBLE) / c END AS opening_pc FROM a)
SELECT ticker, date, {R('opening_pc')} FROM q""",
    "opening_trades_by_expiry": f"""{ctes('listed')}, n AS (SELECT *, DENSE_RANK() OVER (PARTITION BY ticker ORDER BY date) AS seen FROM listed),
j AS (SELECT a.*, a.open_interest > COALESCE(b.open_interest, 0) AS rose FROM n a LEFT JOIN n b ON a.ticker = b.ticker AND a.strike_no = b.strike_no AND a.expiration = b.expiration AND a.is_call = b.is_call AND b.seen = a.seen - 1),
a AS (SELECT ticker, date, SUM(CASE WHEN is_call = 0 AND rose THEN volume ELSE 0 END) AS p, SUM(CASE WHEN is_call = 1 AND rose THEN volume ELSE 0 END) AS c FROM j GROUP BY 1, 2),
q AS (SELECT ticker, date, CASE WHEN c > 0 THEN CAST(p AS DOUBLE) / c END AS opening_pc FROM a) SELECT ticker, date, {R('opening_pc')} FROM q""",
    "implied_event_move": f"""{C}, n AS (SELECT c.*, days_to_next_earnings AS e FROM contracts c JOIN bars_m b ON c.ticker = b.ticker AND c.date = b.date WHERE days_to_next_earnings BETWEEN 0 AND 30 AND moneyness BETWEEN 0.95 AND 1.05),
r AS (SELECT *, RANK() OVER (PARTITION BY ticker, date ORDER BY ABS(dte - GREATEST(e, 1)), dte) AS rk FROM n),
a AS (SELECT ticker, date, AVG(CASE WHEN is_call = 1 THEN mid_price END) AS c, AVG(CASE WHEN is_call = 0 THEN mid_price END) AS p, MAX(underlying_price) AS s FROM r WHERE rk = 1 GROUP BY 1, 2),
q AS (SELECT ticker, date, CASE WHEN s > 0 THEN COALESCE(c + p, 2 * c, 2 * p) / s END AS event_move FROM a)
SELECT ticker, date, {R('event_move')} FROM q""",
    "bkm_moments": f"""{C}, d AS (SELECT *, FIRST_VALUE(dte) OVER (PARTITION BY ticker, date ORDER BY ABS(dte - 30), dte) AS d FROM contracts),
o AS (SELECT *, LN(strike / underlying_price) AS x, underlying_price * EXP(0.02 * d / 365) AS f FROM d WHERE ABS(dte - d) <= 5),
k AS (SELECT *, LEAD(strike) OVER w AS up, LAG(strike) OVER w AS dn FROM o WHERE ((is_call = 1 AND strike > f) OR (is_call = 0 AND strike <= f)) AND mid_price > 0 WINDOW w AS (PARTITION BY ticker, date ORDER BY strike, dte, is_call)),
z AS (SELECT *, mid_price * CASE WHEN up IS NULL THEN strike - dn WHEN dn IS NULL THEN up - strike ELSE (up - dn) / 2 END / (strike * strike) AS q FROM k),
s AS (SELECT ticker, date, COUNT(*) AS n, EXP(0.02 * MAX(d) / 365) AS r, SUM(2 * (1 - x) * q) / EXP(0.02 * MAX(d) / 365) AS v, SUM((6 * x - 3 * x * x) * q) / EXP(0.02 * MAX(d) / 365) AS w, SUM((12 * x * x - 4 * x * x * x) * q) / EXP(0.02 * MAX(d) / 365) AS u FROM z GROUP BY 1, 2 HAVING COUNT(*) >= 5),
m AS (SELECT *, r - 1 - r / 2 * v - r / 6 * w - r / 24 * u AS mu FROM s),
q AS (SELECT ticker, date, n, r * v - mu * mu AS variance, CASE WHEN r * v - mu * mu > 0 THEN (r * w - 3 * mu * r * v + 2 * mu * mu * mu) / POWER(r * v - mu * mu, 1.5) END AS skewness,
 CASE WHEN r * v - mu * mu > 0 THEN (r * u - 4 * mu * r * w + 6 * r * mu * mu * v - 3 * mu * mu * mu * mu) / ((r * v - mu * mu) * (r * v - mu * mu)) END AS kurtosis FROM m)
SELECT ticker, date, n, {R('variance skewness kurtosis', 4)} FROM q""",
    "contract_filter": f"""{C}, k AS (SELECT *, COUNT(*) OVER (PARTITION BY ticker, date) AS c FROM contracts WHERE open_interest >= 10 AND moneyness BETWEEN 0.8 AND 1.2 AND dte BETWEEN 7 AND 180),
q AS (SELECT ticker, date, COUNT(*) AS n, SUM(dte / 365.0E0) AS tau, SUM(LN(1 + GREATEST(volume, 0))) AS log_volume, SUM(LN(1 + GREATEST(open_interest, 0))) AS log_oi FROM k WHERE c >= 10 GROUP BY 1, 2)
SELECT ticker, date, n, {R('tau log_volume log_oi')} FROM q""",
}
