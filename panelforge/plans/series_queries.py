"""Queries over entity time series, calendars, scalars and panel preparation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from panelforge.functions import scalars as S
from panelforge.functions import windows as W
from panelforge.operators import averages, chain, panel
from panelforge.plans.rounding import rounded, sql_rounded as R
from panelforge.sources import tables
from panelforge.sources.tables import bars, contracts, ctes, materialize, scan

K = ("ticker", "date")
w = lambda: W.by()
col = F.col


def iv_rank_changes(spark, d):
    """Rank of the volatility in its last 12 values, and its changes over 1 and 5."""
    iv = chain.atm_skew_term(contracts(spark, d)).where("atm_iv is not null")
    return rounded(iv.select(*K, W.level_rank(col("atm_iv"), w(), 12).alias("iv_rank"), W.change(col("atm_iv"), 1, w()).alias("iv_change1"), W.change(col("atm_iv"), 5, w()).alias("iv_change5")))


def vol_spike_oi_change(spark, d):
    """Volume against its last 20, percent change of open interest, changes of spread and exposure."""
    c = contracts(spark, d)
    daily = c.groupBy(*K).agg(F.sum("volume").alias("v"), F.sum("open_interest").alias("oi")).join(chain.activity(c).select(*K, "vw_spread"), list(K)).join(chain.gamma_exposure(c, bars(spark, d, "month")), list(K))
    return rounded(daily.select(*K, W.to_recent_mean(col("v"), w()).alias("vol_spike"), W.step_change(col("oi"), w()).alias("oi_change"), W.change(col("vw_spread"), 1, w()).alias("spread_change"), W.change(col("gex_to_cap"), 1, w()).alias("gex_change")), 4)


def price_momentum_vol(spark, d):
    b = bars(spark, d)
    v10, v30 = W.rolling_std(col("ret"), 10, w()), W.rolling_std(col("ret"), 30, w()) * F.sqrt(F.lit(252.0))
    return rounded(b.select(*K, "ret", W.pct_change(col("prc"), 5, w()).alias("mom5"), W.pct_change(col("prc"), 10, w()).alias("mom10"), v30.alias("vol30"), S.ratio(v10 * F.sqrt(F.lit(252.0)), v30).alias("vol_ratio")))


def rsi_macd_atr(spark, d):
    b = bars(spark, d)
    up, down = (F.when(c, F.abs("ret")).when(col("ret").isNotNull(), 0.0) for c in (col("ret") > 0, col("ret") < 0))
    out = averages.emas(b, {"fast": (col("prc"), 12), "slow": (col("prc"), 26), "gain": (up, 14), "loss": (down, 14), "atr": (F.abs("ret"), 14)})
    out = materialize(out.select(*K, ((col("fast") - col("slow")) / col("prc")).alias("macd"), averages.rsi_of(col("gain"), col("loss")).alias("rsi"), "atr"), "averages")
    return rounded(averages.emas(out, {"macd_signal": (col("macd"), 9)}))


def bollinger_sma(spark, d):
    """Band position (0 in the warm-up) and distance to the 50-row average."""
    b = bars(spark, d)
    m, s = W.sma(col("prc"), 20, w()), W.rolling_std(col("prc"), 20, w())
    return rounded(b.select(*K, F.when(s > 0, (col("prc") - m) / (2 * s)).otherwise(0.0).alias("bollinger"), (col("prc") / W.sma(col("prc"), 50, w()) - 1).alias("to_sma50")))


def market_columns(spark, d):
    b = bars(spark, d)
    return rounded(b.select(*K, "vix_close", W.change(col("vix_close"), 5, w()).alias("vix_change5"), ((col("vix3m_close") - col("vix_close")) / col("vix_close")).alias("vix_term"), (col("tbill_rate") / 100).alias("tbill")))


def forward_returns(spark, d):
    b = bars(spark, d)
    f = {h: W.forward_return(col("ret"), h, w()) for h in (1, 3, 5)}
    return rounded(b.select(*K, *[f[h].alias(f"ret_{h}") for h in f], *[F.when(f[h] > 0, 1).when(f[h].isNotNull(), 0).alias(f"dir_{h}") for h in f]))


def forward_rv(spark, d):
    b = bars(spark, d).withColumn("next", W.forward_return(col("ret"), 1, w()))
    return rounded(b.select(*K, W.forward_realised_vol(col("next"), 3, w()).alias("rv_3"), W.forward_realised_vol(col("next"), 5, w()).alias("rv_5")))


def causal_threshold(spark, d):
    """Median of all volumes before each date, and the entities above it."""
    b = materialize(bars(spark, d).select("date", "vol"), "volumes")
    out = b.join(F.broadcast(panel.causal_median(b, "vol")), "date")
    return rounded(out.groupBy("date").agg(F.max("median").alias("median"), F.count(F.when(col("vol") > col("median"), 1)).alias("n_high")))


def xs_demean_rank(spark, d):
    b = bars(spark, d)
    return rounded(b.select(*K, W.demean("prc", "date").alias("by_date"), W.demean("prc", "date", "sector").alias("by_sector"), W.rank_scaled("vol", "date").alias("rank")))


def lookback_sequences(spark, d):
    s = panel.sequences(bars(spark, d), ["prc", "vol"], 10)
    return rounded(s.select(*K, col("sequence")[0]["prc"].alias("oldest"), col("sequence")[9]["vol"].alias("newest"), F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["vol"]).alias("total")))


def equity_drawdown(spark, d):
    """Wealth, peak-to-here loss and turnover of a sign position."""
    b = bars(spark, d).where("ret is not null").withColumn("wealth", W.equity(col("ret"), w()))
    pos = F.when(col("ret") > 0, 1.0).otherwise(0.0)
    b = b.withColumn("pos", pos)
    return rounded(b.select(*K, "wealth", W.drawdown("wealth", w()).alias("drawdown"), F.abs(col("pos") - F.lag("pos", 1, 0.0).over(w())).alias("turnover")))


def calendar_features(spark, d):
    o = scan(spark, d, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("date")).distinct()
    x = col("date")
    return o.select("date", S.third_friday(x).alias("expiry"), S.days_to_monthly_expiry(x).cast("long").alias("to_expiry"), S.quarter_end_flag(x).cast("long").alias("quarter_end"), F.weekday(x).cast("long").alias("weekday"), F.year(x).cast("long").alias("year"), S.quarter_label(x).alias("quarter"))


def scalar_functions(spark, d):
    """Normal distribution, clipping, smile variance, delta strikes and labels over customer balances."""
    c = scan(spark, d, "customer", ["c_custkey", "c_acctbal"]).select("c_custkey", (col("c_acctbal").cast("double") / 5000).alias("x"))
    x = col("x")
    return rounded(
        c.select("c_custkey", S.normal_cdf(x).alias("cdf"), S.normal_quantile(S.clip(S.normal_cdf(x), 0.001, 0.999)).alias("quantile"), S.chi2_1_tail(x * x).alias("chi2_tail"), S.clip(x, -1.0, 1.0).alias("clipped"),
                 S.svi_variance(x, F.lit(0.04), F.lit(0.1), F.lit(-0.3), F.lit(0.0), F.lit(0.2)).alias("svi"), S.strike_ratio_of_delta(0.6745, F.abs(x), F.lit(0.25)).alias("strike"), F.format_string("iv_surf_%03d_%03d", col("c_custkey") % 110, F.lit(30)).alias("label"))
    )


def regime_labels(spark, d):
    """Rows a regime: volatility level, nearness of earnings; missing values go to the neutral label."""
    b = bars(spark, d)
    vix = F.when(col("vix_close") >= 25, "high_vix").when(col("vix_close") <= 15, "low_vix").otherwise("normal_vix")
    near = F.when(col("days_to_next_earnings") <= 7, "near_earnings").otherwise("far_earnings")
    return b.groupBy(vix.alias("vix"), near.alias("earnings")).agg(F.count("*").alias("n"))


def temporal_split(spark, d):
    b = bars(spark, d)
    return panel.split_audit(b, panel.temporal_split(b))


def winsorize_impute_zscore(spark, d):
    """Fit on training dates, apply to all."""
    b = materialize(bars(spark, d).select(*K, "ret", "vol"))
    b = b.join(F.broadcast(panel.temporal_split(b)), "date").select(*K, "split", "ret", "vol")
    train, cols = col("split") == "train", ["ret", "vol"]
    b = materialize(panel.winsorize(b, cols, train, 0.05, 0.95))
    b = materialize(panel.impute(b, cols, train))
    return rounded(panel.zscore(b, cols, train))


def missing_report(spark, d):
    b = bars(spark, d)
    b = b.select("ret", "vol", W.rolling_std(col("ret"), 200, w()).alias("vol200"), W.sma(col("prc"), 50, w()).alias("sma50"))
    return rounded(panel.missing_rates(b, ["ret", "vol", "vol200", "sma50"]))


def panel_assembly(spark, d):
    """Targets, bars, chain features and one-hot sectors on one grid, missing values to 0."""
    b, c = bars(spark, d, "month"), contracts(spark, d)
    targets = b.select(*K, W.forward_return(col("ret"), 1, w()).alias("target")).where("target is not null")
    out = panel.assemble(targets, [b.select(*K, "sector", "ret")], [chain.parity_deviation(c).select(*K, "parity_deviation"), chain.implied_moments(c).select(*K, "variance")], list(K))
    names = sorted(r[0] for r in scan(spark, d, "region", ["r_name"]).collect())
    out = panel.one_hot(out, "sector", names, "sec_").withColumnsRenamed({f"sec_{n}": f"sector{i}" for i, n in enumerate(names)})
    return rounded(panel.sanitized(out, panel.present(out, ["ret", "parity_deviation", "variance", "absent"])).drop("sector"))


def upsert_latest(spark, d):
    """Orders keyed by customer, later batch wins."""
    o = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).withColumn("o_totalprice", col("o_totalprice").cast("double"))
    old = panel.first_of(o, ["o_custkey"], "o_orderkey", F.desc("o_totalprice"))
    new = panel.first_of(o.where("o_orderkey % 3 = 0"), ["o_custkey"], F.desc("o_orderkey"), F.desc("o_totalprice"))
    return tables.upsert(old, new, ["o_custkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def pending_cells(spark, d):
    """Model grid cells without a result, by anti join."""
    n = scan(spark, d, "nation", ["n_name"])
    grid = n.crossJoin(spark.range(1, 4).withColumnRenamed("id", "horizon"))
    done = bars(spark, d).where("vol > 200").select(col("ticker").alias("n_name"), (col("date_idx") % 3 + 1).cast("long").alias("horizon")).distinct()
    return tables.pending(grid, done, ["n_name", "horizon"])


def pivot_complete(spark, d):
    """Dates by sector, mean return, complete rows only."""
    names = sorted(r[0] for r in scan(spark, d, "region", ["r_name"]).collect())
    p = bars(spark, d).groupBy("date").pivot("sector", names).agg(F.avg("ret"))
    return rounded(p.select("date", *[col(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names)]).dropna())


def csv_source_sink(spark, d):
    c = scan(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return tables.csv_round_trip(c)


def partitioned_scan(spark, d):
    """Bars written by sector and read back with partition pruning."""
    path = f"{tables.shared_dir(spark)}/by-sector-{tables.uuid.uuid4().hex}"
    tables.write_partitioned(bars(spark, d).select("ticker", "date", "vol", "sector"), path, "sector")
    first = scan(spark, d, "region", ["r_name"]).agg(F.min("r_name")).first()[0]
    return spark.read.parquet(path).where(col("sector") == first).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("vol").alias("vol"))


def thinned_dates(spark, d):
    return panel.every_kth_date(bars(spark, d), 3).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("vol").alias("vol"))


QUERIES = {
    f.__name__: f
    for f in (
        iv_rank_changes, vol_spike_oi_change, price_momentum_vol, rsi_macd_atr, bollinger_sma, market_columns, forward_returns, forward_rv, causal_threshold, xs_demean_rank, lookback_sequences, equity_drawdown, calendar_features,
        scalar_functions, regime_labels, temporal_split, winsorize_impute_zscore, missing_report, panel_assembly, upsert_latest, pending_cells, pivot_complete, csv_source_sink, partitioned_scan, thinned_dates,
    )
}

B, M, C = ctes("bars"), ctes("bars_m"), ctes("contracts")
O = "OVER (PARTITION BY ticker ORDER BY date)"  # noqa: E741


def _inner(text: str, name: str) -> str:
    """The named query's SQL up to its last select, to build on."""
    return text[: text.rindex("\nSELECT")]


def _ema(x: str, span: int, name: str, source: str = "n") -> str:
    """Recursive moving average over rows numbered from 1 by entity."""
    a = 2 / (span + 1)
    return f"{name} AS (SELECT ticker, rn, {x} AS y FROM {source} WHERE rn = 1 UNION ALL SELECT s.ticker, s.rn, {1 - a!r} * e.y + {a!r} * s.{x} FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.rn = e.rn + 1)"


from panelforge.plans import chain_queries as CQ  # noqa: E402

STD = "STDDEV_SAMP(ret) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
FULL = "CASE WHEN COUNT({x}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) = {n} + 1 THEN {f}({x}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) END"
full = lambda f, x, n: FULL.format(f=f, x=x, n=n - 1)
SPLIT = "sp AS (SELECT date, CASE WHEN i < FLOOR(n * 0.6) - 5 THEN 'train' WHEN i >= FLOOR(n * 0.6) AND i < FLOOR(n * 0.6) + FLOOR(n * 0.2) - 5 THEN 'val' WHEN i >= FLOOR(n * 0.6) + FLOOR(n * 0.2) THEN 'test' END AS split FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars) x) y)"
CDF = "(1 - 0.5 * EXP(-x * x / 2) * (1 / (1 + 0.3275911 * ABS(x) / SQRT(2))) * (0.254829592 + (1 / (1 + 0.3275911 * ABS(x) / SQRT(2))) * (-0.284496736 + (1 / (1 + 0.3275911 * ABS(x) / SQRT(2))) * (1.421413741 + (1 / (1 + 0.3275911 * ABS(x) / SQRT(2))) * (-1.453152027 + (1 / (1 + 0.3275911 * ABS(x) / SQRT(2))) * 1.061405429)))))"

ORACLES = {
    "iv_rank_changes": f"""{_inner(CQ.ORACLES['chain_atm_skew_term'], 'q')}, v AS (SELECT * FROM q WHERE atm_iv IS NOT NULL),
r AS (SELECT ticker, date, atm_iv, MIN(atm_iv) OVER l AS lo, MAX(atm_iv) OVER l AS hi, COUNT(*) OVER l AS n, atm_iv - LAG(atm_iv) OVER o AS iv_change1, atm_iv - LAG(atm_iv, 5) OVER o AS iv_change5 FROM v WINDOW o AS (PARTITION BY ticker ORDER BY date), l AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN n = 12 AND hi > lo THEN (atm_iv - lo) / (hi - lo) END AS iv_rank FROM r)
SELECT ticker, date, {R('iv_rank iv_change1 iv_change5')} FROM f""",
    "vol_spike_oi_change": f"""{C}, a AS (SELECT ticker, date, SUM(volume) AS v, SUM(open_interest) AS oi, {CQ.VW.format('spread_pct')} AS sp, SUM(open_interest * gamma * 100 * underlying_price * CASE WHEN is_call = 1 THEN 1 ELSE -1 END) AS g FROM contracts GROUP BY 1, 2),
j AS (SELECT a.*, 100 * g / mktcap AS gc FROM a JOIN bars_m b ON a.ticker = b.ticker AND a.date = b.date),
f AS (SELECT ticker, date, CASE WHEN COUNT(v) OVER p >= 5 THEN v / AVG(v) OVER p END AS vol_spike, CAST(oi AS DOUBLE) / LAG(oi) OVER o - 1 AS oi_change, sp - LAG(sp) OVER o AS spread_change, gc - LAG(gc) OVER o AS gex_change FROM j WINDOW o AS (PARTITION BY ticker ORDER BY date), p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT ticker, date, {R('vol_spike oi_change spread_change gex_change', 4)} FROM f""",
    "price_momentum_vol": f"""{B}, f AS (SELECT ticker, date, ret, prc / LAG(prc, 5) {O} - 1 AS mom5, prc / LAG(prc, 10) {O} - 1 AS mom10, {full('STDDEV_SAMP', 'ret', 30)} * SQRT(252) AS vol30, {full('STDDEV_SAMP', 'ret', 10)} * SQRT(252) AS v10 FROM bars),
g AS (SELECT *, CASE WHEN vol30 > 0 THEN v10 / vol30 END AS vol_ratio FROM f)
SELECT ticker, date, {R('ret mom5 mom10 vol30 vol_ratio')} FROM g""",
    "rsi_macd_atr": f"""{B.replace('WITH', 'WITH RECURSIVE', 1)}, n AS (SELECT *, ROW_NUMBER() {O} AS rn FROM bars),
m AS (SELECT ticker, ROW_NUMBER() {O} AS rn, GREATEST(ret, 0) AS gain, GREATEST(-ret, 0) AS loss, ABS(ret) AS size FROM bars WHERE ret IS NOT NULL),
{_ema('prc', 12, 'e12')}, {_ema('prc', 26, 'e26')}, {_ema('gain', 14, 'eg', 'm')}, {_ema('loss', 14, 'el', 'm')}, {_ema('size', 14, 'ea', 'm')},
md AS (SELECT n.ticker, n.date, n.rn, (e12.y - e26.y) / prc AS macd FROM n JOIN e12 ON n.ticker = e12.ticker AND n.rn = e12.rn JOIN e26 ON n.ticker = e26.ticker AND n.rn = e26.rn), {_ema('macd', 9, 'es', 'md')},
f AS (SELECT md.ticker, md.date, macd, es.y AS macd_signal, CASE WHEN el.y > 0 THEN 100 - 100 / (1 + eg.y / el.y) END AS rsi, ea.y AS atr FROM md JOIN es ON md.ticker = es.ticker AND md.rn = es.rn
 LEFT JOIN eg ON md.ticker = eg.ticker AND eg.rn = md.rn - 1 LEFT JOIN el ON md.ticker = el.ticker AND el.rn = md.rn - 1 LEFT JOIN ea ON md.ticker = ea.ticker AND ea.rn = md.rn - 1)
SELECT ticker, date, {R('macd rsi atr macd_signal')} FROM f""",
    "bollinger_sma": f"""{B}, f AS (SELECT ticker, date, prc, {full('AVG', 'prc', 20)} AS m, {full('STDDEV_SAMP', 'prc', 20)} AS s, {full('AVG', 'prc', 50)} AS m50 FROM bars),
g AS (SELECT ticker, date, CASE WHEN s > 0 THEN (prc - m) / (2 * s) ELSE 0 END AS bollinger, prc / m50 - 1 AS to_sma50 FROM f)
SELECT ticker, date, {R('bollinger to_sma50')} FROM g""",
    "market_columns": f"""{B}, f AS (SELECT ticker, date, vix_close, vix_close - LAG(vix_close, 5) {O} AS vix_change5, (vix3m_close - vix_close) / vix_close AS vix_term, tbill_rate / 100 AS tbill FROM bars)
SELECT ticker, date, {R('vix_close vix_change5 vix_term tbill')} FROM f""",
    "forward_returns": f"""{B}, f AS (SELECT ticker, date, LEAD(prc, 1) {O} / prc - 1 AS ret_1, LEAD(prc, 3) {O} / prc - 1 AS ret_3, LEAD(prc, 5) {O} / prc - 1 AS ret_5 FROM bars)
SELECT ticker, date, {R('ret_1 ret_3 ret_5')}, {', '.join(f'CAST(ret_{h} > 0 AS INT) AS dir_{h}' for h in (1, 3, 5))} FROM f""",
    "forward_rv": f"""{B}, n AS (SELECT ticker, date, LN(LEAD(prc, 1) {O} / prc) AS l FROM bars),
f AS (SELECT ticker, date, {', '.join(f"CASE WHEN COUNT(l) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) = {h} THEN SQRT(SUM(l * l) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)) END AS rv_{h}" for h in (3, 5))} FROM n)
SELECT ticker, date, {R('rv_3 rv_5')} FROM f""",
    "causal_threshold": f"""{B}, m AS (SELECT a.date, QUANTILE_CONT(b.vol, 0.5) AS median FROM (SELECT DISTINCT date FROM bars) a LEFT JOIN bars b ON b.date < a.date GROUP BY 1),
f AS (SELECT b.date, MAX(median) AS median, COUNT(CASE WHEN vol > median THEN 1 END) AS n_high FROM bars b JOIN m ON b.date = m.date GROUP BY 1)
SELECT date, {R('median')}, n_high FROM f""",
    "xs_demean_rank": f"""{B}, f AS (SELECT ticker, date, prc - AVG(prc) OVER (PARTITION BY date) AS by_date, prc - AVG(prc) OVER (PARTITION BY date, sector) AS by_sector, (RANK() OVER (PARTITION BY date ORDER BY vol) + (COUNT(*) OVER (PARTITION BY date, vol) - 1) / 2.0E0) / COUNT(*) OVER (PARTITION BY date) * 2 - 1 AS rank FROM bars)
SELECT ticker, date, {R('by_date by_sector rank')} FROM f""",
    "lookback_sequences": f"""{B}, f AS (SELECT ticker, date, LAG(prc, 10) {O} AS oldest, LAG(vol) {O} AS newest, SUM(vol) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS total FROM bars)
SELECT ticker, date, {R('oldest newest total')} FROM f WHERE oldest IS NOT NULL""",
    "equity_drawdown": f"""{B}, a AS (SELECT ticker, date, ret, EXP(SUM(LN(1 + ret)) {O}) AS wealth FROM bars WHERE ret IS NOT NULL),
f AS (SELECT ticker, date, wealth, wealth / MAX(wealth) {O} - 1 AS drawdown, ABS(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END - COALESCE(LAG(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) {O}, 0)) AS turnover FROM a)
SELECT ticker, date, {R('wealth drawdown turnover')} FROM f""",
    "calendar_features": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), m AS (SELECT date, CAST(date_trunc('month', date) AS DATE) AS a, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS b FROM d),
e AS (SELECT *, a + CAST((12 - isodow(a)) % 7 + 14 AS INT) AS f1, b + CAST((12 - isodow(b)) % 7 + 14 AS INT) AS f2 FROM m),
k AS (SELECT e.date, COUNT(*) AS left_days FROM e JOIN range(0, 31) r(i) ON e.date + CAST(r.i AS INT) < b - 1 AND isodow(e.date + CAST(r.i AS INT)) <= 5 GROUP BY 1)
SELECT e.date, f1 AS expiry, CAST(CASE WHEN e.date <= f1 THEN f1 - e.date ELSE f2 - e.date END AS BIGINT) AS to_expiry, CAST(CASE WHEN month(e.date) IN (3, 6, 9, 12) AND COALESCE(left_days, 0) <= 5 THEN 1 ELSE 0 END AS BIGINT) AS quarter_end,
 CAST(isodow(e.date) - 1 AS BIGINT) AS weekday, CAST(year(e.date) AS BIGINT) AS year, CAST(year(e.date) AS VARCHAR) || 'Q' || CAST(quarter(e.date) AS VARCHAR) AS quarter FROM e LEFT JOIN k ON e.date = k.date""",
    "scalar_functions": f"""WITH c AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 5000 AS x FROM customer), p AS (SELECT *, CASE WHEN x >= 0 THEN {CDF} ELSE 1 - {CDF} END AS cdf FROM c),
t AS (SELECT *, LEAST(GREATEST(cdf, 0.001), 0.999) AS pc FROM p), u AS (SELECT * FROM t),
f AS (SELECT c_custkey, cdf, {S.normal_quantile_sql('pc')} AS quantile, 2 * (1 - CASE WHEN x >= 0 THEN cdf ELSE 1 - cdf END) AS chi2_tail, LEAST(GREATEST(x, -1.0), 1.0) AS clipped,
 0.04 + 0.1 * (-0.3 * x + SQRT(x * x + 0.04)) AS svi, EXP(0.5 * x * x * 0.25 - 0.6745 * ABS(x) * 0.5) AS strike, 'iv_surf_' || lpad(CAST(c_custkey % 110 AS VARCHAR), 3, '0') || '_030' AS label FROM u)
SELECT c_custkey, {R('cdf quantile chi2_tail clipped svi strike')}, label FROM f""",
    "regime_labels": f"""{B} SELECT CASE WHEN vix_close >= 25 THEN 'high_vix' WHEN vix_close <= 15 THEN 'low_vix' ELSE 'normal_vix' END AS vix, CASE WHEN days_to_next_earnings <= 7 THEN 'near_earnings' ELSE 'far_earnings' END AS earnings, COUNT(*) AS n FROM bars GROUP BY 1, 2""",
    "temporal_split": f"""{B}, {SPLIT} SELECT split, COUNT(*) AS rows, COUNT(DISTINCT b.date) AS dates, MIN(b.date) AS first, MAX(b.date) AS last, COUNT(DISTINCT ticker) AS entities FROM bars b JOIN sp ON b.date = sp.date WHERE split IS NOT NULL GROUP BY 1""",
    "winsorize_impute_zscore": f"""{B}, {SPLIT}, p AS (SELECT ticker, b.date, split, ret, vol FROM bars b JOIN sp ON b.date = sp.date WHERE split IS NOT NULL),
q AS (SELECT QUANTILE_CONT(ret, 0.05) AS a, QUANTILE_CONT(ret, 0.95) AS b, QUANTILE_CONT(vol, 0.05) AS c, QUANTILE_CONT(vol, 0.95) AS d FROM p WHERE split = 'train'),
k AS (SELECT ticker, date, split, CASE WHEN ret IS NULL THEN NULL ELSE LEAST(GREATEST(ret, a), b) END AS ret, LEAST(GREATEST(vol, c), d) AS vol FROM p CROSS JOIN q),
e AS (SELECT ticker, QUANTILE_CONT(ret, 0.5) AS er, QUANTILE_CONT(vol, 0.5) AS ev FROM k WHERE split = 'train' GROUP BY 1), g AS (SELECT QUANTILE_CONT(ret, 0.5) AS gr, QUANTILE_CONT(vol, 0.5) AS gv FROM k WHERE split = 'train'),
i AS (SELECT k.ticker, k.date, k.split, COALESCE(ret, er, gr, 0) AS ret, COALESCE(vol, ev, gv, 0) AS vol FROM k LEFT JOIN e ON k.ticker = e.ticker CROSS JOIN g),
z AS (SELECT AVG(ret) AS mr, STDDEV_SAMP(ret) AS sr, AVG(vol) AS mv, STDDEV_SAMP(vol) AS sv FROM i WHERE split = 'train'),
f AS (SELECT ticker, date, split, CASE WHEN sr > 0 THEN (ret - mr) / sr ELSE 0 END AS ret, CASE WHEN sv > 0 THEN (vol - mv) / sv ELSE 0 END AS vol FROM i CROSS JOIN z)
SELECT ticker, date, split, {R('ret vol')} FROM f""",
    "missing_report": f"""{B}, f AS (SELECT ret, vol, {full('STDDEV_SAMP', 'ret', 200)} AS vol200, {full('AVG', 'prc', 50)} AS sma50 FROM bars),
g AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS rate FROM f" for c in ('ret', 'vol', 'vol200', 'sma50'))})
SELECT feature, {R('rate')}, rate > 0.5 AS warn FROM g""",
    "panel_assembly": f"""{_inner(CQ.ORACLES['bkm_moments'], 'q').replace('q AS (SELECT ticker, date, n,', 'bk AS (SELECT ticker, date, n,')}, {_inner(CQ.ORACLES['parity_deviation'], 'q').split(', n AS (', 1)[1].join(['nn AS (', '']).replace('FROM n c JOIN n p', 'FROM nn c JOIN nn p').replace('p AS (SELECT c.ticker', 'pp AS (SELECT c.ticker').replace('FROM p GROUP', 'FROM pp GROUP').replace('q AS (', 'pq AS (')},
t AS (SELECT ticker, date, sector, ret, LEAD(ret) {O} AS target FROM bars_m),
f AS (SELECT t.ticker, t.date, target, COALESCE(ret, 0) AS ret, COALESCE(parity_deviation, 0) AS parity_deviation, COALESCE(variance, 0) AS variance, sector FROM t LEFT JOIN pq ON t.ticker = pq.ticker AND t.date = pq.date LEFT JOIN bk ON t.ticker = bk.ticker AND t.date = bk.date WHERE target IS NOT NULL)
SELECT ticker, date, {R('target ret parity_deviation variance')}, {', '.join(f'CAST(sector = (SELECT r_name FROM region ORDER BY r_name LIMIT 1 OFFSET {i}) AS INT) AS sector{i}' for i in range(4))} FROM f""",
    "upsert_latest": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders), a AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, p DESC) AS r FROM o), b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC, p DESC) AS r FROM o WHERE o_orderkey % 3 = 0)
SELECT a.o_custkey, COALESCE(b.o_orderkey, a.o_orderkey) AS o_orderkey, COALESCE(b.p, a.p) AS o_totalprice FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND b.r = 1 WHERE a.r = 1""",
    "pending_cells": f"""{B} SELECT n_name, h AS horizon FROM nation CROSS JOIN (SELECT 1 AS h UNION ALL SELECT 2 UNION ALL SELECT 3) g WHERE NOT EXISTS (SELECT 1 FROM bars WHERE vol > 200 AND ticker = n_name AND date_idx % 3 + 1 = h)""",
    "csv_source_sink": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "partitioned_scan": f"""{B} SELECT ticker, COUNT(*) AS n, SUM(vol) AS vol FROM bars WHERE sector = (SELECT MIN(r_name) FROM region) GROUP BY 1""",
    "thinned_dates": f"""{B} SELECT ticker, COUNT(*) AS n, SUM(vol) AS vol FROM bars WHERE date_idx % 3 = 0 GROUP BY 1""",
    "pivot_complete": f"""{B}, f AS (SELECT date, {', '.join(f"AVG(CASE WHEN sector = (SELECT r_name FROM region ORDER BY r_name LIMIT 1 OFFSET {i}) THEN ret END) AS s{i}" for i in range(5))} FROM bars GROUP BY 1)
SELECT date, {R('s0 s1 s2 s3 s4')} FROM f WHERE s0 + s1 + s2 + s3 + s4 IS NOT NULL""",
}
