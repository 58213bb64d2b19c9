"""Option-chain aggregations: one row for each (entity, date).

Every operator is one grouping by the keys with conditional aggregates; extrema
use ``min_by`` over a struct with explicit tie-breaks, so no operator sorts or
ranks a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalars import ratio

KEYS = ("ticker", "date")


def call() -> Column:
    return F.col("is_call") == 1


def put() -> Column:
    return F.col("is_call") == 0


def total(x, where: Column | None = None) -> Column:
    """Sum of x where the condition holds, 0 if nothing does."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0))


def nearest(value: str, distance: Column, where: Column, *ties: str) -> Column:
    """``value`` of the row with the least distance, ties broken by the given columns."""
    return F.min_by(value, F.when(where, F.struct(distance.alias("d"), *ties)))


def weighted(x: str, where: Column) -> Column:
    """Volume-weighted mean over rows with volume."""
    use = where & (F.col("volume") > 0) & F.col(x).isNotNull()
    return ratio(F.sum(F.when(use, F.col("volume") * F.col(x))), F.sum(F.when(use, F.col("volume"))))


def sentiment(chain: DataFrame, bars: DataFrame, keys=KEYS) -> DataFrame:
    """Put/call ratios of volume and open interest, option to stock volume, net delta, volume-weighted volatility."""
    out = chain.groupBy(*keys).agg(
        ratio(total("volume", put()), total("volume", call())).alias("pc_volume"),
        ratio(total("open_interest", put()), total("open_interest", call())).alias("pc_open_interest"),
        total("volume").alias("all_volume"),
        total(F.col("volume") * F.col("delta") * 100).alias("delta_volume"),
        weighted("impl_volatility", F.lit(True)).alias("vw_iv"),
    )
    out = out.join(bars.select(*keys, F.col("vol").alias("stock_volume")), list(keys), "left")
    return out.select(*keys, "pc_volume", "pc_open_interest", ratio(100 * F.col("all_volume"), F.col("stock_volume")).alias("option_stock_volume"), ratio(F.col("delta_volume"), F.col("stock_volume")).alias("net_delta"), "vw_iv")


def atm_skew_term(chain: DataFrame, keys=KEYS) -> DataFrame:
    """At-the-money volatility near 30 days, 25-delta skew, term slope from 30 to 90 days."""
    m, dte = F.col("moneyness"), F.col("dte")
    band, wide = m.between(0.97, 1.03), m.between(0.95, 1.05)
    least = F.min(F.when(band, F.abs(dte - 30))).over(Window.partitionBy(*keys))
    ties = ("strike", "is_call")
    out = chain.withColumn("_least", least).groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(band & (F.abs(dte - 30) == F.col("_least")), F.col("impl_volatility"))), weighted("impl_volatility", wide), F.avg(F.when(wide, F.col("impl_volatility")))).alias("atm_iv"),
        nearest("impl_volatility", F.abs(F.col("delta") + 0.25), put(), "dte", *ties).alias("put25"),
        nearest("impl_volatility", F.abs(F.col("delta") - 0.25), call(), "dte", *ties).alias("call25"),
        nearest("impl_volatility", F.abs(dte - 30), band, "dte", *ties).alias("iv30"),
        nearest("impl_volatility", F.abs(dte - 90), band, "dte", *ties).alias("iv90"),
        nearest("dte", F.abs(dte - 30), band, "dte", *ties).alias("dte30"),
        nearest("dte", F.abs(dte - 90), band, "dte", *ties).alias("dte90"),
        F.count(F.when(band, 1)).alias("n"),
    )
    term = F.when((F.col("n") >= 2) & (F.abs(F.col("dte30") - F.col("dte90")) >= 10), F.col("iv30") - F.col("iv90"))
    return out.select(*keys, "atm_iv", (F.col("put25") - F.col("call25")).alias("skew25"), term.alias("term_slope"))


def activity(chain: DataFrame, keys=KEYS) -> DataFrame:
    """Out-of-the-money shares, volume-weighted spread and moneyness, zero-day share."""
    m = F.col("moneyness")
    otm_call, otm_put, atm = call() & (m > 1.05), put() & (m < 0.95), m.between(0.95, 1.05)
    return chain.groupBy(*keys).agg(
        ratio(total("volume", otm_call | otm_put), total("volume")).alias("otm_share"),
        ratio(total("volume", otm_call), total("volume", call() & atm)).alias("otm_call_ratio"),
        ratio(total("volume", otm_put), total("volume", put() & atm)).alias("otm_put_ratio"),
        weighted("spread_pct", F.lit(True)).alias("vw_spread"),
        weighted("moneyness", F.lit(True)).alias("vw_moneyness"),
        ratio(total("volume", F.col("dte") == 0), total("volume")).alias("zero_dte_share"),
    )


def gamma_exposure(chain: DataFrame, bars: DataFrame, keys=KEYS) -> DataFrame:
    """Signed gamma exposure, and in percent of market value."""
    signed = F.col("open_interest") * F.col("gamma") * 100 * F.col("underlying_price") * F.when(call(), 1).otherwise(-1)
    out = chain.groupBy(*keys).agg(F.sum(signed).alias("gex")).join(bars.select(*keys, "mktcap"), list(keys), "left")
    return out.select(*keys, "gex", ratio(100 * F.col("gex"), F.col("mktcap")).alias("gex_to_cap"))


def parity_deviation(chain: DataFrame, keys=KEYS) -> DataFrame:
    """Volume-weighted call minus put volatility over matched strikes near the money.

    Calls and puts meet in one grouping by (keys, strike, days), not a
    self-join; of repeated contracts every call meets every put.
    """
    near = chain.where(F.col("moneyness").between(0.95, 1.05) & F.col("impl_volatility").isNotNull())
    v, q = F.col("impl_volatility"), F.coalesce(F.col("volume"), F.lit(0))
    sums = {"n": F.lit(1), "v": v, "q": q, "vq": v * q}
    one = near.groupBy(*keys, "strike", "dte").agg(*[F.coalesce(F.sum(F.when(side, x)), F.lit(0)).alias(f"{s}{n}") for s, side in (("c", call()), ("p", put())) for n, x in sums.items()]).where("cn > 0 and pn > 0")
    c = F.col
    # sums over all (call, put) pairs of a strike of gap * weight, weight, gap and 1; with one of each they are the pair's own
    lone = (c("cn") == 1) & (c("pn") == 1)
    gaps = F.when(lone, (c("cv") - c("pv")) * (c("cq") + c("pq"))).otherwise(c("pn") * c("cvq") + c("cv") * c("pq") - c("pv") * c("cq") - c("cn") * c("pvq"))
    pairs = one.select(*keys, gaps.alias("g"), (c("pn") * c("cq") + c("cn") * c("pq")).alias("w"), (c("pn") * c("cv") - c("cn") * c("pv")).alias("d"), (c("cn") * c("pn")).alias("m"))
    return pairs.groupBy(*keys).agg(F.coalesce(ratio(F.sum("g"), F.sum("w")), F.sum("d") / F.sum("m")).alias("parity_deviation"), F.sum("m").alias("pairs"))


def opening_trades(chain: DataFrame, dates: DataFrame | None = None, keys=KEYS, contract=("moneyness", "dte", "is_call")) -> DataFrame:
    """Put/call ratio of volume in contracts whose open interest rose since the entity was last observed.

    The observation before is the entity's last date with any contract, or with
    ``dates(date, date_idx)`` the date before in their numbering. A contract not
    seen then counts as rising from 0. Prefer an expiry in ``contract``: days to
    expiry shrink from one date to the next, so another contract takes their place.
    """
    entity, date = keys
    if dates is None:
        days = chain.select(entity, date).distinct().withColumn("_seen", F.row_number().over(Window.partitionBy(entity).orderBy(date)))
        numbered = chain.join(days, list(keys))
    else:
        numbered = chain.join(F.broadcast(dates.select(date, F.col("date_idx").alias("_seen"))), date)
    w = Window.partitionBy(entity, *contract).orderBy("_seen")
    before = F.when(F.lag("_seen").over(w) == F.col("_seen") - 1, F.lag("open_interest").over(w))
    rising = numbered.withColumn("rose", F.col("open_interest") > F.coalesce(before, F.lit(0)))
    return rising.groupBy(*keys).agg(ratio(total("volume", put() & F.col("rose")), total("volume", call() & F.col("rose"))).alias("opening_pc"))


def event_move(chain: DataFrame, bars: DataFrame, keys=KEYS, horizon: int = 30) -> DataFrame:
    """Straddle over spot at the expiry nearest the next event; one side alone counts twice."""
    events = bars.select(*keys, "days_to_next_earnings").where(F.col("days_to_next_earnings").between(0, horizon))
    rows = chain.where(F.col("moneyness").between(0.95, 1.05)).join(events, list(keys))
    gap = F.abs(F.col("dte") - F.greatest(F.col("days_to_next_earnings"), F.lit(1.0)))
    first = F.min(F.struct(gap.alias("g"), "dte")).over(Window.partitionBy(*keys))
    at = rows.withColumn("_dte", first["dte"]).where("dte = _dte")
    out = at.groupBy(*keys).agg(F.avg(F.when(call(), F.col("mid_price"))).alias("c"), F.avg(F.when(put(), F.col("mid_price"))).alias("p"), F.max("underlying_price").alias("s"))
    straddle = F.coalesce(F.col("c") + F.col("p"), 2 * F.col("c"), 2 * F.col("p"))
    return out.select(*keys, ratio(straddle, F.col("s")).alias("event_move"))


def implied_moments(chain: DataFrame, keys=KEYS, rate: float = 0.02, double_discount: bool = True) -> DataFrame:
    """Model-free variance, skewness and kurtosis from out-of-the-money quotes near 30 days.

    Contracts pay the square, cube and fourth power of the log return; strikes
    are weighted by half the distance between their neighbours. With
    ``double_discount`` the discount factor enters the contracts and the moments.
    """
    entity = Window.partitionBy(*keys)
    near = chain.withColumn("_d", F.min(F.struct(F.abs(F.col("dte") - 30).alias("g"), "dte")).over(entity)["dte"]).where(F.abs(F.col("dte") - F.col("_d")) <= 5)
    tau = F.col("_d") / 365
    forward = F.col("underlying_price") * F.exp(rate * tau)
    otm = near.where((call() & (F.col("strike") > forward)) | (put() & (F.col("strike") <= forward))).where("mid_price > 0")
    w = entity.orderBy("strike", "dte", "is_call")
    up, down = F.lead("strike").over(w), F.lag("strike").over(w)
    dk = F.when(up.isNull(), F.col("strike") - down).when(down.isNull(), up - F.col("strike")).otherwise((up - down) / 2)
    x = F.log(F.col("strike") / F.col("underlying_price"))
    q = F.col("mid_price") * F.col("_dk") / (F.col("strike") * F.col("strike"))
    rows = otm.withColumn("_dk", dk)
    sums = rows.groupBy(*keys).agg(
        F.sum(2 * (1 - x) * q).alias("v"), F.sum((6 * x - 3 * x * x) * q).alias("w"), F.sum((12 * x * x - 4 * x * x * x) * q).alias("x"), F.count("*").alias("n"), F.max("_d").alias("d"),
    ).where("n >= 5")
    r = F.exp(rate * F.col("d") / 365)
    g = 1 / r if double_discount else F.lit(1.0)
    v, c3, c4 = F.col("v") * g, F.col("w") * g, F.col("x") * g
    mu = r - 1 - r / 2 * v - r / 6 * c3 - r / 24 * c4
    var = r * v - mu * mu
    return sums.select(
        *keys, "n", var.alias("variance"),
        F.when(var > 0, (r * c3 - 3 * mu * r * v + 2 * mu * mu * mu) / F.pow(var, F.lit(1.5))).alias("skewness"),
        F.when(var > 0, (r * c4 - 4 * mu * r * c3 + 6 * r * mu * mu * v - 3 * mu * mu * mu * mu) / (var * var)).alias("kurtosis"),
    )


def eligible(chain: DataFrame, keys=KEYS, oi: int = 10, money=(0.8, 1.2), days=(7, 180), least: int = 50) -> DataFrame:
    """Contracts within the open interest, moneyness and expiry limits, on dates that keep enough of them."""
    kept = chain.where((F.col("open_interest") >= oi) & F.col("moneyness").between(*money) & F.col("dte").between(*days))
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")
