"""Unit tests with values worked out by hand or bounds that must hold."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.functions import scalars as S
from panelforge.functions import windows as W
from panelforge.operators import backtest, chain, inference, panel, surface, walkforward
from panelforge.sources import tables

DAY = dt.date(2020, 1, 1)


def business_days(n):
    out, d = [], DAY
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


@pytest.fixture(scope="module")
def bars_100(spark):
    rng, p, rows = random.Random(42), 100.0, []
    for d in business_days(100):
        q = p + rng.gauss(0, 0.5)
        rows.append(("X", d, q, q / p - 1))
        p = q
    return spark.createDataFrame(rows, "ticker string, date date, prc double, ret double")


def chain_of(spark, rows):
    return spark.createDataFrame([("X", DAY, c, v, 10, 0.5, 0.2) for c, v in rows], "ticker string, date date, is_call int, volume long, open_interest long, delta double, impl_volatility double")


def test_put_call_ratio(spark):
    bars = spark.createDataFrame([("X", DAY, 1000.0)], "ticker string, date date, vol double")
    assert chain.sentiment(chain_of(spark, [(1, 100), (1, 200), (0, 150), (0, 50)]), bars).first()["pc_volume"] == pytest.approx(200 / 300)
    assert chain.sentiment(chain_of(spark, [(0, 100), (0, 200)]), bars).first()["pc_volume"] is None


def test_rsi_and_bollinger_bounds(bars_100):
    w = W.by()
    out = bars_100.select(W.rsi(F.col("ret"), 14, w).alias("rsi"), ((F.col("prc") - W.sma(F.col("prc"), 20, w)) / (2 * W.rolling_std(F.col("prc"), 20, w))).alias("b")).collect()
    assert all(0 <= r["rsi"] <= 100 for r in out if r["rsi"] is not None)
    assert all(abs(r["b"]) < 5 for r in out if r["b"] is not None)


def test_sma_and_ema_by_hand(bars_100):
    rows = bars_100.select("prc", W.sma(F.col("prc"), 50, W.by()).alias("s"), W.ema(F.col("prc"), 12, W.by()).alias("e")).orderBy("date").collect()
    prices = [r["prc"] for r in rows]
    assert rows[48]["s"] is None and rows[59]["s"] == pytest.approx(sum(prices[10:60]) / 50, abs=1e-9)
    y, a = prices[0], 2 / 13
    for p, r in zip(prices[1:], rows[1:], strict=True):
        y = (1 - a) * y + a * p
        assert r["e"] == pytest.approx(y, rel=1e-12)


def test_forward_returns(spark):
    df = spark.createDataFrame([("X", d, 100.0 + i) for i, d in enumerate(business_days(20))], "ticker string, date date, prc double")
    df = df.withColumn("ret", F.col("prc") / F.lag("prc").over(W.by()) - 1)
    rows = df.select(*[W.forward_return(F.col("ret"), h, W.by()).alias(f"r{h}") for h in (1, 3, 5)]).collect()
    assert [rows[0][f"r{h}"] for h in (1, 3, 5)] == pytest.approx([0.01, 0.03, 0.05])
    assert rows[-1]["r1"] is None and rows[-3]["r3"] is None


def test_split_has_gaps_and_no_overlap(spark):
    days = business_days(500)
    df = spark.createDataFrame([("T", d) for d in days], "ticker string, date date")
    splits = panel.temporal_split(df)
    by = {s: [r["date"] for r in splits.where(F.col("split") == s).orderBy("date").collect()] for s in ("train", "val", "test")}
    assert panel.overlaps(splits).count() == 0
    assert days.index(by["val"][0]) - days.index(by["train"][-1]) > 5 and days.index(by["test"][0]) - days.index(by["val"][-1]) > 5
    assert abs(len(by["train"]) / 500 - 0.6) < 0.05 and abs(len(by["test"]) / 500 - 0.2) < 0.05


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None)], "g int, x double")
    assert sorted(r[0] for r in df.select(W.average_rank("x", "g")).collect() if r[0] is not None) == [1.5, 1.5, 3.0]


def test_normal_functions(spark):
    r = spark.range(1).select(S.normal_cdf(F.lit(1.96)).alias("c"), S.normal_quantile(F.lit(0.975)).alias("q"), S.chi2_1_tail(F.lit(3.841459)).alias("t")).first()
    assert r["c"] == pytest.approx(0.9750021, abs=1e-6) and r["q"] == pytest.approx(1.959963984540054, abs=1e-8) and r["t"] == pytest.approx(0.05, abs=1e-5)


def test_svi_recovers_a_smile(spark):
    a, b, rho, m, sigma, dte = 0.02, 0.15, -0.3, 0.05, 0.14, 30
    spot, rate, rows = 100.0, 0.02, []
    for i in range(21):
        k = -0.4 + 0.04 * i
        w = a + b * (rho * (k - m) + math.sqrt((k - m) ** 2 + sigma**2))
        rows.append(("X", DAY, dte, spot * math.exp(rate * dte / 365) * math.exp(k), spot, math.sqrt(w / (dte / 365)), 10))
    smile = surface.fit_svi(spark.createDataFrame(rows, "ticker string, date date, dte int, strike double, underlying_price double, impl_volatility double, volume long")).first()
    assert smile["rmse"] < 1e-6 and smile["rho"] == pytest.approx(rho, abs=0.01) and smile["b"] == pytest.approx(b, abs=0.01)


@pytest.mark.parametrize("case", ["planted", "clipped", "noise", "few strikes"])
def test_no_feasible_point_beats_the_bounded_fit(case):
    """Least squares within the bounds against a fine grid of feasible points, also where a bound holds the best one."""
    import numpy as np

    rng = np.random.default_rng(len(case))
    sigma, m = 0.2, 0.05
    k = np.linspace(-0.4, 0.4, 15) if case != "few strikes" else np.repeat([-0.1, 0.2], 4)
    v = rng.random(len(k))
    v /= v.sum()
    y = (k - m) / sigma
    z = np.sqrt(y * y + 1)
    w = {"planted": 0.02 + 0.01 * y + 0.03 * z, "clipped": -0.05 + 0.3 * y + 0.2 * z, "noise": rng.standard_normal(len(k)) * 0.05 + 0.04, "few strikes": 0.03 + 0.2 * k}[case]
    of = {"1": np.ones(len(k)), "y": y, "z": z, "w": w}
    sums = {f"s{a}{b}": np.array([(v * of[a] * of[b]).sum()]) for a in of for b in of}
    a, d, c, sse = (float(x[0]) for x in surface.bounded(sums, np.array([sigma])))
    assert a >= 0 and 1e-6 * 0.99 <= c <= 5 * sigma * 1.01 and abs(d) <= 0.9991 * c
    assert sse == pytest.approx(float((v * (a + d * y + c * z - w) ** 2).sum()), abs=1e-12)
    for cc in np.linspace(1e-6, 5 * sigma, 120):
        for dd in np.linspace(-0.999, 0.999, 61) * cc:
            level = max(0.0, float((v * (w - dd * y - cc * z)).sum()))
            assert sse <= float((v * (level + dd * y + cc * z - w) ** 2).sum()) + 1e-12


def test_newey_west_by_hand(spark):
    xs = [0.1, 0.3, -0.2, 0.4, 0.0, 0.2, 0.1, -0.1, 0.3, 0.2]
    got = inference.newey_west(spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "g int, i int, x double"), "x", ["g"], "i").first()
    n, mean = len(xs), sum(xs) / len(xs)
    e, lags = [x - mean for x in xs], max(1, int(n ** (1 / 3)))
    var = sum(v * v for v in e) / n + sum(2 * (1 - k / (lags + 1)) * sum(e[i] * e[i - k] for i in range(k, n)) / (n - k) for k in range(1, lags + 1))
    assert got["lags"] == lags and got["se"] == pytest.approx(math.sqrt(max(var, 0) / n))


def test_windows_and_embargo(spark):
    w = [tuple(r) for r in walkforward.windows(spark, 30, "rolling", 10, 5, embargo=2).orderBy("window").collect()]
    assert w == [(0, 0, 8, 10, 15), (1, 5, 13, 15, 20), (2, 10, 18, 20, 25)]


def test_long_short_costs(spark):
    rows = [("m", DAY + dt.timedelta(d), t, p, y, 0.01) for d in range(2) for t, p, y in (("a", 4.0, 0.1), ("b", 3.0, 0.0), ("c", 2.0, 0.0), ("d", 1.0, -0.1))]
    df = spark.createDataFrame(rows, "model string, date date, ticker string, pred double, y_raw double, spread double")
    out = backtest.long_short(df, ["model"], 1, 1, 0.5, fee=0.0).orderBy("date").collect()
    assert [r["turnover"] for r in out] == [2.0, 0.0]
    assert [r["portfolio_return"] for r in out] == pytest.approx([0.2 - 2 * 0.005, 0.2])


def test_upsert_keeps_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_impute_falls_back(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", None, False), ("b", None, False)], "ticker string, x double, train boolean")
    out = panel.impute(df, ["x"], F.col("train"))
    assert sorted((r["ticker"], r["x"]) for r in out.where("not train").collect()) == [("a", 2.0), ("b", 2.0)]


def test_bootstrap_of_differences_and_ranks(spark):
    # high and low move together by date: their paired difference is always 1, the independent one varies
    rows = [("A", g, f"d{i}", float(i % 7) + (g == "high")) for i in range(60) for g in ("high", "low")]
    v = spark.createDataFrame([*rows, ("A", "high", "only", 99.0)], "k string, g string, date string, v double")
    paired = inference.bootstrap_difference(v, ["k"], "g", "high", "low", "v", "date", 300, paired=True).first()
    assert abs(paired["lo"] - 1) < 1e-9 and abs(paired["hi"] - 1) < 1e-9 and paired["p"] == 0
    apart = inference.bootstrap_difference(v.where("date <> 'only'"), ["k"], "g", "high", "low", "v", "date", 300).first()
    assert apart["lo"] < 0.8 < 1.2 < apart["hi"] and abs(apart["mean"] - 1) < 0.2
    ranks = {r["g"]: (r["rank_lo"], r["rank_median"], r["rank_hi"]) for r in inference.bootstrap_ranks(v, "g", "v", "date", 300).collect()}
    assert ranks == {"high": (1, 1, 1), "low": (2, 2, 2)}


def test_sharpe_probability(spark):
    t = spark.createDataFrame([(0.1, 101), (0.2, 101), (0.6, 101)], "s double, n int")
    got = inference.sharpe_probability(t, "s", "n").collect()
    for r in got:
        assert abs(r["probability"] - 0.5 * (1 + math.erf(r["excess"] * 10 / math.sqrt(2)))) < 1e-5
    assert got[2]["probability"] > 0.95 > got[0]["probability"]


def test_newey_west_uses_all_its_lags(spark):
    """A series of 70,000 values has 41 lags; a stated number of lags is used whatever its size."""
    import numpy as np
    from pyspark.sql import functions as F

    from panelforge.operators import inference

    n = 70_000
    s = spark.range(n).select(F.col("id").alias("date"), (F.sin(F.col("id") * 0.05) + (F.col("id") % 7) / 10).alias("x"), F.lit("a").alias("k"))
    x = np.sin(np.arange(n) * 0.05) + (np.arange(n) % 7) / 10
    e = x - x.mean()
    for lags, column in ((41, None), (60, F.lit(60))):
        var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
        got = inference.newey_west(s, "x", ["k"], "date", column, divisor_n=True).first()
        assert got["lags"] == lags and abs(got["se"] - np.sqrt(var / n)) < 1e-9
    empty = inference.newey_west(s.limit(0), "x", ["k"], "date")
    assert empty.count() == 0


def test_newey_west_in_blocks_equals_one_window(spark):
    from pyspark.sql import functions as F

    from panelforge.operators import inference

    s = spark.range(900).select((F.col("id") % 2).alias("k"), (F.col("id") % 7 * 10).alias("entity"), F.col("id").alias("date"), F.sin(F.col("id") * 0.05).alias("x"))
    one = s.withColumn("at", F.col("entity") * 10_000 + F.col("date"))
    for keys in (["k"], []):
        for lags in (None, F.lit(25)):
            plain = {tuple(r[k] for k in keys): r for r in inference.newey_west(one, "x", keys, "at", lags, divisor_n=True).collect()}
            parts = inference.newey_west(s, "x", keys, ["entity", "date"], lags, divisor_n=True, block=50).collect()
            assert len(parts) == len(plain)
            for r in parts:
                p = plain[tuple(r[k] for k in keys)]
                assert (r["n"], r["lags"]) == (p["n"], p["lags"]) and abs(r["se"] - p["se"]) < 1e-12 and abs(r["mean"] - p["mean"]) < 1e-12


def test_ranks_in_parts_equal_one_window(spark):
    """Ties, nulls, a value that half the rows have, a group of one row."""
    from pyspark.sql import functions as F

    from panelforge.functions.windows import average_rank
    from panelforge.operators import ordering

    x = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 2 == 0, 5.0).otherwise((F.col("id") * 37 % 101).cast("double"))
    df = spark.range(500).select("id", F.when(F.col("id") == 0, "one").otherwise((F.col("id") % 3).cast("string")).alias("k"), x.alias("x"))
    for keys in (["k"], []):
        plain = {r["id"]: r["r"] for r in df.withColumn("c", F.lit(1)).select("id", average_rank("x", *(keys or ["c"])).alias("r")).collect()}
        assert {r["id"]: r["r"] for r in ordering.ranked(df, {"x": "r"}, keys, 8).collect()} == plain
    at = {r["id"]: r["i"] for r in ordering.numbered(df, [], ["k", "id"], "i").collect()}
    assert [at[r["id"]] for r in df.orderBy("k", "id").collect()] == list(range(500))


def test_causal_median_equals_every_past_value(spark):
    """Ties, nulls, and a date without values."""
    import statistics

    from panelforge.operators import panel

    rows = [(d, None if d == 7 or (d + i) % 13 == 0 else float((d * 31 + i * 17) % 23)) for d in range(20) for i in range(1 + d % 4)]
    df = spark.createDataFrame(rows, "date int, x double")
    want = {d: statistics.median(past) if (past := [v for e, v in rows if e < d and v is not None]) else None for d in range(20)}
    for bins, together in ((2, 10**6), (4, 0), (256, 0)):
        assert {r["date"]: r["median"] for r in panel.causal_median(df, "x", bins=bins, together=together).collect()} == want
    assert panel.causal_median(df.limit(0), "x").count() == 0


def test_causal_median_cuts_bins_until_they_fit(spark):
    """A drifting middle, one value in half of all rows, numbers of both signs: at every level fewer values are left."""
    import random
    import statistics

    from panelforge.operators import panel

    rng = random.Random(3)
    rows = [(d, 0.25 if rng.random() < 0.5 and d > 15 else round(rng.gauss(d / 5 - 3, 2), 3)) for d in range(40) for _ in range(25)]
    df = spark.createDataFrame(rows, "date int, x double").repartition(4)
    want = {d: statistics.median(past) if (past := [v for e, v in rows if e < d]) else None for d in range(40)}
    left, cut = [], panel._cut
    try:
        panel._cut = lambda inside, sought, bins: (left.append(inside.count()), cut(inside, sought, bins))[1]
        got = {r["date"]: r["median"] for r in panel.causal_median(df, "x", bins=16, together=300).collect()}
    finally:
        panel._cut = cut
    assert got == want
    assert len(left) > 1 and all(a > b for a, b in zip(left, left[1:]))


def test_parity_meets_every_call_with_every_put(spark):
    from panelforge.operators import chain

    rows = [(1, 0.20, 10), (1, 0.24, 30), (0, 0.18, 5), (0, 0.30, 20), (0, None, 7)]
    c = spark.createDataFrame([("a", "2020-01-01", 100.0, 30, 1.0, s, v, q) for s, v, q in rows], "ticker string, date string, strike double, dte int, moneyness double, is_call int, impl_volatility double, volume int")
    pairs = [(a - b, u + w) for s, a, u in rows if s for t, b, w in rows if not t and b is not None]
    got = chain.parity_deviation(c).first()
    assert got["pairs"] == 4 and abs(got["parity_deviation"] - sum(g * w for g, w in pairs) / sum(w for _, w in pairs)) < 1e-12


def test_stratified_sample_below_its_cells(spark):
    from panelforge.operators import surface

    rows = [("a", "2020-01-01", 0.81 + 0.05 * i, 30 + 20 * (i % 2), 80.0 + i, 1, 10 * (i + 1)) for i in range(8)]
    c = spark.createDataFrame(rows, "ticker string, date string, moneyness double, dte int, strike double, is_call int, volume int")
    money, days = [0.8 + 0.05 * i for i in range(9)], [0, 40, 180]
    kept = {b: surface.stratified_sample(c, b, money, days).collect() for b in (4, 7, 8)}
    assert {b: len(x) for b, x in kept.items()} == {4: 4, 7: 7, 8: 8}
    assert sorted(r["strike"] for r in kept[4]) == [84.0, 85.0, 86.0, 87.0]


def test_grid_runs_only_pending_cells(spark):
    from pyspark.sql import functions as F

    from panelforge.operators import walkforward

    p = spark.range(60 * 6).select((F.col("id") / 6).cast("long").alias("date_idx"), F.sin("id").alias("x"), F.cos("id").alias("y"), F.lit("A").alias("set"))
    wins = {"rolling": walkforward.windows(spark, 60, "rolling", 20, 10)}
    grid = spark.createDataFrame([("A", m, "rolling") for m in ("zero", "mean", "ols")], "set string, model string, scheme string")
    whole = walkforward.run_grid(grid, p, wins, "x", "y", ["set"])
    done = whole.where("model = 'ols'")
    rest = walkforward.run_grid(grid, p, wins, "x", "y", ["set"], done)
    assert {r["model"] for r in rest.collect()} == {"zero", "mean"} and rest.count() + done.count() == whole.count()
    assert all(abs(r["r2"]) < 1e-12 for r in whole.where("model = 'mean'").collect())


def test_correlation_without_variation_is_null(spark):
    from panelforge.functions.scalars import correlation

    rows = [("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 9.0), ("b", 9.0, None), ("c", None, 1.0)]
    data = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r["c"] for r in data.groupBy("k").agg(correlation("x", "y").alias("c")).collect()}
    assert got["a"] is None and got["c"] is None and abs(got["b"] - 1) < 1e-12
