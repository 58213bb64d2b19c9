"""Statistical tests over metric tables: HAC errors, forecast comparison, selection bias, bootstrap, intervals, power."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalars import chi2_1_tail, correlation, normal_cdf, normal_quantile
from panelforge.functions.windows import average_rank
from panelforge.operators import ordering, selection
from panelforge.sources.tables import materialize

EULER = 0.5772156649015329


def daily_ic(panel: DataFrame, x: str, y: str, keys: list[str], least: int = 5) -> DataFrame:
    """Rank correlation of x and y within each group of at least ``least`` complete rows."""
    full = panel.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = full.select(*keys, average_rank(x, *keys).alias("_x"), average_rank(y, *keys).alias("_y"))
    out = ranked.groupBy(*keys).agg(correlation("_x", "_y").alias("ic"), F.count("*").alias("n"))
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def cube_root_lags(n: Column) -> Column:
    """floor(n ** (1/3)) in floating point, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.pow(n.cast("double"), F.lit(1 / 3))).cast("int"))


def _dealt(rows: DataFrame, keys: list[str], order: list[str], most: int, block: int) -> DataFrame:
    """Rows in blocks of consecutive ones, each with the ``most`` rows before it, for which ``_own`` is false."""
    size = max(block, 4 * most)
    i = F.col("_i")
    home = F.floor(i / size)
    places = F.when(i % size >= size - most, F.array(home, home + 1)).otherwise(F.array(home))
    return ordering.numbered(rows, keys, order, "_i").select("*", home.alias("_home"), F.explode(places).alias("_block")).withColumn("_own", F.col("_block") == F.col("_home"))


def newey_west(series: DataFrame, x: str, keys: list[str], order: str | list[str], lags: Column | None = None, divisor_n: bool = False, block: int = 10_000) -> DataFrame:
    """Mean of each series with its HAC error and t-statistic.

    Two estimators: autocovariances as means over their n - k pairs with the
    variance floored at 0 (default), or all divided by n without a floor
    (``divisor_n``). ``lags`` is a function of ``n``, by default its cube root.
    The longest series is counted first, so that as many lags are laid out as
    it uses. Groups of fewer than 3 values are left out.

    A series of dates is one window. One in panel order, whose length grows
    with the rows, is given as ``order=[entity, date]``: it is numbered by
    entity and its lags are taken in blocks of ``block`` rows.
    """
    series = materialize(series.select(*keys, *([order] if isinstance(order, str) else order), F.col(x).alias(x)).where(F.col(x).isNotNull()), "series")
    longest = series.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("n"))
    most = max(1, longest.select(cube_root_lags(F.col("n")) if lags is None else lags).first()[0])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    e = series.where(F.col(x).isNotNull())
    if isinstance(order, str):
        e = e.select(*keys, order, (F.col(x) - F.avg(x).over(group)).alias("_e"), F.col(x).alias("_x"), F.lit(True).alias("_own"))
        w = group.orderBy(order)
    else:
        e = e.select(*keys, *order, F.col(x).alias("_x"))
        means = e.groupBy(*keys).agg(F.avg("_x").alias("_m"))
        e = e.join(means, keys) if keys else e.crossJoin(F.broadcast(means))
        e = _dealt(e.select(*keys, *order, (F.col("_x") - F.col("_m")).alias("_e"), "_x"), keys, order, most, block)
        w = Window.partitionBy(*keys, "_block").orderBy("_i")
    pairs = [F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, most + 1)]
    sums = e.select(*keys, "_e", "_x", "_own", *pairs).where("_own").groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_x").alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("_g0"),
        F.array(*[F.coalesce(F.sum(F.col("_e") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, most + 1)]).alias("_g"),
    ).where("n >= 3")
    n = F.col("n")
    bandwidth = cube_root_lags(n) if lags is None else lags
    terms = F.transform("_g", lambda g, i: F.when(i + 1 <= F.col("_L"), 2 * (1 - (i + 1) / (F.col("_L") + 1)) * g / (n if divisor_n else F.greatest(n - i - 1, F.lit(1)))).otherwise(0.0))
    var = F.col("_g0") / n + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    se = F.sqrt((var if divisor_n else F.greatest(var, F.lit(0.0))) / n)
    out = sums.withColumn("_L", bandwidth).withColumn("se", se)
    return out.select(*keys, "n", "mean", "se", F.when(F.col("se") > 0, F.col("mean") / F.col("se")).alias("t"), F.col("_L").alias("lags"))


def clark_west(preds: DataFrame, small: str, large: str, y: str, keys: list[str], order: str | list[str]) -> DataFrame:
    """One-sided test that the large nested forecast improves on the small one."""
    a, b, g = F.col(y) - F.col(small), F.col(y) - F.col(large), F.col(small) - F.col(large)
    out = newey_west(preds.withColumn("_f", a * a - (b * b - g * g)), "_f", keys, order, divisor_n=True)
    return out.withColumn("p", 1 - normal_cdf(F.col("t")))


def diebold_mariano(preds: DataFrame, first: str, second: str, y: str, keys: list[str], order: str | list[str], horizon: int = 1, loss: str = "squared") -> DataFrame:
    """Two-sided test of equal loss."""
    cost = (lambda e: e * e) if loss == "squared" else F.abs
    d = cost(F.col(y) - F.col(first)) - cost(F.col(y) - F.col(second))
    out = newey_west(preds.withColumn("_d", d), "_d", keys, order, F.lit(max(1, horizon - 1)), divisor_n=True)
    return out.withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))


def mcnemar(preds: DataFrame, first: Column, second: Column, keys: list[str]) -> DataFrame:
    """Chi-squared test of two forecasters' hits, without continuity correction; no discordant pair gives (0, 1)."""
    out = preds.groupBy(*keys).agg(F.count(F.when(first & ~second, 1)).alias("b"), F.count(F.when(~first & second, 1)).alias("c"))
    chi2 = F.when(F.col("b") + F.col("c") > 0, F.pow(F.col("b") - F.col("c"), F.lit(2)) / (F.col("b") + F.col("c"))).otherwise(0.0)
    return out.withColumn("chi2", chi2).withColumn("p", F.when(F.col("chi2") > 0, chi2_1_tail(F.col("chi2"))).otherwise(1.0))


def deflated_sharpe(trials: DataFrame, sharpe: str, n: int | None = None) -> DataFrame:
    """Trials with the expected maximum Sharpe ratio of as many skill-less trials, the excess and a survival flag."""
    stats = trials.agg(F.var_samp(sharpe).alias("_v"), F.count(sharpe).alias("_n"))
    count = F.lit(n) if n else F.col("_n")
    bar = F.sqrt("_v") * ((1 - EULER) * normal_quantile(1 - 1 / count) + EULER * normal_quantile(1 - 1 / (count * math.e)))
    bars = stats.select(bar.alias("sr0"))
    return trials.crossJoin(F.broadcast(bars)).withColumn("excess", F.col(sharpe) - F.col("sr0")).withColumn("survives", F.col("excess") > 0)


def sharpe_probability(trials: DataFrame, sharpe: str, periods: str, n: int | None = None) -> DataFrame:
    """``deflated_sharpe`` with the probability that the true per-period ratio exceeds the bar (normal, one-sided)."""
    out = deflated_sharpe(trials, sharpe, n)
    return out.withColumn("probability", normal_cdf(F.col("excess") * F.sqrt(F.greatest(F.col(periods) - 1, F.lit(1)))))


def pbo(pnl: DataFrame, trial: str, time: str, value: str, blocks: int = 8) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    Times are cut into equal blocks; every choice of half of them is an
    in-sample set. Each (trial, block) keeps only n, sum and sum of squares.
    """
    times = pnl.select(time).distinct().withColumn("_block", F.ntile(blocks).over(Window.orderBy(time)) - 1)
    stats = pnl.join(F.broadcast(times), time).groupBy(trial, "_block").agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    splits = [(i, list(c)) for i, c in enumerate(combinations(range(blocks), blocks // 2))]
    choice = pnl.sparkSession.createDataFrame(splits, "split int, inside array<int>")
    both = stats.crossJoin(F.broadcast(choice)).groupBy("split", trial, F.array_contains("inside", F.col("_block")).alias("ins")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    sharpes = both.withColumn("sr", F.when(sd > 0, F.round(mean / sd, 9)).otherwise(0.0))
    wide = sharpes.groupBy("split", trial).agg(F.max(F.when(F.col("ins"), F.col("sr"))).alias("sr_in"), F.max(F.when(~F.col("ins"), F.col("sr"))).alias("sr_out"))
    w = Window.partitionBy("split")
    ranked = wide.withColumn("best", F.row_number().over(w.orderBy(F.desc("sr_in"), trial))).withColumn("below", F.rank().over(w.orderBy("sr_out"))).withColumn("m", F.count("*").over(w))
    omega = F.col("below") / (F.col("m") + 1)
    chosen = ranked.where("best = 1").withColumn("logit", F.log(omega / (1 - omega)))
    return chosen.agg(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"), F.count("*").alias("splits"), F.avg("logit").alias("mean_logit"))


def replicates_of(values: DataFrame, keys: list[str], value: str, unit: str, replicates: int, seed: int = 42, apart: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, rep, m)``: each group's mean in each replicate, units drawn with replacement.

    A unit (a date, or a block of dates) is first reduced to its sum and count;
    each replicate weighs units by Poisson(1) counts from an MD5, the same on
    every engine, so the work is units x replicates and no rows are drawn. Groups share a unit's weight
    unless they differ in the columns ``apart``. Replicates that draw nothing
    of a group are left out.
    """
    units = values.groupBy(*keys, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    reps = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in (unit, "rep", *apart)], F.lit(str(seed)))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    return reps.withColumn("_w", weight).groupBy(*keys, "rep").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_c"))).alias("m")).where("m is not null")


def _interval(means: DataFrame, keys: list[str]) -> DataFrame:
    below, above = (F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (F.col("m") <= 0, F.col("m") >= 0))
    out = means.groupBy(*keys).agg(F.avg("m").alias("mean"), F.percentile("m", [0.025, 0.975]).alias("ci"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))
    return out.select(*keys, "mean", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"), "p")


def bootstrap(values: DataFrame, keys: list[str], value: str, unit: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval and two-sided p of each group's mean, units drawn with replacement."""
    return _interval(replicates_of(values, keys, value, unit, replicates, seed), keys)


def bootstrap_difference(values: DataFrame, keys: list[str], group: str, first: str, second: str, value: str, unit: str, replicates: int = 5000, seed: int = 42, paired: bool = False) -> DataFrame:
    """Interval and p of the difference of two groups' means.

    The groups are drawn independently, or with ``paired`` both by the same
    draws of the units that both have.
    """
    two = values.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    if paired:
        both = two.groupBy(*keys, unit).agg(F.count_distinct(group).alias("_n")).where("_n = 2").drop("_n")
        two = two.join(both, [*keys, unit])
    m = replicates_of(two, [*keys, group], value, unit, replicates, seed, () if paired else (group,))
    side = lambda g: F.max(F.when(F.col(group) == g, F.col("m")))
    return _interval(m.groupBy(*keys, "rep").agg((side(first) - side(second)).alias("m")).where("m is not null"), keys)


def corrected(tests: DataFrame, p: str, level: float = 0.05) -> DataFrame:
    """Tests with their number, whether each stands at the level and at the level over their number, and how many do."""
    n = tests.agg(F.count("*").alias("tests"))
    out = tests.crossJoin(F.broadcast(n)).withColumn("stands", F.col(p) < level).withColumn("corrected", F.col(p) < level / F.col("tests"))
    out = materialize(out, "tests")
    return out.crossJoin(F.broadcast(out.agg(F.count(F.when(F.col("stands"), 1)).alias("n_stand"), F.count(F.when(F.col("corrected"), 1)).alias("n_corrected"))))


def bootstrap_ranks(values: DataFrame, key: str, value: str, unit: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Median and percentile interval of each group's rank by mean, largest first, over shared draws."""
    m = replicates_of(values, [key], value, unit, replicates, seed)
    ranked = m.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("m"), key)))
    out = ranked.groupBy(key).agg(F.percentile("_r", [0.025, 0.5, 0.975]).alias("_q"))
    return out.select(key, *[F.col("_q")[i].cast("int").alias(c) for i, c in enumerate(("rank_lo", "rank_median", "rank_hi"))])


def conformal(calibration: DataFrame, test: DataFrame, pred: str, y: str, alpha: float = 0.1) -> DataFrame:
    """Test rows with split-conformal bounds from the calibration rows' absolute residuals."""
    q = selection.quantiles(calibration.select(F.abs(F.col(y) - F.col(pred)).alias("q")), {"q": lambda n: [min(math.ceil((1 - alpha) * (n + 1)) / max(n, 1), 1.0)]})
    q = q.select(F.get("q", 0).alias("q"))
    return test.crossJoin(F.broadcast(q)).withColumn("lo", F.col(pred) - F.col("q")).withColumn("hi", F.col(pred) + F.col("q")).drop("q")


def coverage(bounded: DataFrame, y: str, keys: list[str]) -> DataFrame:
    return bounded.groupBy(*keys).agg(F.avg(F.when(F.col(y).between(F.col("lo"), F.col("hi")), 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"), F.count("*").alias("n"))


def minimum_effect(se: Column, t: float = 3.0) -> Column:
    return se * t


def required_names(effect: Column, mde: Column, names: Column) -> Column:
    """Entities needed to detect an effect, errors shrinking with the root of their number."""
    return F.ceil(names * F.pow(mde / effect, F.lit(2)))
