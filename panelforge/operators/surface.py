"""Volatility surface: smile fits, delta and moneyness grids, contract and chain tensors.

The smile fit is quasi-explicit: for fixed (m, sigma) the model is linear in
three coefficients, so each point of a small grid needs only grouped sums and a
small solve, which is exact within the bounds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelforge.functions.scalars import ratio, strike_ratio_of_delta, svi_variance
from panelforge.operators import selection
from panelforge.sources.tables import materialize

KEYS = ["ticker", "date"]
SMILE = [*KEYS, "dte"]
GRID = [(m, s) for m in (-0.2, -0.1, 0.0, 0.1, 0.2) for s in (0.05, 0.1, 0.2, 0.4)]
#: Normal quantiles of the call deltas 0.90, 0.75, 0.50, 0.25 and 0.10.
DELTA_QUANTILES = {"d90": 1.281552, "d75": 0.674490, "d50": 0.0, "d25": -0.674490, "d10": -1.281552}
TENORS = (30, 60, 90, 120)
MONEYNESS_GRID = (0.90, 0.95, 1.00, 1.05, 1.10)
DTE_GRID = (30, 60, 90)


def smile_points(chain: DataFrame, rate: float = 0.02, least: int = 5) -> DataFrame:
    """Log-moneyness, total variance and volume weight of each quote of smiles with enough points."""
    tau = F.col("dte") / 365
    p = chain.where("impl_volatility > 0 and dte > 0").select(*SMILE, F.log(F.col("strike") / (F.col("underlying_price") * F.exp(rate * tau))).alias("k"), (F.col("impl_volatility") * F.col("impl_volatility") * tau).alias("w"), (F.col("volume") + F.lit(1.0)).alias("v"))
    smile = Window.partitionBy(*SMILE)
    return p.withColumn("v", F.col("v") / F.sum("v").over(smile)).withColumn("_n", F.count("*").over(smile)).where(F.col("_n") >= least).drop("_n")


#: Bounds of the fit: the slope's share and the largest |rho|; a determinant below this share of its product is no plane.
SLOPE, RHO, PLANE, LEAST_C = 5.0, 0.999, 1e-7, 1e-6


def bounded(sums: dict[str, np.ndarray], sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, d, c, error) of each row of sums: the weighted least squares within the bounds, exactly.

    The error is quadratic and convex in level a, tilt d and curvature c, and
    the bounds a >= 0, LEAST_C <= c <= SLOPE sigma, |d| <= RHO c are linear, so the best
    point is the least of one face: the inside, an edge or a corner, each with a
    free (moments about the means) or at 0 (moments about 0).
    """
    raw = {k: sums[f"s{k}"] for k in ("yy", "yz", "zz", "yw", "zw")}
    # the weights of a smile sum to 1: far less cancels than in sums about 0
    centred = {k: raw[k] - sums[f"s1{k[0]}"] * sums[f"s1{k[1]}"] for k in raw}
    found = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for q, free in ((centred, True), (raw, False)):
            det = q["yy"] * q["zz"] - q["yz"] * q["yz"]
            plane = np.where(det > PLANE * q["yy"] * q["zz"], det, np.nan)
            faces = [((q["yw"] * q["zz"] - q["zw"] * q["yz"]) / plane, (q["zw"] * q["yy"] - q["yw"] * q["yz"]) / plane)]
            for r in (RHO, -RHO):
                c = (r * q["yw"] + q["zw"]) / (r * r * q["yy"] + 2 * r * q["yz"] + q["zz"])
                faces.append((r * c, c))
            for c in (SLOPE * sigma, np.full(len(sigma), LEAST_C)):
                faces.append(((q["yw"] - c * q["yz"]) / q["yy"], c))
                faces += [(r * c, c) for r in (RHO, -RHO)]
            for d, c in faces:
                a = sums["s1w"] - d * sums["s1y"] - c * sums["s1z"] if free else np.zeros(len(d))
                inside = (c >= LEAST_C * (1 - 1e-9)) & (c <= SLOPE * sigma * (1 + 1e-9)) & (np.abs(d) <= RHO * c * (1 + 1e-9)) & (a >= 0)
                sse = sums["sww"] - 2 * (a * sums["s1w"] + d * raw["yw"] + c * raw["zw"]) + a * a + d * d * raw["yy"] + c * c * raw["zz"] + 2 * (a * d * sums["s1y"] + a * c * sums["s1z"] + d * c * raw["yz"])
                found.append((a, d, c, np.where(inside, np.maximum(sse, 0.0), np.inf)))
    errors = np.stack([f[3] for f in found])
    best, rows = np.round(errors, 14).argmin(0), np.arange(errors.shape[1])
    return *(np.stack([f[k] for f in found])[best, rows] for k in range(3)), errors[best, rows]


def _solve(p: DataFrame) -> DataFrame:
    """Best (a, b, rho, m, sigma) of each smile over the (m, sigma) of its points, within the bounds.

    Errors that agree to 14 digits after the point are ties, which go to the
    least (m, sigma): otherwise the order in which quotes are summed would
    decide (a smile with three distinct strikes is met exactly at many places).
    """
    y = (F.col("k") - F.col("m")) / F.col("sigma")
    p = p.withColumns({"_y": y, "_z": F.sqrt(y * y + 1)})
    cols = {"1": F.lit(1.0), "y": F.col("_y"), "z": F.col("_z"), "w": F.col("w")}
    names = [(a, b) for i, a in enumerate(cols) for b in list(cols)[i:]]
    s = p.groupBy(*SMILE, "m", "sigma").agg(F.count("*").alias("_n"), *[F.sum(F.col("v") * cols[a] * cols[b]).alias(f"s{a}{b}") for a, b in names])
    keys, sums = [*SMILE, "m", "sigma", "_n"], [f"s{a}{b}" for a, b in names]

    def solve(batches):
        for batch in batches:
            column = {c: batch.column(c).to_numpy() for c in (*sums, "sigma")}
            a, d, c, sse = bounded(column, column["sigma"])
            sigma = column["sigma"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *map(pa.array, (sse, a, c / sigma, d / c))], [*keys, "sse", "a", "b", "rho"])

    kinds = dict(s.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sse double, a double, b double, rho double"
    solved = s.select(*keys, *sums).mapInArrow(solve, schema)
    row = F.struct(F.round("sse", 14).alias("sse"), "m", "sigma", "a", "b", "rho", "_n")
    best = solved.groupBy(*SMILE).agg(F.min(row).alias("r"))
    return best.select(*SMILE, "r.a", "r.b", "r.rho", "r.m", "r.sigma", F.sqrt(F.col("r.sse") / F.col("r._n")).alias("rmse"))


def fit_svi(chain: DataFrame) -> DataFrame:
    """Smile parameters and error of each (entity, date, expiry): a coarse grid, then a finer one around its best point.

    The quotes' four numbers are written, as both grids read them: the chain is computed once.
    """
    spark = chain.sparkSession
    points = materialize(smile_points(chain), "points")
    coarse = _solve(points.crossJoin(F.broadcast(spark.createDataFrame(GRID, "m double, sigma double"))))
    steps = F.explode(F.array(*[F.struct(F.lit(dm).alias("dm"), F.lit(fs).alias("fs")) for dm in (-0.05, 0.0, 0.05) for fs in (0.7, 1.0, 1.4)])).alias("s")
    near = coarse.select(*SMILE, "m", "sigma", steps).select(*SMILE, (F.col("m") + F.col("s.dm")).alias("m"), (F.col("sigma") * F.col("s.fs")).alias("sigma"))
    return _solve(points.join(near, SMILE))


def headline(smiles: DataFrame, target: int = 30) -> DataFrame:
    """Parameters of the smile nearest the target days."""
    row = F.struct("a", "b", "rho", "m", "sigma", "rmse", "dte")
    return smiles.groupBy(*KEYS).agg(F.min_by(row, F.struct(F.abs(F.col("dte") - target), "dte")).alias("r")).select(*KEYS, *[F.col(f"r.{c}").alias(f"svi_{c}") for c in ("a", "b", "rho", "m", "sigma", "rmse")])


def delta_grid(smiles: DataFrame) -> DataFrame:
    """Volatility at five deltas and four tenors, each from the smile nearest the tenor within half of it."""
    spark = smiles.sparkSession
    tenors = spark.createDataFrame([(t,) for t in TENORS], "tenor int")
    gap = F.abs(F.col("dte") - F.col("tenor"))
    row = F.struct("a", "b", "rho", "m", "sigma", "dte")
    at = smiles.crossJoin(F.broadcast(tenors)).where(gap <= F.col("tenor") * 0.5).groupBy(*KEYS, "tenor").agg(F.min_by(row, F.struct(gap, "dte")).alias("r")).select(*KEYS, "tenor", "r.*")
    tau = F.col("dte") / 365
    vol = lambda k: F.sqrt(F.greatest(svi_variance(k, F.col("a"), F.col("b"), F.col("rho"), F.col("m"), F.col("sigma")), F.lit(1e-8)) / tau)
    at = at.withColumn("atm", F.coalesce(vol(F.lit(0.0)), F.lit(0.2)))
    cells = at.select(*KEYS, "tenor", *[(F.col("atm") if q == 0 else vol(F.log(strike_ratio_of_delta(q, F.col("atm"), tau)))).alias(n) for n, q in DELTA_QUANTILES.items()])
    agg = [F.max(F.when(F.col("tenor") == t, F.col(n))).alias(f"iv_{n}_{t}") for t in TENORS for n in DELTA_QUANTILES]
    return cells.groupBy(*KEYS).agg(*agg)


def grid_shape(grid: DataFrame, tenor: int = 30) -> DataFrame:
    """Risk reversal, butterfly, term slope and wing spread of a delta grid."""
    c = lambda n, t=tenor: F.col(f"iv_{n}_{t}")
    return grid.select(*KEYS, (c("d25") - c("d75")).alias("risk_reversal"), ((c("d25") + c("d75")) / 2 - c("d50")).alias("butterfly"), (c("d50", 90) - c("d50", 30)).alias("term_slope"), (c("d10") - c("d90")).alias("wing_spread"))


def fit_quality(smiles: DataFrame, chain: DataFrame) -> DataFrame:
    """Share of smiles fitted, error quantiles, wing slope b (1 + |rho|): mean, median, 95 % quantile and the shares above 2 and 4."""
    tried = chain.select(*SMILE).distinct()
    j = tried.join(smiles, SMILE, "left").withColumn("wing", F.col("b") * (1 + F.abs("rho")))
    j = materialize(j.select("rmse", "wing"), "smile-quality")
    q = selection.quantiles(j, {"rmse": [0.5, 0.9], "wing": [0.5, 0.95]}).select(*[F.get(c, i).alias(n) for c, i, n in (("rmse", 0, "rmse_median"), ("rmse", 1, "rmse_p90"), ("wing", 0, "wing_median"), ("wing", 1, "wing_p95"))])
    return j.crossJoin(F.broadcast(q)).groupBy(*q.columns).agg(F.count("*").alias("smiles"), F.avg(F.col("rmse").isNotNull().cast("int")).alias("fitted"), F.avg("rmse").alias("rmse"), F.avg("wing").alias("wing"), F.avg((F.col("wing") > 2).cast("int")).alias("wing_over2"), F.avg((F.col("wing") > 4).cast("int")).alias("wing_over4"))


def moneyness_grid(chain: DataFrame, least: int = 5) -> DataFrame:
    """Model-free volatility at 15 grid points: inverse-distance mean of liquid quotes within one cell, else the nearest quote.

    Dates with fewer liquid quotes keep a row of nulls.
    """
    spark = chain.sparkSession
    liquid = chain.where("(volume > 0 or open_interest > 100) and impl_volatility is not null").withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS))).where(F.col("_n") >= least)
    points = spark.createDataFrame([(m, t) for m in MONEYNESS_GRID for t in DTE_GRID], "gm double, gt int")
    dm, dt = (F.col("moneyness") - F.col("gm")) / 0.05, (F.col("dte") - F.col("gt")) / 30
    dist = F.sqrt(dm * dm + dt * dt)
    q = liquid.select(*KEYS, "moneyness", "dte", "is_call", "impl_volatility").crossJoin(F.broadcast(points)).withColumn("_d", F.round(dist, 9))
    near = F.col("_d") <= 1
    weight = 1 / (F.col("_d") + 0.01)
    cell = q.groupBy(*KEYS, "gm", "gt").agg(F.coalesce(F.sum(F.when(near, weight * F.col("impl_volatility"))) / F.sum(F.when(near, weight)), F.min_by("impl_volatility", F.struct("_d", "dte", "moneyness", "is_call"))).alias("iv"))
    name = lambda m, t: f"iv_surf_{round(m * 100):03d}_{t:03d}"
    wide = cell.groupBy(*KEYS).agg(*[F.max(F.when((F.col("gm") == m) & (F.col("gt") == t), F.col("iv"))).alias(name(m, t)) for m in MONEYNESS_GRID for t in DTE_GRID])
    c = lambda m, t: F.col(name(m, t))
    shape = wide.withColumns({"level": c(1.0, 30), "skew30": c(0.9, 30) - c(1.1, 30), "skew90": c(0.9, 90) - c(1.1, 90), "term": c(1.0, 90) - c(1.0, 30), "curvature": c(0.9, 30) + c(1.1, 30) - 2 * c(1.0, 30)})
    return chain.select(*KEYS).distinct().join(shape, KEYS, "left")


def bucket(x: Column, edges: list[float]) -> Column:
    """Right-closed bins, the lowest edge included; null outside."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), 0)
    for i in range(1, len(edges) - 1):
        out = out.when((x > edges[i]) & (x <= edges[i + 1]), i)
    return out


def stratified_sample(chain: DataFrame, budget: int, money: list[float], days: list[float]) -> DataFrame:
    """At most ``budget`` contracts a (entity, date): each moneyness x expiry bucket gets one and its share of the rest by volume, most traded first.

    With more occupied buckets than the budget the last ``budget`` of them, in
    order of moneyness and expiry, keep one each. Dates within the budget keep
    all rows.
    """
    day = Window.partitionBy(*KEYS)
    b = chain.withColumn("_m", bucket(F.col("moneyness"), money)).withColumn("_t", bucket(F.col("dte"), days)).withColumn("_all", F.count("*").over(day))
    cell = Window.partitionBy(*KEYS, "_m", "_t")
    inside = F.col("_m").isNotNull() & F.col("_t").isNotNull()
    b = b.withColumn("_in", F.sum(F.when(inside, F.col("volume"))).over(day)).withColumn("_size", F.sum("volume").over(cell)).withColumn("_cells", F.size(F.collect_set(F.when(inside, F.struct("_m", "_t"))).over(day)))
    place = F.dense_rank().over(day.orderBy((~inside).cast("int"), "_m", "_t"))
    spread = F.when(F.col("_in") > 0, 1 + F.floor(F.col("_size") / F.col("_in") * (budget - F.col("_cells")))).otherwise(1)
    b = b.withColumn("_place", place)
    quota = F.when(F.col("_cells") > budget, (F.col("_place") > F.col("_cells") - budget).cast("int")).otherwise(spread)
    rank = F.row_number().over(cell.orderBy(F.desc("volume"), "dte", "strike", "is_call"))
    return b.withColumn("_rank", rank).where((F.col("_all") <= budget) | (inside & (F.col("_rank") <= quota))).drop("_m", "_t", "_all", "_in", "_size", "_cells", "_place", "_rank")


TENSOR = ("moneyness", "tau", "is_call", "impl_volatility", "delta", "gamma", "vega", "log_volume", "log_oi", "spread_pct")


def prepared(chain: DataFrame, names: tuple[str, str] = ("", "")) -> DataFrame:
    """The chain with the ten measures of a contract as doubles, missing ones 0: years to expiry and logs of volume and open interest among them.

    ``names`` are a prefix and a suffix of the measures' columns.
    """
    made = {"tau": F.col("dte") / 365, "log_volume": F.log1p(F.greatest("volume", F.lit(0))), "log_oi": F.log1p(F.greatest("open_interest", F.lit(0)))}
    return chain.withColumns({f"{names[0]}{x}{names[1]}": F.coalesce(made.get(x, F.col(x) if x in chain.columns else F.lit(None)).cast("double"), F.lit(0.0)) for x in TENSOR})


def contract_tensor(chain: DataFrame, budget: int = 300) -> DataFrame:
    """The most traded contracts of a (entity, date) by expiry and moneyness: padded rows, mask, raw count."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("volume"), "dte", "strike", "is_call"))
    c = prepared(chain.withColumns({"_rank": rank, "_n": F.count("*").over(Window.partitionBy(*KEYS))}).where(F.col("_rank") <= budget), ("_x_", ""))
    row = F.array(*[F.col(f"_x_{x}") for x in TENSOR])
    t = c.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("dte", "moneyness", "is_call", row.alias("x")))).alias("_r"), F.max("_n").alias("n_raw"))
    return _padded(t, F.transform("_r", lambda r: r["x"]), budget, len(TENSOR))


def _padded(t: DataFrame, rows: Column, size: int, width: int) -> DataFrame:
    empty = F.array_repeat(F.array_repeat(F.lit(0.0), width), F.lit(size) - F.size("_r"))
    return t.select(*KEYS, F.concat(rows, empty).alias("tensor"), F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: i <= F.size("_r")).alias("mask"), "n_raw")


def chain_summary(chain: DataFrame) -> DataFrame:
    """Sixteen measures of each (entity, date, expiry)."""
    call, put, m = F.col("is_call") == 1, F.col("is_call") == 0, F.col("moneyness")
    n = lambda c: F.sum(F.when(c, F.col("volume")).otherwise(0)).cast("double")
    oi = lambda c: F.sum(F.when(c, F.col("open_interest")).otherwise(0)).cast("double")
    iv = F.col("impl_volatility")
    near = lambda d, c: F.min_by(iv, F.when(c, F.struct(d, "strike", "is_call")))
    t = F.lit(True)
    out = chain.groupBy(*SMILE).agg(
        F.count("*").cast("double").alias("contracts"), n(t).alias("volume"), oi(t).alias("open_interest"), ratio(n(put), n(call)).alias("pc_volume"), ratio(oi(put), oi(call)).alias("pc_oi"),
        near(F.abs(m - 1), t).alias("atm_iv"), near(F.abs(F.col("delta") + 0.25), put).alias("_p25"), near(F.abs(F.col("delta") - 0.25), call).alias("_c25"),
        F.avg(iv).alias("mean_iv"), F.stddev_pop(iv).alias("std_iv"), ratio(F.sum(F.col("volume") * iv), n(t)).alias("vw_iv"), ratio(F.sum(F.col("volume") * m), n(t)).alias("vw_moneyness"), F.avg("spread_pct").alias("spread"),
        F.sum(F.col("open_interest") * F.col("gamma") * F.when(call, 1).otherwise(-1)).alias("net_gamma"), F.sum(F.col("volume") * F.col("delta")).alias("net_delta"), F.max(m).alias("max_moneyness"),
    )
    return out.withColumn("skew25", F.coalesce(F.col("_p25") - F.col("_c25"), F.lit(0.0))).withColumn("tau", F.col("dte") / 365).drop("_p25", "_c25")


SUMMARY = ("tau", "contracts", "volume", "open_interest", "pc_volume", "pc_oi", "atm_iv", "skew25", "mean_iv", "std_iv", "vw_iv", "vw_moneyness", "spread", "net_gamma", "net_delta", "max_moneyness")


def chain_tensor(chain: DataFrame, budget: int = 20) -> DataFrame:
    """The first expiries of a (entity, date) as padded rows of their summaries, missing values 0."""
    s = chain_summary(chain).withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS))).withColumn("_rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy("dte"))).where(F.col("_rank") <= budget)
    row = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in SUMMARY])
    t = s.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("dte", row.alias("x")))).alias("_r"), F.max("_n").alias("n_raw"))
    return _padded(t, F.transform("_r", lambda r: r["x"]), budget, len(SUMMARY))


def tensor_coverage(tensors: DataFrame, spine: DataFrame) -> DataFrame:
    """Mean raw rows a date and share of the spine's dates with any, by entity."""
    j = spine.select(*KEYS).distinct().join(tensors.select(*KEYS, "n_raw"), KEYS, "left").withColumn("n", F.coalesce("n_raw", F.lit(0)))
    return j.groupBy("ticker").agg(F.avg("n").alias("mean_rows"), F.avg((F.col("n") > 0).cast("int")).alias("covered"))
