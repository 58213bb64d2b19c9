"""Queries over surfaces, tensors, walk-forward models and injected signals, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelforge.functions.scalars import correlation
from panelforge.functions.windows import by, demean, forward_realised_vol
from panelforge.operators import boosting, grid, inference, linear, networks, panel, surface, walkforward
from panelforge.plans.evaluation_queries import _ic
from panelforge.plans.rounding import rounded, sql_rounded as R
from panelforge.sources.tables import bars, contracts, ctes, materialize, preds, shared_dir

K = ["ticker", "date"]
col = F.col
MONEY, DAYS = [0.8, 0.9, 0.95, 1.05, 1.1, 1.2], [0, 45, 75, 180]


def svi_fit(spark, d):
    """Headline smile parameters and the shape of the delta grid."""
    smiles = materialize(surface.fit_svi(contracts(spark, d)), "smiles")
    return rounded(surface.headline(smiles).join(surface.grid_shape(surface.delta_grid(smiles)), K, "left"))


def svi_diagnostics(spark, d):
    c = contracts(spark, d)
    return rounded(surface.fit_quality(surface.fit_svi(c), c))


def iv_grid(spark, d):
    return rounded(surface.moneyness_grid(contracts(spark, d)), 4)


def stratified_sample(spark, d):
    """Contracts kept a date under a budget of 15, and of 4, below the number of occupied cells."""
    c = materialize(contracts(spark, d), "contracts")
    parts = [surface.stratified_sample(c, b, MONEY, DAYS).withColumn("budget", F.lit(b)) for b in (15, 4)]
    return parts[0].unionByName(parts[1]).groupBy("budget", *K).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.sum("open_interest").alias("open_interest"), F.countDistinct("moneyness", "dte").alias("places"))


def contract_tensor(spark, d):
    """Digest of the padded tensors: size, filled rows, raw rows, sums of two measures, first row's expiry."""
    t = surface.contract_tensor(contracts(spark, d), 12)
    total = lambda i: F.aggregate("tensor", F.lit(0.0), lambda a, r: a + r[i])
    return rounded(t.select(*K, F.size("tensor").alias("size"), F.size(F.filter("mask", lambda m: m)).alias("filled"), "n_raw", total(0).alias("moneyness"), total(7).alias("log_volume"), col("tensor")[0][1].alias("first_tau")))


def chain_tensor(spark, d):
    t = surface.chain_tensor(contracts(spark, d), 3)
    at = lambda r, c: col("tensor")[r][surface.SUMMARY.index(c)]
    return rounded(t.select(*K, "n_raw", F.size("tensor").alias("size"), at(0, "contracts").alias("contracts0"), at(0, "pc_volume").alias("pc0"), at(1, "vw_iv").alias("iv1"), at(2, "net_delta").alias("delta2"), at(0, "skew25").alias("skew0"), at(0, "atm_iv").alias("atm0")))


def tensor_coverage(spark, d):
    c = contracts(spark, d)
    return rounded(surface.tensor_coverage(surface.contract_tensor(c, 12), bars(spark, d, "month")))


def windows_embargo(spark, d):
    n = bars(spark, d).agg(F.max("date_idx")).first()[0] + 1
    a = walkforward.windows(spark, n, "expanding", 120, 13, embargo=3).withColumn("scheme", F.lit("expanding"))
    b = walkforward.windows(spark, n, "rolling", 52, 13, embargo=3).withColumn("scheme", F.lit("rolling"))
    return a.unionByName(b)


def wf_benchmarks(spark, d):
    """Zero, mean, majority and one-feature OLS in every expanding window, in one job."""
    p = materialize(preds(spark, d).where("horizon = 1"), "panel")
    wins = walkforward.windows(spark, p.agg(F.max("date_idx")).first()[0] + 1, "expanding", 120, 13, embargo=3)
    fits = walkforward.closed_form(p, wins, "pred", "y_raw", ["feature_set"])
    return rounded(fits.join(walkforward.score_windows(p, wins, fits, "pred", "y_raw", ["feature_set"]), ["feature_set", "window"]), 4)


def _features(spark, d):
    p = preds(spark, d).where("horizon = 1")
    wide = p.groupBy("ticker", "date", "date_idx").pivot("feature_set", ["A", "B", "C"]).agg(F.max("pred"))
    y = p.groupBy("ticker", "date").agg(F.max("y_raw").alias("target"))
    return materialize(wide.join(y, ["ticker", "date"]), "features")


def _score(p):
    return rounded(p.groupBy("window").agg(correlation("pred", "target").alias("corr"), F.sqrt(F.avg((col("pred") - col("target")) * (col("pred") - col("target")))).alias("rmse"), F.count("*").alias("n")), 4)


def wf_linear(spark, d):
    """Ridge-stabilised OLS and cross-validated elastic net over expanding windows, each in one job."""
    panel = _features(spark, d).where("target is not null").withColumn("cell", F.lit("all"))
    wins = walkforward.windows(spark, panel.agg(F.max("date_idx")).first()[0] + 1, "expanding", 120, 13, embargo=1)
    names, parts = ["A", "B", "C"], []
    for model in ("ols", "elastic_net"):
        fits = linear.linear_windows(panel, wins, names, "target", ["cell"], model)
        parts.append(_score(walkforward.predict_windows(panel, wins, fits, names, ["cell"])).withColumn("model", F.lit(model)))
    return parts[0].unionByName(parts[1])


def _late(spark, panel):
    """Expanding windows of 13 dates after the first 200."""
    return walkforward.windows(spark, panel.agg(F.max("date_idx")).first()[0] + 1, "expanding", 200, 13, embargo=1)


def wf_gbt(spark, d):
    """Boosted trees over expanding windows, all windows in one job."""
    panel = _features(spark, d)
    return _score(boosting.boosted_windows(panel, _late(spark, panel), ["A", "B", "C"], "target"))


def wf_direction(spark, d):
    """Boosted and neural direction classifiers: hit rate by window."""
    panel = _features(spark, d).where("target is not null").withColumn("up", F.when(col("target") > 0, 1.0).otherwise(0.0))
    wins, of = _late(spark, panel), (["A", "B", "C"], "up")
    models = {"gbt": boosting.boosted_windows(panel, wins, *of, settings=boosting.Booster(loss="logistic")), "mlp": networks.network_windows(panel, wins, *of)}
    parts = [p.select("window", "up", "pred").withColumn("model", F.lit(name)) for name, p in models.items()]
    hit = F.avg(F.when((col("pred") >= 0.5) == (col("up") == 1), 1.0).otherwise(0.0))
    return rounded(parts[0].unionByName(parts[1]).groupBy("window", "model").agg(hit.alias("hit"), F.count("*").alias("n")))


def wf_experiment(spark, d):
    """Regression and direction boosters fitted in the same windows: error, hit rate of each, and how often they agree."""
    panel = _features(spark, d)
    p = boosting.experiment(panel, _late(spark, panel), ["A", "B", "C"], "target")
    up, hit = col("up") >= 0.5, lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rounded(p.groupBy("window").agg(F.sqrt(F.avg((col("pred") - col("target")) * (col("pred") - col("target")))).alias("rmse"), hit((col("pred") > 0) == (col("target") > 0)).alias("hit_value"), hit(up == (col("target") > 0)).alias("hit_direction"), hit(up == (col("pred") > 0)).alias("agree"), F.count("*").alias("n")), 4)


def tree_attribution(spark, d):
    """Mean absolute contribution of each feature to the boosted predictions, its share, rank and bootstrap interval over dates.

    ``gap`` is the largest distance of base and contributions from a prediction: 0 up to rounding.
    """
    panel = _features(spark, d)
    p = materialize(boosting.boosted_windows(panel, _late(spark, panel), ["A", "B", "C"], "target"), "boosted")
    gap = p.agg(F.max(F.abs(F.aggregate("contributions", col("base"), lambda a, x: a + x) - col("pred"))).alias("gap"))
    each = p.select("date", F.posexplode("contributions").alias("i", "c")).select("date", F.element_at(F.array(*map(F.lit, "ABC")), col("i") + 1).alias("feature"), F.abs("c").alias("value"))
    total = each.agg(F.sum("value").alias("total"))  # one row, as is the gap
    share = each.groupBy("feature").agg(F.sum("value").alias("value")).crossJoin(F.broadcast(total)).select("feature", F.try_divide("value", "total").alias("share"))
    out = inference.bootstrap(each, ["feature"], "value", "date").drop("p").join(inference.bootstrap_ranks(each, "feature", "value", "date"), "feature").join(share, "feature")
    return rounded(out.crossJoin(F.broadcast(gap)), 9)


def feature_importance(spark, d):
    """Correlation that the least squares fit loses when a feature is shuffled within dates."""
    names = ["A", "B", "C"]
    p = _features(spark, d).where("target is not null").na.fill(0.0, names).withColumn("cell", F.lit("all"))
    whole = spark.createDataFrame([(0, 0, 1 << 40)], "window int, train_lo long, train_hi long")
    beta = walkforward.normal_equations(p, whole, names, "target", ["cell"]).first()["beta"]  # one number a feature
    predict = lambda x: sum((F.lit(float(b)) * x[f] for f, b in zip(names, beta[1:], strict=True)), F.lit(float(beta[0])))
    return rounded(walkforward.permutation_importance(materialize(p, "filled"), names, predict, "target"), 4)


STRENGTHS, SEEDS = (0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15), (1, 2, 3)


def _planted(spark, d):
    """Every row of one feature set at every strength and seed, with the planted target taken from its date's mean."""
    grid = spark.createDataFrame([(s, k) for s in STRENGTHS for k in SEEDS], "strength double, seed int")
    wide = _features(spark, d)
    p = preds(spark, d).where("horizon = 1 and feature_set = 'C'").select("ticker", "date", "date_idx", "y_demeaned").join(wide.select("ticker", "date", "A", "B", "C"), ["ticker", "date"])
    out = walkforward.inject_signal(p.crossJoin(F.broadcast(grid)), "y_demeaned", col("strength"), ["strength", "seed"], col("seed"))
    return out.withColumn("y_planted", F.round(demean("y_planted", "strength", "seed", "date"), 9)).withColumn("z", F.round("z", 9))


def signal_injection(spark, d):
    """Oracle IC of a planted signal by strength over three seeds: rises with strength, near 0 for the placebo."""
    ic = inference.daily_ic(_planted(spark, d), "z", "y_planted", ["strength", "seed", "date"]).groupBy("strength", "seed").agg(F.avg("ic").alias("ic"), F.count("*").alias("n"))
    return rounded(ic.groupBy("strength").agg(F.avg("ic").alias("ic"), F.min("ic").alias("lowest"), F.max("ic").alias("highest"), F.max("n").alias("days")))


def signal_recovery(spark, d):
    """IC, t and surviving seeds of walk-forward models fitted to the planted targets, by strength and model.

    ``ols`` is fitted on the features and the signal, ``ridge`` the same with a
    heavy penalty, ``without`` on the features alone, ``elastic_net`` with the
    penalty chosen by folds. All strengths, seeds and
    windows are fitted in one job each.
    """
    p = materialize(_planted(spark, d), "planted")
    wins = walkforward.windows(spark, p.agg(F.max("date_idx")).first()[0] + 1, "expanding", 120, 13, embargo=1)
    out = None
    for model, features, penalty in (("ols", ["A", "B", "C", "z"], 0.0), ("ridge", ["A", "B", "C", "z"], 100.0), ("without", ["A", "B", "C"], 0.0), ("elastic_net", ["A", "B", "C", "z"], None)):
        of = (p, wins, features, "y_planted", ["strength", "seed"])
        fits = linear.linear_windows(*of) if penalty is None else walkforward.normal_equations(*of, ridge=penalty)
        part = walkforward.predict_windows(p, wins, fits, features, ["strength", "seed"]).select("strength", "seed", "date", "pred", "y_planted").withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    ic = materialize(inference.daily_ic(out, "pred", "y_planted", ["strength", "model", "seed", "date"]), "recovered")
    t = inference.newey_west(ic, "ic", ["strength", "model", "seed"], "date")
    return rounded(t.groupBy("strength", "model").agg(F.avg("mean").alias("ic"), F.min("mean").alias("lowest"), F.max("mean").alias("highest"), F.avg("t").alias("t"), F.count(F.when(F.abs("t") > 3, 1)).alias("surviving"), F.count("*").alias("seeds")), 4)


def ols_coefficients(spark, d):
    """Coefficient table of the three-feature OLS of the last expanding window."""
    p = _features(spark, d)
    wins = walkforward.windows(spark, p.agg(F.max("date_idx")).first()[0] + 1, "expanding", 120, 13, embargo=1)
    last = wins.orderBy(F.desc("window")).limit(1)
    fits = walkforward.normal_equations(p.withColumn("cell", F.lit("all")), last, ["A", "B", "C"], "target", ["cell"])
    return rounded(walkforward.coefficients(fits, ["A", "B", "C"], ["cell"]).drop("cell"))


def _grid_cells(spark, p, models):
    names = spark.createDataFrame([(m, s) for m in models for s in ("expanding", "rolling")], "model string, scheme string")
    return p.select("feature_set", "horizon").distinct().crossJoin(F.broadcast(names))


def _grid_windows(spark, p):
    n = p.agg(F.max("date_idx")).first()[0] + 1
    return {s: walkforward.windows(spark, n, s, t, 13, embargo=3) for s, t in (("expanding", 120), ("rolling", 52))}


CELL = ["feature_set", "horizon", "model", "scheme"]


def _grid(spark, p, models, settings=boosting.Booster()):
    """The result table of a grid over the prediction panel ``p``; its last half is computed by a second, resumed run."""
    wins, keys = _grid_windows(spark, p), ["feature_set", "horizon"]
    table = grid.ResultTable(spark, f"{shared_dir(spark)}/grid-{uuid.uuid4().hex}", CELL)

    def compute(unit, cells):
        of, model = wins[unit["scheme"]], unit["model"]
        mine = p.drop("model", "scheme").join(F.broadcast(cells.select(*keys)), keys, "left_semi")
        base = walkforward.closed_form(mine, of, "pred", "y_raw", keys)
        if model == "boosted":
            rows = boosting.boosted_windows(mine.withColumnRenamed("pred", "x"), of, ["x"], "y_raw", tuple(keys), settings=settings).join(base.select(*keys, "window", "mean"), [*keys, "window"])
        else:
            fits = linear.linear_windows(mine, of, ["pred"], "y_raw", keys, model) if model == "elastic_net" else base.withColumn("beta", F.array(F.when(F.lit(model) == "ols", col("alpha")).when(F.lit(model) == "mean", col("mean")).otherwise(0.0), F.when(F.lit(model) == "ols", col("beta")).otherwise(0.0)))
            rows = walkforward.predict_windows(mine.withColumnRenamed("pred", "x"), of, fits, ["x"], keys).join(base.select(*keys, "window", "mean"), [*keys, "window"])
        return rows.select(*keys, F.lit(model).alias("model"), F.lit(unit["scheme"]).alias("scheme"), "window", "ticker", "date", "pred", col("y_raw").alias("y"), "mean")

    cells = materialize(_grid_cells(spark, p, models), "cells")
    for part in (cells.where("horizon = 1"), cells):
        grid.run(table, part, ["model", "scheme"], compute)
    return table


def grid_run(spark, d):
    """Metrics of horizon x set x model x scheme x window; the cells of horizon 1 are run first, a second run adds what is pending."""
    table = _grid(spark, materialize(preds(spark, d), "panel"), ("zero", "mean", "ols"))
    return rounded(grid.window_metrics(table.read(), CELL).drop("rmse"), 4)


def pooled_run(spark, d):
    """Metrics of each cell over all its windows together, against the mean of the training means."""
    table = _grid(spark, materialize(preds(spark, d), "panel"), ("zero", "mean", "ols"))
    return rounded(grid.pooled_metrics(table.read(), CELL), 4)


def model_grid(spark, d):
    """Pooled metrics of the elastic net and of boosted trees over the whole grid."""
    table = _grid(spark, materialize(preds(spark, d), "panel"), ("elastic_net", "boosted"))
    return rounded(grid.pooled_metrics(table.read(), CELL), 4)


def vol_model_grid(spark, d):
    """The same models, pooled, for the next three weeks' realised volatility from the last value of it and two returns."""
    b = bars(spark, d).withColumn("next", F.lead("ret").over(by()))
    p = materialize(b.withColumn("target", forward_realised_vol(col("next"), 3, by())).withColumn("size", F.abs("ret")).withColumn("before", F.lag("size").over(by())).where("target is not null").select("ticker", "date", "date_idx", "ret", "size", "before", "target", F.lit("all").alias("cell")), "panel")
    of, names = walkforward.windows(spark, p.agg(F.max("date_idx")).first()[0] + 1, "rolling", 104, 13, embargo=3), ["ret", "size", "before"]
    mean = walkforward.closed_form(p, of, "size", "target", ["cell"]).select("window", "mean")
    parts = {"elastic_net": walkforward.predict_windows(p, of, linear.linear_windows(p, of, names, "target", ["cell"]), names, ["cell"]), "boosted": boosting.boosted_windows(p, of, names, "target", ("cell",))}
    rows = [r.join(F.broadcast(mean), "window").select(F.lit(m).alias("model"), "window", "pred", col("target").alias("y"), "mean") for m, r in parts.items()]
    return rounded(grid.pooled_metrics(materialize(rows[0].unionByName(rows[1]), "vol"), ["model"]), 4)


def determinism(spark, d):
    """Cells of the grid computed once more, against their saved table: how many windows there are, and the largest difference."""
    p = materialize(preds(spark, d), "panel")
    table = _grid(spark, p, ("mean", "ols"))
    saved = grid.window_metrics(table.read(), CELL)
    again = walkforward.run_grid(_grid_cells(spark, p, ("mean", "ols")), p.repartition(7, "date"), _grid_windows(spark, p), "pred", "y_raw", ["feature_set", "horizon"])
    return rounded(walkforward.differences(saved, again, [*CELL, "window"], "r2"), 6)


def tensor_panel(spark, d):
    """Contract tensors written with mask and count, read back, and aligned with the panel; every filled cell of four measures."""
    saved = materialize(surface.contract_tensor(contracts(spark, d), 12), "tensors")
    both = panel.aligned(saved, bars(spark, d, "month").where("ret is not null").select(*K, "ret"), K)
    rows = both.select(*K, "n_raw", "ret", F.posexplode(F.arrays_zip("tensor", "mask")).alias("row", "x")).where("x.mask")
    at = lambda name: col("x.tensor")[surface.TENSOR.index(name)]
    return rounded(rows.select(*K, "n_raw", "ret", "row", at("moneyness").alias("moneyness"), at("tau").alias("tau"), at("impl_volatility").alias("iv"), at("log_oi").alias("log_oi")))


def contract_measures(spark, d):
    """Sums of the ten prepared measures of a date's contracts."""
    c = surface.prepared(contracts(spark, d), ("x_", ""))
    return rounded(c.groupBy("date").agg(*[F.sum(f"x_{x}").alias(x) for x in surface.TENSOR]), 4)


QUERIES = {f.__name__: f for f in (svi_fit, svi_diagnostics, iv_grid, stratified_sample, contract_tensor, chain_tensor, tensor_coverage, windows_embargo, wf_benchmarks, wf_linear, wf_gbt, wf_direction, wf_experiment, tree_attribution, feature_importance, determinism, signal_injection, signal_recovery, ols_coefficients, grid_run, pooled_run, model_grid, vol_model_grid, tensor_panel, contract_measures)}

B, C, P = ctes("bars"), ctes("contracts"), ctes("preds")


_GRID = f"""{P}, n AS (SELECT MAX(date_idx) + 1 AS n FROM preds), w AS (SELECT 'expanding' AS scheme, CAST((t - 120) / 13 AS INT) AS win, 0 AS lo, t - 3 AS hi, t, LEAST(t + 13, n) AS te FROM n JOIN range(120, 5000, 13) r(t) ON t < n - 13 UNION ALL SELECT 'rolling', CAST((t - 52) / 13 AS INT), t - 52, t - 3, t, LEAST(t + 13, n) FROM n JOIN range(52, 5000, 13) r(t) ON t < n - 13),
s AS (SELECT feature_set, horizon, w.scheme AS scheme, w.win, AVG(y_raw) AS mean, REGR_SLOPE(y_raw, pred) AS beta, REGR_INTERCEPT(y_raw, pred) AS alpha FROM preds JOIN w ON date_idx >= lo AND date_idx < hi GROUP BY 1, 2, 3, 4),
x AS (SELECT o.feature_set, o.horizon, m.model AS model, w.scheme AS scheme, w.win, y_raw, mean, CASE m.model WHEN 'ols' THEN alpha + beta * pred WHEN 'mean' THEN mean ELSE 0 END AS p FROM preds o JOIN w ON date_idx >= w.t AND date_idx < te JOIN s ON s.feature_set = o.feature_set AND s.horizon = o.horizon AND s.scheme = w.scheme AND s.win = w.win CROSS JOIN (VALUES ('zero'), ('mean'), ('ols')) m(model))"""


def _case(x: str, edges: list[float]) -> str:
    return f"CASE WHEN {x} >= {edges[0]} AND {x} <= {edges[1]} THEN 0 " + " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN {i}" for i in range(1, len(edges) - 1)) + " END"


_NAMES = [(m, t, f"iv_surf_{round(m * 100):03d}_{t:03d}") for m in surface.MONEYNESS_GRID for t in surface.DTE_GRID]
_TOP = "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, date ORDER BY volume DESC, dte, strike, is_call) AS rk, COUNT(*) OVER (PARTITION BY ticker, date) AS n FROM contracts{where})"



def _least_squares(names: list[str]) -> str:
    """Coefficients of y on the columns x0, x1, ... of ``t``: each from what is left of its column without the others."""
    p, parts, ctes_ = len(names), [], []
    part = lambda x, e: f"{x} - SUM({x} * {e}) OVER () / SUM({e} * {e}) OVER () * {e} AS {x}"
    for j in range(p):
        order, source = [i for i in range(p) if i != j] + [j], "t"
        for step, i in enumerate(order):
            left = [f"x{o}" for o in order[step + 1 :]]
            ctes_.append(f"o{j}_{step} AS (SELECT win, y, {', '.join([f'x{o}' for o in order[: step + 1]] + [part(x, f'x{i}') for x in left])} FROM {source})")
            source = f"o{j}_{step}"
        sse = " - ".join(["SUM(y * y)", *[f"SUM(y * x{i}) * SUM(y * x{i}) / SUM(x{i} * x{i})" for i in range(p)]])
        parts.append(f"SELECT MAX(win) AS win, COUNT(*) AS n, '{names[j]}' AS feature, SUM(y * x{j}) / SUM(x{j} * x{j}) AS beta, SQRT(({sse}) / (COUNT(*) - {p}) / SUM(x{j} * x{j})) AS se FROM {source}")
    return ", ".join(ctes_) + f", c AS ({' UNION ALL '.join(parts)})"


_SMILE = "ticker, date, dte"


def _faces(p: str) -> list[tuple[str, str]]:
    """(d, c) of least error inside the bounds of a smile's fit, on their edges and at their corners."""
    det, top, least, rho = f"({p}yy * {p}zz - {p}yz * {p}yz)", f"({surface.SLOPE} * sigma)", f"{surface.LEAST_C:.6f}", surface.RHO
    when = f"CASE WHEN {det} > {surface.PLANE} * {p}yy * {p}zz THEN "
    edge = {r: f"({r} * {p}yw + {p}zw) / ({r} * {r} * {p}yy + 2 * {r} * {p}yz + {p}zz)" for r in (rho, -rho)}
    inside = [(f"{when}({p}yw * {p}zz - {p}zw * {p}yz) / {det} END", f"{when}({p}zw * {p}yy - {p}yw * {p}yz) / {det} END")]
    return inside + [(f"{r} * {c}", c) for r, c in edge.items()] + [x for c in (top, least) for x in ((f"({p}yw - {c} * {p}yz) / {p}yy", c), (f"{rho} * {c}", c), (f"-{rho} * {c}", c))]


#: With the level free (moments about the means), then with the level at 0.
_FACES = _faces("c") + _faces("s")


def _solved(name: str, source: str) -> str:
    """Best (a, b, rho, m, sigma) of each smile over the (m, sigma) of the rows of ``source``, as ``name``."""
    pairs = [(a, b) for i, a in enumerate("1yzw") for b in "1yzw"[i:]]
    of = {"1": "1.0E0", "y": "y", "z": "z", "w": "w"}
    faces = ", ".join("{'i': " + f"{i}, 'd': CAST({d} AS DOUBLE), 'c': CAST({c} AS DOUBLE)" + "}" for i, (d, c) in enumerate(_FACES))
    half = len(_FACES) // 2
    sums = ", ".join(f"SUM(v * {of[a]} * {of[b]}) AS s{a}{b}" for a, b in pairs)
    return f"""{name}y AS (SELECT *, SQRT(y * y + 1) AS z FROM (SELECT *, (k - m) / sigma AS y FROM {source}) x), {name}s AS (SELECT {_SMILE}, m, sigma, COUNT(*) AS n, {sums} FROM {name}y GROUP BY {_SMILE}, m, sigma),
{name}m AS (SELECT *, syy - s1y * s1y AS cyy, szz - s1z * s1z AS czz, syz - s1y * s1z AS cyz, syw - s1y * s1w AS cyw, szw - s1z * s1w AS czw FROM {name}s), {name}f AS (SELECT *, unnest([{faces}]) AS f FROM {name}m),
{name}c AS (SELECT *, f.i AS i, f.d AS d, f.c AS c FROM {name}f WHERE f.c >= {surface.LEAST_C} * (1 - 1E-9) AND f.c <= {surface.SLOPE} * sigma * (1 + 1E-9) AND ABS(f.d) <= {surface.RHO} * f.c * (1 + 1E-9)), {name}a AS (SELECT * FROM (SELECT *, CASE WHEN i < {half} THEN s1w - d * s1y - c * s1z ELSE 0 END AS a FROM {name}c) x WHERE a >= 0),
{name}e AS (SELECT *, ROUND(GREATEST(sww - 2 * (a * s1w + d * syw + c * szw) + a * a + d * d * syy + c * c * szz + 2 * (a * d * s1y + a * c * s1z + d * c * syz), 0), 14) AS sse FROM {name}a),
{name} AS (SELECT {_SMILE}, a, c / sigma AS b, d / c AS rho, m, sigma, SQRT(sse / n) AS rmse FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_SMILE} ORDER BY sse, m, sigma, i) AS rk FROM {name}e) x WHERE rk = 1)"""


_SVI = f"""pt AS (SELECT * FROM (SELECT {_SMILE}, LN(strike / (underlying_price * EXP(0.02E0 * (dte / 365.0E0)))) AS k, impl_volatility * impl_volatility * (dte / 365.0E0) AS w, (volume + 1.0E0) / SUM(volume + 1.0E0) OVER s AS v, COUNT(*) OVER s AS quotes FROM contracts WHERE impl_volatility > 0 AND dte > 0 WINDOW s AS (PARTITION BY {_SMILE})) x WHERE quotes >= 5),
gr AS (SELECT m, sigma FROM (VALUES {', '.join(f'({m}E0, {s}E0)' for m, s in surface.GRID)}) t(m, sigma)), p1 AS (SELECT pt.*, m, sigma FROM pt CROSS JOIN gr), {_solved('co', 'p1')},
p2 AS (SELECT pt.*, co.m + dm AS m, co.sigma * fs AS sigma FROM pt JOIN co ON pt.ticker = co.ticker AND pt.date = co.date AND pt.dte = co.dte CROSS JOIN (VALUES (-0.05E0), (0.0E0), (0.05E0)) u(dm) CROSS JOIN (VALUES (0.7E0), (1.0E0), (1.4E0)) o(fs)), {_solved('svi', 'p2')},
hd AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, date ORDER BY ABS(dte - 30), dte) AS rk FROM svi) x WHERE rk = 1)"""
_VOL = "SQRT(GREATEST(a + b * (rho * ({k} - m) + SQRT(({k} - m) * ({k} - m) + sigma * sigma)), 1E-8) / tau)"

ORACLES = {
    "svi_diagnostics": f"""{C}, {_SVI}, j AS (SELECT t.*, rmse, b * (1 + ABS(rho)) AS wing FROM (SELECT DISTINCT {_SMILE} FROM contracts) t LEFT JOIN svi ON t.ticker = svi.ticker AND t.date = svi.date AND t.dte = svi.dte),
f AS (SELECT COUNT(*) AS smiles, AVG(CASE WHEN rmse IS NULL THEN 0.0 ELSE 1 END) AS fitted, AVG(rmse) AS rmse, QUANTILE_CONT(rmse, 0.5) AS rmse_median, QUANTILE_CONT(rmse, 0.9) AS rmse_p90, AVG(wing) AS wing, QUANTILE_CONT(wing, 0.5) AS wing_median, QUANTILE_CONT(wing, 0.95) AS wing_p95, AVG(CAST(wing > 2 AS INT)) AS wing_over2, AVG(CAST(wing > 4 AS INT)) AS wing_over4 FROM j)
SELECT smiles, {R('fitted rmse rmse_median rmse_p90 wing wing_median wing_p95 wing_over2 wing_over4')} FROM f""",
    "svi_fit": f"""{C}, {_SVI}, te AS (SELECT UNNEST([30, 90]) AS tenor), ct AS (SELECT *, dte / 365.0E0 AS tau FROM (SELECT svi.*, tenor, ROW_NUMBER() OVER (PARTITION BY ticker, date, tenor ORDER BY ABS(dte - tenor), dte) AS rk FROM svi CROSS JOIN te WHERE ABS(dte - tenor) <= tenor * 0.5) x WHERE rk = 1), am AS (SELECT *, {_VOL.format(k='0.0E0')} AS atm FROM ct),
ks AS (SELECT *, {', '.join(f'0.5E0 * atm * atm * tau - ({q}E0) * atm * SQRT(tau) AS k_{n}' for n, q in surface.DELTA_QUANTILES.items() if q)} FROM am),
vs AS (SELECT ticker, date, tenor, atm AS d50, {', '.join(f"{_VOL.format(k=f'k_{n}')} AS {n}" for n, q in surface.DELTA_QUANTILES.items() if q)} FROM ks),
gs AS (SELECT ticker, date, MAX(CASE WHEN tenor = 30 THEN d25 - d75 END) AS risk_reversal, MAX(CASE WHEN tenor = 30 THEN (d25 + d75) / 2 - d50 END) AS butterfly, MAX(CASE WHEN tenor = 90 THEN d50 END) - MAX(CASE WHEN tenor = 30 THEN d50 END) AS term_slope, MAX(CASE WHEN tenor = 30 THEN d10 - d90 END) AS wing_spread FROM vs GROUP BY 1, 2),
f AS (SELECT hd.ticker, hd.date, a AS svi_a, b AS svi_b, rho AS svi_rho, m AS svi_m, sigma AS svi_sigma, rmse AS svi_rmse, risk_reversal, butterfly, term_slope, wing_spread FROM hd LEFT JOIN gs ON hd.ticker = gs.ticker AND hd.date = gs.date)
SELECT ticker, date, {R('svi_a svi_b svi_rho svi_m svi_sigma svi_rmse risk_reversal butterfly term_slope wing_spread')} FROM f""",
    "feature_importance": f"""{P}, p AS (SELECT ticker, date, COALESCE(MAX(CASE WHEN feature_set = 'A' THEN pred END), 0) AS a, COALESCE(MAX(CASE WHEN feature_set = 'B' THEN pred END), 0) AS b, COALESCE(MAX(CASE WHEN feature_set = 'C' THEN pred END), 0) AS c, MAX(y_raw) AS y FROM preds WHERE horizon = 1 GROUP BY 1, 2),
t AS (SELECT 0 AS win, 1.0E0 AS x0, a AS x1, b AS x2, c AS x3, y FROM p), {_least_squares(['constant', 'A', 'B', 'C'])}, k AS (SELECT MAX(CASE WHEN feature = 'constant' THEN beta END) AS k0, MAX(CASE WHEN feature = 'A' THEN beta END) AS ka, MAX(CASE WHEN feature = 'B' THEN beta END) AS kb, MAX(CASE WHEN feature = 'C' THEN beta END) AS kc FROM c),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY md5(ticker || '|' || CAST(date AS VARCHAR) || '|42'), ticker) AS r, ROW_NUMBER() OVER (PARTITION BY date ORDER BY md5(ticker || '|' || CAST(date AS VARCHAR) || '|43'), ticker) AS s FROM p),
j AS (SELECT u.y, k0 + ka * u.a + kb * u.b + kc * u.c AS q, k0 + ka * v.a + kb * u.b + kc * u.c AS qa, k0 + ka * u.a + kb * v.b + kc * u.c AS qb, k0 + ka * u.a + kb * u.b + kc * v.c AS qc FROM o u JOIN o v ON u.date = v.date AND u.r = v.s CROSS JOIN k),
l AS (SELECT CORR(q, y) - CORR(qa, y) AS a, CORR(q, y) - CORR(qb, y) AS b, CORR(q, y) - CORR(qc, y) AS c FROM j), m AS (SELECT 'A' AS feature, a AS loss FROM l UNION ALL SELECT 'B', b FROM l UNION ALL SELECT 'C', c FROM l),
f AS (SELECT feature, loss, COALESCE(GREATEST(loss, 0) / NULLIF(SUM(GREATEST(loss, 0)) OVER (), 0), 0) AS share FROM m) SELECT feature, {R('loss share', 4)} FROM f""",
    "ols_coefficients": f"""{P}, p AS (SELECT ticker, date, date_idx, MAX(CASE WHEN feature_set = 'A' THEN pred END) AS a, MAX(CASE WHEN feature_set = 'B' THEN pred END) AS b, MAX(CASE WHEN feature_set = 'C' THEN pred END) AS c, MAX(y_raw) AS y FROM preds WHERE horizon = 1 GROUP BY 1, 2, 3),
w AS (SELECT MAX(r.t) AS t FROM (SELECT MAX(date_idx) + 1 AS n FROM p) m JOIN range(120, 5000, 13) r(t) ON r.t < n - 13), t AS (SELECT CAST((w.t - 120) / 13 AS INT) AS win, 1.0E0 AS x0, COALESCE(a, 0) AS x1, COALESCE(b, 0) AS x2, COALESCE(c, 0) AS x3, y FROM p JOIN w ON date_idx < w.t - 1),
{_least_squares(['constant', 'A', 'B', 'C'])}, f AS (SELECT *, beta / se AS t FROM c) SELECT win AS "window", n, feature, {R('beta se t')} FROM f""",
    "iv_grid": f"""{C}, l AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY ticker, date) AS n FROM contracts WHERE volume > 0 OR open_interest > 100) x WHERE n >= 5),
g AS ({' UNION ALL '.join(f"SELECT {m}E0 AS gm, {t} AS gt" for m, t, _ in _NAMES)}),
d AS (SELECT ticker, date, gm, gt, dte, moneyness, is_call, impl_volatility AS iv, ROUND(SQRT(POWER((moneyness - gm) / 0.05E0, 2) + POWER((dte - gt) / 30.0E0, 2)), 9) AS d FROM l CROSS JOIN g),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, date, gm, gt ORDER BY d, dte, moneyness, is_call) AS rk FROM d),
c AS (SELECT ticker, date, gm, gt, COALESCE(SUM(CASE WHEN d <= 1 THEN iv / (d + 0.01E0) END) / SUM(CASE WHEN d <= 1 THEN 1 / (d + 0.01E0) END), MAX(CASE WHEN rk = 1 THEN iv END)) AS iv FROM k GROUP BY 1, 2, 3, 4),
w AS (SELECT ticker, date, {', '.join(f"MAX(CASE WHEN gm = {m}E0 AND gt = {t} THEN iv END) AS {n}" for m, t, n in _NAMES)} FROM c GROUP BY 1, 2),
f AS (SELECT s.ticker, s.date, w.* EXCLUDE (ticker, date), iv_surf_100_030 AS level, iv_surf_090_030 - iv_surf_110_030 AS skew30, iv_surf_090_090 - iv_surf_110_090 AS skew90, iv_surf_100_090 - iv_surf_100_030 AS term, iv_surf_090_030 + iv_surf_110_030 - 2 * iv_surf_100_030 AS curvature FROM (SELECT DISTINCT ticker, date FROM contracts) s LEFT JOIN w ON s.ticker = w.ticker AND s.date = w.date)
SELECT ticker, date, {R(' '.join(n for *_, n in _NAMES) + ' level skew30 skew90 term curvature', 4)} FROM f""",
    "stratified_sample": f"""{C}, b AS (SELECT *, {_case('moneyness', MONEY)} AS m, {_case('dte', DAYS)} AS t FROM contracts), a AS (SELECT ticker, date, COUNT(*) AS al, SUM(CASE WHEN m IS NOT NULL AND t IS NOT NULL THEN volume END) AS tv, COUNT(DISTINCT CASE WHEN m IS NOT NULL AND t IS NOT NULL THEN m * 10 + t END) AS cells FROM b GROUP BY 1, 2),
k AS (SELECT *, SUM(volume) OVER (PARTITION BY ticker, date, m, t) AS cv, ROW_NUMBER() OVER (PARTITION BY ticker, date, m, t ORDER BY volume DESC, dte, strike, is_call) AS rk FROM b),
o AS (SELECT ticker, date, m, t, ROW_NUMBER() OVER (PARTITION BY ticker, date ORDER BY m, t) AS cr FROM (SELECT DISTINCT ticker, date, m, t FROM b WHERE m IS NOT NULL AND t IS NOT NULL) z)
SELECT g.budget, k.ticker, k.date, COUNT(*) AS n, CAST(SUM(volume) AS BIGINT) AS volume, CAST(SUM(open_interest) AS BIGINT) AS open_interest, COUNT(DISTINCT (moneyness, dte)) AS places FROM k JOIN a ON k.ticker = a.ticker AND k.date = a.date LEFT JOIN o ON k.ticker = o.ticker AND k.date = o.date AND k.m = o.m AND k.t = o.t CROSS JOIN (SELECT 15 AS budget UNION ALL SELECT 4) g
WHERE al <= budget OR (cr IS NOT NULL AND rk <= CASE WHEN cells > budget THEN CASE WHEN cr > cells - budget THEN 1 ELSE 0 END WHEN tv > 0 THEN 1 + FLOOR(CAST(cv AS DOUBLE) / CAST(tv AS DOUBLE) * (budget - cells)) ELSE 1 END) GROUP BY 1, 2, 3""",
    "contract_tensor": f"""{C}, {_TOP.format(where='')}, f AS (SELECT ticker, date, 12 AS size, COUNT(*) AS filled, MAX(n) AS n_raw, SUM(moneyness) AS moneyness, SUM(LN(1 + volume)) AS log_volume, MIN(dte) / 365.0E0 AS first_tau FROM r WHERE rk <= 12 GROUP BY 1, 2)
SELECT ticker, date, size, filled, n_raw, {R('moneyness log_volume first_tau')} FROM f""",
    "chain_tensor": f"""{C}, r AS (SELECT *, DENSE_RANK() OVER (PARTITION BY ticker, date ORDER BY dte) - 1 AS k, ROW_NUMBER() OVER (PARTITION BY ticker, date, dte ORDER BY ABS(moneyness - 1), strike, is_call) AS ra, ROW_NUMBER() OVER (PARTITION BY ticker, date, dte, is_call ORDER BY ABS(delta + CASE WHEN is_call = 1 THEN -0.25 ELSE 0.25 END), strike) AS rd FROM contracts),
s AS (SELECT ticker, date, k, COUNT(*) AS c, CASE WHEN SUM(CASE WHEN is_call = 1 THEN volume ELSE 0 END) > 0 THEN CAST(SUM(CASE WHEN is_call = 0 THEN volume ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN is_call = 1 THEN volume ELSE 0 END) END AS pc, SUM(volume * impl_volatility) / SUM(volume) AS vw, SUM(volume * delta) AS nd,
 COALESCE(MAX(CASE WHEN is_call = 0 AND rd = 1 THEN impl_volatility END) - MAX(CASE WHEN is_call = 1 AND rd = 1 THEN impl_volatility END), 0) AS sk, MAX(CASE WHEN ra = 1 THEN impl_volatility END) AS atm FROM r GROUP BY 1, 2, 3),
f AS (SELECT ticker, date, COUNT(*) AS n_raw, 3 AS size, COALESCE(MAX(CASE WHEN k = 0 THEN c END), 0) AS contracts0, COALESCE(MAX(CASE WHEN k = 0 THEN pc END), 0) AS pc0, COALESCE(MAX(CASE WHEN k = 1 THEN vw END), 0) AS iv1, COALESCE(MAX(CASE WHEN k = 2 THEN nd END), 0) AS delta2, MAX(CASE WHEN k = 0 THEN sk END) AS skew0, MAX(CASE WHEN k = 0 THEN atm END) AS atm0 FROM s GROUP BY 1, 2)
SELECT ticker, date, n_raw, size, {R('contracts0 pc0 iv1 delta2 skew0 atm0')} FROM f""",
    "tensor_coverage": f"""{C}, n AS (SELECT ticker, date, COUNT(*) AS n FROM contracts GROUP BY 1, 2), f AS (SELECT b.ticker, AVG(COALESCE(n, 0)) AS mean_rows, AVG(CASE WHEN n > 0 THEN 1.0 ELSE 0 END) AS covered FROM (SELECT DISTINCT ticker, date FROM bars_m) b LEFT JOIN n ON b.ticker = n.ticker AND b.date = n.date GROUP BY 1)
SELECT ticker, {R('mean_rows covered')} FROM f""",
    "windows_embargo": f"""{B}, n AS (SELECT MAX(date_idx) + 1 AS n FROM bars), e AS (SELECT n, t FROM n JOIN range(120, 5000, 13) r(t) ON t < n - 13), o AS (SELECT n, t FROM n JOIN range(52, 5000, 13) r(t) ON t < n - 13)
SELECT CAST((t - 120) / 13 AS INT) AS window, CAST(0 AS BIGINT) AS train_lo, t - 3 AS train_hi, t AS test_lo, LEAST(t + 13, n) AS test_hi, 'expanding' AS scheme FROM e UNION ALL SELECT CAST((t - 52) / 13 AS INT), t - 52, t - 3, t, LEAST(t + 13, n), 'rolling' FROM o""",
    "wf_benchmarks": f"""{P}, o AS (SELECT * FROM preds WHERE horizon = 1), n AS (SELECT MAX(date_idx) + 1 AS n FROM o), w AS (SELECT CAST((t - 120) / 13 AS INT) AS win, t - 3 AS hi, t, LEAST(t + 13, n) AS te FROM n JOIN range(120, 5000, 13) r(t) ON t < n - 13),
s AS (SELECT feature_set, w.win, COUNT(*) AS n, AVG(y_raw) AS mean, CASE WHEN AVG(CASE WHEN y_raw > 0 THEN 1.0 ELSE 0 END) >= 0.5 THEN 1 ELSE 0 END AS majority, REGR_SLOPE(y_raw, pred) AS beta, REGR_INTERCEPT(y_raw, pred) AS alpha, REGR_SXX(y_raw, pred) AS sxx, REGR_SYY(y_raw, pred) AS syy, REGR_SXY(y_raw, pred) AS sxy FROM o JOIN w ON date_idx < hi GROUP BY 1, 2),
t AS (SELECT o.feature_set, w.win, 1 - SUM(y_raw * y_raw) / SUM((y_raw - mean) * (y_raw - mean)) AS r2_zero, 1 - SUM((y_raw - alpha - beta * pred) * (y_raw - alpha - beta * pred)) / SUM((y_raw - mean) * (y_raw - mean)) AS r2_ols, AVG(CASE WHEN (y_raw > 0) = (majority = 1) THEN 1.0 ELSE 0 END) AS hit_majority, COUNT(*) AS n_test FROM o JOIN w ON date_idx >= w.t AND date_idx < te JOIN s ON s.feature_set = o.feature_set AND s.win = w.win GROUP BY 1, 2),
f AS (SELECT s.feature_set, s.win, n, mean, majority, beta, alpha, beta / SQRT((syy - beta * sxy) / (n - 2) / sxx) AS t, r2_zero, r2_ols, hit_majority, n_test FROM s JOIN t ON s.feature_set = t.feature_set AND s.win = t.win)
SELECT feature_set, win AS "window", n, majority, n_test, {R('mean beta alpha t r2_zero r2_ols hit_majority', 4)} FROM f""",
    "signal_injection": f"""{P}, o AS (SELECT ticker, date, y_demeaned AS y FROM preds WHERE horizon = 1 AND feature_set = 'C'), g AS (SELECT s.s AS strength, k.k AS seed FROM (VALUES {', '.join(f'({x}E0)' for x in STRENGTHS)}) s(s) CROSS JOIN (VALUES (1), (2), (3)) k(k)),
u AS (SELECT o.*, strength, seed, (CAST('0x' || substr(md5(ticker || '|' || date || '|' || seed || '|a'), 1, 13) AS BIGINT) + 0.5) / {1 << 52}E0 AS ua, (CAST('0x' || substr(md5(ticker || '|' || date || '|' || seed || '|b'), 1, 13) AS BIGINT) + 0.5) / {1 << 52}E0 AS ub FROM o CROSS JOIN g),
z AS (SELECT *, SQRT(-2 * LN(ua)) * COS(2 * PI() * ub) AS z FROM u), w AS (SELECT *, y + strength * STDDEV_SAMP(y) OVER (PARTITION BY strength, seed) / SQRT(1 - strength * strength) * z AS yp FROM z),
q AS (SELECT strength, seed, date, ROUND(z, 9) AS z, ROUND(yp - AVG(yp) OVER (PARTITION BY strength, seed, date), 9) AS yp FROM w), {_ic('i', 'q', 'z', 'yp', 'strength, seed, date', 5)},
m AS (SELECT strength, seed, AVG(ic) AS ic, COUNT(*) AS n FROM i GROUP BY 1, 2), f AS (SELECT strength, AVG(ic) AS ic, MIN(ic) AS lowest, MAX(ic) AS highest, MAX(n) AS days FROM m GROUP BY 1) SELECT {R('strength ic lowest highest')}, days FROM f""",
    "grid_run": f"""{_GRID},
f AS (SELECT feature_set, horizon, model, scheme, win, COUNT(*) AS n_test, 1 - SUM((y_raw - p) * (y_raw - p)) / SUM((y_raw - mean) * (y_raw - mean)) AS r2, AVG(CASE WHEN (y_raw > 0) = (p > 0) THEN 1.0 ELSE 0 END) AS hit FROM x GROUP BY 1, 2, 3, 4, 5) SELECT feature_set, horizon, model, scheme, win AS "window", n_test, {R('r2 hit', 4)} FROM f""",
    "determinism": f"""{_GRID},
f AS (SELECT feature_set, horizon, model, scheme, win FROM x WHERE model <> 'zero' GROUP BY 1, 2, 3, 4, 5) SELECT COUNT(*) AS cells, 0.0E0 AS max_difference FROM f""",
    "pooled_run": f"""{_GRID},
b AS (SELECT feature_set, horizon, model, scheme, AVG(mean) AS base, COUNT(*) AS windows FROM (SELECT feature_set, horizon, model, scheme, win, MAX(mean) AS mean FROM x GROUP BY 1, 2, 3, 4, 5) q GROUP BY 1, 2, 3, 4),
r AS (SELECT x.*, base, windows, RANK() OVER (PARTITION BY x.feature_set, x.horizon, x.model, x.scheme ORDER BY ROUND(p, 12)) + (COUNT(*) OVER (PARTITION BY x.feature_set, x.horizon, x.model, x.scheme, ROUND(p, 12)) - 1) / 2.0E0 AS pr,
 RANK() OVER (PARTITION BY x.feature_set, x.horizon, x.model, x.scheme ORDER BY ROUND(y_raw, 12)) + (COUNT(*) OVER (PARTITION BY x.feature_set, x.horizon, x.model, x.scheme, ROUND(y_raw, 12)) - 1) / 2.0E0 AS yr FROM x JOIN b ON x.feature_set = b.feature_set AND x.horizon = b.horizon AND x.model = b.model AND x.scheme = b.scheme),
f AS (SELECT feature_set, horizon, model, scheme, windows, COUNT(*) AS n, 1 - SUM((y_raw - p) * (y_raw - p)) / SUM((y_raw - base) * (y_raw - base)) AS r2, SQRT(AVG((y_raw - p) * (y_raw - p))) AS rmse, AVG(CASE WHEN (y_raw > 0) = (p > 0) THEN 1.0 ELSE 0 END) AS hit, CASE WHEN MIN(pr) < MAX(pr) AND MIN(yr) < MAX(yr) THEN CORR(pr, yr) END AS ic FROM r GROUP BY 1, 2, 3, 4, 5)
SELECT feature_set, horizon, model, scheme, windows, n, {R('r2 rmse hit ic', 4)} FROM f""",
    "tensor_panel": f"""{C}, {_TOP.format(where='')}, f AS (SELECT r.ticker, r.date, n AS n_raw, ret, CAST(ROW_NUMBER() OVER (PARTITION BY r.ticker, r.date ORDER BY dte, moneyness, is_call) - 1 AS INT) AS row, moneyness, dte / 365.0E0 AS tau, impl_volatility AS iv, LN(1 + open_interest) AS log_oi FROM r JOIN bars_m b ON r.ticker = b.ticker AND r.date = b.date WHERE rk <= 12 AND ret IS NOT NULL)
SELECT ticker, date, n_raw, row, {R('ret moneyness tau iv log_oi')} FROM f""",
    "contract_measures": f"""{C}, f AS (SELECT date, SUM(moneyness) AS moneyness, SUM(dte / 365.0E0) AS tau, SUM(is_call) AS is_call, SUM(impl_volatility) AS impl_volatility, SUM(delta) AS delta, SUM(gamma) AS gamma, SUM(vega) AS vega, SUM(LN(1 + volume)) AS log_volume, SUM(LN(1 + open_interest)) AS log_oi, SUM(spread_pct) AS spread_pct FROM contracts GROUP BY 1)
SELECT date, {R(' '.join(surface.TENSOR), 4)} FROM f""",
}
