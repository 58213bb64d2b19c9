"""Walk-forward windows and models.

Windows are index ranges over distinct dates. Closed-form models are fitted for
all windows in one job: a date's sufficient statistics are summed first, and a
window is the difference of two running sums (``linear``). Boosted trees and networks have modules of their
own. ``fit_windows`` fits any ``pyspark.ml`` estimator window by window; the driver only loops over the few windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforge.functions.scalars import correlation
from panelforge.operators.linear import over_ranges, running


def windows(spark: SparkSession, n_dates: int, scheme: str, train: int, step: int, test: int | None = None, embargo: int = 0) -> DataFrame:
    """(window, train_lo, train_hi, test_lo, test_hi), half-open date indices.

    ``expanding`` trains on everything before the test block, ``rolling`` on the
    last ``train`` dates. The last ``embargo`` training dates go if the block is longer.
    """
    test = test or step
    starts = spark.range(train, max(train, n_dates - step), step).withColumnRenamed("id", "test_lo") if n_dates - step > train else spark.range(0).withColumnRenamed("id", "test_lo")
    lo = F.lit(0) if scheme == "expanding" else F.col("test_lo") - train
    size = F.col("test_lo") - lo
    return starts.select(((F.col("test_lo") - train) / step).cast("int").alias("window"), lo.cast("long").alias("train_lo"), (F.col("test_lo") - F.when(size > embargo, embargo).otherwise(0)).alias("train_hi"), "test_lo", F.least(F.col("test_lo") + test, F.lit(n_dates)).alias("test_hi"))


def closed_form(panel: DataFrame, wins: DataFrame, x: str, y: str, keys: list[str], date_idx: str = "date_idx") -> DataFrame:
    """For each window: training mean, majority direction and one-feature OLS with its t-statistic."""
    X, Y = F.col(x), F.col(y)
    daily = panel.where(X.isNotNull() & Y.isNotNull()).groupBy(*keys, date_idx).agg(F.count("*").alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(X * Y).alias("sxy"), F.sum(Y * Y).alias("syy"), F.sum(F.when(Y > 0, 1).otherwise(0)).alias("up"))
    sums = ["n", "sx", "sy", "sxx", "sxy", "syy", "up"]
    stats = over_ranges(running(daily, sums, keys, date_idx), wins.select("window", F.col("train_lo").alias("lo"), F.col("train_hi").alias("hi")), sums, keys, ["window"], date_idx).where("n > 0")
    n = F.col("n")
    vxx, vxy, vyy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    beta = vxy / vxx
    sse = F.greatest(vyy - beta * vxy, F.lit(0.0))
    return stats.select(*keys, "window", "n", (F.col("sy") / n).alias("mean"), F.when(F.col("up") / n >= 0.5, 1).otherwise(0).alias("majority"), beta.alias("beta"), ((F.col("sy") - beta * F.col("sx")) / n).alias("alpha"), (beta / F.sqrt(sse / (n - 2) / vxx)).alias("t"))


def score_windows(panel: DataFrame, wins: DataFrame, fits: DataFrame, x: str, y: str, keys: list[str], date_idx: str = "date_idx") -> DataFrame:
    """Test error of the zero, mean and OLS forecasts, by window."""
    rows = panel.join(F.broadcast(wins.select("window", "test_lo", "test_hi")), (F.col(date_idx) >= F.col("test_lo")) & (F.col(date_idx) < F.col("test_hi"))).join(fits, [*keys, "window"])
    Y, ols = F.col(y), F.col("alpha") + F.col("beta") * F.col(x)
    sq = lambda p: F.sum((Y - p) * (Y - p))
    base = sq(F.col("mean"))
    return rows.groupBy(*keys, "window").agg((1 - sq(F.lit(0.0)) / base).alias("r2_zero"), (1 - sq(ols) / base).alias("r2_ols"), F.avg(F.when((Y > 0) == (F.col("majority") == 1), 1.0).otherwise(0.0)).alias("hit_majority"), F.count("*").alias("n_test"))


def normal_equations(panel: DataFrame, wins: DataFrame, features: list[str], y: str, keys: list[str], date_idx: str = "date_idx", ridge: float = 0.0) -> DataFrame:
    """Least squares on several features for every cell and window in one job: ``(keys, window, n, beta, se)``, the constant first.

    A date is first reduced to its sums of products, and a window is the
    difference of two running sums; each window's small system is solved in Arrow batches. Missing
    features count as 0, rows without a target are left out. ``ridge`` / n is
    added to the features' part of the mean system. ``se`` are the plain
    errors; collinear features share by the pseudo-inverse.
    """
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = {f"x{i}_{j}": x[i] * x[j] for i, j in pairs} | {f"y{i}": x[i] * F.col(y) for i in range(p)} | {"yy": F.col(y) * F.col(y)}
    daily = panel.where(F.col(y).isNotNull()).groupBy(*keys, date_idx).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ranges = wins.select("window", F.col("train_lo").alias("lo"), F.col("train_hi").alias("hi"))
    stats = over_ranges(running(daily, list(sums), keys, date_idx), ranges, list(sums), keys, ["window"], date_idx).where("x0_0 > 0")

    def solve(frames):
        for frame in frames:
            a = np.zeros((len(frame), p, p))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = frame[f"x{i}_{j}"]
            b = np.stack([frame[f"y{i}"] for i in range(p)], 1)
            n = a[:, 0, 0]
            penalty = np.diag([0.0, *[ridge] * (p - 1)])
            inverse = np.linalg.pinv(a + penalty, hermitian=True)
            beta = np.einsum("nij,nj->ni", inverse, b)
            sse = np.maximum(frame["yy"].to_numpy() - 2 * (beta * b).sum(1) + np.einsum("ni,nij,nj->n", beta, a, beta), 0)
            se = np.sqrt(np.maximum(np.einsum("nii->ni", inverse), 0) * (sse / np.maximum(n - p, 1))[:, None])
            yield frame[[*keys, "window"]].assign(n=n.astype("int64"), beta=list(beta), se=list(se))

    kinds = {f.name: f.dataType.simpleString() for f in stats.schema}
    return stats.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "window"]) + ", n long, beta array<double>, se array<double>")


def coefficients(fits: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """A row for each coefficient of ``normal_equations``, named by its feature."""
    names = F.array(*[F.lit(f) for f in ("constant", *features)])
    each = fits.select(*keys, "window", "n", F.explode(F.arrays_zip(names.alias("feature"), F.col("beta"), F.col("se"))).alias("c"))
    return each.select(*keys, "window", "n", "c.feature", F.col("c.beta").alias("beta"), F.col("c.se").alias("se"), F.when(F.col("c.se") > 0, F.col("c.beta") / F.col("c.se")).alias("t"))


def predict_windows(panel: DataFrame, wins: DataFrame, fits: DataFrame, features: list[str], keys: list[str], date_idx: str = "date_idx") -> DataFrame:
    """Test rows of each window with ``pred`` of its fit."""
    inside = (F.col(date_idx) >= F.col("test_lo")) & (F.col(date_idx) < F.col("test_hi"))
    rows = panel.join(F.broadcast(wins.select("window", "test_lo", "test_hi")), inside).join(fits.select(*keys, "window", "beta"), [*keys, "window"])
    pred = F.element_at("beta", 1)
    for i, f in enumerate(features):
        pred = pred + F.element_at("beta", i + 2) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return rows.withColumn("pred", pred).drop("beta", "test_lo", "test_hi")


def run_grid(grid: DataFrame, panel: DataFrame, wins: dict[str, DataFrame], x: str, y: str, keys: list[str], done: DataFrame | None = None, date_idx: str = "date_idx") -> DataFrame:
    """Test metrics of the grid's cells ``(keys, model, scheme)`` that ``done`` lacks, by window: ``(keys, model, scheme, window, n_test, r2, hit)``.

    Models are ``zero``, ``mean`` and ``ols`` of one feature; all pending cells
    and windows of a scheme run in one job. The baseline of ``r2`` is the
    training mean. ``keys`` name the panel's cells (feature set, horizon).
    """
    cell = [*keys, "model", "scheme"]
    todo = grid if done is None else grid.join(done.select(*cell).distinct(), cell, "left_anti")
    out = None
    for scheme, of in wins.items():
        mine = F.broadcast(todo.where(F.col("scheme") == scheme))  # a cell's name each: the grid is small by nature
        rows = panel.drop("model", "scheme").join(mine.select(*keys).distinct(), keys, "left_semi")
        fits = closed_form(rows, of, x, y, keys, date_idx)
        inside = (F.col(date_idx) >= F.col("test_lo")) & (F.col(date_idx) < F.col("test_hi"))
        test = rows.join(F.broadcast(of.select("window", "test_lo", "test_hi")), inside).join(fits, [*keys, "window"]).join(mine, keys)
        pred = F.when(F.col("model") == "ols", F.col("alpha") + F.col("beta") * F.col(x)).when(F.col("model") == "mean", F.col("mean")).otherwise(0.0)
        Y = F.col(y)
        part = test.withColumn("_p", pred).groupBy(*cell, "window").agg(
            F.count("*").alias("n_test"), (1 - F.sum((Y - F.col("_p")) * (Y - F.col("_p"))) / F.sum((Y - F.col("mean")) * (Y - F.col("mean")))).alias("r2"),
            F.avg(F.when((Y > 0) == (F.col("_p") > 0), 1.0).otherwise(0.0)).alias("hit"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def neural_direction(width: int, layers: tuple[int, ...] = (256, 128, 64, 32), rounds: int = 100) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[width, *layers, 2], maxIter=rounds, seed=42, featuresCol="x", labelCol="up")


def model_matrix(panel: DataFrame, features: list[str], y: str) -> DataFrame:
    """Rows with a target; feature vector ``x`` (missing as 0), target ``y``, direction ``up``."""
    filled = panel.where(F.col(y).isNotNull()).withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=features, outputCol="raw").transform(filled).withColumn("y", F.col(y)).withColumn("up", F.when(F.col(y) > 0, 1.0).otherwise(0.0))


def fit_windows(panel: DataFrame, wins: DataFrame, features: list[str], y: str, model: Callable[[int], object], date_idx: str = "date_idx", val_share: float = 0.2, all_train: bool = False, parallelism: int = 8) -> DataFrame:
    """Out-of-sample predictions of an estimator fitted in each window.

    Features are scaled on the training dates. The last ``val_share`` of the
    training dates are validation rows (none below 20 dates); they are left out
    of the fit unless the estimator reads ``is_val`` or ``all_train`` is set.
    Each window is a distributed fit; ``parallelism`` of them share the cluster.
    """
    rows = model_matrix(panel, features, y).persist()

    def one(w):
        lo, hi = w["train_lo"], w["train_hi"]
        cut = hi if hi - lo < 20 else lo + int((hi - lo) * (1 - val_share))
        train = rows.where((F.col(date_idx) >= lo) & (F.col(date_idx) < hi))
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
        train = scaler.transform(train).withColumn("is_val", F.col(date_idx) >= cut).withColumn("fold", F.least(F.floor((F.col(date_idx) - lo) * 3 / max(1, cut - lo)), F.lit(2)).cast("int"))
        estimator = model(len(features))
        if not all_train and not getattr(estimator, "reads_val", False):
            train = train.where("not is_val")
        fitted = estimator.fit(train)
        test = scaler.transform(rows.where((F.col(date_idx) >= w["test_lo"]) & (F.col(date_idx) < w["test_hi"])))
        return fitted.transform(test).drop("raw", "x", "rawPrediction", "probability").withColumnRenamed("prediction", "pred").withColumn("window", F.lit(w["window"]))

    with ThreadPool(parallelism) as pool:  # a few windows: the driver only starts their jobs
        parts = pool.map(inheritable_thread_target(panel.sparkSession)(one), wins.orderBy("window").collect())
    return reduce(DataFrame.unionByName, parts)


def permuted(panel: DataFrame, columns: list[str], entity: str = "ticker", date: str = "date", seed: int = 42, suffix: str = "_shuffled") -> DataFrame:
    """The panel with a shuffled copy of each column: within its date a row takes the values of another.

    The rows' two orders come from hashes of entity and date, so the shuffle is
    the same in every run and however often a partition is computed. (entity,
    date) is unique.
    """
    order = lambda s: Window.partitionBy(date).orderBy(F.md5(F.concat_ws("|", F.col(entity).cast("string"), F.col(date).cast("string"), F.lit(str(s))).cast("binary")), entity)
    a = panel.withColumn("_r", F.row_number().over(order(seed)))
    b = panel.select(date, *[F.col(c).alias(c + suffix) for c in columns], F.row_number().over(order(seed + 1)).alias("_r"))
    return a.join(b, [date, "_r"]).drop("_r")


def permutation_importance(panel: DataFrame, features: list[str], predict: Callable[[dict[str, Column]], Column], y: str, entity: str = "ticker", date: str = "date", seed: int = 42) -> DataFrame:
    """``(feature, loss, share)``: correlation lost when a feature is shuffled within its date, and its share of all losses; one job for all.

    ``predict`` gives the prediction from a column for each feature.
    """
    own = {f: F.col(f) for f in features}
    both = permuted(panel, features, entity, date, seed)
    named = both.select(F.col(y).alias("_y"), predict(own).alias("_base"), *[predict(own | {f: F.col(f + "_shuffled")}).alias(f"_p{i}") for i, f in enumerate(features)])
    one = named.agg(correlation("_base", "_y").alias("_c"), *[correlation(f"_p{i}", "_y").alias(f"_c{i}") for i in range(len(features))])
    losses = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("_c") - F.col(f"_c{i}")).alias("loss")) for i, f in enumerate(features)])
    total = F.aggregate(losses, F.lit(0.0), lambda a, x: a + F.greatest(x["loss"], F.lit(0.0)))
    each = one.select(total.alias("total"), F.explode(losses).alias("l"))
    return each.select("l.feature", "l.loss", F.coalesce(F.try_divide(F.greatest(F.col("l.loss"), F.lit(0.0)), F.col("total")), F.lit(0.0)).alias("share"))


def differences(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest difference of two result tables on their common cells: the determinism check."""
    j = first.select(*keys, F.col(value).alias("_a")).join(second.select(*keys, F.col(value).alias("_b")), keys)
    return j.agg(F.count("*").alias("cells"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))


def normal_draw(name: Column, seed: Column | int) -> Column:
    """A standard normal number from the MD5 of a name and a seed: the same on every engine and in every run."""
    seed = F.lit(seed) if isinstance(seed, int) else seed

    def uniform(salt: str) -> Column:
        digest = F.md5(F.concat_ws("|", name, seed.cast("string"), F.lit(salt)).cast("binary"))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(uniform("a"))) * F.cos(2 * math.pi * uniform("b"))


def inject_signal(preds: DataFrame, y: str, strength: Column, keys: list[str], seed: Column | int = 42, units: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """Targets with a planted standard normal signal ``z`` of the given correlation: y' = y + c z, c = d s / sqrt(1 - d^2).

    ``units`` name a row; the same row and seed get the same z at every strength.
    """
    s = F.stddev_samp(y).over(Window.partitionBy(*keys))
    planted = preds.withColumn("z", normal_draw(F.concat_ws("|", *[F.col(c).cast("string") for c in units]), seed))
    return planted.withColumn("y_planted", F.col(y) + strength * s / F.sqrt(1 - strength * strength) * F.col("z"))
