"""Linear models of every cell and window from sums of products.

A date is reduced to its sums of products once; running sums over dates make any
range of dates two lookups, so windows, folds and cells cost no further pass.
Each (cell, window) is then a small system, solved in Arrow batches: least
squares with or without a ridge, or the elastic net by coordinate descent with
its penalty chosen over folds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

#: Penalties of the elastic net, its share of the absolute part, and contiguous folds.
ALPHAS, L1_SHARE, FOLDS = (1e-4, 1e-3, 1e-2, 1e-1), 0.5, 3


def running(daily: DataFrame, sums: list[str], keys: list[str], date_idx: str = "date_idx") -> DataFrame:
    """``daily`` with its sums from the first date on, and ``_until``, the next date of the cell (null at its last).

    A cell's window holds its dates, not its rows.
    """
    w = Window.partitionBy(*keys).orderBy(date_idx) if keys else Window.orderBy(date_idx)
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, date_idx, F.lead(date_idx).over(w).alias("_until"), *[F.sum(c).over(total).alias(c) for c in sums])


def over_ranges(cumulated: DataFrame, ranges: DataFrame, sums: list[str], keys: list[str], names: list[str], date_idx: str = "date_idx") -> DataFrame:
    """``(keys, names, sums)`` of each range ``[lo, hi)`` of dates of ``ranges(names, lo, hi)``.

    Each end meets the one running sum that holds before it: two rows a range
    and cell. A range without a row of the cell has no row, or sums of 0.
    """
    at = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign"))))
    ends = ranges.select(*names, at.alias("e")).select(*names, "e.at", "e.sign")
    holds = (F.col("at") > F.col(date_idx)) & (F.col("_until").isNull() | (F.col("at") <= F.col("_until")))
    met = cumulated.join(F.broadcast(ends), holds)  # a few ends a window
    return met.groupBy(*keys, *names).agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in sums])


def fit_ranges(wins: DataFrame, val_share: float = 0.2, folds: int = FOLDS, all_train: bool = False) -> DataFrame:
    """``(window, fold, lo, hi)``: contiguous folds of the training dates before the validation dates."""
    size = F.col("train_hi") - F.col("train_lo")
    cut = F.col("train_hi") if all_train else F.when(size < 20, F.col("train_hi")).otherwise(F.col("train_lo") + F.floor(size * (1 - val_share)))
    edge = lambda k: F.col("train_lo") + F.floor((cut - F.col("train_lo")) * k / folds)
    each = wins.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return each.select("window", "fold", edge(F.col("fold")).cast("long").alias("lo"), edge(F.col("fold") + 1).cast("long").alias("hi"))


def descend(c: np.ndarray, r: np.ndarray, alpha: np.ndarray, share: float, rounds: int = 10_000, close: float = 1e-12) -> np.ndarray:
    """Elastic nets of many systems at once, by coordinate descent: ``c`` (m, p, p) and ``r`` (m, p) are mean products, ``alpha`` (m,)."""
    m, p = r.shape
    beta, diagonal = np.zeros((m, p)), np.einsum("mii->mi", c)
    for _ in range(rounds):
        moved = 0.0
        for j in range(p):
            left = r[:, j] - np.einsum("mk,mk->m", c[:, j], beta) + diagonal[:, j] * beta[:, j]
            weight = diagonal[:, j] + alpha * (1 - share)
            new = np.where(weight > 0, np.sign(left) * np.maximum(np.abs(left) - alpha * share, 0) / np.where(weight > 0, weight, 1), 0.0)
            moved = max(moved, float((np.abs(new - beta[:, j]) * np.sqrt(np.maximum(diagonal[:, j], 0))).max(initial=0)))
            beta[:, j] = new
        if moved <= close:
            break
    return beta


def _centred(s: np.ndarray, b: np.ndarray, yy: np.ndarray, spread: np.ndarray) -> tuple:
    """Mean products about the means, features scaled by ``spread``, from sums whose first entry is the constant."""
    n = np.maximum(s[:, 0, 0], 1)
    mx, my = s[:, 0, 1:] / n[:, None], b[:, 0] / n
    c = s[:, 1:, 1:] / n[:, None, None] - mx[:, :, None] * mx[:, None, :]
    r = b[:, 1:] / n[:, None] - mx * my[:, None]
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0.0)
    return c * scale[:, :, None] * scale[:, None, :], r * scale, mx, my, scale


def elastic_nets(s: np.ndarray, b: np.ndarray, yy: np.ndarray, alphas: tuple[float, ...] = ALPHAS, share: float = L1_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients with the constant first, chosen penalty) of m systems from the sums of their folds.

    ``s`` (m, folds, p + 1, p + 1), ``b`` (m, folds, p + 1) and ``yy`` (m, folds).
    Features are scaled by their deviation over all folds; the penalty with the
    least mean error over the folds is kept, and fitted to all of them.
    """
    m, folds = yy.shape
    whole_s, whole_b, whole_y = s.sum(1), b.sum(1), yy.sum(1)
    n = np.maximum(whole_s[:, 0, 0], 1)
    variance = np.einsum("mii->mi", whole_s)[:, 1:] / n[:, None] - (whole_s[:, 0, 1:] / n[:, None]) ** 2
    spread = np.sqrt(np.where(variance > 1e-12 * np.maximum(1e-300, np.einsum("mii->mi", whole_s)[:, 1:] / n[:, None]), variance, 0.0))

    def fit(s, b, yy, alpha):
        c, r, mx, my, scale = _centred(s, b, yy, spread)
        beta = descend(c, r, np.full(len(s), alpha), share) * scale
        return np.column_stack([my - (beta * mx).sum(1), beta])

    errors = np.zeros((len(alphas), m))
    for k, alpha in enumerate(alphas):
        for f in range(folds):
            w = fit(whole_s - s[:, f], whole_b - b[:, f], whole_y - yy[:, f], alpha)
            sse = yy[:, f] - 2 * (w * b[:, f]).sum(1) + np.einsum("mi,mij,mj->m", w, s[:, f], w)
            errors[k] += np.where(s[:, f, 0, 0] > 0, sse / np.maximum(s[:, f, 0, 0], 1), 0.0)
    best = errors.argmin(0)
    fits = np.stack([fit(whole_s, whole_b, whole_y, alpha) for alpha in alphas])
    return fits[best, np.arange(m)], np.array(alphas)[best]


def linear_windows(panel: DataFrame, wins: DataFrame, features: list[str], y: str, keys: list[str], model: str = "elastic_net", date_idx: str = "date_idx", ridge: float = 1e-6, all_train: bool = False, folds: int = FOLDS) -> DataFrame:
    """``(keys, window, n, beta, alpha)`` of every cell and window in one job, the constant first.

    ``model`` is ``elastic_net`` or ``ols`` (with ``ridge`` on the scaled
    features' sums, so that collinear ones are stable). Fitted on the training
    dates before the validation dates, or on all with ``all_train``. Missing
    features count as 0; rows without a target are left out.
    """
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    products = {f"x{i}_{j}": x[i] * x[j] for i, j in pairs} | {f"y{i}": x[i] * F.col(y) for i in range(p)} | {"yy": F.col(y) * F.col(y)}
    daily = panel.where(F.col(y).isNotNull()).groupBy(*keys, date_idx).agg(*[F.sum(c).alias(n) for n, c in products.items()])
    sums = over_ranges(running(daily, list(products), keys, date_idx), fit_ranges(wins, folds=folds, all_train=all_train), list(products), keys, ["window", "fold"], date_idx)
    at = {name: k for k, name in enumerate(products)}
    cells = sums.groupBy(*keys, "window").agg(F.sort_array(F.collect_list(F.struct("fold", F.array(*products).alias("v")))).alias("f"))  # a row a fold

    def solve(frames):
        for frame in frames:
            m = len(frame)
            v = np.zeros((m, folds, len(at)))
            for i, rows in enumerate(frame["f"]):
                for r in rows:
                    v[i, r["fold"]] = r["v"]
            s = np.zeros((m, folds, p, p))
            for i, j in pairs:
                s[..., i, j] = s[..., j, i] = v[..., at[f"x{i}_{j}"]]
            b, yy = np.stack([v[..., at[f"y{i}"]] for i in range(p)], -1), v[..., at["yy"]]
            if model == "elastic_net":
                beta, alpha = elastic_nets(s, b, yy)
            else:
                whole, spread = s.sum(1), np.ones((m, p - 1))
                c, r, mx, my, _ = _centred(whole, b.sum(1), yy.sum(1), spread)
                d = np.sqrt(np.maximum(np.einsum("mii->mi", c), 0))
                d = np.where(d > 0, d, 1.0)
                n = np.maximum(whole[:, 0, 0], 1)
                scaled = c / d[:, :, None] / d[:, None, :] + (ridge / n)[:, None, None] * np.eye(p - 1)
                w = np.einsum("mij,mj->mi", np.linalg.pinv(scaled, hermitian=True), r / d) / d
                beta, alpha = np.column_stack([my - (w * mx).sum(1), w]), np.full(m, ridge)
            yield frame[[*keys, "window"]].assign(n=s.sum(1)[:, 0, 0].astype("int64"), beta=list(beta), alpha=alpha)

    kinds = dict(cells.dtypes)
    return cells.mapInPandas(solve, ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "window"]) + ", n long, beta array<double>, alpha double")
