"""Feed-forward networks of every cell and walk-forward window.

A window whose rows are few enough for a task (the bound of ``boosting``) is
trained by one task, all windows side by side; windows beyond it are trained by
``pyspark.ml``'s distributed network, one after the other (direction only).
Layers are linear with rectifiers and dropout, trained by Adam on batches, with a
falling rate and an early stop on the validation rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelforge.operators import boosting, walkforward


@dataclass(frozen=True)
class Network:
    """Settings; ``logistic`` predicts the probability that a target of 0 or 1 is 1, ``squared`` the target."""

    layers: tuple[int, ...] = (256, 128, 64, 32)
    dropout: float = 0.3
    batch: int = 512
    rate: float = 0.001
    decay: float = 0.0001
    epochs: int = 200
    patience: int = 20
    loss: str = "logistic"
    seed: int = 42


def _forward(x: np.ndarray, weights: list, masks: list | None = None) -> list[np.ndarray]:
    """Input, outputs of the hidden layers and score; ``masks`` drop units in training."""
    out = [x]
    for i, (w, b) in enumerate(weights):
        z = out[-1] @ w + b
        if i < len(weights) - 1:
            z = np.maximum(z, 0)
            z = z * masks[i] if masks else z
        out.append(z)
    return out


def _losses(y: np.ndarray, s: np.ndarray, loss: str) -> float:
    return float(((y - s) ** 2).mean() if loss == "squared" else (np.logaddexp(0, s) - y * s).mean())


def train(x: np.ndarray, y: np.ndarray, xv: np.ndarray, yv: np.ndarray, n: Network) -> list:
    """Weights at the epoch of the least validation loss (of the training loss where no row validates)."""
    rng = np.random.default_rng(n.seed)
    sizes = [x.shape[1], *n.layers, 1]
    weights = [[rng.standard_normal((a, b)) * np.sqrt(2 / max(a, 1)), np.zeros(b)] for a, b in zip(sizes, sizes[1:], strict=False)]
    moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in weights]
    best, kept, since, step = np.inf, [[p.copy() for p in layer] for layer in weights], 0, 0
    if not len(xv):
        xv, yv = x, y
    for epoch in range(n.epochs if len(x) else 0):
        rate = n.rate * 0.5 * (1 + np.cos(np.pi * epoch / n.epochs))
        order = rng.permutation(len(x))
        for lo in range(0, len(x), n.batch):
            at = order[lo : lo + n.batch]
            masks = [(rng.random((len(at), k)) >= n.dropout) / (1 - n.dropout) for k in n.layers]
            out = _forward(x[at], weights, masks)
            s = out[-1][:, 0]
            slope = (2 * (s - y[at]) if n.loss == "squared" else 1 / (1 + np.exp(-s)) - y[at])[:, None] / len(at)
            step += 1
            for i in range(len(weights) - 1, -1, -1):
                grads = [out[i].T @ slope, slope.sum(0)]
                slope = slope @ weights[i][0].T
                if i:
                    slope = slope * masks[i - 1] * (out[i] > 0)
                for k, g in enumerate(grads):
                    g = g + n.decay * weights[i][k]
                    m, v = moments[i][k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    weights[i][k] = weights[i][k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        error = _losses(yv, _forward(xv, weights)[-1][:, 0], n.loss)
        if error < best - 1e-9:
            best, kept, since = error, [[p.copy() for p in layer] for layer in weights], 0
        else:
            since += 1
            if since >= n.patience:
                break
    return kept


def network_windows(panel: DataFrame, wins: DataFrame, features: list[str], y: str, keys: tuple[str, ...] = (), units: tuple[str, ...] = ("ticker", "date"), settings: Network = Network(), date_idx: str = "date_idx") -> DataFrame:
    """Test rows of each cell and window: ``(keys, window, units, y, pred)``.

    Features are scaled by the rows that are trained on; one that doesn't vary counts as 0. Rows without a target are left out.
    """
    keys, units = list(keys), list(units)
    rows = boosting.in_windows(panel, wins, features, y, keys, units, date_idx)
    large, groups = boosting.oversized(panel, wins, len(features), y, keys, date_idx)
    if large and (keys or settings.loss == "squared"):
        raise ValueError("windows beyond a task's size: one cell at a time, and direction only")
    xs = [f"_x{i}" for i in range(len(features))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_ident", kind="stable")
        x, t, role = frame[xs].to_numpy(float), frame["_y"].to_numpy(float), frame["_role"].to_numpy()
        own, val, test = role == boosting.TRAIN, role == boosting.VALIDATION, role == boosting.TEST
        mean, spread = (x[own].mean(0), x[own].std(0)) if own.any() else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        x = np.where(spread > 0, (x - mean) / np.where(spread > 0, spread, 1), 0.0)
        weights = train(x[own], t[own], x[val], t[val], settings)
        score = _forward(x[test], weights)[-1][:, 0]
        return frame.loc[test, [*keys, "window", *units, "_y"]].assign(pred=score if settings.loss == "squared" else 1 / (1 + np.exp(-score)))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "window", *units, "_y"]) + ", pred double"
    small = rows
    if large:
        names = F.broadcast(panel.sparkSession.createDataFrame(large, rows.select("window").schema))  # a row a window
        small = rows.join(names, "window", "left_anti")
    out = boosting.spread(small, keys, groups).groupBy(*keys, "window").applyInPandas(run, schema).withColumnRenamed("_y", y)
    if large:
        rest = walkforward.fit_windows(panel, wins.join(names, "window", "left_semi"), features, y, lambda width: walkforward.neural_direction(width, settings.layers), date_idx)
        out = out.unionByName(rest.select(*out.columns))
    return out
