"""Boosting, networks and linear models of all windows against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting, linear, networks, walkforward


def plain_booster(x, y, role, ident, s):
    """The same trees by looking at each cut of each node in turn; predictions of all rows and the rounds kept."""
    own, val = role == 0, role == 1
    edges = [sorted({sorted(x[own, j])[max(0, int(np.ceil(k / s.bins * own.sum())) - 1)] for k in range(1, s.bins)}) for j in range(x.shape[1])]
    base = s.start(y[own].sum(), own.sum())
    score, kept, best, at_best = np.full(len(y), base), 0, np.inf, np.full(len(y), base)
    for r in range(s.rounds):
        g = y - score if s.loss == "squared" else y - 1 / (1 + np.exp(-score))
        h = np.ones(len(y)) if s.loss == "squared" else (1 / (1 + np.exp(-score))) * (1 - 1 / (1 + np.exp(-score)))
        rows = own & s.sampled(ident, r)

        def grow(inside, depth, rows=rows, g=g, h=h, r=r):
            mine = inside & rows
            found = None
            if depth < s.depth:
                for j in s.drawn(r, x.shape[1]):
                    for e in edges[j]:
                        a, b = mine & (x[:, j] <= e), mine & (x[:, j] > e)
                        if h[a].sum() >= s.least - 1e-9 and h[b].sum() >= s.least - 1e-9:
                            gain = sum(g[m].sum() ** 2 / (h[m].sum() + s.penalty) * k for m, k in ((a, 1), (b, 1), (mine, -1)))
                            if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-11)):
                                found = gain, j, e
            if found is None:
                return np.where(inside, s.rate * g[mine].sum() / (h[mine].sum() + s.penalty), 0.0)
            _, j, e = found
            return grow(inside & (x[:, j] <= e), depth + 1) + grow(inside & (x[:, j] > e), depth + 1)

        score = score + grow(np.ones(len(y), bool), 0)
        if val.any():
            loss = s.losses(y[val], score[val]).mean()
            if loss < best:
                best, kept, at_best = loss, r + 1, score
            elif r + 1 - kept >= s.patience:
                break
        else:
            kept, at_best = r + 1, score
    return at_best, kept


@pytest.mark.parametrize("loss,val", [("squared", True), ("squared", False), ("logistic", True)])
def test_trees_equal_a_plain_booster(loss, val):
    rng = np.random.default_rng(1)
    x = rng.integers(-6, 7, (240, 3)) / 4
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + rng.integers(-4, 5, 240) / 4
    y = y if loss == "squared" else (y > 0).astype(float)
    role = np.where(np.arange(240) < 150, 0, np.where(np.arange(240) < 200, 1 if val else 0, 2))
    ident = rng.integers(-(1 << 62), 1 << 62, 240)
    s = boosting.Booster(rounds=8, depth=3, rate=0.3, patience=3, loss=loss, bins=8, features=0.67)
    bins = boosting.binned(x, boosting.edges_of(x[role == 0], s.bins))
    base, trees = boosting.grow(bins, y, role, ident, s)
    parts = boosting.explained(bins, base, trees, 3)
    want, kept = plain_booster(x, y, role, ident, s)
    assert len(trees) == kept and np.abs(base + parts.sum(1) - want).max() < 1e-9


def test_boosting_stops_and_keeps_the_best():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((600, 2)), rng.standard_normal(600)
    role = np.repeat([0, 1, 2], 200)
    s = boosting.Booster(rounds=400, depth=4, rate=0.3, patience=12)
    bins = boosting.binned(x, boosting.edges_of(x[:200], s.bins))
    _, trees = boosting.grow(bins, y, role, np.arange(600), s)
    assert len(trees) < 60  # noise: no gain for long


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cell in ("p", "q"):
        for d in range(60):
            for t in range(10):
                a, b = (rng.integers(-8, 9, 2) / 4).tolist()
                rows.append((cell, d, f"t{t}", a, b if rng.random() > 0.1 else None, float(np.sign(a) * b + rng.integers(-4, 5) / 8) if rng.random() > 0.05 else None))
    return spark.createDataFrame(rows, "cell string, date_idx long, ticker string, a double, b double, y double").withColumn("date", F.col("date_idx")).cache()


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_windows_beyond_a_task_give_the_same_trees(spark, panel, monkeypatch, loss):
    wins = walkforward.windows(spark, 60, "expanding", 30, 10, embargo=1)
    p = panel if loss == "squared" else panel.withColumn("y", F.when(F.col("y").isNotNull(), F.when(F.col("y") > 0, 1.0).otherwise(0.0)))
    s = boosting.Booster(rounds=5, depth=2, rate=0.2, patience=2, loss=loss)
    run = lambda: {(r["cell"], r["window"], r["ticker"], r["date"]): r for r in boosting.boosted_windows(p, wins, ["a", "b"], "y", ("cell",), settings=s).collect()}
    small = run()
    monkeypatch.setattr(boosting, "TASK_VALUES", 2_000)  # the shortest window of each cell still fits
    monkeypatch.setattr(boosting, "RENEW", 2)
    large = run()
    assert small.keys() == large.keys() and {k[1] for k in small} == {0, 1}
    for k, r in small.items():
        assert large[k]["rounds"] == r["rounds"] and large[k]["pred"] == pytest.approx(r["pred"], abs=1e-12)
        assert large[k]["contributions"] == pytest.approx(r["contributions"], abs=1e-12)
        score = r["base"] + sum(r["contributions"])
        assert r["pred"] == pytest.approx(score if loss == "squared" else 1 / (1 + np.exp(-score)), abs=1e-12)


def test_experiment_in_the_same_windows(spark, panel):
    wins = walkforward.windows(spark, 60, "expanding", 40, 10)
    out = boosting.experiment(panel, wins, ["a", "b"], "y", ("cell",), settings=boosting.Booster(rounds=60, depth=4, rate=0.1, patience=10)).collect()
    assert len(out) == panel.where("y is not null and date_idx >= 40 and date_idx < 50").count()
    assert sum((r["up"] > 0.5) == (r["y"] > 0) for r in out) > 0.8 * len(out) and sum((r["pred"] > 0) == (r["y"] > 0) for r in out) > 0.8 * len(out)


def test_boosting_without_rows(spark, panel):
    wins = walkforward.windows(spark, 60, "expanding", 40, 10)
    assert boosting.boosted_windows(panel.limit(0), wins, ["a"], "y", ("cell",)).count() == 0
    assert boosting.boosted_windows(panel, wins.limit(0), ["a"], "y", ("cell",)).count() == 0


def test_network_learns_a_direction(spark, panel):
    wins = walkforward.windows(spark, 60, "expanding", 40, 10)
    p = panel.where("cell = 'p' and y is not null").withColumn("up", F.when(F.col("y") > 0, 1.0).otherwise(0.0)).withColumn("one", F.lit(3.0))
    out = networks.network_windows(p, wins, ["a", "b", "one"], "up", settings=networks.Network(layers=(32, 16), batch=64, rate=0.01, epochs=60)).collect()
    assert sum((r["pred"] > 0.5) == (r["up"] == 1) for r in out) > 0.75 * len(out) > 50


def test_network_fits_what_no_line_does():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((80, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    s = networks.Network(layers=(8, 4), dropout=0.0, batch=80, epochs=150, patience=150, rate=0.02, decay=0.0)
    weights = networks.train(x, y, np.empty((0, 3)), np.empty(0), s)
    fitted = networks._losses(y, networks._forward(x, weights)[-1][:, 0], "logistic")
    assert fitted < 0.3


def plain_net(x, y, alpha, share):
    n = len(y)
    x, y, beta = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(20_000):
        before = beta.copy()
        for j in range(x.shape[1]):
            r = y - x @ beta + x[:, j] * beta[j]
            a = x[:, j] @ r / n
            d = x[:, j] @ x[:, j] / n + alpha * (1 - share)
            beta[j] = np.sign(a) * max(abs(a) - alpha * share, 0) / d if d > 0 else 0.0
        if np.abs(beta - before).max() < 1e-14:
            break
    return beta


def test_elastic_net_equals_plain_descent(spark, panel):
    wins = walkforward.windows(spark, 60, "expanding", 40, 10, embargo=2)
    p = panel.withColumns({"c": F.col("a") * 2 + F.col("date_idx") % 3, "still": F.lit(7.0)})
    names = ["a", "b", "c", "still"]
    fits = linear.linear_windows(p, wins, names, "y", ["cell"])
    got = {r["cell"]: r for r in fits.collect()}
    rows = p.where("y is not null").toPandas().fillna({"b": 0.0})
    for cell, r in got.items():
        mine = rows[(rows.cell == cell) & (rows.date_idx < int(38 * 0.8))]
        x, y, d = mine[names].to_numpy(), mine.y.to_numpy(), mine.date_idx.to_numpy()
        spread = np.where(x.std(0) > 0, x.std(0), np.inf)
        z, fold = (x - x.mean(0)) / spread, np.searchsorted([30 * 1 // 3, 30 * 2 // 3], d, "right")
        errors = []
        for alpha in linear.ALPHAS:
            e = 0
            for f in range(3):
                b = plain_net(z[fold != f], y[fold != f], alpha, 0.5)
                constant = y[fold != f].mean() - z[fold != f].mean(0) @ b
                e += ((y[fold == f] - constant - z[fold == f] @ b) ** 2).mean()
            errors.append(e)
        alpha = linear.ALPHAS[int(np.argmin(errors))]
        b = plain_net(z, y, alpha, 0.5) / spread
        want = [y.mean() - x.mean(0) @ b, *b]
        assert r["alpha"] == alpha and r["n"] == len(y) and np.abs(np.array(r["beta"]) - want).max() < 1e-8


def test_ols_by_sums(spark, panel):
    wins = walkforward.windows(spark, 60, "rolling", 30, 10)
    got = {(r["cell"], r["window"]): r["beta"] for r in linear.linear_windows(panel, wins, ["a", "b"], "y", ["cell"], "ols", all_train=True).collect()}
    rows = panel.where("y is not null").toPandas().fillna({"b": 0.0})
    for (cell, w), beta in got.items():
        mine = rows[(rows.cell == cell) & (rows.date_idx >= 10 * w) & (rows.date_idx < 10 * w + 30)]
        want = np.linalg.lstsq(np.column_stack([np.ones(len(mine)), mine[["a", "b"]]]), mine.y, rcond=None)[0]
        assert np.abs(np.array(beta) - want).max() < 1e-6
    assert len(got) == 2 * wins.count()


def test_ranges_meet_two_sums_each(spark):
    """Gaps, ranges before the first and after the last date, and empty ones."""
    daily = spark.createDataFrame([(k, d, float(d)) for k, of in (("a", (2, 3, 7, 9)), ("b", (5,))) for d in of], "k string, date_idx long, s double")
    ranges = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate([(0, 3), (3, 8), (4, 7), (0, 100), (8, 100), (50, 60), (0, 2)])], "window int, lo long, hi long")
    got = {(r["k"], r["window"]): r["s"] for r in linear.over_ranges(linear.running(daily, ["s"], ["k"]), ranges, ["s"], ["k"], ["window"]).collect()}
    for k, of in (("a", (2, 3, 7, 9)), ("b", (5,))):
        for i, (lo, hi) in enumerate([(0, 3), (3, 8), (4, 7), (0, 100), (8, 100), (50, 60), (0, 2)]):
            assert got.get((k, i), 0.0) == sum(d for d in of if lo <= d < hi)
