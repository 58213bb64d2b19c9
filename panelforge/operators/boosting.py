"""Gradient boosting of every cell and walk-forward window at once, on binned features.

Trees grow level by level. A level needs, for each (cell, window, node, feature,
bin), the sums of gradients and curvatures; from these the best cut of each node
follows. Each round draws rows by a hash of the row and features by the round, so
the trees don't depend on how rows are dealt. A window stops when its validation
rows have got no better for ``patience`` rounds and keeps the trees up to the
best one; nothing is fitted twice.

Two ways give the same trees:

* ``grown_in_tasks``: a (cell, window) whose rows are few enough for a task,
  ``TASK_VALUES``, a checked size, is grown by one task; windows run side by side.
* ``grown_by_level``: larger ones stay dealt over the cluster. A level is one
  job for all of them: tasks add up the histograms of their rows, one grouping
  joins them, and the cuts, a few numbers a node, go back to the tasks. Scores so
  far are a written column, renewed every ``RENEW`` rounds.

A prediction is the base plus, for each step down a tree, the change of the
node's value, credited to the feature that was asked: contributions that add up
to the prediction less the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelforge.sources.tables import materialize

#: Values (rows times features and five more) of a (cell, window) that one task may hold; rounds between two writings of the scores.
TASK_VALUES = 20_000_000
RENEW = 10
#: Partitions over which (cell, window) pairs are dealt.
PARTITIONS = 4096
TRAIN, VALIDATION, TEST = 0, 1, 2


@dataclass(frozen=True)
class Booster:
    """Settings; ``loss`` is ``squared`` or ``logistic`` (then the target is 0 or 1 and predictions are probabilities)."""

    rounds: int = 500
    depth: int = 6
    rate: float = 0.01
    patience: int = 50
    loss: str = "squared"
    rows: float = 0.8
    features: float = 0.8
    bins: int = 64
    penalty: float = 1.0
    least: float = 1.0
    seed: int = 42

    def drawn(self, round_: int, width: int) -> np.ndarray:
        """Features of a round."""
        n = max(1, round(self.features * width))
        return np.sort(np.random.default_rng([self.seed, round_]).permutation(width)[:n])

    def sampled(self, ident: np.ndarray, round_: int) -> np.ndarray:
        """Rows of a round, by a hash of their number."""
        with np.errstate(over="ignore"):
            x = ident.astype(np.uint64) + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.uint64(self.seed)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x >> np.uint64(11)).astype(float) < self.rows * (1 << 53)

    def start(self, total: float, n: float) -> float:
        """Score before the first tree, from the sum and number of the training targets."""
        mean = total / max(n, 1)
        if self.loss == "squared":
            return mean
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return float(np.log(mean / (1 - mean)))

    def slopes(self, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.loss == "squared":
            return y - score, np.ones(len(y))
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    def losses(self, y: np.ndarray, score: np.ndarray) -> np.ndarray:
        return (y - score) ** 2 if self.loss == "squared" else np.logaddexp(0.0, score) - y * score

    def predicted(self, score: np.ndarray) -> np.ndarray:
        return score if self.loss == "squared" else 1 / (1 + np.exp(-score))


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending distinct quantiles of each column; a value's bin is the number of edges below it."""
    if not len(x):
        return [np.empty(0)] * x.shape[1]
    return [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins, method="inverted_cdf")) for j in range(x.shape[1])]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


@dataclass
class Tree:
    """Nodes in heap order: 1 is the root, 2 i and 2 i + 1 are below i; feature -1 is a leaf."""

    depth: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 << self.depth
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)

    def steps(self, bins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, feature, node) of each step down."""
        node, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            if not len(rows):
                return
            node[rows] = 2 * node[rows] + (bins[rows, f] > self.cut[node[rows]])
            yield rows, f, node[rows]

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        out = np.ones(len(bins), np.int64)
        for rows, _, node in self.steps(bins):
            out[rows] = node
        return out


def histogram(bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """Sums of g and h by (node from 0, feature, bin)."""
    q = bins.shape[1]
    place = ((at[:, None] * q + np.arange(q)) * size + bins).ravel()
    return np.stack([np.bincount(place, np.repeat(w, q), nodes * q * size).reshape(nodes, q, size) for w in (g, h)])


def cut_nodes(sums: np.ndarray, settings: Booster) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the feature or -1, bin, value, weight) of each node, by the largest gain; ties go to the first."""
    g, h = sums
    total_g, total_h = g[:, 0].sum(-1), h[:, 0].sum(-1)
    value = settings.rate * total_g / (total_h + settings.penalty)
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
    score = lambda a, b: a * a / (b + settings.penalty)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)[:, None, None]
    slack = 1e-9 * (1 + np.abs(total_h))[:, None, None]  # curvatures are sums: an empty side may be a little off 0
    gain = np.where((left_h >= settings.least - slack) & (right_h >= settings.least - slack), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    # gains equal to 12 digits are one, so that the order of summation decides nothing
    top = flat.max(1)
    best = (flat >= (top - 1e-12 * np.abs(top))[:, None]).argmax(1)
    cut, width = top > 1e-12, gain.shape[2]
    return np.where(cut, best // width, -1), best % width, value, total_h


def settle(tree: Tree, level: int, sums: np.ndarray, drawn: np.ndarray, settings: Booster) -> None:
    """Put the cuts of a level's nodes, and their values, into the tree."""
    first = 1 << level
    feature, cut, value, weight = cut_nodes(sums, settings)
    held = weight > 0
    at = first + np.flatnonzero(held)
    tree.value[at] = value[held]
    if level < tree.depth:
        tree.feature[at] = np.where(feature[held] >= 0, drawn[feature[held]], -1)
        tree.cut[at] = cut[held]


def grow(bins: np.ndarray, y: np.ndarray, role: np.ndarray, ident: np.ndarray, settings: Booster) -> tuple[float, list[Tree]]:
    """Base score and kept trees of one (cell, window)."""
    train, val = role == TRAIN, role == VALIDATION
    base = settings.start(float(y[train].sum()), float(train.sum()))
    score, trees, best, kept = np.full(len(y), base), [], np.inf, 0
    if not train.any():
        return base, []
    for r in range(settings.rounds):
        drawn, tree = settings.drawn(r, bins.shape[1]), Tree(settings.depth)
        g, h = settings.slopes(y, score)
        rows = np.flatnonzero(train & settings.sampled(ident, r))
        node, some = np.ones(len(rows), np.int64), bins[rows]
        for level in range(settings.depth + 1):
            at = node >> level == 1  # rows that have come down to this level
            if not at.any():
                break
            settle(tree, level, histogram(some[at][:, drawn], node[at] - (1 << level), g[rows[at]], h[rows[at]], 1 << level, settings.bins), drawn, settings)
            f = tree.feature[node]
            on = at & (f >= 0)
            node[on] = 2 * node[on] + (some[on, f[on]] > tree.cut[node[on]])
        trees.append(tree)
        score += tree.value[tree.nodes(bins)]
        if val.any():
            error = float(settings.losses(y[val], score[val]).mean())
            if error < best:
                best, kept = error, r + 1
            elif r + 1 - kept >= settings.patience:
                break
    return base, trees[:kept] if val.any() else trees


def explained(bins: np.ndarray, base: float, trees: list[Tree], width: int) -> np.ndarray:
    """Contribution of each feature (columns) to each row's score, the base left out; the constant of each root is the last column."""
    out = np.zeros((len(bins), width + 1))
    for tree in trees:
        out[:, width] += tree.value[1]
        before = np.full(len(bins), tree.value[1])
        for rows, f, node in tree.steps(bins):
            out[rows, f] += tree.value[node] - before[rows]
            before[rows] = tree.value[node]
    return out


def _results(own: pd.DataFrame, bins: np.ndarray, base: float, trees: list[Tree], width: int, settings: Booster) -> pd.DataFrame:
    parts = explained(bins, base, trees, width)
    score = base + parts.sum(1)
    return own.assign(pred=settings.predicted(score), base=base + parts[:, width], contributions=list(parts[:, :width]), rounds=len(trees))


def in_windows(panel: DataFrame, wins: DataFrame, features: list[str], y: str, keys: list[str], units: list[str], date_idx: str = "date_idx", val_share: float = 0.2) -> DataFrame:
    """Rows with a target in each window they belong to: ``(keys, window, units, y, features as double, _role, _ident)``.

    The last ``val_share`` of the training dates validate, none below 20 dates.
    Missing features count as 0.
    """
    size, at = F.col("train_hi") - F.col("train_lo"), F.col(date_idx)
    cut = F.when(size < 20, F.col("train_hi")).otherwise(F.col("train_lo") + F.floor(size * (1 - val_share)))
    inside = ((at >= F.col("train_lo")) & (at < F.col("train_hi"))) | ((at >= F.col("test_lo")) & (at < F.col("test_hi")))
    role = F.when(at >= F.col("test_lo"), TEST).when(at >= cut, VALIDATION).otherwise(TRAIN)
    rows = panel.where(F.col(y).isNotNull()).select(*dict.fromkeys([*keys, *units, date_idx]), F.col(y).cast("double").alias("_y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)])
    rows = rows.join(F.broadcast(wins), inside)  # the windows are few by nature
    return rows.select(*keys, "window", *units, "_y", *[f"_x{i}" for i in range(len(features))], role.alias("_role"), F.xxhash64(*units).alias("_ident"))


def oversized(panel: DataFrame, wins: DataFrame, width: int, y: str, keys: list[str], date_idx: str = "date_idx") -> tuple[list, int]:
    """(keys, window) whose rows are too many for a task, and the number of all, from the counts by date."""
    daily = panel.where(F.col(y).isNotNull()).groupBy(*keys, date_idx).agg(F.count("*").alias("n"))
    inside = (F.col(date_idx) >= F.col("train_lo")) & (F.col(date_idx) < F.col("test_hi"))
    sizes = daily.join(F.broadcast(wins), inside).groupBy(*keys, "window").agg((F.sum("n") * (width + 5) > TASK_VALUES).alias("large")).persist()
    out = sizes.where("large").select(*keys, "window").collect(), sizes.count()
    sizes.unpersist()
    return out


def spread(rows: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """Rows by (cell, window), a partition for each at most ``PARTITIONS``: by their bytes alone Spark would put many long fits into one task."""
    return rows.repartition(max(1, min(PARTITIONS, 3 * groups)), *keys, "window")


def _schema(rows: DataFrame, keys: list[str], units: list[str], extra: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "window", *units, "_y"]) + ", " + extra


OUT = "pred double, base double, contributions array<double>, rounds int"


def grown_in_tasks(rows: DataFrame, width: int, keys: list[str], units: list[str], settings: Booster) -> DataFrame:
    xs = [f"_x{i}" for i in range(width)]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_ident", kind="stable")
        x, role = frame[xs].to_numpy(float), frame["_role"].to_numpy()
        bins = binned(x, edges_of(x[role == TRAIN], settings.bins))
        base, trees = grow(bins, frame["_y"].to_numpy(float), role, frame["_ident"].to_numpy(), settings)
        test = role == TEST
        return _results(frame.loc[test, [*keys, "window", *units, "_y"]], bins[test], base, trees, width, settings)

    return rows.groupBy(*keys, "window").applyInPandas(run, _schema(rows, keys, units, OUT))


def grown_by_level(rows: DataFrame, width: int, keys: list[str], units: list[str], settings: Booster) -> DataFrame:
    """The same for windows of any size: one job a level for all of them."""
    spark, group = rows.sparkSession, [*keys, "window"]
    quantiles = F.array(*[F.lit(i / settings.bins) for i in range(1, settings.bins)])
    trained = lambda c: F.when(F.col("_role") == TRAIN, F.col(c))
    fitted = rows.groupBy(*group).agg(F.coalesce(F.sum(trained("_y")), F.lit(0.0)).alias("total"), F.count(trained("_y")).alias("n"), *[F.array_distinct(F.percentile_approx(trained(f"_x{i}"), quantiles, F.lit(10_000))).alias(f"e{i}") for i in range(width)]).collect()
    groups = [tuple(r[k] for k in group) for r in fitted]
    number = {g: i for i, g in enumerate(groups)}
    edges = [[np.array(r[f"e{i}"] or [], float) for i in range(width)] for r in fitted]
    base = [settings.start(float(r["total"]), float(r["n"])) for r in fitted]
    numbered = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], rows.select(*group).schema.add("_group", "integer"))
    placed = rows.join(F.broadcast(numbered), group)  # a row for each cell and window

    def pack(frames):
        for f in frames:
            of, x = f["_group"].to_numpy(), f[[f"_x{i}" for i in range(width)]].to_numpy(float)
            bins = np.zeros((len(f), width), np.uint8)
            for i in np.unique(of):
                bins[of == i] = binned(x[of == i], edges[i])
            yield f[[*group, *units, "_y", "_role", "_ident", "_group"]].assign(_bins=[b.tobytes() for b in bins], _score=np.array(base)[of] if len(f) else np.empty(0))

    kinds = dict(placed.dtypes)
    columns = [*group, *units, "_y", "_role", "_ident", "_group"]
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", _bins binary, _score double"
    state = materialize(placed.mapInPandas(pack, kept), "boosting")
    trees: list[list[Tree]] = [[] for _ in groups]
    best, keep, live, written = np.full(len(groups), np.inf), np.zeros(len(groups), int), {i for i, r in enumerate(fitted) if r["n"]}, 0

    def scored(f: pd.DataFrame, since: int, forest: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = f["_group"].to_numpy()
        bins = np.frombuffer(b"".join(f["_bins"]), np.uint8).reshape(len(f), width)
        score = f["_score"].to_numpy(float).copy()
        for i in np.unique(of):
            at = np.flatnonzero(of == i)
            for tree in forest[i][since:]:
                score[at] += tree.value[tree.nodes(bins[at])]
        return of, bins, score

    def level_sums(level: int, round_: int, growing: dict[int, Tree], forest: list[list[Tree]], since: int, drawn: np.ndarray):
        size = len(drawn) * settings.bins

        def run(frames):
            sums: dict[int, np.ndarray] = {}
            errors: dict[int, np.ndarray] = {}
            for f in frames:
                of, bins, score = scored(f, since, forest)
                y, role, ident = f["_y"].to_numpy(float), f["_role"].to_numpy(), f["_ident"].to_numpy()
                for i in np.unique(of):
                    if i not in growing:
                        continue
                    mine = of == i
                    if level == 0 and (v := mine & (role == VALIDATION)).any():
                        errors[i] = errors.get(i, 0) + np.array([settings.losses(y[v], score[v]).sum(), v.sum()])
                    at = np.flatnonzero(mine & (role == TRAIN))
                    at = at[settings.sampled(ident[at], round_)]
                    node = growing[i].nodes(bins[at])
                    at, node = at[node >> level == 1], node[node >> level == 1]
                    if len(at):
                        g, h = settings.slopes(y[at], score[at])
                        sums[i] = sums.get(i, 0) + histogram(bins[at][:, drawn], node - (1 << level), g, h, 1 << level, settings.bins)
            for i, s in sums.items():
                place = np.flatnonzero(s[1].ravel())
                yield pd.DataFrame({"grp": np.int32(i), "place": place, "g": s[0].ravel()[place], "h": s[1].ravel()[place]})
            for i, e in errors.items():
                yield pd.DataFrame({"grp": [np.int32(i)], "place": [-1], "g": [e[0]], "h": [e[1]]})

        # histograms of a level: nodes x features x bins a group, whatever its rows
        found = state.where(F.col("_role") != TEST).mapInPandas(run, "grp int, place long, g double, h double").groupBy("grp", "place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        out = {}
        for i, part in found.groupby("grp"):
            s = np.zeros((2, (1 << level) * size))
            some = part[part.place >= 0]
            s[0, some.place], s[1, some.place] = some.g, some.h
            wrong = part[part.place < 0]
            out[int(i)] = s.reshape(2, 1 << level, len(drawn), settings.bins), (float(wrong.g.iloc[0] / wrong.h.iloc[0]) if len(wrong) else None)
        return out

    for r in range(settings.rounds + 1):
        growing, drawn = {i: Tree(settings.depth) for i in live}, settings.drawn(r, width)
        for level in range(settings.depth + 1):
            found = level_sums(level, r, growing, trees, written, drawn)
            for i, (sums, error) in found.items():
                if level == 0 and error is not None and r:  # of the trees so far
                    if error < best[i]:
                        best[i], keep[i] = error, r
                    elif r - keep[i] >= settings.patience:
                        live.discard(i)
                elif level == 0 and error is None:
                    keep[i] = r
                settle(growing[i], level, sums, drawn, settings)
            growing = {i: t for i, t in growing.items() if i in live}
            if not growing or r == settings.rounds or not any((t.feature[1 << level : 2 << level] >= 0).any() for t in growing.values()):
                break
        if not live or r == settings.rounds:
            break
        for i, t in growing.items():
            trees[i].append(t)
        if (r + 1) % RENEW == 0:
            since, forest = written, [list(t) for t in trees]

            def renew(frames, since=since, forest=forest):
                for f in frames:
                    yield f.assign(_score=scored(f, since, forest)[2])

            state, written = materialize(state.mapInPandas(renew, kept), "boosting"), r + 1
    final = [t[: int(k)] for t, k in zip(trees, keep, strict=True)]

    def finish(frames):
        for f in frames:
            for i, mine in f.groupby("_group"):
                bins = np.frombuffer(b"".join(mine["_bins"]), np.uint8).reshape(len(mine), width)
                yield _results(mine[[*group, *units, "_y"]], bins, base[i], final[i], width, settings)

    return state.where(F.col("_role") == TEST).mapInPandas(finish, _schema(rows, keys, units, OUT))


def boosted_windows(panel: DataFrame, wins: DataFrame, features: list[str], y: str, keys: tuple[str, ...] = (), units: tuple[str, ...] = ("ticker", "date"), settings: Booster = Booster(), date_idx: str = "date_idx") -> DataFrame:
    """Test rows of each cell and window: ``(keys, window, units, y, pred, base, contributions, rounds)``.

    Rows without a target are left out. ``contributions`` follow ``features``;
    their sum and ``base`` are the score (for ``logistic``: before it becomes a
    probability). A cell without training rows in a window predicts 0 (or a half).
    """
    keys, units = list(keys), list(units)
    rows = in_windows(panel, wins, features, y, keys, units, date_idx)
    large, groups = oversized(panel, wins, len(features), y, keys, date_idx)
    if large:
        names = panel.sparkSession.createDataFrame(large, rows.select(*keys, "window").schema)
        near = F.broadcast(names)  # at most a row for each cell and window
        out = grown_in_tasks(spread(rows.join(near, [*keys, "window"], "left_anti"), keys, groups), len(features), keys, units, settings)
        out = out.unionByName(grown_by_level(rows.join(near, [*keys, "window"], "left_semi"), len(features), keys, units, settings))
    else:
        out = grown_in_tasks(spread(rows, keys, groups), len(features), keys, units, settings)
    return out.withColumnRenamed("_y", y)


def experiment(panel: DataFrame, wins: DataFrame, features: list[str], y: str, keys: tuple[str, ...] = (), units: tuple[str, ...] = ("ticker", "date"), settings: Booster = Booster(), date_idx: str = "date_idx") -> DataFrame:
    """A regression and a direction booster in the same windows: ``(keys, window, units, y, pred, up)``, ``up`` the probability of a positive target."""
    value = boosted_windows(panel, wins, features, y, keys, units, settings, date_idx).select(*keys, "window", *units, y, "pred")
    signed = panel.withColumn("_up", F.when(F.col(y).isNotNull(), F.when(F.col(y) > 0, 1.0).otherwise(0.0)))
    sign = boosted_windows(signed, wins, features, "_up", keys, units, replace(settings, loss="logistic"), date_idx)
    return value.join(sign.select(*keys, "window", *units, F.col("pred").alias("up")), [*keys, "window", *units])
