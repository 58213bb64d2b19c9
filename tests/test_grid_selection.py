"""Resumable grid, upsert of partitions, exact selection and averages with gaps, each against a plain version."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from panelforge.operators import averages, grid, inference, ordering, panel, selection
from panelforge.sources import tables


def cells_of(spark):
    return spark.createDataFrame([(m, s, h) for m in ("a", "b", "c") for s in ("x", "y") for h in (1, 2)], "model string, scheme string, horizon int").coalesce(1)


def compute(unit, cells):
    rows = cells.crossJoin(cells.sparkSession.range(0, 30, 1, 1).withColumnRenamed("id", "i"))
    value = F.sin(F.hash("model", "scheme", "horizon", "i") / 7.0)
    return rows.select("model", "scheme", "horizon", (F.col("i") % 3).cast("int").alias("window"), value.alias("y"), (value + F.cos("i")).alias("pred"), (F.col("i") % 3 / 10.0).alias("mean"))


def test_a_run_that_is_cut_off_loses_one_unit(spark, tmp_path):
    cell = ["model", "scheme", "horizon"]
    whole = grid.ResultTable(spark, f"{tmp_path}/whole", cell)
    assert grid.run(whole, cells_of(spark), ["model", "scheme"], compute) == 6
    cut, calls = grid.ResultTable(spark, f"{tmp_path}/cut", cell), []

    def until(unit, cells):
        calls.append(unit)
        if len(calls) == 4:  # its rows are written, but the run ends before they are recorded
            tables.overwrite_partitions(compute(unit, cells).withColumn("pred", F.lit(99.0)), cut.path, cell)
            raise KeyboardInterrupt
        return compute(unit, cells)

    with pytest.raises(KeyboardInterrupt):
        grid.run(cut, cells_of(spark), ["model", "scheme"], until)
    assert cut.done().count() == 6 and cut.read().where("pred = 99").count() == 0
    assert grid.run(cut, cells_of(spark), ["model", "scheme"], compute) == 3
    assert grid.run(cut, cells_of(spark), ["model", "scheme"], compute) == 0
    columns = whole.read().columns
    rows = lambda t: sorted(tuple(r[c] for c in columns) for r in t.read().collect())
    assert rows(cut) == rows(whole) and len(rows(cut)) == 360


def test_pooled_against_the_mean_of_training_means(spark, tmp_path):
    rows = compute({}, cells_of(spark)).toPandas()
    got = {(r["model"], r["scheme"], r["horizon"]): r for r in grid.pooled_metrics(compute({}, cells_of(spark)), ["model", "scheme", "horizon"]).collect()}
    for key, g in rows.groupby(["model", "scheme", "horizon"]):
        base = g.groupby("window")["mean"].first().mean()
        r = got[key]
        assert r["r2"] == pytest.approx(1 - ((g.y - g.pred) ** 2).sum() / ((g.y - base) ** 2).sum()) and r["windows"] == 3 and r["n"] == 30
        assert r["ic"] == pytest.approx(g.y.rank().corr(g.pred.rank()))


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/table"
    first = spark.createDataFrame([(p, k, f"old{p}{k}") for p in "abc" for k in range(3)], "p string, k int, v string")
    assert tables.upsert_partitions(first, path, ["p", "k"], ["p"]) == 3
    files = lambda p: sorted(f.name for f in (tmp_path / "table" / f"p={p}").glob("part-*"))
    before = {p: files(p) for p in "abc"}
    new = spark.createDataFrame([("b", 1, "new"), ("b", 7, "more"), ("d", 0, "fresh"), ("b", 1, "newer")], first.schema)
    assert tables.upsert_partitions(new.where("v <> 'new'"), path, ["p", "k"], ["p"]) == 2
    assert files("a") == before["a"] and files("c") == before["c"] and files("b") != before["b"]
    got = {(r["p"], r["k"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 11 and got["b", 1] == "newer" and got["b", 7] == "more" and got["b", 0] == "oldb0" and got["d", 0] == "fresh"


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    special = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 1.0, 1.0000000000000002]
    rows = [("hot", rng.choice([7.5, rng.gauss(0, 1), rng.choice(special)]), rng.gauss(0, 1e6)) for _ in range(3000)]
    rows += [("same", -2.25, None) for _ in range(400)] + [("few", rng.random(), float(i)) for i in range(5)] + [("none", None, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(5)


bits = lambda v: None if v is None else [struct.pack("<d", x + 0.0) for x in v]


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_selection_equals_percentile_to_the_bit(values, monkeypatch, keys):
    shares = {"x": [0.0, 0.001, 0.5, 0.73, 1.0], "y": [0.25, 0.5]}
    want = {tuple(r[k] for k in keys): r for r in values.where("x is null or abs(x) < 1e301").groupBy(*keys).agg(*[F.percentile(c, s).alias(c) for c, s in shares.items()]).collect()}
    monkeypatch.setattr(selection, "WHOLE", 100)
    got = {tuple(r[k] for k in keys): r for r in selection.quantiles(values.where("x is null or abs(x) < 1e301"), shares, keys).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert bits(got[k]["x"]) == bits(r["x"]) and bits(got[k]["y"]) == bits(r["y"])


def test_selection_orders_special_values(values, monkeypatch):
    monkeypatch.setattr(selection, "WHOLE", 100)
    data = sorted((r["x"] + 0.0 for r in values.where("g = 'hot'").collect()))
    n = len(data)
    got = selection.quantiles(values.where("g = 'hot'"), {"x": [i / (n - 1) for i in range(0, n, 211)]}).first()["x"]
    for i, v in zip(range(0, n, 211), got, strict=True):
        assert v in (data[i], data[max(0, i - 1)], data[min(n - 1, i + 1)]) or min(data[max(0, i - 1)], data[i]) <= v <= data[min(n - 1, i + 1)]


def test_operators_by_selection_equal_theirs_in_one_task(spark, values, monkeypatch):
    df = values.where("x is not null and abs(x) < 1e6").withColumn("date", F.lit(1))
    runs = []
    for whole in (1_000_000, 50):
        monkeypatch.setattr(selection, "WHOLE", whole)
        a = panel.winsorize(df, ["x", "y"], F.lit(True), 0.01, 0.99)
        b = panel.impute(df.withColumn("x", F.when(F.col("x") > 1, F.col("x"))), ["x", "y"], F.lit(True), "g")
        c = inference.conformal(df.where("y is not null"), df.where("y is not null"), "x", "y", 0.1)
        runs.append([sorted(map(tuple, f.collect()), key=repr) for f in (a, b, c)])
    assert runs[0] == runs[1]


def test_ranks_in_parts_equal_plain_ones(spark, values, monkeypatch):
    df = values.where("x is not null").select("g", "x", F.monotonically_increasing_id().alias("id")).cache()
    plain = sorted(map(tuple, ordering.ranked(df, {"x": "r"}, ["g"]).collect()))
    monkeypatch.setattr(ordering, "WHOLE", 10)
    assert sorted(map(tuple, ordering.ranked(df, {"x": "r"}, ["g"], 8).collect())) == plain


def recursion(xs, span):
    """Average with absolute gaps: the old weight ages with each row, missing or not."""
    alpha, y, weight, out = 2 / (span + 1), None, 1.0, []
    for x in xs:
        if y is None:
            y = x
        else:
            weight *= 1 - alpha
            if x is not None:
                y, weight = (weight * y + alpha * x) / (weight + alpha), 1.0
        out.append(y)
    return out


@pytest.mark.parametrize("spans", [(3, 9), (2, 60), (26, 252)])
def test_averages_equal_the_recursion_with_gaps(spark, spans):
    rng = random.Random(sum(spans))
    series = {
        "full": [rng.gauss(5, 1) for _ in range(700)],
        "gaps": [None if rng.random() < 0.6 else rng.gauss(0, 1) for _ in range(900)],
        "late": [None] * 333 + [rng.gauss(0, 3) if i % 97 == 0 else None for i in range(800)],
        "one": [4.0], "none": [None] * 5,
    }
    rows = [(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "ticker string, t int, x double").withColumn("date", F.date_add(F.lit("2001-01-01").cast("date"), F.col("t"))).repartition(7)
    out = averages.emas(df, {"a": (F.col("x"), spans[0]), "b": (F.abs("x"), spans[1])})
    assert out.columns == [*df.columns, "a", "b"]
    got = {(r["ticker"], r["t"]): (r["a"], r["b"]) for r in out.collect()}
    for k, xs in series.items():
        for i, (a, b) in enumerate(zip(recursion(xs, spans[0]), recursion([None if x is None else abs(x) for x in xs], spans[1]), strict=True)):
            for mine, want in zip(got[k, i], (a, b), strict=True):
                assert (mine is None) == (want is None) and (want is None or math.isclose(mine, want, rel_tol=1e-9, abs_tol=1e-9)), (k, i, mine, want)


def test_no_row_collects_its_history(spark):
    plan = averages.emas(spark.createDataFrame([("a", 1, 1.0)], "ticker string, t int, x double").withColumn("date", F.lit("2001-01-01").cast("date")), {"a": (F.col("x"), 26)})._jdf.queryExecution().optimizedPlan().toString()
    # the only lists are of a block's maps, after the grouping by block
    assert all("_m0" in line or "_l0" in line for line in plan.split("\n") if "collect_list" in line)
