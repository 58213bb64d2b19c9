"""Every registered panel query against its DuckDB SQL on the smallest tables."""

import decimal

import pytest
from conftest import DATA

from panelforge.plans.catalog import ORACLES, QUERIES

#: Model fits without SQL, and the number of models in each; their kernels are compared with plain numpy in ``test_models.py``.
MODELS = {"wf_linear": 2, "wf_gbt": 1, "wf_direction": 2, "wf_experiment": 1}


def norm(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert sorted(names) == cols
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - set(MODELS) - {"tree_attribution"}))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_signal_rises_with_strength(spark):
    rows = QUERIES["signal_injection"](spark, "/root/testdata/sf0.01").orderBy("strength").collect()
    ics = [r["ic"] for r in rows]
    assert abs(ics[0]) < 0.02 and ics == sorted(ics)


def test_recovered_signal_rises_with_strength(spark):
    rows = QUERIES["signal_recovery"](spark, "/root/testdata/sf0.01").collect()
    by = {m: {r["strength"]: r for r in rows if r["model"] == m} for m in ("ols", "ridge", "without")}
    for m in ("ols", "ridge"):
        assert by[m][0.15]["ic"] > by[m][0.05]["ic"] > by[m][0.0]["ic"]
        assert by[m][0.15]["surviving"] == by[m][0.15]["seeds"] == 3
    assert by["ols"][0.15]["ic"] > by["without"][0.15]["ic"]


def test_ols_coefficients_equal_numpy(spark):
    import numpy as np

    from panelforge.plans.model_queries import _features

    got = {r["feature"]: r for r in QUERIES["ols_coefficients"](spark, DATA).collect()}
    p = _features(spark, DATA).toPandas()
    n = p.date_idx.max() + 1
    last = list(range(120, n - 13, 13))[-1]
    p = p[(p.date_idx < last - 1) & p.target.notna()]
    x = np.column_stack([np.ones(len(p)), p[["A", "B", "C"]].fillna(0.0)])
    beta = np.linalg.lstsq(x, p.target.to_numpy(), rcond=None)[0]
    e = p.target - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(p) - 4))
    for i, f in enumerate(("constant", "A", "B", "C")):
        assert got[f]["n"] == len(p)
        assert (got[f]["beta"], got[f]["t"]) == pytest.approx((beta[i], beta[i] / se[i]), abs=2e-5)


@pytest.mark.parametrize("name", sorted(MODELS))
def test_models_walk_to_the_end(spark, name):
    """Real fits at full size: every window is there, each with its test rows."""
    rows = QUERIES[name](spark, DATA).collect()
    models = {r["model"] for r in rows} if "model" in rows[0].asDict() else {None}
    windows = {r["window"] for r in rows}
    assert len(models) == MODELS[name] and len(rows) == len(models) * len(windows) and windows == set(range(len(windows))) and len(windows) > 10
    assert all(r["n"] > 0 for r in rows)


def test_tree_attribution_adds_up(spark):
    rows = QUERIES["tree_attribution"](spark, DATA).collect()
    assert {r["feature"] for r in rows} == {"A", "B", "C"} and all(r["gap"] < 1e-8 and r["lo"] <= r["mean"] <= r["hi"] for r in rows)
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-6


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
