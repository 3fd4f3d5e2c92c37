"""Boosted trees: a booster in numpy that grows node by node, missing values,
partitionings, early stop and the model table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmetrics.operators import boosting as bo

EXACT = dict(rounds=3, step=0.3, depth=3, l1=0.5, l2=2.0, gamma=0.1, min_child=2.0, row_share=1.0, column_share=1.0, bins=16)


def _data(n=400, seed=3, missing=True):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)).round(2)
    y = 3 * (x[:, 0] > 0.2) + x[:, 1] * x[:, 2] + 0.1 * r.normal(size=n)
    if missing:
        x[r.random((n, 4)) < 0.15] = np.nan
        y[np.isnan(x[:, 3])] += 2
    return x, y


def _frame(spark, x, y, held=None):
    rows = [(i, [None if math.isnan(v) else float(v) for v in x[i]], float(y[i]), bool(held[i]) if held is not None else False)
            for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double, held boolean")


def _brute(x, y, p, logistic=False):
    """Recursive second-order trees over the same candidate borders."""
    n, width = x.shape
    edges = []
    for f in range(width):
        v = np.sort(x[:, f][~np.isnan(x[:, f])])
        edges.append(sorted({v[max(math.ceil((i + 1) / p.bins * len(v)) - 1, 0)] for i in range(p.bins - 1)}) if len(v) else [])
    soft = lambda g: np.sign(g) * max(abs(g) - p.l1, 0.0)
    base = math.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    out = np.full(n, base)

    def grow(rows, g, h, depth):
        total = soft(g[rows].sum()) ** 2 / (h[rows].sum() + p.l2)
        best = None
        for f in range(width if depth else 0):
            gone = np.isnan(x[rows, f])
            for e in edges[f] + [math.inf]:
                for missing_left in (False, True):
                    left = np.where(gone, missing_left, x[rows, f] <= e)
                    a, b = rows[left], rows[~left]
                    if min(h[a].sum(), h[b].sum()) < p.min_child:
                        continue
                    gain = sum(soft(g[k].sum()) ** 2 / (h[k].sum() + p.l2) for k in (a, b)) - total
                    if gain > p.gamma and (best is None or gain > best[0] + 1e-7):
                        best = (gain, a, b)
        if best is None:
            out[rows] += -p.step * soft(g[rows].sum()) / (h[rows].sum() + p.l2)
            return
        grow(best[1], g, h, depth - 1)
        grow(best[2], g, h, depth - 1)

    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-out))
        g, h = (q - y, q * (1 - q)) if logistic else (out - y, np.ones(n))
        grow(np.arange(n), g, h, p.depth)
    return 1 / (1 + np.exp(-out)) if logistic else out


def _predict(model, df):
    return np.array([r["p"] for r in df.select("id", model.predict(F.col("x")).alias("p")).orderBy("id").collect()])


@pytest.mark.parametrize("missing", [False, True])
def test_equals_brute_force(spark, missing):
    x, y = _data(missing=missing)
    p = bo.Params(**EXACT)
    df = _frame(spark, x, y)
    got = _predict(bo.fit(df, "id", F.col("x"), 4, "y", params=p), df)
    assert np.abs(got - _brute(x, y, p)).max() < 1e-4


def test_logistic_equals_brute_force(spark):
    x, y = _data(missing=False)
    y = (y > 1.5).astype(float)
    p = bo.Params(**{**EXACT, "objective": "logistic", "rounds": 2})
    df = _frame(spark, x, y)
    got = _predict(bo.fit(df, "id", F.col("x"), 4, "y", params=p), df)
    assert np.abs(got - _brute(x, y, p, logistic=True)).max() < 1e-4


def test_same_trees_under_any_partitioning_and_past_a_stored_margin(spark, monkeypatch):
    monkeypatch.setattr(bo, "FOLD", 2)
    x, y = _data()
    p = bo.Params(**{**EXACT, "rounds": 5, "depth": 2, "row_share": 0.7, "column_share": 0.5})
    df = _frame(spark, x, y)
    tables = [bo.fit(d, "id", F.col("x"), 4, "y", params=p).table(spark).orderBy("tree", "node").collect()
              for d in (df.coalesce(1), df.repartition(7))]
    assert tables[0][1:] == tables[1][1:]
    assert len({r["tree"] for r in tables[0]}) == 6


def test_stops_early_and_keeps_the_best_trees(spark):
    x, y = _data(n=300, missing=False)
    r = np.random.default_rng(1)
    y = r.normal(size=300) + (x[:, 0] > 0)
    held = np.arange(300) % 3 == 0
    p = bo.Params(**{**EXACT, "rounds": 40, "step": 0.9, "gamma": 0.0, "l1": 0.0, "l2": 0.0, "min_child": 1.0, "depth": 2, "patience": 3})
    df = _frame(spark, x, y, held)
    model = bo.fit(df, "id", F.col("x"), 4, "y", "held", p)
    assert len(model.losses) < 40 and len(model.losses) - 1 - len(model.trees) == 3
    assert model.losses[len(model.trees)] == min(model.losses)
    got = _predict(model, df)
    assert abs(((got - y)[held] ** 2).mean() - min(model.losses)) < 1e-6


def test_strong_l1_leaves_the_mean(spark):
    x, y = _data(n=100)
    df = _frame(spark, x, y)
    model = bo.fit(df, "id", F.col("x"), 4, "y", params=bo.Params(**{**EXACT, "l1": 1e9, "rounds": 1}))
    assert np.abs(_predict(model, df) - y.mean()).max() < 1e-9


def test_model_table_round_trip(spark):
    x, y = _data(n=200)
    p = bo.Params(**{**EXACT, "rounds": 3})
    df = _frame(spark, x, y)
    model = bo.fit(df, "id", F.col("x"), 4, "y", params=p)
    back = bo.from_table(model.table(spark), 4, p)
    assert np.array_equal(_predict(back, df), _predict(model, df))


def test_edge_rows(spark):
    schema = "id long, x array<double>, y double"
    p = bo.Params(**{**EXACT, "rounds": 1})
    empty = spark.createDataFrame([], schema)
    assert bo.fit(empty, "id", F.col("x"), 2, "y", params=p).trees == []
    odd = spark.createDataFrame([(None, [None, 1.0], 1.0), (1, None, 5.0), (1, [0.0, None], None), (2, [float("inf"), None], 3.0),
                                 (2, [float("inf"), None], 3.0)], schema)
    model = bo.fit(odd, "id", F.col("x"), 2, "y", params=p)
    assert abs(model.base - 7 / 3) < 1e-12
    scored = odd.select(model.predict(F.col("x")).alias("p")).collect()
    assert sum(r["p"] is None for r in scored) == 1
    with pytest.raises(ValueError):
        bo.fit(odd, "id", F.col("x"), 0, "y", params=p)


@pytest.mark.parametrize("objective", ["squared", "logistic"])
def test_one_task_grows_the_trees_of_the_jobs(spark, monkeypatch, objective):
    r = np.random.default_rng(5)
    x, y = _data(n=500)
    x = np.concatenate([x, r.poisson(0.2, size=(500, 5))], axis=1)
    if objective == "logistic":
        y = (y > 1.5).astype(float)
    p = bo.Params(**{**EXACT, "rounds": 6, "row_share": 0.7, "column_share": 0.6, "gamma": 0.01, "objective": objective})
    df = _frame(spark, x, y, np.arange(500) % 5 == 0)
    monkeypatch.setattr(bo, "SUM_ROWS", 64)
    one = bo.fit(df, "id", F.col("x"), 9, "y", "held", p)
    monkeypatch.setattr(bo, "LOCAL_ROWS", 0)
    jobs = bo.fit(df, "id", F.col("x"), 9, "y", "held", p)
    assert one.losses == jobs.losses and len(one.trees) == len(jobs.trees) > 2
    assert one.table(spark).collect() == jobs.table(spark).collect()
    assert one.table(spark).filter("feature >= 4").count() > 0


def test_the_whole_chain_trains_all_rounds_of_the_reference(spark, monkeypatch):
    """no parameter of ``end_to_end_boosting`` leaves rounds or bins out."""
    import inspect

    from threadmetrics.plans import catalog as cat
    rows = spark.createDataFrame([(f"c{i}", [0.0] * cat.pr.FULL_WIDTH) for i in range(20)], "Top_comment_id string, x array<double>")
    monkeypatch.setattr(cat, "_t", lambda *a: None)
    monkeypatch.setattr(cat.pr, "metric_pca", lambda *a: (None, None))
    monkeypatch.setattr(cat.pr, "full_features", lambda *a: rows)
    monkeypatch.setattr(cat.pr, "pc0", lambda *a: rows.select("Top_comment_id", F.lit(1.0).alias("PC0")))
    used, fit = [], inspect.signature(bo.fit)

    def seen(*args, **kwargs):
        call = fit.bind(*args, **kwargs)
        call.apply_defaults()
        used.append(call.arguments["params"])
        return bo.Boosted(bo.Params(), 1.0, cat.pr.FULL_WIDTH)

    monkeypatch.setattr(cat.bo, "fit", seen)
    assert cat.end_to_end_boosting(spark, "").count() == 20
    p, = used
    assert (p.rounds, p.step, p.bins, p.patience, p.depth, p.row_share, p.column_share) == (3000, 0.005, 256, 50, 4, 0.8, 0.8)
