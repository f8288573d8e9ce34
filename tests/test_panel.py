"""Panel operators on small frames: order-dependent and recursive ones, guards, leakage, and a few queries against DuckDB."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest

from panelweft.functions import linalg
from panelweft.operators import channels, graph, joins, stats, windows
from panelweft.plans import panels, queries
from panelweft.sources import ingest

DAY = dt.date(2000, 1, 3)


def week(k):
    return DAY + dt.timedelta(weeks=k)


@pytest.fixture(scope="module")
def series(spark):
    draw = np.random.default_rng(8)
    rows = []
    for e in "ab":
        y = 50 + np.cumsum(draw.normal(0, 1, 120)) + 5 * np.sin(np.arange(120) / 52 * 2 * np.pi)
        rows += [(e, week(k), float(y[k]), k + 1) for k in range(120)]
    return spark.createDataFrame(rows, "entity string, date date, y double, widx int")


@pytest.fixture(scope="module")
def origins(spark, series):
    return series.where("widx IN (70, 90)").selectExpr("entity", "date AS origin", "widx")


def test_fill_keeps_leading_gaps_and_entities_apart(spark):
    rows = [("a", week(0), 1.0), ("a", week(1), None), ("a", week(2), 3.0), ("b", week(0), None), ("b", week(1), 5.0), ("b", week(2), None)]
    filled, log = joins.ffill_log(spark.createDataFrame(rows, "entity string, date date, y double"))
    got = {(r["entity"], r["date"]): r["y"] for r in filled.collect()}
    assert got["a", week(1)] == 1.0 and got["b", week(0)] is None and got["b", week(2)] == 5.0
    assert sorted((r["entity"], r["filled_value"]) for r in log.collect()) == [("a", 1.0), ("b", 5.0)]


def test_asof_takes_ties_and_leaves_the_unmatched(spark):
    left = spark.createDataFrame([(week(0),), (week(1),), (week(2),)], "date date")
    right = spark.createDataFrame([(week(1), 1.0), (week(2), 2.0), (None, 9.0)], "at date, v double")
    assert [r["v"] for r in joins.asof_join(left, right, "date", "at", ["v"]).orderBy("date").collect()] == [None, 1.0, 2.0]


def test_forward_actuals_need_all_steps(spark, series):
    o = series.where("widx IN (100, 118)").selectExpr("entity", "date AS origin", "widx")
    h = spark.createDataFrame([(4,), (2,)], "h int")
    got = joins.forward_actuals(series, o, h).groupBy("entity", "origin", "h").count().collect()
    assert sorted((r["origin"], r["h"], r["count"]) for r in got if r["entity"] == "a") == [(week(99), 2, 2), (week(99), 4, 4), (week(117), 2, 2)]


def test_revision_diff(spark, series):
    same = ingest.revision_diff(series, series, ["entity", "date"], ["y"])
    assert same.count() == 0
    changed = series.selectExpr("entity", "date", "CASE WHEN entity = 'a' AND widx = 3 THEN y + 1 ELSE y END AS y", "widx")
    assert ingest.revision_diff(series, changed, ["entity", "date"], ["y"]).count() == 1


CHANNELS = {
    "naive": channels.naive,
    "seasonal_naive": channels.seasonal_naive,
    "seasonal": channels.seasonal,
    "holt": channels.holt,
    "adjusted_trend": channels.adjusted_trend,
    "adjusted_theta": channels.adjusted_theta,
}


@pytest.mark.parametrize("name", CHANNELS)
def test_channels_see_nothing_after_the_origin(spark, series, origins, name):
    o = origins.where("widx = 90")

    def values(s):
        return {(r["entity"], r["step"]): r["yhat"] for r in CHANNELS[name](s, o, 4).collect()}

    full = values(series)
    assert len(full) == 8
    future = values(series.selectExpr("entity", "date", "CASE WHEN widx > 90 THEN y * 3 ELSE y END AS y", "widx"))
    past = values(series.selectExpr("entity", "date", "CASE WHEN widx <= 90 THEN y * 1.5 ELSE y END AS y", "widx"))
    assert all(math.isclose(full[k], future[k], rel_tol=1e-12) for k in full)
    assert any(abs(full[k] - past[k]) > 1e-6 for k in full)


def test_holt_is_the_best_grid_point(series, origins):
    got = {(r["entity"], r["widx"]): r for r in channels.trend_fit(channels.histories(series, origins)).collect()}
    ys = [r["y"] for r in series.where("entity = 'a' AND widx <= 70").orderBy("widx").collect()]
    best = None
    for a in channels.ALPHAS:
        for b in channels.BETAS:
            level, trend, error = ys[0], ys[1] - ys[0], 0.0
            for y in ys[1:]:
                e = y - level - trend
                level, trend, error = level + trend + a * e, trend + a * b * e, error + e * e
            if best is None or round(error, 9) < best[0]:
                best = (round(error, 9), level, trend, a, b)
    r = got["a", 70]
    assert (r["alpha"], r["beta"]) == best[3:]
    assert math.isclose(r["level"], best[1], rel_tol=1e-9) and math.isclose(r["trend"], best[2], rel_tol=1e-6, abs_tol=1e-9)


def test_bounds_are_enforced_step_by_step(spark):
    f = spark.createDataFrame([("x", "a", DAY, k + 1, v) for k, v in enumerate([10.5, 20.0, 20.5, -3.0])], "channel string, entity string, origin date, step int, yhat double")
    last = spark.createDataFrame([("a", DAY, 10.0)], "entity string, origin date, y0 double")
    bound = spark.createDataFrame([("a", 0.1)], "entity string, bound double")
    assert [r["problem"] for r in graph.boundary_check(f, last, bound).orderBy("step").collect()] == ["jump", "floor"]
    r = graph.enforce(f, last, bound).collect()[0]
    assert np.allclose(r["path"], [10.5, 11.55, 12.705, 11.4345]) and r["corrected"] and not r["fell_back"] and r["attempts"] == 1


def test_gate_order(spark):
    rows = [("a", True, 9.0, 9.0), ("b", None, 2.1, 9.0), ("c", False, 2.0, 2.6), ("d", False, None, None)]
    out = graph.gate(spark.createDataFrame(rows, "entity string, event_live boolean, z double, shock_z double")).collect()
    assert {r["entity"]: r["trigger"] for r in out} == {"a": "event", "b": "own_error", "c": "neighbour_shock", "d": "none"}


def test_tails_and_regression(spark):
    assert math.isclose(linalg.t_tail(2.228139, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(linalg.f_tail(4.102821, 2, 10), 0.05, abs_tol=1e-6)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 2))
    y = x @ [1.5, -2.0] + draw.normal(size=200)
    rows = [(str(i % 8), week(i // 8), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(200)]
    df = spark.createDataFrame(rows, "entity string, date date, y double, x1 double, x2 double")
    got = {r["term"]: r for r in stats.panel_regression(df, "y", ["x1", "x2"], effects=[["entity"]]).collect()}
    groups = np.arange(200) % 8
    xd = x - np.stack([x[groups == g].mean(0) for g in range(8)])[groups]
    yd = y - np.array([y[groups == g].mean() for g in range(8)])[groups]
    b = np.linalg.lstsq(xd, yd, rcond=None)[0]
    inv = np.linalg.inv(xd.T @ xd)
    s = np.stack([(xd * (yd - xd @ b)[:, None])[groups == g].sum(0) for g in range(8)])
    se = np.sqrt(np.diag(inv @ s.T @ s @ inv) * 8 / 7 * 199 / 198)
    for i, term in enumerate(("x1", "x2")):
        assert math.isclose(got[term]["coef"], b[i], rel_tol=1e-9) and math.isclose(got[term]["se"], se[i], rel_tol=1e-9)


def test_granger_finds_the_direction(spark):
    draw = np.random.default_rng(2)
    a = np.cumsum(draw.normal(size=150))
    b = np.concatenate([[0], a[:-1]]) + draw.normal(0, 0.1, 150)
    s = spark.createDataFrame([(e, week(k), float(v[k])) for e, v in (("a", a), ("b", b)) for k in range(150)], "entity string, date date, y double")
    p = {(r["source"], r["target"]): r["p_value"] for r in stats.granger(joins.ordered_pairs(s), s, 3).collect()}
    assert p["a", "b"] < 1e-6 < p["b", "a"]


def test_episodes(spark):
    labels = ["x", "x", "y", "x", None, None]
    df = spark.createDataFrame([("a", week(k), v) for k, v in enumerate(labels)], "entity string, date date, regime string")
    assert sorted((r["episode"], r["weeks"]) for r in windows.episodes(df).collect()) == [(1, 2), (2, 1), (3, 1), (4, 2)]


@pytest.mark.parametrize("name", ["j1_asof_join", "j2_ffill_log", "w5_regime", "s17_coverage", "h1_fold_table"])
def test_queries_equal_their_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    with duckdb.connect() as con:
        for t in ("orders", "customer", "supplier", "lineitem", "events"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.sql(queries.ORACLES[name])
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert {tuple(map(str, r)) for r in want.select(*columns).fetchall()} == {tuple(map(str, r)) for r in got.select(*columns).collect()}


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert panels.HORIZONS == [4, 8, 13]
