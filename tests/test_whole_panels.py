"""Panel operators and queries over whole histories, all origins and all events."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest

from panelweft.operators import channels, joins, windows
from panelweft.plans import panels, queries


@pytest.fixture(scope="module")
def long_series(spark):
    draw = np.random.default_rng(3)
    y = 200 + np.cumsum(draw.normal(0.3, 2, 343))
    rows = [("a", dt.date(1995, 1, 2) + dt.timedelta(weeks=k), float(y[k]), k + 1) for k in range(343)]
    return spark.createDataFrame(rows, "entity string, date date, y double, widx int")


def test_fits_read_every_row_up_to_the_origin(long_series):
    o = long_series.where("widx = 340").selectExpr("entity", "date AS origin", "widx")
    ys = [r["y"] for r in long_series.where("widx <= 340").orderBy("widx").collect()]
    assert channels.histories(long_series, o).collect()[0]["ys"] == ys
    assert channels.histories(long_series, o, 260).collect()[0]["ys"] == ys[-260:]
    state = channels.seasonal_states(long_series, o, kinds=channels.ADJUSTED).collect()[0]
    weeks = [r["date"].isocalendar()[1] for r in long_series.where("widx <= 340").orderBy("widx").collect()]
    adjusted = [y / state["factors"][w - 1] for y, w in zip(ys, weeks, strict=True)]
    for kind, damped in (("fa_ets", False), ("fa_ets_d", True)):
        fit = state["fits"][kind]
        _, a, _, p, level, trend = plain_trend(adjusted, damped)
        assert (fit["n"], fit["alpha"], fit["phi"]) == (340, a, p)
        assert math.isclose(fit["level"], level, rel_tol=1e-9) and math.isclose(fit["trend"], trend, rel_tol=1e-9)
    assert math.isclose(state["fits"]["fa_theta"]["slope"], np.polyfit(np.arange(340), adjusted, 1)[0], rel_tol=1e-9)


def plain_factors(ys, weeks, smooth=3):
    """The factors at the end of ys, every average made anew."""
    ratios = {}
    for t, y in enumerate(ys):
        near = ys[max(t - 26, 0) : t + 26]
        if len(near) >= 26:
            ratios.setdefault(weeks[t], []).append(y / (sum(near) / len(near)))
    raw = [float(np.median(ratios[w])) if len(ratios.get(w, [])) >= 2 else 1.0 for w in range(1, 54)]
    s = [np.mean([raw[(k + j) % 53] for j in range(-(smooth // 2), smooth // 2 + 1)]) for k in range(53)]
    return [1.0] * 53 if len(ys) < 53 else [x / np.mean(s) for x in s]


@pytest.mark.parametrize("smooth", [1, 3, 5])
def test_factors_of_every_origin_equal_a_plain_version(long_series, smooth):
    rows = long_series.orderBy("widx").collect()
    ys, weeks = [r["y"] for r in rows], [r["date"].isocalendar()[1] for r in rows]
    o = long_series.where("widx % 7 = 0 OR widx < 30").selectExpr("entity", "date AS origin", "widx")
    got = {r["origin"]: r["factors"] for r in channels.seasonal_states(long_series, o, smooth).collect()}
    assert len(got) == o.count()
    for k, r in enumerate(rows):
        if r["date"] in got:
            assert np.allclose(got[r["date"]], plain_factors(ys[: k + 1], weeks[: k + 1], smooth), rtol=1e-9)


def plain_trend(ys, damped):
    best = None
    for a in channels.ALPHAS:
        for b in channels.BETAS:
            for p in channels.PHIS if damped else (1.0,):
                level, trend, error = ys[0], ys[1] - ys[0], 0.0
                for y in ys[1:]:
                    e = y - level - p * trend
                    level, trend, error = level + p * trend + a * e, p * trend + a * b * e, error + e * e
                best = min(best or (math.inf,), (round(error, 9), a, b, p, level, trend))
    return best


@pytest.mark.parametrize("damped", [False, True])
def test_holt_equals_the_plain_recursion_on_all_rows(long_series, damped):
    o = long_series.where("widx = 340").selectExpr("entity", "date AS origin", "widx")
    ys = [r["y"] for r in long_series.where("widx <= 340").orderBy("widx").collect()]
    *_, p, level, trend = plain_trend(ys, damped)
    for r in channels.holt(long_series, o, damped=damped).collect():
        want = level + trend * sum(p**k for k in range(1, r["step"] + 1))
        assert math.isclose(r["yhat"], max(want, 0.0), rel_tol=1e-9)


def cell(v):
    return format(v, ".5f") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["w2_centred_average_at", "f3_seasonal_factors", "f4_seasonal", "f7_adjusted_trend", "f8_adjusted_theta", "s9_expand_active_weeks", "s10_attach_interpretation", "j7_active_event", "f15_event_flat", "f16_event_scaled"])
def test_queries_equal_their_sql_over_all_origins_and_events(spark, sf, name):
    sql = queries.ORACLES[name]
    for cut in ("WHERE o.widx % 8 = 0", "WHERE widx % 8 = 0", "AND o_orderkey % 37 = 0"):
        sql = sql.replace(cut, "")
    got = queries.QUERIES[name](spark, sf)
    with duckdb.connect() as con:
        for t in ("orders", "customer", "lineitem"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.sql(sql)
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        want = sorted(tuple(map(cell, r)) for r in want.select(*columns).fetchall())
    assert want == sorted(tuple(map(cell, r)) for r in got.select(*columns).collect())


@pytest.mark.parametrize("name", ["f5_holt", "f6_holt_damped", "f7_adjusted_trend", "f8_adjusted_theta"])
def test_fitted_channels_forecast_from_every_origin(spark, sf, name):
    want = {(r["entity"], r["origin"]) for r in panels.origins(spark, sf).collect()}
    got = queries.QUERIES[name](spark, sf).groupBy("entity", "origin").count().collect()
    assert {(r["entity"], r["origin"]) for r in got} == want
    assert {r["count"] for r in got} == {channels.MAX_STEP * (2 if name == "f7_adjusted_trend" else 1)}


def test_slope_disagreement_counts_every_origin(spark, sf):
    s = panels.series(spark, sf)
    last = {r["entity"]: r["n"] for r in s.groupBy("entity").agg({"widx": "max"}).toDF("entity", "n").collect()}
    want = {}
    for r in panels.origins(spark, sf, s).collect():
        want[r["entity"]] = want.get(r["entity"], 0) + (r["widx"] + 13 <= last[r["entity"]])
    assert {r["entity"]: r["n"] for r in queries.QUERIES["f22_slope_disagreement"](spark, sf).collect()} == want


def test_bounds_of_filled_series_need_no_row_for_a_week_without_a_value(spark, sf):
    week = lambda k: dt.date(1995, 1, 2) + dt.timedelta(weeks=k)
    seen = {"gaps": {0: 4.0, 1: 6.0, 5: 3.0}, "dense": {k: 2.0 + k for k in range(10)}, "late": {9: 5.0}, "early": {0: 5.0}, "zero": {2: 0.0, 4: 3.0}, "none after": {3: 0.0}}
    rows = spark.createDataFrame([(e, week(k), y) for e, ys in seen.items() for k, y in ys.items()], "entity string, date date, y double")
    grid = spark.createDataFrame([(e, week(k)) for e in seen for k in range(10)], "entity string, date date").join(rows, ["entity", "date"], "left")
    filled = joins.ffill_log(grid)[0].where("y IS NOT NULL")
    n = {r["entity"]: r["count"] for r in filled.groupBy("entity").count().collect()}
    want = {(r["entity"], n[r["entity"]], r["bound"]) for r in windows.historical_bound(filled).collect()}
    assert {tuple(r) for r in windows.historical_bound_filled(rows, str(week(9))).collect()} == want and len(want) == len(seen)
    plan = queries.QUERIES["w12_historical_bound_customers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
