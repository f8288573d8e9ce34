"""Guarded holdouts, sweeps and repeated runs against plain versions on small panels."""

import datetime as dt

import numpy as np
import pytest

from panelweft.functions.draws import draws
from panelweft.operators import backtest, channels, joins, losses, stats, windows

START = dt.date(2000, 1, 3)
RESERVED, CAP = "2000-08-07", "2000-10-02"
STEPS = "entity string, origin date, h int, step int, target_date date, channel string, y double, yhat double"


def week(k):
    return START + dt.timedelta(weeks=k)


def panel(spark, change=0.0):
    """Two entities over 52 weeks; `change` is added to the reserved window and what follows."""
    rows = []
    for e, base in (("a", 50.0), ("b", 80.0)):
        for k in range(52):
            y = base + 7 * np.sin(k / 3) + k / 10 + (change if str(week(k)) >= RESERVED else 0.0)
            rows.append((e, week(k), float(y), k + 1))
    return spark.createDataFrame(rows, "entity string, date date, y double, widx int")


def horizons(spark):
    return spark.createDataFrame([(2,), (4,)], "h int")


def folds(spark):
    return spark.createDataFrame([(1, START, week(12), week(26), week(28))], "fold int, train_start date, train_end date, test_start date, test_end date")


def scores(spark, change, disclosed):
    s = panel(spark, change)
    table = backtest.holdout_table(folds(spark), RESERVED, CAP, embargo_weeks=2)
    part = table.where(f"part = '{'holdout' if disclosed else 'pseudo'}'")
    o = backtest.origin_set(s, table)
    actuals = joins.forward_actuals(backtest.scorable(s, RESERVED, CAP, disclosed), o, horizons(spark))
    made = channels.naive(s, o, 4).unionByName(channels.holt(s, o, 4)).unionByName(channels.seasonal_naive(s, o, 4, 8))
    steps = losses.cell_steps(actuals, made)
    members = part.selectExpr("fold", "explode(array(2, 4)) AS h", "'holt' AS channel")
    return actuals, backtest.holdout(steps, part, members, "naive", "snaive")


def test_holdout_table_holds_the_embargo(spark):
    by = {r["part"]: r for r in backtest.holdout_table(folds(spark), RESERVED, CAP, embargo_weeks=13).collect()}
    first = dt.date.fromisoformat(RESERVED)
    assert (by["pseudo"]["train_end"], by["pseudo"]["test_start"], by["pseudo"]["test_end"]) == (week(12), week(26), first - dt.timedelta(days=1))
    assert (by["holdout"]["train_end"], by["holdout"]["test_start"]) == (first - dt.timedelta(weeks=14), first)
    assert str(by["holdout"]["test_end"]) == CAP and [by[p]["fold"] for p in ("pseudo", "holdout")] == [2, 3]


def test_a_closed_window_has_no_cells_and_cannot_change_a_score(spark):
    actuals, before = scores(spark, 0.0, None)
    rows = actuals.collect()
    assert rows and all(str(r["target_date"]) < RESERVED for r in rows)
    per = {}
    for r in rows:
        per.setdefault((r["entity"], r["origin"], r["h"]), []).append(r["step"])
    assert all(sorted(v) == list(range(1, k[2] + 1)) for k, v in per.items())  # none is cut short
    key = lambda df: sorted((r["system"], r["entity"], r["origin"], r["h"], round(r["mape"], 9)) for r in df.collect())
    assert key(before) == key(scores(spark, 1000.0, None)[1])


def test_the_window_opens_for_a_stated_reason_and_never_past_the_cap(spark):
    with pytest.raises(ValueError):
        backtest.scorable(panel(spark), RESERVED, CAP, " ")
    actuals, scored = scores(spark, 0.0, "once")
    targets = [str(r["target_date"]) for r in actuals.collect()]
    assert max(targets) == CAP and any(t >= RESERVED for t in targets)
    assert {r["system"] for r in scored.collect()} == {"naive", "holt", "snaive", "system", "system with external"}


def test_the_external_channel_counts_only_where_it_is(spark):
    day = [week(k) for k in range(30)]
    rows = []
    for k in range(0, 28):
        for c, v in (("naive", 90.0), ("m", 100.0 + k % 3), ("x", 104.0 - k % 2)):
            if not (c == "x" and k == 27):
                rows.append(("a", day[k], 1, 1, day[k + 1], c, 101.0, v))
    steps = spark.createDataFrame(rows, STEPS)
    fold = spark.createDataFrame([(1, START, week(20), week(24), week(29))], "fold int, train_start date, train_end date, test_start date, test_end date")
    members = spark.createDataFrame([(1, 1, "m")], "fold int, h int, channel string")
    got = {(r["system"], r["origin"]): r["mape"] for r in backtest.holdout(steps, fold, members, "naive", "x").collect()}
    skill = {c: np.median([1 - abs(101 - v(k)) / 11 for k in range(20)]) for c, v in (("m", lambda k: 100.0 + k % 3), ("x", lambda k: 104.0 - k % 2))}
    w = {c: np.exp(v / 0.05) for c, v in skill.items()}
    for k in (24, 25, 26, 27):
        m, x = 100.0 + k % 3, 104.0 - k % 2
        both = m if k == 27 else (w["m"] * m + w["x"] * x) / (w["m"] + w["x"])
        assert np.isclose(got["system", day[k]], abs(101 - m) / 101 * 100) and np.isclose(got["system with external", day[k]], abs(101 - both) / 101 * 100)
    assert ("x", day[27]) not in got


def test_information_origins_lie_the_lag_before(spark):
    s = panel(spark)
    o = s.where("widx IN (1, 2, 10)").selectExpr("entity", "date AS origin", "widx")
    got = {(r["entity"], r["origin"], r["widx"]) for r in channels.information_origins(s, o, (0, 2)).collect()}
    assert got == {(e, week(k - 1), k) for e in "ab" for k in (1, 2, 8, 10)}


def test_cap_sweep_equals_a_loop(spark):
    s = panel(spark)
    f = folds(spark)
    o = backtest.origin_set(s, f)
    level = spark.createDataFrame([(1, "a", 40.0), (1, "b", 95.0)], "fold int, entity string, level double")
    got = {r["rho"]: (r["mape"], r["n"]) for r in backtest.cap_sweep(joins.forward_actuals(s, o, horizons(spark)), channels.last_value(s, o), level, f, [0.0, 0.5]).collect()}
    y = {(r["entity"], r["date"]): r["y"] for r in s.collect()}
    for rho in (0.0, 0.5):
        cells = []
        for e, to in (("a", 40.0), ("b", 95.0)):
            for k in range(13):
                for h in (2, 4):
                    if k + h <= 12:
                        y0 = y[e, week(k)]
                        path = [max(round(y0 + rho * (j / h) ** 2 * (to - y0), 2), 0.0) for j in range(1, h + 1)]
                        cells.append(100 * np.mean([abs(y[e, week(k + j)] - p) / y[e, week(k + j)] for j, p in enumerate(path, 1)]))
        assert got[rho][1] == len(cells) and np.isclose(got[rho][0], np.mean(cells))


def test_runs_differ_by_the_draw_of_their_origin(spark):
    f = spark.createDataFrame([("e", "a", week(k), 1, 12.0) for k in range(5)], "channel string, entity string, origin date, step int, yhat double")
    base = f.selectExpr("'naive' AS channel", "entity", "origin", "step", "10.0D AS yhat")
    rows = backtest.noisy_runs(f, base, 3, seed=23, spread=0.5).collect()
    assert len(rows) == 15 and {r["run"] for r in rows} == {1, 2, 3}
    for r in rows:
        day = (r["origin"] - dt.date(1970, 1, 1)).days
        share = 1 + 0.5 * (int(draws(23, r["run"], day)) % 2001 - 1000) / 1000
        assert np.isclose(r["yhat"], 10 + 2 * share)
    assert len({round(r["yhat"], 9) for r in rows}) > 5


def test_a_sweep_over_affected_cells_leaves_the_others_out(spark):
    rows = [("a", week(k), 2, j, week(k + j), p, 100.0, 100.0 + (p if k < 3 else 0.0)) for k in range(8) for j in (1, 2) for p in (1.0, 2.0)]
    steps = spark.createDataFrame(rows, "entity string, origin date, h int, step int, target_date date, p double, y double, yhat double")
    only = spark.createDataFrame([("a", week(k)) for k in range(3)], "entity string, origin date")
    got = {r["p"]: (r["mape"], r["n"]) for r in backtest.sweep(steps, folds(spark), "p", only).collect()}
    assert {p: (round(m, 9), n) for p, (m, n) in got.items()} == {1.0: (1.0, 3), 2.0: (2.0, 3)}


def test_one_split_scores_all_systems_on_the_same_cells(spark):
    rows = []
    for k in range(40):
        for c, v in (("naive", 90.0), ("m", 99.0), ("x", 107.0)):
            if not (c == "x" and k == 39):
                rows.append(("a", week(k), 1, 1, week(k + 1), c, 100.0, v))
    steps = spark.createDataFrame(rows, STEPS)
    steps, lost = backtest.losses_with_regime(steps, spark.createDataFrame([(week(k), "stable") for k in range(40)], "origin date, regime string"))
    got = backtest.single_split_systems(steps, lost, str(week(20)), ["m", "x"], embargo_weeks=2).collect()
    by = {}
    for r in got:
        by.setdefault(r["system"], {})[r["origin"]] = r["mape"]
    assert set(by) == {"naive", "m", "x", "blend", "fusion"} and min(by["blend"]) == week(23)
    assert all(np.isclose(v, 3.0) for d, v in by["blend"].items() if d != week(39)) and all(np.isclose(v, 1.0) for v in by["m"].values())


def test_change_correlation_and_its_probability(spark):
    """Student's t of 3 and 8 degrees by their closed tails; groups without variation, of two rows and of exact correlation."""
    rng = np.random.default_rng(5)
    rows = [("g", float(x), float(x + e)) for x, e in zip(rng.normal(size=10), rng.normal(size=10), strict=True)]
    rows += [("flat", 1.0, float(k)) for k in range(5)] + [("two", float(k), float(k)) for k in range(2)] + [("exact", float(k), -2.0 * k) for k in range(4)] + [("g", None, 1.0)]
    got = {r["k"]: r for r in stats.change_correlation(spark.createDataFrame(rows, "k string, predicted double, realised double"), ["k"]).collect()}
    a = np.array([r[1:] for r in rows if r[0] == "g" and r[1] is not None])
    r = np.corrcoef(a.T)[0, 1]
    th = np.arctan(abs(r) / np.sqrt(1 - r * r))
    c2 = np.cos(th) ** 2
    tail = 1 - np.sin(th) * (1 + c2 / 2 + 3 / 8 * c2**2 + 15 / 48 * c2**3)
    assert got["g"]["n"] == 10 and np.isclose(got["g"]["r"], r) and np.isclose(got["g"]["p"], tail)
    assert got["flat"]["r"] is None and got["flat"]["p"] is None and got["two"]["p"] is None
    assert np.isclose(got["exact"]["r"], -1) and got["exact"]["p"] < 1e-6


def test_factors_that_do_not_vary_have_no_correlation(spark):
    rows = [("a", week(k), 10.0 + k % 5, 3.0, float(k % 7)) for k in range(60)]
    df = spark.createDataFrame(rows, "entity string, date date, y double, flat double, moving double")
    got = {r["factor"]: r["corr"] for r in windows.factor_correlation(df, ["flat", "moving"], str(week(59)), 2).collect()}
    assert got["flat"] == 0.0 and got["moving"] is not None
    z = df.withColumn("z", windows.pct(df["y"], df["moving"]))
    assert [r["r"] for r in stats.lag_correlation(z, "flat", [0, 1]).collect()] == [None, None]
