"""Registered statistics whose numbers SQL cannot make, against NumPy on the same panels (smallest scale)."""

import datetime as dt
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from panelweft.functions.draws import INCREMENT, MODULUS, MULTIPLIER
from panelweft.functions.tables import settled
from panelweft.operators import backtest, channels, fusion, joins, losses, screens, stats, windows
from panelweft.plans import panels, queries
from pyspark.sql import functions as F


def draw(*parts):
    out = 1
    for p in parts:
        out = (out * MULTIPLIER + INCREMENT + p % MODULUS) % MODULUS
    for _ in range(3):
        out = (out * MULTIPLIER + INCREMENT) % MODULUS
    return out


def upper(density, x, top=4000.0, n=400_001):
    """Upper tail of a density by Simpson's rule on a stretched grid."""
    u = np.linspace(0, 1, n)
    v = x + (top - x) * u**4
    f = density(v) * 4 * (top - x) * u**3
    return float((f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) / (3 * (n - 1)))


def t_tail(t, df):
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 2 * upper(lambda v: c * (1 + v * v / df) ** (-(df + 1) / 2), abs(t))


def f_tail(f, a, b):
    if f <= 0:
        return 1.0
    c = math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) * (a / b) ** (a / 2)
    return upper(lambda v: c * v ** (a / 2 - 1) * (1 + a * v / b) ** (-(a + b) / 2), f)


def close(a, b, tol=1e-6):
    assert (a is None) == (b is None or (isinstance(b, float) and math.isnan(b))), (a, b)
    assert a is None or math.isclose(a, b, rel_tol=tol, abs_tol=tol), (a, b)


@pytest.fixture(scope="module")
def tested(spark, sf):
    return panels.cell_losses(spark, sf).where("fold IS NOT NULL").toPandas()


@pytest.fixture(scope="module")
def series(spark, sf):
    return panels.series(spark, sf).toPandas().sort_values(["entity", "date"])


@pytest.fixture(scope="module")
def panel(spark, sf):
    return queries._panel(spark, sf).select("entity", "date", "period", "y", "z", "x", "q").toPandas().sort_values(["entity", "date"]).reset_index(drop=True)


def dm(d, h):
    n, mean = len(d), d.mean()
    e = d - mean
    lrv = sum((1 if j == 0 else 2 * (1 - j / h)) * (e[j:] * e[: n - j]).sum() for j in range(min(h, n))) / n
    if lrv <= 1e-18:
        return mean, None, None
    stat = mean / math.sqrt(lrv / n) * math.sqrt(max((n + 1 - 2 * h + h * (h - 1) / n) / n, 0))
    return mean, stat, t_tail(stat, n - 1)


def step_up(p, q=0.05):
    order = sorted(range(len(p)), key=lambda i: p[i])
    last = max([k + 1 for k, i in enumerate(order) if p[i] <= q * (k + 1) / len(p)], default=0)
    return {i for i in order[:last]}


def diffs(tested, a, b, keys):
    wide = tested.pivot_table(index=keys, columns="channel", values="mape")
    return (wide[a] - wide[b]).dropna()


def entity_counts(tested, a, b, h):
    d = diffs(tested, a, b, ["h", "entity", "origin"]).loc[h]
    own = [dm(g.droplevel(0).sort_index().to_numpy(), h) for _, g in d.groupby(level=0)]
    p = [x[2] for x in own]
    known = [i for i, x in enumerate(p) if x is not None]
    sig = {known[i] for i in step_up([p[i] for i in known])}
    return len(own), sum(own[i][0] < 0 for i in sig), sum(own[i][0] > 0 for i in sig)


def test_entity_tests(spark, sf, tested):
    got = {r["h"]: (r["n_entities"], r["a_better"], r["b_better"]) for r in queries.QUERIES["t3_entity_dm"](spark, sf).collect()}
    assert got == {h: entity_counts(tested, "snaive", "naive", h) for h in panels.HORIZONS}


def starts(seed, n, replicates, block):
    for rep in range(replicates):
        yield np.concatenate([draw(seed, rep, b) % max(n - block + 1, 1) + np.arange(block) for b in range(-(-n // block))])[:n]


def test_intervals_of_short_and_gappy_series(spark):
    """Fewer weeks than a block, a broken last block, nulls, ties, one week; blocks of one week are the iid bootstrap."""
    rng = np.random.default_rng(11)
    values = {1: [2.5], 2: rng.normal(size=5).tolist(), 3: rng.normal(size=13).tolist(), 4: [*rng.normal(size=29).tolist(), None, 1.0, 1.0], 5: [3.0] * 40}
    rows = [(g, k, v) for g, vs in values.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, origin int, d double").repartition(3)
    for block in (1, 13):
        got = {r["g"]: r for r in stats.block_bootstrap(df, ["g"], "d", 60, block).collect()}
        assert got.keys() == values.keys()
        for g, vs in values.items():
            v = np.array([x for x in vs if x is not None])
            boot = [v[i].mean() for i in starts(5, len(v), 60, block)]
            for key, want in (("mean", v.mean()), ("low", np.percentile(boot, 2.5)), ("high", np.percentile(boot, 97.5))):
                close(got[g][key], float(want), 1e-9)
    assert stats.block_bootstrap(df.limit(0), ["g"], "d", 60).collect() == []


def test_bundle_of_pairs(spark, sf, tested):
    got = {(r["h"], r["a"], r["b"]): r for r in queries.QUERIES["t9_pair_bundle"](spark, sf).collect()}
    assert len(got) == 9
    for (h, a, b), r in got.items():
        d = diffs(tested, a, b, ["h", "origin", "entity"]).loc[h].groupby(level=0).mean().sort_index().to_numpy()
        mean, stat, p = dm(d, h)
        boot = [d[i].mean() for i in starts(5, len(d), 5000, 13)]
        for key, value in (("mean", mean), ("stat", stat), ("p_value", p), ("low", np.percentile(boot, 2.5)), ("high", np.percentile(boot, 97.5))):
            close(r[key], value)
        assert (r["a_better"], r["b_better"]) == entity_counts(tested, a, b, h)[1:]


def plain_set(weekly, replicates, block=13, seed=5):
    weekly = weekly.dropna()
    names, twin = [], {}
    for c in sorted(weekly.columns):
        same = next((k for k in names if np.abs(weekly[c] - weekly[k]).max() <= 1e-12), None)
        (names.append(c) if same is None else twin.update({c: same}))
    own = weekly[names].to_numpy()
    boot = np.stack([own[i].mean(0) for i in starts(seed, len(own), replicates, block)])
    alive, p, out = list(range(len(names))), 0.0, {}
    while len(alive) > 1:
        bar = own[:, alive].mean(0) - own[:, alive].mean()
        moved = boot[:, alive] - boot[:, alive].mean(1, keepdims=True)
        se = moved.std(0, ddof=1)
        t = bar / se
        p = max(p, float((((moved - bar) / se).max(1) >= t.max()).mean()))
        worst = alive[int(np.argmax(t))]
        out[names[worst]] = p
        alive.remove(worst)
    out[names[alive[0]]] = 1.0
    return out | {c: out[k] for c, k in twin.items()}


def test_confidence_set(spark, sf, tested):
    got = {(r["h"], r["channel"]): r for r in queries.QUERIES["t8_model_confidence_set"](spark, sf).collect()}
    for h in panels.HORIZONS:
        weekly = tested[tested.h == h].groupby(["origin", "channel"])["mape"].mean().unstack()
        for c, p in plain_set(weekly, 5000).items():
            close(got[h, c]["p_value"], p)
            assert got[h, c]["member"] == (p >= 0.1)


def test_confidence_set_merges_equal_methods(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(10, 1, 60)
    weekly = pd.DataFrame({"a": base, "b": base + rng.normal(0.5, 0.3, 60), "c": base, "d": base + rng.normal(0.02, 0.5, 60)})
    rows = [(4, f"2000-01-{k % 28 + 1:02d}-{k}", c, float(weekly[c][k])) for k in range(60) for c in weekly]
    df = spark.createDataFrame([(h, str(1000 + int(o.split("-")[-1])), c, v) for h, o, c, v in rows], "h int, origin string, channel string, mape double")
    got = {r["channel"]: r["p_value"] for r in stats.model_confidence_set(df, replicates=80).collect()}
    want = plain_set(weekly, 80)
    assert got.keys() == want.keys() and got["a"] == got["c"]
    for c in want:
        close(got[c], want[c])


def differenced(frame):
    return {e: g.sort_values("date").set_index("date")["y"].diff().dropna() for e, g in frame.groupby("entity")}


def plain_granger(source, target, max_lag, least=60):
    cols = {"z": target} | {f"a{k}": target.shift(k) for k in range(1, max_lag + 1)} | {f"b{k}": source.shift(k) for k in range(1, max_lag + 1)}
    rows = pd.DataFrame(cols).dropna()
    n = len(rows)
    if n < least:
        return None
    best = (0, 0.0, 2.0)
    for k in range(1, max_lag + 1):
        ssr = []
        for names in ([f"a{j}" for j in range(1, k + 1)], [f"{s}{j}" for s in "ab" for j in range(1, k + 1)]):
            x = np.column_stack([np.ones(n), rows[names].to_numpy()])
            b = np.linalg.lstsq(x, rows["z"].to_numpy(), rcond=None)[0]
            ssr.append(((rows["z"].to_numpy() - x @ b) ** 2).sum())
        free = n - 2 * k - 1
        f = (ssr[0] - ssr[1]) / k / (ssr[1] / free)
        p = f_tail(f, k, free)
        if p < best[2]:
            best = (k, f, p)
    return best[0], best[1], min(1.0, best[2] * max_lag), n


def same_tests(got, want):
    assert got.keys() == want.keys() and want
    for k, (lag, f, p, n) in want.items():
        r = got[k]
        assert (r["best_lag"], r["n_obs"]) == (lag, n)
        close(r["f_stat"], f, 1e-5)
        close(r["p_value"], p, 1e-5)


def screened(own, max_lag):
    found = {(a, b): plain_granger(own[a], own[b], max_lag) for a in own for b in own if a != b}
    return {k: v for k, v in found.items() if v}


def test_granger_screen(spark, sf, series):
    got = {(r["source"], r["target"]): r for r in queries.QUERIES["t11_granger"](spark, sf).collect()}
    same_tests(got, screened(differenced(series), 8))


def test_graph_of_own_movements(spark, sf, series):
    wide = series.pivot(index="date", columns="entity", values="y")
    change = series.assign(c=series.groupby("entity")["y"].pct_change(fill_method=None))
    own = (change["c"] - change.groupby("date")["c"].transform("mean")).fillna(0.0)
    index = change.assign(y=(1 + own).groupby(change["entity"]).cumprod())
    assert wide.shape[1] == index["entity"].nunique()
    got = {(r["source"], r["target"]): r for r in queries.QUERIES["t12_spillover_graph"](spark, sf).collect()}
    want = screened(differenced(index), 8)
    same_tests(got, want)
    keys = list(want)
    assert {k for k, r in got.items() if r["significant"]} == {keys[i] for i in step_up([want[k][2] for k in keys])}


def test_own_index_keeps_sign_and_zero(spark):
    rows = [("a", 0, 10.0), ("a", 1, 0.0), ("a", 2, 5.0), ("b", 0, 10.0), ("b", 1, 45.0), ("b", 2, 40.0)]
    df = spark.createDataFrame([(e, f"2000-01-{3 + 7 * k:02d}", y) for e, k, y in rows], "entity string, date string, y double").selectExpr("entity", "to_date(date) AS date", "y")
    got = {(r["entity"], r["date"].day): r["own"] for r in windows.strip_common(df).collect()}
    # Mean change of the second week is (-1 + 3.5) / 2 = 1.25: a loses 2.25, which turns its index negative.
    assert math.isclose(got["a", 10], -1.25) and math.isclose(got["b", 10], 3.25) and math.isclose(got["a", 17], -1.25)


def window(frame, as_of, weeks=104):
    return frame[(frame["date"] <= as_of) & (frame["date"] >= as_of - dt.timedelta(weeks=weeks))]


def same_edges(got, want):
    assert got.keys() == want.keys() and want
    for k, (lag, f, p, n) in want.items():
        if lag == 0:  # a series that does not move
            assert (got[k]["f_stat"], got[k]["p_value"], got[k]["n_obs"]) == (0.0, 1.0, n)
            continue
        assert (got[k]["best_lag"], got[k]["n_obs"]) == (lag, n)
        close(got[k]["f_stat"], f, 1e-5)
        close(got[k]["p_value"], p, 1e-5)


def test_screen_at_dates(spark, sf, series):
    got = {}
    for r in queries.QUERIES["t11_granger_at"](spark, sf).collect():
        got.setdefault(r["as_of"], {})[r["source"], r["target"]] = r
    assert sorted(got) == queries.GRAPH_DATES
    for as_of in queries.GRAPH_DATES[::8]:
        same_edges(got[as_of], screened(differenced(window(series, as_of)), 8))


def own_index(frame):
    change = frame.assign(c=frame.groupby("entity")["y"].pct_change(fill_method=None))
    return change.assign(g=(change["c"] - change.groupby("date")["c"].transform("mean")).fillna(0.0))


def test_graph_at_dates(spark, sf, series):
    """Own movements make an index that starts anew in each window; significance is judged among the pairs of a date."""
    got = {}
    for r in queries.QUERIES["t12_graph_at"](spark, sf).collect():
        got.setdefault(r["as_of"], {})[r["source"], r["target"]] = r
    grown = own_index(series)
    for as_of in queries.GRAPH_DATES[::8]:
        part = window(grown, as_of).copy()
        first = part.groupby("entity")["date"].transform("min") == part["date"]
        part["y"] = (1 + part["g"].where(~first, 0.0)).groupby(part["entity"]).cumprod()
        want = screened(differenced(part), 8)
        same_edges(got[as_of], want)
        keys = list(want)
        assert {k for k, r in got[as_of].items() if r["significant"]} == {keys[i] for i in step_up([want[k][2] for k in keys])}


def test_later_rows_change_nothing(spark, series):
    """No edge, gate signal or factor test sees a row after its date."""
    dates = queries.GRAPH_DATES[4:6]
    later = series.assign(y=np.where(series["date"] > dates[0], series["y"] * 3 + 7, series["y"]))
    found = []
    for frame in (series, later):
        df = spark.createDataFrame(frame[["entity", "date", "y"]])
        edges = screens.graph_at(joins.ordered_pairs(df), df, dates, 3).collect()
        found.append({(r["source"], r["target"]): tuple(r) for r in edges if r["as_of"] == dates[0]})
    assert found[0] == found[1] and len(found[0]) == 20


def test_screen_in_blocks_with_gaps_and_flat_series(spark):
    rng = np.random.default_rng(2)
    days = [dt.date(1999, 1, 4) + dt.timedelta(weeks=k) for k in range(120)]
    rows = [(f"e{e}", d, None if rng.random() < 0.1 * (e % 3) else float(rng.normal())) for e in range(7) for d in days]
    rows += [("flat", d, 1.0) for d in days] + [("short", d, float(rng.normal())) for d in days[-20:]]
    df = spark.createDataFrame(rows, "entity string, date date, y double")
    pairs = joins.ordered_pairs(df)
    get = lambda block: {(r["source"], r["target"]): tuple(r) for r in screens.granger_at(pairs, df, [days[-1]], 2, block=block).collect()}
    one, many = get(64), get(2)
    assert one.keys() == many.keys() and not any("short" in k for k in one)
    for k, a in one.items():
        assert a[:4] == many[k][:4] and a[6] == many[k][6]
        close(a[5], many[k][5])
    frame = pd.DataFrame(rows, columns=["entity", "date", "y"]).dropna()
    own = differenced(window(frame, days[-1]))
    for (a, b), r in one.items():
        if "flat" in (a, b):
            continue
        lag, _, p, n = plain_granger(own[a], own[b], 2)
        assert (r[3], r[6]) == (lag, n)
        close(r[5], p, 1e-5)
    assert all(r[5] == 1.0 for k, r in one.items() if k[0] == "flat")
    assert screens.granger_at(pairs.limit(0), df, [days[-1]], 2).collect() == []


def test_factor_scores(spark, sf):
    a = panels.aligned(spark, sf)
    frame = a.toPandas().sort_values(["entity", "date"])
    corr = {(r["entity"], r["factor"]): r["corr"] for r in windows.factor_correlation(a, ["disc", "tax", "qty"], "2000-06-05", 4).collect()}
    frame = window(frame, dt.date(2000, 6, 5))
    own = differenced(frame)
    factors = {f: frame[["date", f]].dropna().drop_duplicates("date").set_index("date")[f].sort_index().diff().dropna() for f in ("disc", "tax", "qty")}
    got = {(r["entity"], r["factor"]): r for r in queries.QUERIES["t13_factor_scores"](spark, sf).collect()}
    want = {(e, f): plain_granger(factors[f], own[e], 8) for e in own for f in factors}
    want = {k: v for k, v in want.items() if v and k in corr}
    assert got.keys() == want.keys() and want
    for k, (lag, _, p, _) in want.items():
        close(got[k]["corr"], corr[k])
        close(got[k]["p_value"], p, 1e-5)
        assert got[k]["best_lag"] == lag
    for r in queries.QUERIES["a16_factor_summary"](spark, sf).collect():
        p = [v[2] for (_, f), v in want.items() if f == r["factor"]]
        close(r["mean_corr"], np.mean([corr[k] for k in want if k[1] == r["factor"]]))
        assert r["n_significant"] == sum(x < 0.05 for x in p)
        close(r["median_p"], float(np.median(p)), 1e-5)


def dummies(frame, effects):
    return np.column_stack([np.ones(len(frame))] + [pd.get_dummies(frame[e], drop_first=True).to_numpy(float) for e in effects])


def residual(v, d):
    return v - d @ np.linalg.lstsq(d, v, rcond=None)[0]


def clustered(frame, y, xs, effects, cluster="entity"):
    frame = frame.dropna(subset=[y, *xs])
    d = dummies(frame, effects)
    x = np.column_stack([residual(frame[c].to_numpy(), d) for c in xs])
    z = residual(frame[y].to_numpy(), d)
    b = np.linalg.lstsq(x, z, rcond=None)[0]
    inv = np.linalg.pinv(x.T @ x)
    scores = pd.DataFrame(x * (z - x @ b)[:, None]).groupby(frame[cluster].to_numpy()).sum().to_numpy()
    g, n = len(scores), len(frame)
    se = np.sqrt(np.diag(inv @ scores.T @ scores @ inv) * g / (g - 1) * (n - 1) / (n - len(xs)))
    return b, se, n, g


def test_two_way_effects(spark, sf, panel):
    r = queries.QUERIES["t14_panel_regression_two_way"](spark, sf).collect()[0]
    b, se, n, g = clustered(panel, "z", ["x"], ["entity", "period"])
    close(r["coef"], b[0])
    close(r["se"], se[0])
    full = stats.panel_regression(queries._panel(spark, sf), "z", ["x"], effects=[["entity"], ["period"]]).collect()[0]
    close(full["p_value"], t_tail(b[0] / se[0], g - 1), 1e-5)
    assert r["n"] == n


@pytest.mark.parametrize("levels", [200, 3])
def test_solved_and_swept_effects_leave_the_same(spark, monkeypatch, levels):
    """Solved at once, or swept when both effects have too many levels; groups of their own, disconnected parts, single rows."""
    monkeypatch.setattr(stats, "LEVELS", levels)
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 300), "entity": rng.integers(0, 30, 300).astype(str), "period": rng.integers(0, 8, 300), "date": "2000-01-03", "z": rng.normal(size=300) * 5 + 100})
    frame.loc[frame["entity"] >= "5", "period"] += 100  # two parts that share no period
    frame["z"] += frame["period"] * 0.3
    got = stats.within(spark.createDataFrame(frame.reset_index(names="i")).repartition(5), ["z"], [["g", "entity"], ["g", "period"]]).toPandas().set_index("i")["z"]
    for _, part in frame.groupby("g"):
        want = residual(part["z"].to_numpy(), dummies(part, ["entity", "period"]))
        assert np.allclose(got.loc[part.index].to_numpy(), want, atol=1e-6)


def test_effects_of_an_unbalanced_panel(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"entity": rng.integers(0, 9, 400).astype(str), "period": (rng.integers(0, 12, 400) ** 2 // 9).astype(str), "date": "2000-01-03", "x": rng.normal(size=400)})
    frame["z"] = frame["x"] * 0.7 + frame["entity"].astype(float) + frame["period"].astype(float) ** 1.5 + rng.normal(size=400)
    df = spark.createDataFrame(frame)
    r = stats.panel_regression(df, "z", ["x"], effects=[["entity"], ["period"]]).collect()[0]
    b, se, *_ = clustered(frame, "z", ["x"], ["entity", "period"])
    close(r["coef"], b[0], 1e-8)
    close(r["se"], se[0], 1e-8)


def test_wild_cluster_bootstrap(spark, sf, panel):
    r = queries.QUERIES["t16_wild_cluster"](spark, sf).collect()[0]
    frame = panel.dropna(subset=["z", "x", "q"])
    d = dummies(frame, ["entity"])
    x = np.column_stack([residual(frame[c].to_numpy(), d) for c in ("x", "q")])
    z = residual(frame["z"].to_numpy(), d)
    fit = x[:, 1:] @ np.linalg.lstsq(x[:, 1:], z, rcond=None)[0]
    inv, names = np.linalg.pinv(x.T @ x), frame["entity"].to_numpy()
    k = np.stack([[draw(23, rep, zlib.crc32(e.encode())) % 6 for rep in range(10_000)] for e in sorted(set(names))])
    w = np.sqrt(np.array(stats.WEBB))[k % 3] * np.where(k < 3, 1.0, -1.0)
    w[:, 0] = 1.0
    w = w[np.searchsorted(sorted(set(names)), names)]
    y = fit[:, None] + w * (z - fit)[:, None]
    b = inv @ x.T @ y
    v = 0.0
    for e in set(names):
        on = names == e
        v = v + (inv[:1] @ x[on].T @ (y[on] - x[on] @ b)) ** 2
    ts = np.where(v[0] > 0, b[0] / np.sqrt(v[0]), 0.0)
    close(r["t"], ts[0])
    assert r["n_replicates"] == 9999
    close(r["p_value"], np.mean(np.abs(ts[1:]) >= abs(ts[0]) - 1e-9), 0.0011)


def test_wild_bootstrap_of_many_clusters(spark):
    """A null effect among 300 clusters over several partitions is not rejected, a strong one is."""
    rng = np.random.default_rng(8)
    rows = [(f"c{e}", k, float(x), float(rng.normal() + rng.normal() * 0.3), float(x * 0.5 + rng.normal())) for e in range(300) for k, x in enumerate(rng.normal(size=6))]
    df = spark.createDataFrame(rows, "entity string, date int, x double, flat double, steep double").repartition(7)
    assert stats.wild_cluster(df, "flat", "x", [], 999).collect()[0]["p_value"] > 0.02
    assert stats.wild_cluster(df, "steep", "x", [], 999).collect()[0]["p_value"] < 0.01
    assert stats.wild_cluster(df.limit(0), "flat", "x", [], 99).collect() == []


def test_distributed_lag_and_sums(spark, sf, panel):
    frame = panel.copy()
    names = [f"x{k}" for k in range(27)]
    for k, c in enumerate(names):
        frame[c] = frame.groupby("entity")["x"].shift(k)
    frame = frame.dropna(subset=["z", *names])
    d = dummies(frame, ["entity"])
    x = np.column_stack([residual(frame[c].to_numpy(), d) for c in names])
    z = residual(frame["z"].to_numpy(), d)
    b = np.linalg.lstsq(x, z, rcond=None)[0]
    s = pd.DataFrame(x * (z - x @ b)[:, None]).groupby(frame["date"].to_numpy()).sum().sort_index().to_numpy()
    meat = s.T @ s
    for j in range(1, 5):
        g = s[j:].T @ s[:-j]
        meat += (1 - j / 5) * (g + g.T)
    inv = np.linalg.pinv(x.T @ x)
    cov = inv @ meat @ inv
    got = {(r["first_lag"], r["last_lag"]): r for r in queries.QUERIES["t17_distributed_lag"](spark, sf).collect()}
    assert len(got) == 29
    for (lo, hi), r in got.items():
        w = np.zeros(27)
        w[lo : hi + 1] = 1
        close(r["coef"], w @ b)
        close(r["se"], math.sqrt(max(w @ cov @ w, 0)), 1e-5)


def test_lag_grid(spark, sf, panel):
    rows = {(r["weeks"], r["feature"], r["lag"]): r for r in queries.QUERIES["t18_lag_grid"](spark, sf).collect()}
    assert len(rows) == 2 * 2 * 23
    inside = panel["date"].astype(str).between("1999-01-04", "1999-06-28")
    for weeks, frame in (("all", panel.copy()), ("without", panel[~inside].copy())):
        same_grid(frame, {k[1:]: r for k, r in rows.items() if k[0] == weeks})


def same_grid(frame, got):
    want = {}
    for f in ("x", "q"):
        for k in range(4, 27):
            frame["v"] = frame.groupby("entity")[f].shift(k)
            b, se, n, g = clustered(frame, "z", ["v"], ["entity"])
            want[f, k] = (b[0], se[0], t_tail(b[0] / se[0], g - 1), n)
    keys = list(want)
    rejected = {keys[i] for i in step_up([want[k][2] for k in keys])}
    assert got.keys() == want.keys()
    for k, (b, se, p, n) in want.items():
        close(got[k]["coef"], b)
        close(got[k]["se"], se)
        close(got[k]["p_value"], p, 1e-5)
        assert got[k]["n"] == n and got[k]["reject"] == (k in rejected)
        assert got[k]["stable_sign"] == (len({np.sign(want[j][0]) for j in keys if j[0] == k[0]}) == 1)


def test_serial_correlation(spark, sf, panel):
    frame = panel.dropna(subset=["z", "x"]).copy()
    d = dummies(frame, ["entity", "period"])
    x, z = residual(frame["x"].to_numpy(), d), residual(frame["z"].to_numpy(), d)
    frame["e"] = z - x * (x @ z) / (x @ x)
    frame["past"] = frame.groupby("entity")["e"].shift(1)
    frame = frame.dropna(subset=["past"])
    b, se, n, _ = clustered(frame, "e", ["past"], [])
    rho = frame.groupby("entity")[["e", "past"]].apply(lambda g: g["e"].corr(g["past"]))
    r = queries.QUERIES["t19_serial_correlation"](spark, sf).collect()[0]
    close(r["coef"], b[0])
    close(r["se"], se[0])
    close(r["mean_rho"], rho.mean())
    close(r["t_rho"], rho.mean() / (rho.std(ddof=1) / math.sqrt(len(rho))))
    assert r["n"] == n


def test_ridge_on_all_factors(spark, sf):
    a = panels.aligned(spark, sf).toPandas().sort_values(["entity", "date"])
    a["date"] = pd.to_datetime(a["date"])
    a["qty"] /= 1000
    lags = {"disc": 6, "tax": 10, "qty": 5}
    for f, k in lags.items():
        past = a[["entity", "date", f]].assign(date=a["date"] + pd.Timedelta(weeks=k)).rename(columns={f: f"x_{f}"})
        a = a.merge(past, on=["entity", "date"], how="left")
    a["z"] = a.groupby("entity")["y"].pct_change(fill_method=None)
    xs = [f"x_{f}" for f in lags]
    got = {(r["entity"], pd.Timestamp(r["origin"])): r["modifier"] for r in queries.QUERIES["f9_exogenous_modifier_all"](spark, sf).collect()}
    want = {}
    for r in panels.origins(spark, sf).collect():
        rows = a[(a.entity == r["entity"]) & (a.date <= pd.Timestamp(r["origin"]))]
        at = rows.iloc[-1]
        fit = rows.dropna(subset=["z", *xs])
        if len(fit) >= 10 and at[xs].notna().all():
            x, z = fit[xs].to_numpy(float), fit["z"].to_numpy()
            b = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(3), (x - x.mean(0)).T @ (z - z.mean()))
            want[r["entity"], pd.Timestamp(r["origin"])] = z.mean() + b @ (at[xs].to_numpy(float) - x.mean(0))
    assert got.keys() == want.keys() and len(want) > 100
    for k in want:
        close(got[k], want[k])


def test_placebo_reruns_the_backtest(spark):
    rng = np.random.default_rng(4)
    weeks = [dt.date(1996, 1, 1) + dt.timedelta(weeks=k) for k in range(150)]
    rows = []
    for e in "ab":
        for k, o in enumerate(weeks):
            for h in (2, 4):
                for step in range(1, h + 1):
                    y = 50 + 10 * math.sin(k / 9) + float(rng.normal())
                    rows += [(e, o, h, step, o + dt.timedelta(weeks=step), c, y, round(y + float(rng.normal(b, s)), 2)) for c, b, s in (("naive", 2, 3), ("x", 3 if k // 13 % 2 else 0, 2), ("z", 0 if k // 13 % 2 else 4, 2))]
    steps = settled(spark.createDataFrame(rows, "entity string, origin date, h int, step int, target_date date, channel string, y double, yhat double"), "steps")
    cells = settled(losses.cell_losses(steps), "losses")
    ends = [(1, weeks[90], weeks[95], weeks[115]), (2, weeks[110], weeks[116], weeks[149])]
    f = spark.createDataFrame(ends, "fold int, train_end date, test_start date, test_end date")
    true = spark.createDataFrame([(o, "hiking" if k // 13 % 2 else "stable") for k, o in enumerate(weeks)], "date date, regime string")
    labels = settled(backtest.placebo_labels(true, 1), "labels")
    names = ["hiking", "cutting", "stable"]
    got = {(r["perm"], r["h"]): r["mape"] for r in backtest.regime_placebo(steps, cells, f, labels, [2, 4], names).collect()}
    assert len(got) == 4
    for perm in range(2):
        own = labels.where(f"perm = {perm}").selectExpr("date AS origin", "regime")
        fused = backtest.backtest(steps.join(own, "origin"), cells.join(own, "origin"), f, [2, 4], names)
        for r in fused.groupBy("h").agg({"mape": "avg"}).toDF("h", "mape").collect():
            close(got[perm, r["h"]], r["mape"], 1e-9)
    assert len(set(got.values())) == 4


def test_weights_without_labels(spark):
    rng = np.random.default_rng(12)
    weeks = [dt.date(1996, 1, 1) + dt.timedelta(weeks=k) for k in range(110)]
    rows = [(e, o, h, c, float(rng.integers(1, 30)) if rng.random() > 0.05 else None) for e in "ab" for o in weeks for h in (2, 4) for c in ("naive", "x", "z")]
    cells = spark.createDataFrame(rows, "entity string, origin date, h int, channel string, mape double")
    ends = [(1, weeks[60]), (2, weeks[100])]
    f = spark.createDataFrame(ends, "fold int, train_end date")
    val = settled(fusion.validation(cells, f), "val")
    got = {(r["fold"], r["h"], r["channel"]): (r["skill"], r["w"]) for r in fusion.recency_weights(val, f).collect()}
    naive = {(e, o, h): m for e, o, h, c, m in rows if c == "naive"}
    for fold, end in ends:
        for h in (2, 4):
            skills = {}
            for c in ("naive", "x", "z"):
                own = [(e, o, m) for e, o, k, channel, m in rows if k == h and channel == c and 0 <= (end - o).days <= 728 and o + dt.timedelta(weeks=h) <= end]
                points = sorted((round(1 - m / naive[e, o, h], 9), e, o) for e, o, m in own if m is not None and (naive[e, o, h] or 0) > 0)
                weights = np.array([0.5 ** ((end - o).days / 7 / 26) for _, _, o in points])
                skills[c] = points[int(np.searchsorted(np.cumsum(weights) / weights.sum(), 0.5 - 1e-12))][0]
            total = sum(math.exp(v / 0.05) for v in skills.values())
            for c, v in skills.items():
                close(got[fold, h, c][0], v, 1e-9)
                close(got[fold, h, c][1], math.exp(v / 0.05) / total, 1e-9)
    days = backtest.by_period(spark.createDataFrame([(weeks[0],), (weeks[1],)], "origin date"), str(weeks[1]), "stable", "hiking").orderBy("origin").collect()
    assert [r["regime"] for r in days] == ["stable", "hiking"]


def test_blend_keeps_horizons_apart(spark):
    day = dt.date(1996, 1, 1)
    rows = [("a", "x", day, 4, 1, 2.0), ("b", "x", day, 4, 1, 4.0), ("a", "x", day, 8, 1, 10.0)]
    df = spark.createDataFrame(rows, "channel string, entity string, origin date, h int, step int, yhat double")
    assert {r["h"]: r["yhat"] for r in channels.blend(df).collect()} == {4: 3.0, 8: 10.0}
    signals = spark.createDataFrame([("x", day, 0.5)], "entity string, origin date, trend double")
    tilted = channels.with_spillover(df, signals, F.col("h"), 1.0)
    assert {(r["channel"], r["h"]): r["yhat"] for r in tilted.collect()} == {("a", 4): 2.25, ("b", 4): 4.5, ("a", 8): 10.625}


def test_ranks_without_a_group(spark):
    rng = np.random.default_rng(1)
    p = [float(x) for x in rng.choice(np.linspace(0, 0.2, 60), 500)] + [None] * 5
    df = spark.createDataFrame(list(enumerate(p)), "id int, p_value double").repartition(5)
    known = [x for x in p if x is not None]
    last = max(x for i, x in enumerate(sorted(known)) if x <= 0.05 * (i + 1) / len(known))
    got = {r["id"]: r["reject"] for r in stats.benjamini_hochberg(df, []).collect()}
    assert got == {i: x is not None and x <= last for i, x in enumerate(p)}
    ranks = sorted(r["_r"] for r in stats.ranked(df, []).collect())
    assert ranks == list(range(1, len(p) + 1))
