"""Registered queries of whole evaluations: guarded holdouts, sweeps over affected cells, splits, variants, and gates and signals on tested edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..functions.tables import settled
from ..operators import backtest as bt
from ..operators import channels as ch
from ..operators import fusion as fu
from ..operators import guards as gu
from ..operators import joins as jo
from ..operators import losses as lo
from ..operators import stats as stt
from ..sources import ingest as ing
from . import panels as pa
from . import queries as q
from .panels import sql
from .queries import query

DISCLOSED = "scored once, after every choice was made"
LATE = (0, 2)
EXCLUDED = ("1999-06-07", "1999-10-04")

# Holdout

_HOLD = {
    "folds": """
folds AS (SELECT 'pseudo' AS part, CAST(5 AS INT) AS fold, DATE '1996-01-01' AS train_start, DATE '2000-03-20' AS train_end, DATE '2000-06-26' AS test_start, DATE '2000-12-31' AS test_end
  UNION ALL SELECT 'holdout', 6, DATE '1996-01-01', DATE '2000-09-25', DATE '2001-01-01', DATE '2001-07-23')""",
    "origins": """
asked AS (SELECT entity, date AS origin, widx, y AS y0 FROM series s WHERE EXISTS (SELECT 1 FROM folds f WHERE s.date BETWEEN f.train_end - 728 AND f.train_end OR s.date BETWEEN f.test_start AND f.test_end)),
origins AS (SELECT entity, date AS origin, widx, y AS y0 FROM series s WHERE EXISTS (SELECT 1 FROM asked a WHERE a.entity = s.entity AND s.widx IN (a.widx, a.widx - 2)))""",
    "forecasts": q._SYSTEM.replace("range(1, 14)", "range(1, 16)"),
}
_HOLD_CELLS = """, lags AS (SELECT CAST(unnest([0, 2]) AS INT) AS lag),
lf AS (SELECT g.lag, f.channel, a.entity, a.origin, f.step - g.lag AS step, f.yhat FROM asked a CROSS JOIN lags g JOIN series i ON i.entity = a.entity AND i.widx = a.widx - g.lag JOIN flat f ON f.entity = a.entity AND f.origin = i.date AND f.step > g.lag),
pc AS (SELECT p.part, p.fold, a.entity, a.origin, hs.h, st.step, s.date AS target_date, s.y, count(*) OVER (PARTITION BY p.part, a.entity, a.origin, hs.h) AS n FROM folds p CROSS JOIN asked a CROSS JOIN hs CROSS JOIN st JOIN series s ON s.entity = a.entity AND s.widx = a.widx + st.step
  WHERE st.step <= hs.h AND s.date <= DATE '2001-07-23' AND (p.part = 'holdout' OR s.date < DATE '2001-01-01'))"""
_HOLD_SCORES = _HOLD_CELLS + """,
xc AS (SELECT a.entity, a.origin, hs.h, st.step, s.y AS yhat, count(*) OVER (PARTITION BY a.entity, a.origin, hs.h) AS k FROM asked a CROSS JOIN hs CROSS JOIN st JOIN series s ON s.entity = a.entity AND s.widx = a.widx + st.step - 52 WHERE st.step <= hs.h AND NOT (extract(day FROM a.origin) % 5 = 0 AND st.step = 6)),
hc AS (SELECT c.part, c.fold, f.lag, f.channel, c.entity, c.origin, c.h, c.step, c.y, f.yhat FROM pc c JOIN lf f USING (entity, origin, step) WHERE c.n = c.h
  UNION ALL SELECT c.part, c.fold, g.lag, 'ext', c.entity, c.origin, c.h, c.step, c.y, e.yhat FROM pc c JOIN xc e USING (entity, origin, h, step) CROSS JOIN lags g WHERE c.n = c.h AND e.k = c.h),
hl AS (SELECT part, lag, channel, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM hc GROUP BY ALL),
hv AS (SELECT l.* FROM hl l JOIN folds f USING (part) WHERE l.origin BETWEEN f.train_end - 728 AND f.train_end AND l.origin + 7 * l.h <= f.train_end),
ce AS (SELECT part, lag, h, CASE WHEN avg(mape) FILTER (channel = 'fa_ets_d') < avg(mape) FILTER (channel = 'fa_ets') THEN 'fa_ets_d' ELSE 'fa_ets' END AS ets FROM hv GROUP BY ALL),
mb AS (SELECT part, lag, h, unnest(CASE WHEN h = 4 THEN ['holt', 'seasonal', 'macro', 'ext'] ELSE [ets, 'seasonal', 'macro', 'ext'] END) AS channel FROM ce),
ms AS (SELECT v.part, v.lag, v.h, v.channel, exp(coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) / 0.05) AS e FROM hv v JOIN mb USING (part, lag, h, channel)
  JOIN hv n ON n.channel = 'fa_ets_d' AND n.part = v.part AND n.lag = v.lag AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY ALL),
fz AS (SELECT c.part, c.lag, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, sum(e * yhat) FILTER (c.channel <> 'ext') / sum(e) FILTER (c.channel <> 'ext') AS a, sum(e * yhat) / sum(e) AS b
  FROM hc c JOIN folds f USING (part) JOIN ms m ON m.part = c.part AND m.lag = c.lag AND m.h = c.h AND m.channel = c.channel WHERE c.origin BETWEEN f.test_start AND f.test_end GROUP BY ALL),
sy AS (SELECT part, lag, h, 'system' AS system, 100 * avg(abs((y - a) / nullif(y, 0))) AS mape FROM fz GROUP BY part, lag, entity, origin, h
  UNION ALL SELECT part, lag, h, 'system with external', 100 * avg(abs((y - b) / nullif(y, 0))) FROM fz GROUP BY part, lag, entity, origin, h
  UNION ALL SELECT l.part, l.lag, l.h, l.channel, l.mape FROM hl l JOIN folds f USING (part) WHERE l.origin BETWEEN f.test_start AND f.test_end)
"""


def _holdout_parts(spark, d):
    """(series, origins, folds of both parts, actuals by part): cells of the reserved window are made for the disclosed part only."""
    s = settled(pa.series(spark, d), "series")
    f = bt.holdout_table(pa.folds(spark), pa.RESERVED, pa.CAP)
    o = settled(bt.origin_set(s, f), "origins")
    rows = {"pseudo": bt.scorable(s, pa.RESERVED, pa.CAP), "holdout": bt.scorable(s, pa.RESERVED, pa.CAP, DISCLOSED)}
    return s, o, f, {part: settled(jo.forward_actuals(r, o, pa.horizons(spark)), "actuals") for part, r in rows.items()}


@query(sql(_HOLD_SCORES + "SELECT part, lag, h, system, avg(mape) AS mape, count(*) AS n FROM sy GROUP BY ALL", "forecasts", **_HOLD), "mape")
def h20_guarded_holdout(spark, d):
    """The assembled system beyond the last fold, with data on time and two weeks late, beside its channels and with an external one in the fusion:
    a pseudo-holdout up to the reserved window, and the disclosed holdout inside it."""
    s, o, f, actuals = _holdout_parts(spark, d)
    paths = settled(pa.system_paths(spark, d, s, ch.information_origins(s, o, LATE), ch.MAX_STEP + max(LATE)), "paths")
    outside = settled(ch.seasonal_naive(s, o).where(~((F.dayofmonth("origin") % 5 == 0) & (F.col("step") == 6))), "external")  # a system that lacks some steps
    out = []
    for lag in LATE:
        made = ch.publication_lagged(lambda *_: paths, s, o, lag).crossJoin(F.broadcast(pa.horizons(spark))).where("step <= h").select("channel", "entity", "origin", "h", "step", "yhat")
        for part, rows in actuals.items():
            own = f.where(F.col("part") == part)
            external = ing.import_external(rows, outside, "ext").where("yhat IS NOT NULL").select("channel", "entity", "origin", "h", "step", "yhat")
            steps = settled(lo.cell_steps(rows, made.unionByName(external)), "cells")
            ets = ch.choose_damping(fu.validation(lo.cell_losses(steps), own), "fa_ets", "fa_ets_d").where("h > 4")
            fixed = [(4, c) for c in ("holt", "seasonal", "macro")] + [(h, c) for h in (8, 13) for c in ("seasonal", "macro")]
            members = own.select("fold").crossJoin(F.broadcast(spark.createDataFrame(fixed, "h int, channel string"))).unionByName(ets.select("fold", "h", "channel"))
            scores = bt.holdout(steps, own, members, "fa_ets_d", "ext").groupBy("h", "system").agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))
            out.append(scores.select(F.lit(part).alias("part"), F.lit(lag).alias("lag"), "h", "system", "mape", "n"))
    return reduce(DataFrame.unionByName, out)


@query(sql(_HOLD_CELLS + " SELECT part, h, count(DISTINCT (entity, origin)) AS n_cells, max(target_date) AS last_target, max(origin) AS last_origin FROM pc WHERE n = h GROUP BY ALL", "forecasts", **(_HOLD | {"forecasts": "hs AS (SELECT CAST(unnest([4, 8, 13]) AS INT) AS h), st AS (SELECT CAST(unnest(range(1, 14)) AS INT) AS step), flat AS (SELECT 'none' AS channel, entity, origin, 1 AS step, y0 AS yhat FROM origins)"})))
def h20_cells_built(spark, d):
    """How far the cells of both parts reach: with the reserved window closed none has a target in it."""
    _, _, _, actuals = _holdout_parts(spark, d)
    parts = [rows.where("step = h").groupBy("h").agg(F.count("*").alias("n_cells"), F.max("target_date").alias("last_target"), F.max("origin").alias("last_origin")).withColumn("part", F.lit(p)) for p, rows in actuals.items()]
    return reduce(DataFrame.unionByName, parts).select("part", "h", "n_cells", "last_target", "last_origin")


# Sweeps

ACTIVE_WEEKS = (4, 8, 13, 26)
CAPS = (0.0, 0.1, 0.3, 0.5, 1.0)
_MAJOR = {"events": pa.SQL["events"].replace("ev AS (SELECT", "ev AS (SELECT entity, x.event, x.begin_date, x.end_date, x.impact, x.confidence FROM (SELECT entity, max({'price': price, 'event': event, 'begin_date': begin_date, 'end_date': end_date, 'impact': CAST(impact AS DOUBLE), 'confidence': CAST(confidence AS DOUBLE)}) AS x FROM (SELECT CAST(o_totalprice AS DOUBLE) AS price,", 1).replace("'1-URGENT')", "'1-URGENT') GROUP BY entity, date_trunc('quarter', begin_date)))", 1)}
_WINDOWS = f""", wsc AS (SELECT active_weeks, c.entity, c.origin, c.h, 100 * avg(abs((c.y - e.y0 * CASE WHEN age <= active_weeks THEN 1 + impact * 0.1 ELSE 1 END) / nullif(c.y, 0))) AS mape FROM cells c JOIN {q._LIVE} e USING (entity, origin), (SELECT CAST(unnest({list(ACTIVE_WEEKS)}) AS DOUBLE) AS active_weeks)
  WHERE c.channel = 'naive' AND age > {min(ACTIVE_WEEKS)} AND age <= {max(ACTIVE_WEEKS)} GROUP BY ALL),
sw AS (SELECT active_weeks, f.fold, avg(mape) AS mape, count(*) AS n FROM wsc JOIN folds f ON origin BETWEEN f.train_end - 728 AND f.train_end AND origin + 7 * h <= f.train_end GROUP BY ALL)"""


def _gate_sql(param: str, current: float, least: int = 3) -> str:
    good = f"better >= {least} AND mean_change < 0"
    return f""", dd AS (SELECT a.{param}, a.mape - b.mape AS x, a.n FROM sw a JOIN sw b ON b.fold = a.fold AND b.{param} = {current} WHERE a.{param} <> {current}),
g AS (SELECT {param}, count(*) FILTER (x < -0.01 AND n >= 30) AS better, count(*) FILTER (x > 0.01 AND n >= 30) AS worse, count(*) FILTER (abs(x) <= 0.01 OR n < 30) AS neutral, avg(x) AS mean_change FROM dd GROUP BY 1)
SELECT {param}, better, worse, neutral, mean_change, {good} AND row_number() OVER (ORDER BY CASE WHEN {good} THEN round(mean_change, 9) END NULLS LAST, {param}) = 1 AS approved FROM g"""


def _window_scores(spark, d):
    s = settled(pa.series(spark, d), "series")
    o = pa.origins(spark, d, s)
    weekly = settled(pa.event_weeks(spark, d, pa.major_events(spark, d)), "event-weeks")
    made = ch.event_scaled(s, o, weekly, bt.literal_grid(spark, scale=[0.1], window=list(ACTIVE_WEEKS))).withColumnRenamed("window", "active_weeks")
    ages = jo.active_event(o.select("entity", F.col("origin").alias("week")), weekly, max(ACTIVE_WEEKS)).withColumnRenamed("week", "origin")
    affected = ages.where(F.col("live") & (F.col("age_weeks") > min(ACTIVE_WEEKS)))
    steps = jo.forward_actuals(s, o, pa.horizons(spark)).join(made, ["entity", "origin", "step"])
    return bt.sweep(steps, pa.folds(spark), "active_weeks", affected)


@query(sql(_WINDOWS + " SELECT active_weeks, fold, mape, n FROM sw", "cells", "events", **_MAJOR), "active_weeks mape")
def h11_event_window_sweep(spark, d):
    """How long an event moves the forecast, on the origins whose event's age lies between the candidates: elsewhere they all agree."""
    return _window_scores(spark, d)


@query(sql(_WINDOWS + _gate_sql("active_weeks", 8.0), "cells", "events", **_MAJOR), "active_weeks mean_change")
def h11_event_window_gate(spark, d):
    """The fold-consistency gate over those windows, against eight weeks."""
    return bt.consistency(_window_scores(spark, d), "active_weeks", 8.0, least_folds=3)


_CAPS = f""", stat AS (SELECT c_mktsegment AS entity, CAST(count(*) AS DOUBLE) AS n_customers FROM customer GROUP BY 1),
lv AS (SELECT f.fold, o.entity, l.level, n_customers AS x FROM folds f JOIN origins o ON o.origin = f.train_end JOIN lvl l USING (entity, origin) JOIN stat USING (entity)),
sl AS (SELECT fold, entity, ml + CASE WHEN sx > 0 THEN (n * c / sx) / (n + 1.0) * (x0 - mx) / sx ELSE 0 END AS level FROM (SELECT a.fold, a.entity, any_value(a.x) AS x0, avg(b.x) AS mx, stddev_pop(b.x) AS sx, avg(b.level) AS ml, covar_pop(b.x, b.level) AS c, count(*) AS n
  FROM lv a JOIN lv b ON b.fold = a.fold AND b.entity <> a.entity GROUP BY ALL HAVING count(*) >= 3)),
csc AS (SELECT rho, f.fold, a.entity, a.origin, a.h, 100 * avg(abs((a.y - greatest(round(o.y0 + rho * pow(a.step / a.h, 2) * (l.level - o.y0), 2), 0.0)) / nullif(a.y, 0))) AS mape FROM act a JOIN origins o USING (entity, origin)
  JOIN folds f ON a.origin BETWEEN f.train_end - 728 AND f.train_end AND a.origin + 7 * a.h <= f.train_end JOIN sl l ON l.fold = f.fold AND l.entity = a.entity, (SELECT CAST(unnest({list(CAPS)}) AS DOUBLE) AS rho) WHERE a.n = a.h GROUP BY ALL),
sw AS (SELECT rho, fold, avg(mape) AS mape, count(*) AS n FROM csc GROUP BY ALL)"""


def _cap_scores(spark, d):
    s = settled(pa.series(spark, d), "series")
    o, f = pa.origins(spark, d, s), pa.folds(spark)
    ends = o.join(F.broadcast(f.select("fold", F.col("train_end").alias("origin"))), "origin")
    level = ch.structural_level(s, ends.drop("fold"), pa.statics(spark, d), ["n_customers"], leave_out=True)
    return bt.cap_sweep(jo.forward_actuals(s, o, pa.horizons(spark)), ch.last_value(s, o), level.join(ends, ["entity", "origin"]).select("fold", "entity", "level"), f, list(CAPS))


@query(sql(_CAPS + " SELECT rho, fold, mape, n FROM sw", "cells"), "rho mape")
def h11_cap_sweep(spark, d):
    """How far a forecast may go back to the structural level that was fitted at each fold's training end."""
    return _cap_scores(spark, d)


@query(sql(_CAPS + _gate_sql("rho", 0.3), "cells"), "rho mean_change")
def h11_cap_gate(spark, d):
    """The fold-consistency gate over those caps, against 0.3."""
    return bt.consistency(_cap_scores(spark, d), "rho", 0.3, least_folds=3)


# Splits and variants


@query(sql(""", v AS (SELECT * FROM losses WHERE origin BETWEEN DATE '1999-01-04' - 728 AND DATE '1999-01-04' AND origin + 7 * h <= DATE '1999-01-04'),
k AS (SELECT v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM v JOIN v n ON n.channel = 'naive' AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY 1),
w AS (SELECT channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER () AS w FROM k),
fz AS (SELECT entity, origin, h, step, any_value(y) AS y, greatest(round(sum(w * yhat), 2), 0.0) AS a, greatest(round(0.5 * sum(yhat) FILTER (channel IN ('holt', 'macro')), 2), 0.0) AS b FROM cells JOIN w USING (channel) WHERE origin >= DATE '1999-01-04' + 98 GROUP BY ALL),
al AS (SELECT 'fusion' AS system, entity, origin, h, 100 * avg(abs((y - a) / nullif(y, 0))) AS mape, sqrt(avg((y - a) * (y - a))) AS rmse FROM fz GROUP BY ALL UNION ALL SELECT 'blend', entity, origin, h, 100 * avg(abs((y - b) / nullif(y, 0))), sqrt(avg((y - b) * (y - b))) FROM fz GROUP BY ALL
  UNION ALL SELECT channel, entity, origin, h, mape, rmse FROM losses WHERE origin >= DATE '1999-01-04' + 98)
SELECT system, entity, h, avg(mape) AS mape, avg(rmse) AS rmse, count(*) AS n FROM al GROUP BY ALL""", "losses", forecasts=q._SYSTEM), "mape rmse")
def h18_blend_and_fusion(spark, d):
    """One split: fitted channels, the blend of two of them, and the fusion, per entity and horizon."""
    steps, losses, _, _ = q._base(spark, d, True)
    return bt.single_split_systems(steps, losses, "1999-01-04", ["holt", "macro"]).groupBy("system", "entity", "h").agg(F.avg("mape").alias("mape"), F.avg("rmse").alias("rmse"), F.count("*").alias("n"))


_WITHOUT = pa.SQL["cells"].replace("cells AS (SELECT a.entity", "all_cells AS (SELECT a.entity") + f""",
bad AS (SELECT DISTINCT entity, origin, h FROM all_cells WHERE origin BETWEEN DATE '{EXCLUDED[0]}' AND DATE '{EXCLUDED[1]}' OR target_date BETWEEN DATE '{EXCLUDED[0]}' AND DATE '{EXCLUDED[1]}'),
cells AS (SELECT c.* FROM all_cells c ANTI JOIN bad USING (entity, origin, h))"""
_RESULTS = " SELECT fold, entity, h, regime, avg(mape) AS mape, avg(rmse) AS rmse, count(*) AS n_origins FROM tl GROUP BY ALL"


@query(f"SELECT 'all cells' AS cells, * FROM ({sql(q._ADAPT + _RESULTS, 'skills')}) UNION ALL SELECT 'without window', * FROM ({sql(q._ADAPT + _RESULTS, 'skills', cells=_WITHOUT)})", "mape rmse")
def h19_both_ways(spark, d):
    """The adaptive backtest with and without the cells that touch a window: weights, modes and scores follow."""
    steps, losses, _, f = q._base(spark, d)
    run = lambda name, exclude: bt.results(bt.backtest(steps, losses, f, pa.HORIZONS, pa.REGIMES, exclude=exclude)).withColumn("cells", F.lit(name))
    return run("all cells", None).unionByName(run("without window", EXCLUDED)).select("cells", "fold", "entity", "h", "regime", "mape", "rmse", "n_origins")


@query(sql("SELECT f.fold, s.entity, hs.h, c.channel, 100 * abs((t.y - c.yhat) / nullif(t.y, 0)) AS ape FROM folds f JOIN series s ON s.date = f.train_end CROSS JOIN hs JOIN series t ON t.entity = s.entity AND t.date = s.date + 7 * hs.h JOIN flat c ON c.entity = s.entity AND c.origin = s.date AND c.step = hs.h", "forecasts", forecasts=q._SYSTEM), "ape")
def h21_all_channels(spark, d):
    """Every fitted channel's forecast made at each training end."""
    s = settled(pa.series(spark, d), "series")
    ends = s.join(F.broadcast(pa.folds(spark).select(F.col("train_end").alias("date"))), "date", "left_semi").select("entity", F.col("date").alias("origin"), "widx")
    return bt.single_origin(s, pa.system_paths(spark, d, s, ends), pa.folds(spark), pa.horizons(spark))


_VARIANTS = """, bad AS (SELECT DISTINCT c.entity, c.origin, c.h FROM cells c JOIN filled g ON g.entity = c.entity AND g.raw IS NULL AND g.date IN (c.origin, c.target_date)),
cv AS (SELECT 'base' AS variant, entity, origin, h, step, channel, y, yhat FROM cells UNION ALL SELECT 'level is naive', entity, origin, h, step, channel, y, yhat FROM cells WHERE channel <> 'histmean'
  UNION ALL SELECT 'level is naive', entity, origin, h, step, 'histmean', y, yhat FROM cells WHERE channel = 'naive' UNION ALL SELECT 'without filled', entity, origin, h, step, channel, y, yhat FROM cells ANTI JOIN bad USING (entity, origin, h)),
vl AS (SELECT variant, entity, origin, h, channel, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM cv GROUP BY ALL),
vv AS (SELECT f.fold, l.* FROM vl l JOIN folds f ON l.origin BETWEEN f.train_end - 728 AND f.train_end AND l.origin + 7 * l.h <= f.train_end),
k AS (SELECT v.variant, v.fold, v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM vv v JOIN vv n ON n.channel = 'naive' AND n.variant = v.variant AND n.fold = v.fold AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY 1, 2, 3),
w AS (SELECT variant, fold, channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY variant, fold) AS w FROM k),
fz AS (SELECT c.variant, f.fold, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, greatest(round(sum(w.w * c.yhat), 2), 0.0) AS yhat FROM cv c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end JOIN w ON w.variant = c.variant AND w.fold = f.fold AND w.channel = c.channel GROUP BY ALL)
SELECT variant, h, avg(mape) AS mape, count(*) AS n FROM (SELECT variant, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM fz GROUP BY ALL) GROUP BY ALL"""


@query(sql(_VARIANTS, "cells"), "mape")
def h13_variant_matrix(spark, d):
    """The fused system as it is, with the naive forecast in the place of the level channel, and without cells that touch filled values; weights anew for each."""
    steps, _, _, f = q._base(spark, d)
    _, log = jo.ffill_log(pa.weekly(spark, d))
    touched = gu.touches_filled(steps.where("channel = 'naive'"), log, with_origin=True).where("touched")
    names = {"base": {}, "level is naive": {"histmean": "naive"}, "without filled": {}}
    rows = bt.variants(steps, names, {"without filled": touched})
    parts = []
    for name in names:
        own = rows.where(F.col("variant") == name).drop("variant")
        losses = lo.cell_losses(own).join(own.select("entity", "origin", "regime").distinct(), ["entity", "origin"])
        parts.append(bt.backtest(own, losses, f, pa.HORIZONS, pa.REGIMES, "fold").withColumn("variant", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).groupBy("variant", "h").agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))


# Runs, router, gates and signals


@query(sql(f""", r AS (SELECT run, c.h, c.entity, c.origin, 100 * avg(abs((c.y - (c.yhat + (e.y0 * CASE WHEN age <= 8 THEN 1 + impact * 0.1 ELSE 1 END - c.yhat) * (1 + 0.5 * ({draw_sql('23', 'run', "date_diff('day', DATE '1970-01-01', origin)")} % 2001 - 1000) / 1000))) / nullif(c.y, 0))) AS mape
  FROM cells c JOIN {q._LIVE} e USING (entity, origin), (SELECT CAST(unnest(range(1, 6)) AS INT) AS run) WHERE c.channel = 'naive' GROUP BY ALL),
m AS (SELECT 'event_scaled' AS channel, h, run, avg(mape) / 100 AS m FROM r GROUP BY ALL) SELECT channel, h, avg(m) AS mean, stddev_pop(m) AS sd, count(*) AS n_runs FROM m GROUP BY ALL""", "cells", "events"), "mean sd")
def a20_seeded_runs(spark, d):
    """Five runs of the event channel, whose impacts are read a little differently each time: mean and deviation of the loss over runs."""
    s = settled(pa.series(spark, d), "series")
    o = pa.origins(spark, d, s)
    made = ch.event_scaled(s, o, pa.event_weeks(spark, d), bt.literal_grid(spark, scale=[0.1], window=[8])).drop("scale", "window")
    steps = jo.forward_actuals(s, o, pa.horizons(spark)).join(bt.noisy_runs(made, ch.naive(s, o), 5), ["entity", "origin", "step"])
    losses = lo.cell_losses(steps.withColumn("entity", F.struct("entity", "run")))
    return lo.repeated_runs(losses.withColumn("run", F.col("entity.run")))


_ROUTED = q._ADAPT + """, ff AS (SELECT f.fold, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, greatest(round(sum(w.w * yhat), 2), 0.0) AS yhat FROM cells c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end JOIN fw w ON w.fold = f.fold AND w.channel = c.channel GROUP BY ALL),
fl AS (SELECT fold, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM ff GROUP BY ALL)"""


@query(sql(_ROUTED + " SELECT a.fold, a.h, (a.s - b.s) / n AS effect FROM (SELECT fold, h, sum(mape) AS s FROM fl GROUP BY ALL) a JOIN (SELECT fold, h, sum(mape) AS s FROM tl GROUP BY ALL) b ON b.fold = a.fold AND b.h = a.h JOIN (SELECT h, count(*) AS n FROM fl GROUP BY 1) k ON k.h = a.h", "skills"), "effect")
def a22_router_of_modes(spark, d):
    """What the adaptive mode saves against fold weights, by fold."""
    steps, losses, _, f = q._base(spark, d)
    run = lambda mode: bt.backtest(steps, losses, f, pa.HORIZONS, pa.REGIMES, mode).withColumn("mode", F.lit(mode))
    return lo.router_effect(run("fold").unionByName(run("adaptive")))


@query(sql(q._MODES + """, k AS (SELECT fold, h, channel, coalesce(median(s), -1) AS all_skill FROM sk GROUP BY ALL), nr AS (SELECT g.fold, g.h, count(*) AS n_rules FROM grid g JOIN k USING (fold, h, channel) WHERE g.skill < 0 AND all_skill - g.skill > 0.1 AND g.n > 0 GROUP BY ALL)
SELECT w.fold, m.h, m.mode, string_agg(w.channel || '=' || printf('%.4f', round(w.w, 4)), ', ' ORDER BY w.channel) AS weights, coalesce(any_value(n_rules), 0) AS n_rules, 'fold ' || w.fold || ', ' || m.h || ' weeks: ' || m.mode || ' weights' AS sentence FROM fw w JOIN modes m ON m.fold = w.fold LEFT JOIN nr ON nr.fold = m.fold AND nr.h = m.h GROUP BY w.fold, m.h, m.mode""", "skills"))
def g15_report_with_rules(spark, d):
    """Weights, mode and rules per fold and horizon, the rules at their usual gap."""
    steps, _, val, f, fold_w, grid = q._router(spark, d)
    rules = fu.gating_rules(fu.regime_weights(val, f, pa.REGIMES, pa.HORIZONS), lo.median_skill(val, ["fold", "h"]))
    return fu.report(fold_w.crossJoin(F.broadcast(pa.horizons(spark))), fu.select_modes(q._val_steps(steps, f), fold_w, grid), rules)


@query(sql(q._ADAPT + q._SIGNAL + q._DECIDED + """, gv AS (SELECT l.h, l.mape AS b, t.mape AS f, gd.trigger <> 'none' AS act FROM tl t JOIN losses l ON l.channel = 'naive' AND l.entity = t.entity AND l.origin = t.origin AND l.h = t.h JOIN gd ON gd.entity = t.entity AND gd.origin = t.origin)
SELECT h, avg(b) AS base, avg(f) AS full_path, avg(CASE WHEN act THEN f ELSE b END) AS gated, avg(b - f) FILTER (act) AS gain_open, avg(b - f) FILTER (NOT act) AS gain_shut, avg(CAST(act AS DOUBLE)) AS activation FROM gv GROUP BY 1""", "skills", "events"), "base full_path gated gain_open gain_shut activation")
def h16_gate_value_at(spark, d):
    """What the fused system gives where the gate of tested edges opens it, and where the naive forecast is kept."""
    steps, losses, _, f = q._base(spark, d)
    fused = bt.backtest(steps, losses, f, pa.HORIZONS, pa.REGIMES).select("entity", "origin", "h", F.lit("fused").alias("channel"), "mape")
    naive = losses.where("channel = 'naive' AND fold IS NOT NULL").select("entity", "origin", "h", "channel", "mape")
    return bt.gate_value(settled(fused.unionByName(naive), "losses"), settled(q._gated(spark, d, True), "decisions"), "fused", "naive").withColumnRenamed("full", "full_path")


@query(sql(q._SIGNAL + " SELECT channel, f.entity, f.origin, f.h, step, yhat * (1 + 0.5 * coalesce(trend, 0.0) * step / f.h) AS yhat FROM forecasts f LEFT JOIN sg USING (entity, origin)", "forecasts"), "yhat")
def f21_with_spillover_at(spark, d):
    """The base channels tilted by the moves of the neighbours that were known at each origin."""
    s = settled(pa.series(spark, d), "series")
    signal = q._signal(spark, d, s, pa.origins(spark, d, s)).select("entity", "origin", "trend")
    return ch.with_spillover(pa.forecasts(spark, d, s), signal, F.col("h"), 0.5).select("channel", "entity", "origin", "h", "step", "yhat")


# Changes and modifiers


@query(sql(f""", pr AS (SELECT c.channel, c.h, (c.yhat - o.y0) / nullif(o.y0, 0) AS predicted, (c.y - o.y0) / nullif(o.y0, 0) AS realised FROM cells c JOIN origins o USING (entity, origin) WHERE c.step = c.h AND c.channel <> 'naive'),
cr AS (SELECT channel, h, count(*) AS n, corr(predicted, realised) AS r FROM pr WHERE predicted IS NOT NULL AND realised IS NOT NULL GROUP BY ALL),
th AS (SELECT channel, h, n, r, r * sqrt(n - 2) / sqrt(1 - r * r) AS t, n - 2 AS v, atan(abs(r) / sqrt(1 - r * r)) AS th FROM cr)
SELECT channel, h, n, r, t, greatest({q.LEAST_P}, 1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (th + sin(th) * {q._SERIES_OF_T}) ELSE sin(th) * {q._SERIES_OF_T} END) AS p FROM th""", "cells"), "r t p")
def t10_predicted_change(spark, d):
    """Whether each channel's predicted change over a horizon goes with the realised one, with the probability of so large a correlation by chance (under a millionth as a millionth)."""
    s = settled(pa.series(spark, d), "series")
    y0 = ch.last_value(s, pa.origins(spark, d, s)).select("entity", "origin", "y0")
    ends = pa.cells(spark, d, s=s).where("step = h AND channel <> 'naive'").join(y0, ["entity", "origin"])
    change = lambda c: F.try_divide(F.col(c) - F.col("y0"), F.col("y0"))
    out = stt.change_correlation(ends.withColumns({"predicted": change("yhat"), "realised": change("y")}), ["channel", "h"])
    return out.withColumn("p", F.greatest("p", F.lit(q.LEAST_P)))


_AT = "FROM fit f JOIN z ON z.entity = f.entity AND z.date = f.origin"


@query(sql(q._MOD + f" SELECT 'macro' AS channel, f.entity, f.origin, step, greatest(round(z.y * pow(1 + f.mz + f.b * (z.x - f.mx), step), 2), 0.0) AS yhat {_AT} CROSS JOIN st WHERE z.x IS NOT NULL", "aligned", "folds", "origins", "forecasts"), "yhat")
def f10_compounded(spark, d):
    """The modifier compounded over the steps."""
    return ch.anchored(q.f9_exogenous_modifier(spark, d), compound=True)


@query(sql(q._MOD + f" SELECT 'snaive_macro' AS channel, n.entity, n.origin, n.step, n.yhat * (1 + f.mz + f.b * (z.x - f.mx)) AS yhat {_AT} JOIN forecasts n ON n.channel = 'snaive' AND n.h = 13 AND n.entity = f.entity AND n.origin = f.origin WHERE z.x IS NOT NULL", "aligned", "folds", "origins", "forecasts"), "yhat")
def f10_applied(spark, d):
    """The modifier on top of the seasonal naive channel."""
    s = pa.series(spark, d)
    return ch.applied_to(q.f9_exogenous_modifier(spark, d), ch.seasonal_naive(s, pa.origins(spark, d, s)), "snaive_macro")
