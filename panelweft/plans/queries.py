"""The registered queries of the panel operators and the SQL that checks them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw_sql
from ..functions.tables import new_path, settled
from ..operators import backtest as bt
from ..operators import channels as ch
from ..operators import fusion as fu
from ..operators import graph as gr
from ..operators import guards as gu
from ..operators import joins as jo
from ..operators import losses as lo
from ..operators import screens as sc
from ..operators import stats as stt
from ..operators import windows as wi
from ..sources import ingest as ing
from ..sources import store as sto
from . import panels as pa
from .panels import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Added before rounding, so that a value half way between two roundings goes the same way in both engines.
NUDGE = 1.23e-08


def query(oracle: str | None = None, floats: str = ""):
    """Registers a query under its function's name; the named columns are rounded to six places on both sides."""
    names = floats.split()

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, d: str) -> DataFrame:
            out = f(spark, d)
            return out.withColumns({c: F.round(F.col(c).cast("double") + NUDGE, 6) + F.lit(0.0) for c in names})

        QUERIES[f.__name__] = run
        if oracle:
            fixed = ", ".join(f"round(CAST({c} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {c}" for c in names)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({fixed}) FROM ({oracle})" if names else oracle
        return f

    return register


# Ingestion


@query(sql("SELECT entity, date, y FROM weekly WHERE y IS NOT NULL AND date <= DATE '1999-12-27'", "weekly"))
def s1_unpivot_weekly(spark, d):
    """Weekly counts pivoted wide, read back long; S2's cap drops the later date columns."""
    wide = pa.weekly(spark, d).withColumn("d", F.col("date").cast("string"))
    dates = [str(r[0]) for r in ing.week_grid(spark, pa.FIRST, pa.LAST).collect()]  # one name per week of the grid
    wide = wide.groupBy("entity").pivot("d", dates).agg(F.first("y"))
    return ing.unpivot_weekly(wide, "entity", cap="1999-12-27").where("y IS NOT NULL")


@query(sql("""SELECT entity, date, last_value(n IGNORE NULLS) OVER w AS n_orders, last_value(p IGNORE NULLS) OVER w AS price FROM (
  SELECT c_mktsegment AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n, CASE WHEN count(*) % 2 = 0 THEN CAST(count(DISTINCT o_custkey) AS DOUBLE) END AS p
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)""", "weekly"))  # fmt: skip
def s3_merge_metrics(spark, d):
    """Two metrics merged on (entity, date) and carried forward within the entity."""
    o, c = pa.table(spark, d, "orders"), pa.table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("entity"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"))
    both = j.agg(F.count("*").cast("double").alias("n"), F.count_distinct("o_custkey").cast("double").alias("k"))
    return ing.merge_metrics({"n_orders": both.select("entity", "date", F.col("n").alias("y")), "price": both.where("n % 2 = 0").select("entity", "date", F.col("k").alias("y"))})


@query(sql("""SELECT entity, 'y' AS metric, min(CASE WHEN y IS NOT NULL THEN date END) AS first_valid,
  CAST(sum(CASE WHEN y IS NULL AND date > f THEN 1 ELSE 0 END) AS BIGINT) AS interior_gaps
  FROM (SELECT *, min(CASE WHEN y IS NOT NULL THEN date END) OVER (PARTITION BY entity) AS f FROM weekly) GROUP BY entity""", "weekly"))  # fmt: skip
def s3_gap_report(spark, d):
    """First valid date and interior gaps per entity and metric."""
    return ing.gap_report(pa.weekly(spark, d), ["y"])


@query(sql("SELECT series, obs_date, value, available_date FROM monthly", "weekly", "monthly"), "value")
def s4_availability(spark, d):
    """Publication lags as available_date."""
    return ing.with_availability(pa.monthly(spark, d), pa.LAGS)


@query("SELECT CAST(t.d AS DATE) AS date, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN CAST(t.d AS DATE) AND CAST(t.d AS DATE) + 6) AS n_orders FROM generate_series(TIMESTAMP '1994-12-31', TIMESTAMP '2001-12-29', INTERVAL 7 DAY) t(d)")
def s5_week_grid(spark, d):
    """A Saturday grid over all orders' dates, and the orders of each of its weeks."""
    grid = ing.week_grid(spark, "1994-12-31", "2001-12-31", "Sat")
    o = pa.table(spark, d, "orders").select(F.date_sub(F.next_day(F.to_date("o_orderdate"), "Sat"), 7).alias("date")).groupBy("date").agg(F.count("*").alias("n"))
    return grid.join(o, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS entity, c AS population, s AS area, CAST(c AS DOUBLE) / nullif(s, 0) AS density FROM (SELECT DISTINCT c_nationkey AS n_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS c FROM customer)
  LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""", "density")  # fmt: skip
def s6_build_static(spark, d):
    """Static attributes of nations with a density."""
    c = pa.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("entity")).agg(F.count("*").alias("population"))
    s = pa.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("entity")).agg(F.count("*").alias("area"))
    return ing.build_static(c, s).select("entity", "population", "area", "density")


_XW = "SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS code, c_mktsegment AS entity FROM customer"


@query(_XW)
def s7_crosswalk(spark, d):
    """Zero-padded codes of two parts, mapped to entities."""
    c = pa.table(spark, d, "customer").withColumn("part", F.col("c_custkey") % 1000)
    return ing.crosswalk(c, "c_nationkey", "part", "c_mktsegment")


@query(f"""WITH x AS ({_XW}), e AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS code, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT m.entity, CAST(coalesce(n, 0) AS BIGINT) AS n_events FROM (SELECT DISTINCT c_mktsegment AS entity FROM customer) m
LEFT JOIN (SELECT entity, count(*) AS n FROM e JOIN x USING (code) WHERE o_totalprice > 200000 GROUP BY 1) USING (entity)""")
def s8_impact_counts(spark, d):
    """Orders over a price as damaging events, counted per entity with zeros kept."""
    o, c = pa.table(spark, d, "orders"), pa.table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    events = j.select(code.alias("code"), (F.col("o_totalprice") > 200000).cast("int").alias("damage"))
    return ing.impact_counts(events, s7_crosswalk(spark, d), c.select(F.col("c_mktsegment").alias("entity")), ["damage"])


@query(sql("SELECT DISTINCT entity, event, week FROM evw", "weekly", "events"))
def s9_expand_active_weeks(spark, d):
    """Events on every Monday on which they were active."""
    return ing.expand_active_weeks(pa.events(spark, d))


@query(sql("SELECT entity, event, week, impact, confidence FROM evw", "weekly", "events"), "impact confidence")
def s10_attach_interpretation(spark, d):
    """One interpretation per event on all of its weeks."""
    e = pa.events(spark, d)
    return ing.attach_interpretation(ing.expand_active_weeks(e), e.select("entity", "event", "impact", "confidence"))


@query(sql("""SELECT entity, origin, h, step, 'ext' AS channel, CASE WHEN count(v) OVER (PARTITION BY entity, origin, h) = h THEN v END AS yhat FROM (
  SELECT c.entity, c.origin, c.h, c.step, CASE WHEN NOT (extract(day FROM c.origin) % 5 = 0 AND c.step = 6) THEN o.y0 END AS v FROM cells c JOIN origins o USING (entity, origin) WHERE c.channel = 'naive')""", "cells"), "yhat")  # fmt: skip
def s11_import_external(spark, d):
    """External forecasts with steps missing: only complete cells keep them."""
    s = pa.series(spark, d)
    ext = ch.naive(s, pa.origins(spark, d, s)).where(~((F.dayofmonth("origin") % 5 == 0) & (F.col("step") == 6)))
    return ing.import_external(pa.cells(spark, d).where("channel = 'naive'"), ext, "ext")


@query(sql("""SELECT DISTINCT entity, origin, channel FROM (SELECT entity, origin, unnest(['naive', 'snaive', 'flow']) AS channel FROM origins)
  WHERE (entity, origin, channel) NOT IN (SELECT (entity, origin, channel) FROM (SELECT DISTINCT entity, origin, channel FROM forecasts WHERE channel = 'naive' AND extract(day FROM origin) > 7))""", "forecasts"))  # fmt: skip
def s12_missing_cells(spark, d):
    """(entity, origin, channel) that a partly filled store still lacks."""
    s = pa.series(spark, d)
    o = pa.origins(spark, d, s)
    need = o.select("entity", "origin", F.explode(F.array(*[F.lit(c) for c in ("naive", "snaive", "flow")])).alias("channel"))
    store = ch.naive(s, o).where(F.dayofmonth("origin") > 7)
    return ing.missing_cells(store, need, ["entity", "origin", "channel"])


@query(sql("""SELECT channel, k AS fill, count(*) AS n_rows, count(DISTINCT (entity, origin)) AS n_cells, count(*) FILTER (yhat IS NULL) AS n_null, sum(yhat) AS total
  FROM (SELECT c.channel, o.entity, o.origin, st.step, f.yhat, CASE WHEN o.origin < DATE '1998-01-05' AND c.channel = 'naive' THEN 1 ELSE 2 END AS k FROM origins o CROSS JOIN (SELECT unnest(['naive', 'snaive']) AS channel) c CROSS JOIN st
  LEFT JOIN forecasts f ON f.channel = c.channel AND f.entity = o.entity AND f.origin = o.origin AND f.h = 13 AND f.step = st.step) GROUP BY ALL""", "forecasts"), "total")
def s12_fill_store(spark, d):
    """A store filled in part, then wholly, then again: rows and cells by channel and by the fill that made them; cells without a forecast are held as nulls."""
    s = settled(pa.series(spark, d), "series")
    o = pa.origins(spark, d, s)
    made = ch.naive(s, o).unionByName(ch.seasonal_naive(s, o))
    keys = ["channel", "entity", "origin", "step"]
    need = o.select("entity", "origin", F.explode(F.array(F.lit("naive"), F.lit("snaive"))).alias("channel")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(13))))
    path, shape = new_path(spark, "forecast-store"), "channel string, entity string, origin date, step int, yhat double, fill int"
    for k, part in ((1, need.where("channel = 'naive' AND origin < DATE '1998-01-05'")), (2, need), (3, need)):
        out = sto.fill(path, part, keys, shape, lambda missing, k=k: missing.join(made, keys, "left").withColumn("fill", F.lit(k)))
    return out.groupBy("channel", "fill").agg(F.count("*").alias("n_rows"), F.count_distinct("entity", "origin").alias("n_cells"), F.count(F.when(F.col("yhat").isNull(), 1)).alias("n_null"), F.sum("yhat").alias("total"))


@query(sql("SELECT channel, entity, origin, h, step, yhat FROM forecasts", "forecasts"), "yhat")
def s13_read_cells(spark, d):
    """Strict lookup of stored forecasts."""
    f = pa.forecasts(spark, d)
    keys = ["channel", "entity", "origin", "h"]
    return ing.read_cells(f, f.select(*keys), keys).select("channel", "entity", "origin", "h", "step", "yhat")


_REV = sql("""SELECT entity, date, CASE WHEN b.y2 IS NULL AND NOT b.has THEN 'removed' ELSE 'changed' END AS change, CASE WHEN NOT b.has THEN '' ELSE 'y' END AS "column",
  CASE WHEN b.has THEN y END AS old_value, y2 AS new_value FROM (SELECT *, widx % 50 <> 0 AS has, CASE WHEN widx % 50 <> 0 THEN CASE WHEN widx % 7 = 0 THEN y * 1.01 ELSE y END END AS y2 FROM series) b
  WHERE NOT has OR y <> y2""", "series")  # fmt: skip


def _revised(spark, d):
    s = pa.series(spark, d)
    return s, s.where("widx % 50 <> 0").withColumn("y", F.when(F.col("widx") % 7 == 0, F.col("y") * 1.01).otherwise(F.col("y")))


@query(sql("SELECT channel, h, avg(mape) AS mape, '13' AS config_embargo_weeks, 'test' AS config_split FROM losses WHERE fold IS NOT NULL GROUP BY ALL", "losses"), "mape")
def s14_result_table(spark, d):
    """A result table that carries its configuration, written and read back."""
    path = new_path(spark, "result")
    ing.write_result(lo.headline(pa.cell_losses(spark, d).where("fold IS NOT NULL")), path, {"embargo_weeks": 13, "split": "test"})
    return spark.read.parquet(path)


@query(sql("SELECT channel, h, avg(mape) AS mape, '13' AS embargo_weeks, 'test' AS split FROM losses WHERE fold IS NOT NULL GROUP BY ALL", "losses"), "mape")
def s14_result_csv(spark, d):
    """A result table as CSV behind a line of configuration, which the reader of rows skips and the reader of configurations finds."""
    path = new_path(spark, "result-csv")
    table = lo.headline(pa.cell_losses(spark, d).where("fold IS NOT NULL")).select("channel", "h", "mape")
    sto.write_csv(table, path, {"embargo_weeks": 13, "split": "test"})
    config = sto.read_config(spark, path).groupBy().pivot("name", ["embargo_weeks", "split"]).agg(F.first("value"))
    return ing.read_csv(spark, path, "channel string, h int, mape double").crossJoin(F.broadcast(config))  # one row


@query(_REV, "old_value new_value")
def s15_revision_diff(spark, d):
    """A vintage against its revision: rows gone and values changed."""
    return ing.revision_diff(*_revised(spark, d), ["entity", "date"], ["y"])


@query(f"""SELECT CAST(sum(CASE WHEN abs(new_value / old_value - 1) > 0.005 THEN 1 ELSE 0 END) AS DOUBLE) / any_value(n) AS share_large,
 CAST(sum(CASE WHEN abs(new_value / old_value - 1) > 0.005 THEN 1 ELSE 0 END) AS DOUBLE) / any_value(n) > 0.01 AS material, median(abs((new_value - old_value) / old_value)) AS median_change, max(abs((new_value - old_value) / old_value)) AS max_change
 FROM ({_REV}) r, ({sql('SELECT count(*) AS n FROM series', 'series')}) t WHERE change = 'changed'""", "share_large median_change max_change")
def s16_revision_materiality(spark, d):
    """How much of the panel a revision moved."""
    old, new = _revised(spark, d)
    return ing.revision_materiality(ing.revision_diff(old, new, ["entity", "date"], ["y"]), old)


@query(sql("""SELECT entity, count(*) AS n_rows, CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, min(date) AS first_date, max(date) AS last_date,
  CAST(sum(CASE WHEN y IS NULL AND (f IS NULL OR date < f) THEN 1 ELSE 0 END) AS BIGINT) AS leading_gaps, CAST(sum(CASE WHEN y IS NULL AND date > f THEN 1 ELSE 0 END) AS BIGINT) AS interior_gaps
  FROM (SELECT *, min(CASE WHEN y IS NOT NULL THEN date END) OVER (PARTITION BY entity) AS f FROM (SELECT CAST(e.k AS VARCHAR) AS entity, CAST(t.d AS DATE) AS date, w.y FROM (SELECT DISTINCT c_nationkey AS k FROM customer) e
  CROSS JOIN generate_series(TIMESTAMP '1995-01-02', TIMESTAMP '2001-07-23', INTERVAL 7 DAY) t(d) LEFT JOIN (SELECT c_nationkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS wd, count(*) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) w ON w.c_nationkey = e.k AND w.wd = CAST(t.d AS DATE))) GROUP BY entity""", "weekly"))  # fmt: skip
def s17_coverage(spark, d):
    """Coverage of the weekly panel of nations."""
    return ing.coverage(pa.weekly(spark, d, "c_nationkey"))


# Joins


@query(sql("SELECT entity, date, y, widx, disc, tax, qty FROM aligned", "aligned"), "y disc tax qty")
def j1_asof_join(spark, d):
    """The panel with the latest published factors."""
    return pa.aligned(spark, d)


@query("""WITH wk AS (SELECT CAST(c_nationkey AS VARCHAR) AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT CAST(e.k AS VARCHAR) AS entity, CAST(t.d AS DATE) AS date FROM (SELECT DISTINCT c_nationkey AS k FROM customer) e, generate_series(TIMESTAMP '1995-01-02', TIMESTAMP '2001-07-23', INTERVAL 7 DAY) t(d)),
f AS (SELECT g.entity, g.date, wk.y, last_value(wk.y IGNORE NULLS) OVER (PARTITION BY g.entity ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS filled_value FROM g LEFT JOIN wk ON wk.entity = g.entity AND wk.date = g.date)
SELECT date, entity, filled_value FROM f WHERE y IS NULL AND filled_value IS NOT NULL""")
def j2_ffill_log(spark, d):
    """Every filled gap of the panel of nations."""
    return jo.ffill_log(pa.weekly(spark, d, "c_nationkey"))[1]


@query(sql("SELECT a.entity, a.date, a.y, b.y AS lagged FROM series a LEFT JOIN series b ON b.entity = a.entity AND b.date = a.date - 42"))
def j3_calendar_lag(spark, d):
    """The value exactly six weeks before."""
    return jo.calendar_lag(pa.series(spark, d), "y", 6, "lagged").select("entity", "date", "y", "lagged")


@query(sql("SELECT entity, date, lag(y, 4) OVER w AS before, lead(y, 2) OVER w AS after FROM series WINDOW w AS (PARTITION BY entity ORDER BY date)"))
def j4_positional(spark, d):
    """Values four rows before and two after."""
    s = pa.series(spark, d)
    return jo.positional(jo.positional(s, "y", 4, "before"), "y", -2, "after").select("entity", "date", "before", "after")


@query(sql("SELECT entity, origin, h, step, target_date, y FROM act WHERE n = h", "cells"))
def j5_forward_actuals(spark, d):
    """The next rows after each origin, complete cells only."""
    s = pa.series(spark, d)
    return jo.forward_actuals(s, pa.origins(spark, d, s), pa.horizons(spark))


@query(sql("SELECT o.entity, o.origin, h, CAST(o.origin + 7 * h AS DATE) AS target_date, s.y FROM origins o, hs JOIN series s ON s.entity = o.entity AND s.date = o.origin + 7 * h", "forecasts"))
def j6_calendar_targets(spark, d):
    """Values a fixed number of weeks after each origin."""
    s = pa.series(spark, d)
    return jo.calendar_targets(s, pa.origins(spark, d, s), pa.horizons(spark)).select("entity", "origin", "h", "target_date", "y")


_ONE = "one AS (SELECT entity, week AS event_week, (min({'b': begin_date, 'e': event, 'i': impact, 'c': confidence})) AS x FROM evw GROUP BY ALL)"


@query(sql(f"""SELECT s.entity, s.date AS week, a.x.e AS event, a.x.i AS impact, CAST((s.date - a.event_week) // 7 AS INT) AS age_weeks, coalesce((s.date - a.event_week) / 7.0 <= 8, false) AS live
  FROM series s ASOF LEFT JOIN (WITH {_ONE} SELECT * FROM one) a ON a.entity = s.entity AND s.date >= a.event_week""", "series", "events"), "impact")
def j7_active_event(spark, d):
    """The latest event at each week, its age, and whether it is live."""
    asks = pa.series(spark, d).select("entity", F.col("date").alias("week"))
    return jo.active_event(asks, pa.event_weeks(spark, d)).select("entity", "week", "event", "impact", "age_weeks", "live")


@query(sql("SELECT s.entity, s.date AS origin, f.fold, coalesce(f.fold, 4) AS fold_or_last FROM series s LEFT JOIN folds f ON s.date BETWEEN f.test_start AND f.test_end", "folds"))
def j8_fold_of(spark, d):
    """The fold of each date, with and without the fallback to the last one."""
    rows = pa.series(spark, d).select("entity", F.col("date").alias("origin"))
    both = jo.fold_of(rows, pa.folds(spark)).join(jo.fold_of(rows, pa.folds(spark), fallback=True).withColumnRenamed("fold", "fold_or_last"), ["entity", "origin"])
    return both.select("entity", "origin", "fold", "fold_or_last")


@query("SELECT a.k AS source, b.k AS target FROM (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS k FROM customer) a, (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS k FROM customer) b WHERE a.k <> b.k")
def j9_ordered_pairs(spark, d):
    """All ordered pairs of nations."""
    return jo.ordered_pairs(pa.table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("entity")))


@query(sql("""SELECT channel, entity, origin, h, step, yhat FROM forecasts WHERE NOT (channel = 'snaive' AND extract(day FROM origin) < 5)
  AND (entity, origin, h) IN (SELECT (entity, origin, h) FROM forecasts WHERE NOT (channel = 'snaive' AND extract(day FROM origin) < 5) GROUP BY entity, origin, h HAVING count(*) = 3 * h)""", "forecasts"), "yhat")  # fmt: skip
def j10_complete_cells(spark, d):
    """Cells for which every channel is there."""
    f = pa.forecasts(spark, d).where(~((F.col("channel") == "snaive") & (F.dayofmonth("origin") < 5)))
    return jo.complete_cells(f, pa.CHANNELS).select("channel", "entity", "origin", "h", "step", "yhat")


@query(sql("""SELECT h, origin, entity, channel, mape FROM losses l WHERE NOT (channel = 'snaive' AND entity = 'BUILDING' AND extract(day FROM origin) < 10)
  AND NOT EXISTS (SELECT 1 FROM losses b WHERE b.h = l.h AND b.origin = l.origin AND b.channel = 'snaive' AND b.entity = 'BUILDING' AND extract(day FROM b.origin) < 10)""", "losses"), "mape")  # fmt: skip
def j11_complete_weeks(spark, d):
    """Weeks in which no entity lacks a method."""
    raw = pa.cell_losses(spark, d).where(~((F.col("channel") == "snaive") & (F.col("entity") == "BUILDING") & (F.dayofmonth("origin") < 10)))
    return jo.complete_weeks(raw, pa.CHANNELS).select("h", "origin", "entity", "channel", "mape")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS snapped FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-02' AND DATE '2001-07-29'")
def j12_snap_to_grid(spark, d):
    """Every order's date snapped to the Monday grid."""
    o = pa.table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.to_date("o_orderdate").alias("date"))
    return jo.snap_to_grid(o.where("date BETWEEN '1995-01-02' AND '2001-07-29'"), ing.week_grid(spark, pa.FIRST, pa.LAST), "date").select("o_orderkey", "snapped")


@query(sql("""SELECT count(*) FILTER (x IS NOT NULL) AS n_both, count(*) FILTER (x IS NULL) AS n_first_only, CAST(0 AS BIGINT) AS n_second_only, max(abs(y - x)) AS max_abs, max(abs(y - x) / abs(y)) AS max_rel,
  quantile_cont(abs(y - x), 0.99) AS p99_abs, median(abs(y - x)) AS median_abs FROM (SELECT y, CASE WHEN widx % 50 <> 0 THEN CASE WHEN widx % 7 = 0 THEN y * 1.01 ELSE y END END AS x FROM series)"""), "max_abs max_rel p99_abs median_abs")  # fmt: skip
def j13_parity(spark, d):
    """Two runs over the same keys."""
    return jo.parity(*_revised(spark, d), ["entity", "date"], "y")


# Guards


@query(sql("SELECT entity, date, y FROM series WHERE date > DATE '2000-06-05' - 42"))
def c1_lookahead(spark, d):
    """Rows past the as-of date less a lag."""
    return gu.lookahead_violations(pa.series(spark, d), "2000-06-05", lag_days=42).select("entity", "date", "y")


@query(sql("""SELECT entity, origin, h, step, channel, target_date >= DATE '2001-01-01' AS bleed FROM cells WHERE target_date <= DATE '2001-02-26'""", "cells"))
def c2_scoring_guard(spark, d):
    """Disclosed scoring up to the cap, with the cells that bleed into the reserved window."""
    return gu.scoring_guard(pa.cells(spark, d), pa.RESERVED, "2001-02-26", disclosed=True).select("entity", "origin", "h", "step", "channel", "bleed")


@query(sql(""", bad AS (SELECT * REPLACE (CASE WHEN channel = 'snaive' AND widx % 40 = 0 AND step = 2 THEN NULL WHEN channel = 'histmean' AND widx % 40 = 1 AND step = 1 THEN -1.0 ELSE yhat END AS yhat)
  FROM forecasts JOIN (SELECT entity, origin, widx FROM origins) USING (entity, origin) WHERE NOT (channel = 'naive' AND widx % 40 = 2) AND NOT (channel = 'naive' AND widx % 40 = 3 AND step = 4))
SELECT entity, origin, h, channel, 'missing' AS problem FROM bad WHERE yhat IS NULL UNION ALL SELECT entity, origin, h, channel, 'negative' FROM bad WHERE yhat < 0
UNION ALL SELECT entity, origin, h, channel, 'length' FROM bad GROUP BY ALL HAVING count(*) <> h
UNION ALL SELECT entity, origin, h, 'naive', 'absent' FROM origins, hs WHERE widx % 40 = 2""", "forecasts"))  # fmt: skip
def c3_contract_violations(spark, d):
    """Forecasts with planted faults against the contract."""
    s = pa.series(spark, d)
    o = pa.origins(spark, d, s)
    f = pa.forecasts(spark, d, s).join(o, ["entity", "origin"]).where("NOT (channel = 'naive' AND widx % 40 = 2) AND NOT (channel = 'naive' AND widx % 40 = 3 AND step = 4)")
    bad = F.when((F.col("channel") == "snaive") & (F.col("widx") % 40 == 0) & (F.col("step") == 2), None).when((F.col("channel") == "histmean") & (F.col("widx") % 40 == 1) & (F.col("step") == 1), -1.0).otherwise(F.col("yhat"))
    return gu.contract_violations(f.withColumn("yhat", bad), pa.CHANNELS)


@query(sql("SELECT fold, o.origin, CAST(test_start - o.origin AS INT) AS gap_days FROM folds, (SELECT DISTINCT origin FROM origins) o WHERE o.origin <= train_end + 98 AND o.origin > train_end - 98 AND test_start - o.origin < 91", "origins"))
def c4_embargo(spark, d):
    """Candidate training ends too close to each fold's test window."""
    s = pa.series(spark, d)
    ends = pa.origins(spark, d, s).select(F.col("origin").alias("end")).distinct()
    f = pa.folds(spark).join(ends, F.col("end").between(F.date_sub("train_end", 97), F.date_add("train_end", 98))).withColumn("train_end", F.col("end"))
    return gu.embargo_violations(f).select("fold", F.col("end").alias("origin"), "gap_days")


@query(sql(""", bad AS (SELECT DISTINCT entity, origin, h FROM cells WHERE origin BETWEEN DATE '1998-03-02' AND DATE '1998-07-06' OR target_date BETWEEN DATE '1998-03-02' AND DATE '1998-07-06')
SELECT entity, origin, h, step, channel FROM cells ANTI JOIN bad USING (entity, origin, h)""", "cells"))  # fmt: skip
def c5_exclude_window(spark, d):
    """Cells without an origin or target in the excluded window."""
    return gu.exclude_window(pa.cells(spark, d), "1998-03-02", "1998-07-06").select("entity", "origin", "h", "step", "channel")


@query(sql("""SELECT c.entity, c.origin, c.h, max(CASE WHEN s.widx % 29 = 0 THEN 1 ELSE 0 END) = 1 AS touched FROM cells c JOIN series s ON s.entity = c.entity AND (s.date = c.target_date OR s.date = c.origin)
  GROUP BY ALL""", "cells"))  # fmt: skip
def c6_touches_filled(spark, d):
    """Cells with an imputed target or origin; every 29th row counts as imputed."""
    log = pa.series(spark, d).where("widx % 29 = 0")
    return gu.touches_filled(pa.cells(spark, d), log, True)


@query(sql("SELECT entity, origin, h, channel, fold, mape FROM val", "val"), "mape")
def c7_in_validation(spark, d):
    """Validation cells of every fold with bounded targets."""
    return fu.validation(pa.cell_losses(spark, d), pa.folds(spark)).select("entity", "origin", "h", "channel", "fold", "mape")


@query("""SELECT CAST(event_id AS BIGINT) AS event_id, value AS raw_impact, c <= 0.60 AS gated, CASE WHEN c <= 0.60 THEN 0.0 ELSE v END AS impact FROM (
  SELECT event_id, (event_id % 27 - 13) / 10.0 AS v, (event_id % 12) / 10.0 AS c, event_type, (event_id % 27 - 13) / 10.0 AS value FROM events)
  WHERE event_type IN ('click', 'view', 'purchase') AND v BETWEEN -1 AND 1 AND c BETWEEN 0 AND 1 AND event_id % 9 <> 0""", "raw_impact impact")  # fmt: skip
def c8_gate_events(spark, d):
    """Accepted events, with impact 0 at or under the confidence floor."""
    i = F.col("event_id").cast("bigint")
    e = pa.table(spark, d, "events").select(i.alias("event_id"), "event_type", ((i % 27 - 13) / 10.0).cast("double").alias("impact"), ((i % 12) / 10.0).cast("double").alias("confidence"), F.when(i % 9 == 0, "  ").otherwise("text").alias("reasoning"))
    return gu.gate_events(e, ["click", "view", "purchase"])[0].select("event_id", "raw_impact", "gated", "impact")


def _flags(spark, d):
    k = F.col("o_orderkey").cast("bigint")
    return pa.table(spark, d, "orders").select(
        k.alias("event"), (k % 2 == 0).alias("ih"), (k % 3 == 0).alias("ia"), (k % 5 == 0).alias("pa"), (k % 7 == 0).alias("hm"),
        F.when(k % 4 == 0, "DR").when(k % 4 == 1, "EM").otherwise("FM").alias("declaration_type"), ((k % 21 - 10) / 10.0).cast("double").alias("impact"),
    )


_FL = "SELECT CAST(o_orderkey AS BIGINT) AS event, o_orderkey % 2 = 0 AS ih, o_orderkey % 3 = 0 AS ia, o_orderkey % 5 = 0 AS pa, o_orderkey % 7 = 0 AS hm, CASE o_orderkey % 4 WHEN 0 THEN 'major disaster' WHEN 1 THEN 'emergency' ELSE 'other' END AS note, (o_orderkey % 21 - 10) / 10.0 AS impact FROM orders"


@query(f"""SELECT event, n_programs, note, programs, note || ' with ' || n_programs || ' of 4 programs: ' || CASE WHEN n_programs > 0 THEN programs ELSE 'none' END AS sentence FROM (
  SELECT event, note, CAST(ih AS INT) + CAST(ia AS INT) + CAST(pa AS INT) + CAST(hm AS INT) AS n_programs, concat_ws(', ', CASE WHEN ih THEN 'ih' END, CASE WHEN ia THEN 'ia' END, CASE WHEN pa THEN 'pa' END, CASE WHEN hm THEN 'hm' END) AS programs FROM ({_FL}))""")
def c9_severity(spark, d):
    """Program counts, notes and sentences of declarations."""
    return gu.severity(_flags(spark, d), ["ih", "ia", "pa", "hm"]).select("event", "n_programs", "note", "programs", "sentence")


@query(f"""SELECT event, abs(impact) >= least(n, 3) * 0.2 - 1e-9 AND abs(impact) <= CASE WHEN n >= 3 THEN 1.0 ELSE (n + 1) * 0.2 END + 1e-9 AS in_band FROM (
  SELECT *, CAST(ih AS INT) + CAST(ia AS INT) + CAST(pa AS INT) + CAST(hm AS INT) AS n FROM ({_FL}))""")
def c10_rubric_band(spark, d):
    """Whether the impact fits the band of the program count."""
    return gu.rubric_band(gu.severity(_flags(spark, d), ["ih", "ia", "pa", "hm"])).select("event", "in_band")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS event, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'urgent' WHEN lower(o_orderpriority) LIKE '%high%' THEN 'high' ELSE 'other' END AS label,
  NOT ((o_orderkey % 3 = 0 AND o_orderkey % 5 > 2) OR (o_orderkey % 3 = 1 AND o_orderkey % 5 < 2)) AS consistent FROM orders""")  # fmt: skip
def c11_sign_consistent(spark, d):
    """Short titles, and whether words and sign agree."""
    k = F.col("o_orderkey").cast("bigint")
    words = F.when(k % 3 == 0, "Prices will FALL soon").when(k % 3 == 1, "a strong rise").otherwise("no view")
    e = pa.table(spark, d, "orders").select(k.alias("event"), words.alias("reasoning"), (k % 5 - 2).cast("double").alias("impact"), gu.short_title("o_orderpriority", {"urgent": "urgent", "high": "high"}).alias("label"))
    return gu.sign_consistent(e).select("event", "label", "consistent")


@query(sql("""SELECT DISTINCT date, CAST(weekofyear(date) AS INT) AS iso_week, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, weekofyear(date) BETWEEN 13 AND 26 AS spring,
  date >= make_date(year(date), 11, 22) + CAST((4 - isodow(make_date(year(date), 11, 22)) + 7) % 7 AS INT) OR (month(date) = 1 AND day(date) = 1) AS holiday FROM series"""))
def c12_calendar_features(spark, d):
    """Calendar features of every week."""
    return gu.calendar_features(pa.series(spark, d).select("date").distinct(), "date")


@query(sql("SELECT 'tax' AS factor, 'repeated date' AS problem UNION ALL SELECT 'qty', 'negative lag' UNION ALL SELECT 'disc', 'two lags'", "weekly"))
def c13_exogenous_problems(spark, d):
    """Faults of a lag-tagged factor table with planted ones."""
    m = pa.monthly(spark, d).select(F.col("series").alias("factor"), F.col("obs_date").alias("date"), "value")
    lag = F.when(F.col("factor") == "qty", -1).when((F.col("factor") == "disc") & (F.month("date") == 1), 7).otherwise(6)
    return gu.exogenous_problems(m.withColumn("lag", lag).unionByName(m.where("factor = 'tax'").withColumn("lag", F.lit(6))))


@query(sql("SELECT entity, 'negative' AS problem FROM series WHERE widx = 5"))
def c14_payload_problems(spark, d):
    """Array payloads with a negative value planted."""
    s = pa.series(spark, d).groupBy("entity").agg(F.collect_list("date").alias("dates"), F.collect_list(F.when(F.col("widx") == 5, -F.col("y")).otherwise(F.col("y"))).alias("values"))
    return gu.payload_problems(s).select("entity", "problem")


# Windows


@query(sql("SELECT entity, date, CASE WHEN count(y) OVER w >= 26 THEN avg(y) OVER w END AS cma FROM series WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 26 PRECEDING AND 25 FOLLOWING)"), "cma")
def w2_centred_average(spark, d):
    """Centred 52-row average."""
    return wi.centred_average(pa.series(spark, d)).select("entity", "date", "cma")


@query(sql("""SELECT o.entity, o.origin, a.date, CASE WHEN count(*) >= 26 THEN avg(b.y) END AS cma FROM origins o JOIN series a ON a.entity = o.entity AND a.widx <= o.widx
  JOIN series b ON b.entity = o.entity AND b.widx BETWEEN a.widx - 26 AND least(a.widx + 25, o.widx) GROUP BY ALL""", "origins"), "cma")  # fmt: skip
def w2_centred_average_at(spark, d):
    """The same, truncated at each of the origins."""
    s = pa.series(spark, d)
    return wi.centred_average_at(s, pa.origins(spark, d, s)).select("entity", "origin", "date", "cma")


@query(sql("SELECT entity, date, widx, (y - lag(y) OVER w) / nullif(lag(y) OVER w, 0) AS change FROM series WINDOW w AS (PARTITION BY entity ORDER BY date)"), "change")
def w3_weekly_change(spark, d):
    """Row numbers (W1) and week-on-week change."""
    return wi.weekly_change(pa.series(spark, d)).select("entity", "date", "widx", "change")


@query(sql("SELECT entity, date, (lead(y, 8) OVER w - y) / nullif(y, 0) AS forward, lead(y, 8) OVER w - y AS forward_diff FROM series WINDOW w AS (PARTITION BY entity ORDER BY date)"), "forward forward_diff")
def w4_forward_change(spark, d):
    """Change over the next eight rows."""
    return wi.forward_change(pa.series(spark, d), 8).select("entity", "date", "forward", "forward_diff")


@query(sql("SELECT origin, regime FROM regimes", "regimes"))
def w5_regime(spark, d):
    """The regime of every week."""
    return pa.regimes(spark, d)


@query(sql("""SELECT t.threshold, count(*) AS n_rows, CAST(sum(CASE WHEN (CASE WHEN m > t.threshold THEN 1 WHEN m < -t.threshold THEN -1 ELSE 0 END) <> (CASE WHEN m > 0.25 THEN 1 WHEN m < -0.25 THEN -1 ELSE 0 END) THEN 1 ELSE 0 END) AS BIGINT) AS n_flipped,
  CAST(sum(CASE WHEN abs(abs(m) - 0.25) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_near FROM (SELECT disc * 1000 - lag(disc * 1000, 13) OVER (PARTITION BY entity ORDER BY date) AS m FROM aligned), (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.5]) AS DOUBLE) AS threshold) t GROUP BY 1""", "aligned"))  # fmt: skip
def w6_threshold_sensitivity(spark, d):
    """Labels that other thresholds flip."""
    a = pa.aligned(spark, d, ["disc"]).withColumn("x", F.col("disc") * 1000)
    return wi.threshold_sensitivity(a, [0.1, 0.2, 0.3, 0.5], 0.25, 0.05)


@query(sql("""SELECT entity, factor, CASE WHEN count(*) < 10 OR stddev_pop(x) < 1e-12 OR stddev_pop(z) < 1e-12 THEN 0.0 ELSE corr(x, z) END AS corr, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, factor ORDER BY date DESC) AS r FROM (UNPIVOT (SELECT entity, date, disc, tax, qty, (lead(y, 4) OVER (PARTITION BY entity ORDER BY date) - y) / nullif(y, 0) AS z
  FROM aligned WHERE date <= DATE '2000-06-05' AND date > DATE '2000-06-05' - 728) ON disc, tax, qty INTO NAME factor VALUE x) WHERE x IS NOT NULL AND z IS NOT NULL) WHERE r <= 52 GROUP BY entity, factor""", "aligned"), "corr")  # fmt: skip
def w7_factor_correlation(spark, d):
    """Correlation of each factor with the change ahead, over the last 52 pairs."""
    return wi.factor_correlation(pa.aligned(spark, d), ["disc", "tax", "qty"], "2000-06-05", 4)


@query(sql("""SELECT entity, date, CASE WHEN n + 1 < 4 OR ape IS NULL THEN NULL WHEN sd < 1e-12 THEN 0.0 ELSE (ape - m) / sd END AS z FROM (SELECT entity, date, ape, count(ape) OVER w AS n, avg(ape) OVER w AS m, stddev_pop(ape) OVER w AS sd
  FROM (SELECT entity, date, abs((y - lag(y) OVER (PARTITION BY entity ORDER BY date)) / nullif(y, 0)) AS ape FROM series) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING))"""), "z")  # fmt: skip
def w8_error_zscore(spark, d):
    """Score of the last naive error against those before."""
    return wi.error_zscore(pa.series(spark, d)).select("entity", "date", "z")


@query(sql("""SELECT entity, date, CASE WHEN n < 12 THEN NULL WHEN sd < 1e-12 THEN 0.0 ELSE abs(mv) / sd END AS z FROM (SELECT entity, date, mv, count(mv) OVER w AS n, stddev_pop(mv) OVER w AS sd
  FROM (SELECT entity, date, (y - lag(y, 4) OVER (PARTITION BY entity ORDER BY date)) / nullif(lag(y, 4) OVER (PARTITION BY entity ORDER BY date), 0) AS mv FROM series) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""), "z")  # fmt: skip
def w9_move_zscore(spark, d):
    """Score of the last four-row move."""
    return wi.move_zscore(pa.series(spark, d)).select("entity", "date", "z")


@query(sql("SELECT entity, date, (lag(y, 2) OVER w - lag(y, 5) OVER w) / nullif(lag(y, 5) OVER w, 0) AS recent FROM series WINDOW w AS (PARTITION BY entity ORDER BY date)"), "recent")
def w10_lagged_move(spark, d):
    """A three-step move that ends two rows before."""
    return wi.lagged_move(pa.series(spark, d), 2).select("entity", "date", "recent")


_OWN = """own AS (SELECT entity, date, widx, product(1 + o) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS own FROM (SELECT entity, date, widx, coalesce(c - avg(c) OVER (PARTITION BY date), 0.0) AS o
  FROM (SELECT entity, date, widx, (y - lag(y) OVER (PARTITION BY entity ORDER BY date)) / nullif(lag(y) OVER (PARTITION BY entity ORDER BY date), 0) AS c FROM small)))"""


@query(sql("SELECT entity, date, own FROM own", "series") .replace("series AS (SELECT entity, date, y, CAST", "series AS (SELECT entity, date, 100 + y AS y, CAST").replace("\nSELECT entity, date, own", ", small AS (SELECT * FROM series), " + _OWN + "\nSELECT entity, date, own"), "own")
def w11_strip_common(spark, d):
    """Entities' own movement beside the common one."""
    return wi.strip_common(pa.series(spark, d).withColumn("y", F.col("y") + 100)).select("entity", "date", "own")


@query(sql("SELECT entity, coalesce(max(abs(c)), 1.0) AS bound FROM (SELECT entity, (y - lag(y) OVER (PARTITION BY entity ORDER BY date)) / nullif(lag(y) OVER (PARTITION BY entity ORDER BY date), 0) AS c FROM series) GROUP BY 1"), "bound")
def w12_historical_bound(spark, d):
    """The largest weekly change of each entity."""
    return wi.historical_bound(pa.series(spark, d))


@query(sql("SELECT entity, count(*) AS n_weeks, coalesce(max(abs(c)), 1.0) AS bound FROM (SELECT entity, (y - lag(y) OVER (PARTITION BY entity ORDER BY date)) / nullif(lag(y) OVER (PARTITION BY entity ORDER BY date), 0) AS c FROM series) GROUP BY 1").replace("c_mktsegment AS entity", "CAST(c_custkey AS VARCHAR) AS entity"), "bound")
def w12_historical_bound_customers(spark, d):
    """The same over a panel of every customer, with the weeks that each has."""
    seen = pa.counts(spark, d, "c_custkey").where(F.col("date").between(pa.FIRST, pa.LAST))
    return wi.historical_bound_filled(seen, pa.LAST).select(F.col("entity").cast("string").alias("entity"), "n_weeks", "bound")


@query(sql("""SELECT entity, m AS mean, sd, sd / m AS cv, CAST(coalesce(sum(CASE WHEN s <> p THEN 1 ELSE 0 END), 0) AS BIGINT) AS reversals FROM (SELECT entity, m, sd, s, lag(s) OVER (PARTITION BY entity ORDER BY date) AS p FROM (
  SELECT r.*, sign(round(r.rm - lag(r.rm) OVER (PARTITION BY entity ORDER BY date), 9)) AS s FROM (SELECT entity, date, avg(y) OVER (PARTITION BY entity) AS m, stddev_samp(y) OVER (PARTITION BY entity) AS sd,
  CASE WHEN count(y) OVER w = 13 THEN avg(y) OVER w END AS rm FROM series WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 12 PRECEDING)) r) WHERE s <> 0) GROUP BY entity, m, sd"""), "mean sd cv")  # fmt: skip
def w13_reversals(spark, d):
    """Turns of the 13-row mean, and spread."""
    return wi.reversals(pa.series(spark, d)).select("entity", "mean", "sd", "cv", "reversals")


@query(sql("SELECT entity, date, lag(qty, 6) OVER w - lag(qty, 10) OVER w AS dq FROM aligned WINDOW w AS (PARTITION BY entity ORDER BY date)", "aligned"), "dq")
def w14_lagged_change(spark, d):
    """A four-row change of a factor, six rows before."""
    return wi.lagged_change(pa.aligned(spark, d, ["qty"]), "qty", 4, 6, "dq").select("entity", "date", "dq")


@query(sql("SELECT o.entity, o.origin, sum(s.y) AS total, count(*) AS n, min(s.date) AS first_date FROM origins o JOIN series s ON s.entity = o.entity AND s.widx BETWEEN o.widx - 51 AND o.widx GROUP BY ALL HAVING count(*) = 52", "origins"), "total")
def w15_contexts(spark, d):
    """Contexts of 52 values, summed up."""
    s = pa.series(spark, d)
    c = wi.contexts(s, pa.origins(spark, d, s))
    return c.select("entity", "origin", F.aggregate("context", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("context").cast("bigint").alias("n"), F.date_sub("origin", 7 * 51).alias("first_date"))


@query(sql("""SELECT regime, CAST(g AS BIGINT) AS episode, count(*) AS weeks, min(origin) AS first_date, max(origin) AS last_date FROM (SELECT *, sum(c) OVER (ORDER BY origin ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN regime = lag(regime) OVER (ORDER BY origin) THEN 0 ELSE 1 END AS c FROM regimes)) GROUP BY 1, 2""", "regimes"))  # fmt: skip
def w16_episodes(spark, d):
    """Runs of one regime."""
    r = pa.regimes(spark, d).select(F.lit("all").alias("entity"), F.col("origin").alias("date"), "regime")
    return wi.episodes(r).select("regime", "episode", "weeks", "first_date", "last_date")


@query(sql("SELECT date, count(DISTINCT y > 9) AS n_labels FROM series GROUP BY 1 HAVING count(DISTINCT y > 9) > 1"))
def w17_label_disagreement(spark, d):
    """Weeks in which entities carry different labels."""
    return wi.label_disagreement(pa.series(spark, d).withColumn("regime", F.col("y") > 9))


# Channels


@query(sql("SELECT DISTINCT channel, entity, origin, step, yhat FROM forecasts WHERE channel = 'naive' AND h = 13", "forecasts"), "yhat")
def f1_naive(spark, d):
    """The last value, repeated."""
    s = pa.series(spark, d)
    return ch.naive(s, pa.origins(spark, d, s))


@query(sql("SELECT channel, entity, origin, step, yhat FROM forecasts WHERE channel = 'snaive' AND h = 13", "forecasts"), "yhat")
def f2_seasonal_naive(spark, d):
    """The value 52 rows before the target."""
    s = pa.series(spark, d)
    return ch.seasonal_naive(s, pa.origins(spark, d, s))


_FACTORS = """, chosen AS (SELECT * FROM origins), cma AS (SELECT o.entity, o.origin, a.date, a.y, CASE WHEN count(*) >= 26 THEN avg(b.y) END AS c FROM chosen o JOIN series a ON a.entity = o.entity AND a.widx <= o.widx
  JOIN series b ON b.entity = o.entity AND b.widx BETWEEN a.widx - 26 AND least(a.widx + 25, o.widx) GROUP BY ALL),
med AS (SELECT entity, origin, weekofyear(date) AS week, CASE WHEN count(y / nullif(c, 0)) >= 2 THEN median(y / nullif(c, 0)) ELSE 1.0 END AS raw FROM cma GROUP BY ALL),
fullw AS (SELECT o.entity, o.origin, o.widx, w.week, coalesce(m.raw, 1.0) AS raw FROM chosen o CROSS JOIN (SELECT CAST(unnest(range(1, 54)) AS INT) AS week) w LEFT JOIN med m ON m.entity = o.entity AND m.origin = o.origin AND m.week = w.week),
smo AS (SELECT a.entity, a.origin, a.widx, a.week, avg(b.raw) AS s FROM fullw a JOIN fullw b ON b.entity = a.entity AND b.origin = a.origin AND (b.week = a.week OR b.week = (a.week % 53) + 1 OR a.week = (b.week % 53) + 1) GROUP BY ALL),
factors AS (SELECT entity, origin, week, CASE WHEN widx < 53 THEN 1.0 ELSE s / avg(s) OVER (PARTITION BY entity, origin) END AS factor FROM smo)"""


@query(sql(_FACTORS + "\nSELECT entity, origin, week, factor FROM factors", "forecasts"), "factor")
def f3_seasonal_factors(spark, d):
    """Week-of-year factors as known at each of the origins."""
    s = pa.series(spark, d)
    return ch.seasonal_factors(s, pa.origins(spark, d, s))


@query(sql(_FACTORS + """\nSELECT 'seasonal' AS channel, o.entity, o.origin, st.step, greatest(round(CASE WHEN a.factor > 0 THEN y0 * (b.factor / a.factor) ELSE y0 END, 2), 0.0) AS yhat FROM chosen o CROSS JOIN st
  JOIN factors a ON a.entity = o.entity AND a.origin = o.origin AND a.week = weekofyear(o.origin) JOIN factors b ON b.entity = o.entity AND b.origin = o.origin AND b.week = (weekofyear(o.origin) - 1 + st.step) % 53 + 1""", "forecasts"), "yhat")  # fmt: skip
def f4_seasonal(spark, d):
    """Seasonally adjusted naive forecast."""
    s = pa.series(spark, d)
    return ch.seasonal(s, pa.origins(spark, d, s))


def _doubles(values) -> str:
    return "unnest([" + ", ".join(map(str, values)) + "]::DOUBLE[])"


def _trends(lists: str, damped: dict[str, bool], name: str = "") -> str:
    """tfit, its name after `name` (channel, entity, origin, l, b, p): the best grid point of each list of values, by the recursion from the first value on."""
    grids = " UNION ALL ".join(f"SELECT '{c}' AS channel, a, b, p FROM (SELECT {_doubles(ch.ALPHAS)} AS a), (SELECT {_doubles(ch.BETAS)} AS b), (SELECT {_doubles(ch.PHIS if d else (1.0,))} AS p)" for c, d in damped.items())
    error = "(y - s.l - p * s.b)"
    state = f"{{'l': s.l + p * s.b + a * {error}, 'b': p * s.b + a * b * {error}, 'e': s.e + {error} * {error}}}"
    return f""", {name}tgrid AS ({grids}),
{name}truns AS (SELECT channel, entity, origin, a, b, p, list_reduce(ys[2:], lambda s, y: {state}, {{'l': ys[1], 'b': coalesce(ys[2] - ys[1], 0.0), 'e': CAST(0 AS DOUBLE)}}) AS r FROM {lists}, {name}tgrid),
{name}tfit AS (SELECT channel, entity, origin, x.l, x.b, x.p FROM (SELECT channel, entity, origin, arg_min({{'l': r.l, 'b': r.b, 'p': p}}, {{'e': round(r.e, 9), 'a': a, 'b': b, 'p': p}}) AS x FROM {name}truns GROUP BY ALL))"""


_HIST = ", hist AS (SELECT o.entity, o.origin, h.ys FROM origins o JOIN (SELECT entity, date AS origin, list(y) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS ys FROM series) h USING (entity, origin))"
_PATH = "t.l + t.b * CASE WHEN t.p >= 1 THEN step ELSE t.p * (1 - pow(t.p, step)) / (1 - t.p) END"
#: Values divided by their week's factor as known at the origin, and the factor of a step's week.
_ADJUSTED = """, adj AS (SELECT o.entity, o.origin, list(CASE WHEN f.factor > 0 THEN s.y / f.factor ELSE s.y END ORDER BY s.widx) AS ys FROM origins o JOIN series s ON s.entity = o.entity AND s.widx <= o.widx
  JOIN factors f ON f.entity = o.entity AND f.origin = o.origin AND f.week = weekofyear(s.date) GROUP BY ALL)"""
_STEP_FACTOR = "JOIN factors f ON f.entity = t.entity AND f.origin = t.origin AND f.week = (weekofyear(t.origin) - 1 + step) % 53 + 1"


def _fitted(spark, d):
    """The series and all origins."""
    s = pa.series(spark, d)
    return s, pa.origins(spark, d, s)


@query(sql(_HIST + _trends("hist", {"holt": False}) + f" SELECT channel, entity, origin, step, greatest({_PATH}, 0.0) AS yhat FROM tfit t, st", "forecasts"), "yhat")
def f5_holt(spark, d):
    """Linear trend by parameter grid."""
    return ch.holt(*_fitted(spark, d))


@query(sql(_HIST + _trends("hist", {"holt_damped": True}) + f" SELECT channel, entity, origin, step, greatest({_PATH}, 0.0) AS yhat FROM tfit t, st", "forecasts"), "yhat")
def f6_holt_damped(spark, d):
    """Damped trend by parameter grid."""
    return ch.holt(*_fitted(spark, d), damped=True)


_F7 = sql(_FACTORS + _ADJUSTED + _trends("adj", {"fa_ets": False, "fa_ets_d": True}) + f" SELECT channel, t.entity, t.origin, step, greatest(({_PATH}) * f.factor, 0.0) AS yhat FROM tfit t CROSS JOIN st {_STEP_FACTOR}", "forecasts")


@query(_F7, "yhat")
def f7_adjusted_trend(spark, d):
    """Factor-adjusted smoothing, undamped and damped."""
    s, o = _fitted(spark, d)
    states = settled(ch.seasonal_states(s, o, kinds=("fa_ets", "fa_ets_d")), "seasonal-states")
    return ch.adjusted_trend(s, o, damped=False, states=states).unionByName(ch.adjusted_trend(s, o, states=states))


@query(_F7.replace("c_mktsegment AS entity", "CAST(c_nationkey AS VARCHAR) AS entity"), "yhat")
def f7_adjusted_trend_nations(spark, d):
    """The same over the panel of the customers' nations."""
    filled, _ = jo.ffill_log(pa.weekly(spark, d, "c_nationkey"))
    s = settled(wi.with_row_index(filled.where("y IS NOT NULL")), "series")
    o = pa.origins(spark, d, s)
    states = settled(ch.seasonal_states(s, o, kinds=("fa_ets", "fa_ets_d")), "seasonal-states")
    return ch.adjusted_trend(s, o, damped=False, states=states).unionByName(ch.adjusted_trend(s, o, states=states))


@query(sql(_FACTORS + _ADJUSTED + f""", aruns AS (SELECT entity, origin, a, len(ys) AS n, 12 * list_sum(list_transform(ys, lambda y, i: (i - (len(ys) + 1) / 2.0) * y)) / nullif(len(ys) * (CAST(len(ys) AS DOUBLE) * len(ys) - 1), 0) AS slope,
  list_reduce(ys[2:], lambda s, y: {{'l': s.l + a * (y - s.l), 'e': s.e + (y - s.l) * (y - s.l)}}, {{'l': ys[1], 'e': CAST(0 AS DOUBLE)}}) AS r FROM adj, (SELECT {_doubles(ch.ALPHAS)} AS a)),
afit AS (SELECT entity, origin, any_value(n) AS n, any_value(slope) AS slope, arg_min({{'l': r.l, 'a': a}}, {{'e': round(r.e, 9), 'a': a}}) AS x FROM aruns GROUP BY ALL)
SELECT 'fa_theta' AS channel, t.entity, t.origin, step, greatest((t.x.l + coalesce(slope, 0.0) / 2 * (step - 1 + (1 - pow(1 - t.x.a, n)) / t.x.a)) * f.factor, 0.0) AS yhat FROM afit t CROSS JOIN st {_STEP_FACTOR}""", "forecasts"), "yhat")
def f8_adjusted_theta(spark, d):
    """Factor-adjusted Theta."""
    return ch.adjusted_theta(*_fitted(spark, d))


_MOD = """, z AS (SELECT a.entity, a.date, a.y, (a.y - lag(a.y) OVER (PARTITION BY a.entity ORDER BY a.date)) / nullif(lag(a.y) OVER (PARTITION BY a.entity ORDER BY a.date), 0) AS z, b.qty / 1000 AS x FROM aligned a LEFT JOIN aligned b ON b.entity = a.entity AND b.date = a.date - 42),
fit AS (SELECT o.entity, o.origin, count(*) AS n, avg(x) AS mx, avg(z) AS mz, covar_pop(x, z) * count(*) / (var_pop(x) * count(*) + 1.0) AS b FROM origins o JOIN z ON z.entity = o.entity AND z.date <= o.origin WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)"""


@query(sql(_MOD + "\nSELECT f.entity, f.origin, z.y AS y0, f.mz + f.b * (z.x - f.mx) AS modifier FROM fit f JOIN z ON z.entity = f.entity AND z.date = f.origin WHERE z.x IS NOT NULL", "aligned", "folds", "origins"), "y0 modifier")
def f9_exogenous_modifier(spark, d):
    """Ridge of the weekly change on one lagged factor."""
    a = pa.aligned(spark, d, ["qty"]).withColumn("qty", F.col("qty") / 1000)
    return ch.exogenous_modifier(a, pa.origins(spark, d, a), {"qty": 6})


@query()
def f9_exogenous_modifier_all(spark, d):
    """Ridge of the weekly change on all lagged factors."""
    a = pa.aligned(spark, d).withColumn("qty", F.col("qty") / 1000)
    return ch.exogenous_modifier(a, pa.origins(spark, d), {"disc": 6, "tax": 10, "qty": 5})


@query(sql(_MOD + "\nSELECT 'macro' AS channel, f.entity, f.origin, step, greatest(round(z.y * (1 + f.mz + f.b * (z.x - f.mx)), 2), 0.0) AS yhat FROM fit f JOIN z ON z.entity = f.entity AND z.date = f.origin CROSS JOIN st WHERE z.x IS NOT NULL", "aligned", "folds", "origins", "forecasts"), "yhat")
def f10_anchored(spark, d):
    """The modifier applied to the level."""
    return ch.anchored(f9_exogenous_modifier(spark, d))


@query(sql(""", z AS (SELECT a.entity, a.date, a.y, (lead(a.y, 4) OVER (PARTITION BY a.entity ORDER BY a.date) - a.y) / nullif(a.y, 0) AS z, b.qty / 1000 AS x FROM aligned a LEFT JOIN aligned b ON b.entity = a.entity AND b.date = a.date - 42),
fit AS (SELECT o.entity, o.origin, count(*) AS n, avg(x) AS mx, avg(z) AS mz, covar_pop(x, z) * count(*) / (var_pop(x) * count(*) + 1.0) AS b FROM origins o JOIN z ON z.entity = o.entity AND z.date + 28 <= o.origin WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY ALL HAVING count(*) >= 15)
SELECT f.entity, f.origin, z.y AS y0, f.mz + f.b * (z.x - f.mx) AS modifier FROM fit f JOIN z ON z.entity = f.entity AND z.date = f.origin WHERE z.x IS NOT NULL""", "aligned", "folds", "origins"), "y0 modifier")  # fmt: skip
def f11_horizon_ridge(spark, d):
    """Ridge of the four-week change, on rows known by the origin."""
    a = pa.aligned(spark, d).withColumn("qty", F.col("qty") / 1000)
    return ch.exogenous_modifier(a, pa.origins(spark, d), {"qty": 6}, least=15, ahead=4)


@query(sql(""", stat AS (SELECT c_mktsegment AS entity, CAST(count(*) AS DOUBLE) AS n_customers FROM customer GROUP BY 1),
lv AS (SELECT o.entity, o.origin, l.level, n_customers AS x FROM origins o JOIN lvl l USING (entity, origin) JOIN stat USING (entity)),
g AS (SELECT a.entity, a.origin, any_value(a.x) AS x0, avg(b.x) AS mx, stddev_pop(b.x) AS sx, avg(b.level) AS ml, covar_pop(b.x, b.level) AS c, count(*) AS n FROM lv a JOIN lv b ON b.origin = a.origin AND b.entity <> a.entity GROUP BY ALL HAVING count(*) >= 3)
SELECT entity, origin, ml + CASE WHEN sx > 0 THEN (n * c / sx) / (n + 1.0) * (x0 - mx) / sx ELSE 0 END AS level FROM g""", "forecasts"), "level")  # fmt: skip
def f12_structural_level(spark, d):
    """Levels predicted from a static attribute, each entity left out of its own fit."""
    s = pa.series(spark, d)
    return ch.structural_level(s, pa.origins(spark, d, s), pa.statics(spark, d), ["n_customers"], leave_out=True)


@query(sql("SELECT 'reversion' AS channel, entity, origin, h, step, greatest(round(y0 + 0.291 * pow(step / h, 2) * (40.0 - y0), 2), 0.0) AS yhat FROM origins, hs, st WHERE step <= h", "forecasts"), "yhat")
def f13_reversion(spark, d):
    """Reversion to a given level."""
    s = pa.series(spark, d)
    o = pa.origins(spark, d, s)
    return ch.reversion(s, o, o.select("entity", "origin", F.lit(40.0).alias("level")), pa.HORIZONS, 0.291)


@query(sql("SELECT channel, entity, origin, h, step, yhat FROM forecasts WHERE channel = 'histmean'", "forecasts"), "yhat")
def f14_historical_mean(spark, d):
    """Reversion to the entity's own mean."""
    s = pa.series(spark, d)
    return ch.historical_mean(s, pa.origins(spark, d, s), pa.HORIZONS, 0.317)


_LIVE = f"""(SELECT o.entity, o.origin, o.y0, a.x.i AS impact, a.x.c AS confidence, (o.origin - a.event_week) / 7.0 AS age FROM origins o ASOF LEFT JOIN (WITH {_ONE} SELECT * FROM one) a ON a.entity = o.entity AND o.origin >= a.event_week)"""


@query(sql(f"SELECT 'event' AS channel, entity, origin, step, y0 AS yhat, coalesce(CASE WHEN age <= 8 THEN confidence END, 0.0) AS confidence FROM {_LIVE}, st", "forecasts", "events"), "yhat confidence")
def f15_event_flat(spark, d):
    """The last value, with the live event's confidence."""
    s = pa.series(spark, d)
    return ch.event_flat(s, pa.origins(spark, d, s), pa.event_weeks(spark, d))


@query(sql(f"""SELECT scale, "window", 'event_scaled' AS channel, entity, origin, step, y0 * CASE WHEN age <= "window" THEN 1 + impact * scale ELSE 1 END AS yhat FROM {_LIVE}, st, (SELECT CAST(unnest([0.0, 0.05, 0.1]) AS DOUBLE) AS scale), (SELECT CAST(unnest([4, 8]) AS DOUBLE) AS "window")""", "forecasts", "events"), "yhat")
def f16_event_scaled(spark, d):
    """The event channel over a grid of scales and windows."""
    s = pa.series(spark, d)
    return ch.event_scaled(s, pa.origins(spark, d, s), pa.event_weeks(spark, d), bt.literal_grid(spark, scale=[0.0, 0.05, 0.1], window=[4, 8]))


@query(sql(""", p AS (SELECT entity, date, y, ln(y / qty) AS x1, tax AS x2 FROM aligned WHERE y > 0 AND qty > 0 AND tax IS NOT NULL),
lng AS (SELECT entity, date, y, x1, x2, st.step, ln(lead(y, 1) OVER w1 / y) AS z1, ln(lead(y, 2) OVER w1 / y) AS z2, lead(date, 1) OVER w1 AS k1, lead(date, 2) OVER w1 AS k2 FROM p, (SELECT CAST(unnest([1, 2]) AS INT) AS step) st WINDOW w1 AS (PARTITION BY entity, st.step ORDER BY date)),
rw AS (SELECT entity, date, step, x1, x2, CASE step WHEN 1 THEN z1 ELSE z2 END AS z, CASE step WHEN 1 THEN k1 ELSE k2 END AS known FROM lng),
fit AS (SELECT o.origin, r.step, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(z) AS mz, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, z) AS s1z, covar_pop(x2, z) AS s2z FROM (SELECT DISTINCT origin FROM origins) o JOIN rw r ON r.known <= o.origin WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)
SELECT 'flow' AS channel, p.entity, f.origin, f.step, p.y * exp(mz + (s1z * s22 - s2z * s12) / (s11 * s22 - s12 * s12) * (x1 - m1) + (s2z * s11 - s1z * s12) / (s11 * s22 - s12 * s12) * (x2 - m2)) AS yhat FROM fit f JOIN p ON p.date = f.origin JOIN origins o ON o.origin = f.origin AND o.entity = p.entity""", "aligned", "folds", "origins"))  # fmt: skip
def f17_flow_regression(spark, d):
    """Pooled direct regression on a log ratio and a share; four decimals."""
    a = pa.aligned(spark, d, ["tax", "qty"])
    return ch.flow_regression(a, pa.origins(spark, d, a), "y", "qty", "tax", 2)


ORACLES["f17_flow_regression"] = "SELECT channel, entity, origin, step, round(yhat + 1.23e-06, 4) AS yhat FROM (" + ORACLES["f17_flow_regression"] + ")"
_flow = QUERIES["f17_flow_regression"]
QUERIES["f17_flow_regression"] = lambda spark, d: _flow(spark, d).withColumn("yhat", F.round(F.col("yhat") + 1.23e-06, 4))


@query(sql("SELECT 'naive' AS channel, o.entity, o.origin, step, s.y AS yhat FROM origins o JOIN series s ON s.entity = o.entity AND s.widx = o.widx - 2, st", "forecasts"), "yhat")
def f18_publication_lagged(spark, d):
    """The naive channel with data two rows late."""
    s = pa.series(spark, d)
    return ch.publication_lagged(ch.naive, s, pa.origins(spark, d, s), 2)


#: The fitted channels in the place of the base ones: the tables behind them (cells, losses, val, skills) follow.
_SYSTEM = """
hs AS (SELECT CAST(unnest([4, 8, 13]) AS INT) AS h), st AS (SELECT CAST(unnest(range(1, 14)) AS INT) AS step)""" + _FACTORS + _ADJUSTED + _HIST + _trends("hist", {"holt": False}) + _trends("adj", {"fa_ets": False, "fa_ets_d": True}, "a") + _MOD.replace("fit AS", "mfit AS").replace(", z AS", ", mz AS").replace("JOIN z ON z.", "JOIN mz z ON z.") + f""",
flat AS (SELECT 'naive' AS channel, entity, origin, step, y0 AS yhat FROM origins, st
  UNION ALL SELECT channel, entity, origin, step, greatest({_PATH}, 0.0) FROM tfit t, st
  UNION ALL SELECT channel, t.entity, t.origin, step, greatest(({_PATH}) * f.factor, 0.0) FROM atfit t CROSS JOIN st {_STEP_FACTOR}
  UNION ALL SELECT 'seasonal', o.entity, o.origin, st.step, greatest(round(CASE WHEN a.factor > 0 THEN y0 * (b.factor / a.factor) ELSE y0 END, 2), 0.0) FROM origins o CROSS JOIN st
    JOIN factors a ON a.entity = o.entity AND a.origin = o.origin AND a.week = weekofyear(o.origin) JOIN factors b ON b.entity = o.entity AND b.origin = o.origin AND b.week = (weekofyear(o.origin) - 1 + st.step) % 53 + 1
  UNION ALL SELECT 'macro', f.entity, f.origin, step, greatest(round(z.y * (1 + f.mz + f.b * (z.x - f.mx)), 2), 0.0) FROM mfit f JOIN mz z ON z.entity = f.entity AND z.date = f.origin CROSS JOIN st WHERE z.x IS NOT NULL),
forecasts AS (SELECT channel, entity, origin, h, step, yhat FROM flat, hs WHERE step <= h)"""


@query(sql("SELECT fold, h, CASE WHEN avg(mape) FILTER (channel = 'fa_ets_d') < avg(mape) FILTER (channel = 'fa_ets') THEN 'fa_ets_d' ELSE 'fa_ets' END AS channel FROM val GROUP BY 1, 2", "val", forecasts=_SYSTEM))
def f19_choose_damping(spark, d):
    """Undamped or damped smoothing, per fold and horizon, by validation loss."""
    return ch.choose_damping(_base(spark, d, True)[2], "fa_ets", "fa_ets_d")


@query(sql("SELECT 'blend' AS channel, entity, origin, h, step, avg(yhat) AS yhat FROM forecasts GROUP BY ALL", "forecasts"), "yhat")
def f20_blend(spark, d):
    """Equal-weight blend."""
    return ch.blend(pa.forecasts(spark, d))


@query(sql("SELECT channel, f.entity, f.origin, f.h, step, yhat * (1 + 0.5 * coalesce(t, 0.0) * step / f.h) AS yhat FROM forecasts f LEFT JOIN (SELECT entity, date AS origin, (y - lag(y, 3) OVER (PARTITION BY entity ORDER BY date)) / nullif(lag(y, 3) OVER (PARTITION BY entity ORDER BY date), 0) AS t FROM series) USING (entity, origin)", "forecasts"), "yhat")
def f21_with_spillover(spark, d):
    """A forecast tilted by a trend signal."""
    s = pa.series(spark, d)
    signals = wi.lagged_move(s, 0).select("entity", F.col("date").alias("origin"), F.col("recent").alias("trend"))
    return ch.with_spillover(pa.forecasts(spark, d, s), signals, F.col("h"), 0.5).select("channel", "entity", "origin", "h", "step", "yhat")


@query(sql(_HIST + _trends("hist", {"holt": False}) + """ SELECT entity, count(*) AS n, CAST(sum(CASE WHEN sign(b) * sign(move) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_disagree
  FROM tfit JOIN (SELECT entity, date AS origin, lead(y, 13) OVER (PARTITION BY entity ORDER BY date) - y AS move FROM series) USING (entity, origin) WHERE move IS NOT NULL GROUP BY 1""", "forecasts"))
def f22_slope_disagreement(spark, d):
    """Origins whose fitted trend and realised move disagree."""
    return ch.slope_disagreement(*_fitted(spark, d))


# Losses


@query(sql("SELECT entity, origin, h, channel, mape, rmse, mae FROM losses", "losses"), "mape rmse mae")
def a1_cell_losses(spark, d):
    """Percentage, squared and absolute losses of every cell (A1, A2)."""
    return pa.cell_losses(spark, d).select("entity", "origin", "h", "channel", "mape", "rmse", "mae")


@query(sql("SELECT fold, entity, h, regime, channel, avg(mape) AS mape, avg(rmse) AS rmse, count(*) AS n_origins FROM losses WHERE fold IS NOT NULL GROUP BY ALL", "losses"), "mape rmse")
def a3_regime_results(spark, d):
    """Mean losses per fold, entity, horizon and regime."""
    return lo.regime_results(pa.cell_losses(spark, d).where("fold IS NOT NULL"))


@query(sql(""", t AS (SELECT * FROM losses WHERE fold IS NOT NULL), r AS (SELECT fold, entity, h, regime, channel, avg(mape) AS mape, count(*) AS n FROM t GROUP BY ALL)
SELECT 'cells' AS mode, channel, h, avg(mape) AS mape FROM t GROUP BY ALL UNION ALL SELECT 'rows', channel, h, avg(mape) FROM r GROUP BY ALL UNION ALL SELECT 'weighted', channel, h, sum(mape * n) / sum(n) FROM r GROUP BY ALL""", "losses"), "mape")  # fmt: skip
def a4_headline(spark, d):
    """Three ways to average."""
    t = pa.cell_losses(spark, d).where("fold IS NOT NULL")
    parts = [lo.headline(t, m).select(F.lit(m).alias("mode"), "channel", "h", "mape") for m in ("cells", "rows", "weighted")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(sql(""", m AS (SELECT channel, h, entity, avg(mape) AS mape FROM losses GROUP BY ALL), s AS (SELECT m.channel, m.h, m.entity, 1 - m.mape / n.mape AS skill, round(m.mape, 9) < round(n.mape, 9) AS beats FROM m JOIN m n ON n.channel = 'naive' AND n.h = m.h AND n.entity = m.entity)
SELECT channel, h, avg(skill) AS mean_skill, stddev_samp(skill) AS sd_skill, min(skill) AS min_skill, max(skill) AS max_skill, CAST(sum(CAST(beats AS INT)) AS BIGINT) AS n_beats FROM s GROUP BY ALL""", "losses"), "mean_skill sd_skill min_skill max_skill")  # fmt: skip
def a5_skill_spread(spark, d):
    """Skill per entity and its spread."""
    return lo.skill_spread(lo.entity_skill(pa.cell_losses(spark, d)))


@query(sql(""", m AS (SELECT h, entity, avg(mape) FILTER (channel = 'snaive') AS a, avg(mape) FILTER (channel = 'naive') AS b FROM losses GROUP BY ALL)
SELECT h, count(*) FILTER (a < b) AS a_wins, count(*) FILTER (a > b) AS b_wins, count(*) FILTER (a = b) AS ties, avg(a) AS mean_a, avg(b) AS mean_b, median(a) AS median_a, median(b) AS median_b FROM m GROUP BY 1""", "losses"), "mean_a mean_b median_a median_b")  # fmt: skip
def a6_win_counts(spark, d):
    """Wins of one method over another."""
    return lo.win_counts(pa.cell_losses(spark, d), "snaive", "naive")


@query(sql(", m AS (SELECT h, entity, channel, round(avg(mape), 9) AS m FROM losses GROUP BY ALL) SELECT h, channel, count(*) AS n_best FROM (SELECT *, row_number() OVER (PARTITION BY h, entity ORDER BY m, channel) AS r FROM m) WHERE r = 1 GROUP BY ALL", "losses"))
def a7_best_of(spark, d):
    """How often each method is the best."""
    return lo.best_of(pa.cell_losses(spark, d))


_SKC = ", c AS (SELECT l.*, n.mape AS ref FROM losses l JOIN losses n ON n.channel = 'naive' AND n.entity = l.entity AND n.origin = l.origin AND n.h = l.h)"


@query(sql(_SKC + " SELECT h, regime, channel, coalesce(median(CASE WHEN ref > 0 THEN 1 - mape / ref END), -1.0) AS skill, count(CASE WHEN ref > 0 THEN 1 END) AS n FROM c GROUP BY ALL", "losses"), "skill")
def a8_median_skill(spark, d):
    """Median skill per point."""
    return lo.median_skill(pa.cell_losses(spark, d), ["h", "regime"])


@query(sql(_SKC + " SELECT h, channel, 1 - avg(mape) / avg(ref) AS skill FROM c GROUP BY ALL", "losses"), "skill")
def a9_pooled_skill(spark, d):
    """Pooled skill."""
    return lo.pooled_skill(pa.cell_losses(spark, d), ["h"])


@query(sql(_SKC + """, w AS (SELECT h, channel, entity, origin, round(1 - mape / ref, 9) AS s, pow(0.5, (DATE '2001-01-01' - origin) / 7 / 26.0) AS w FROM c WHERE ref > 0)
SELECT h, channel, min(s) AS skill FROM (SELECT *, sum(w) OVER (PARTITION BY h, channel ORDER BY s, entity, origin ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY h, channel) AS p FROM w) WHERE p >= 0.5 - 1e-12 GROUP BY ALL""", "losses"), "skill")  # fmt: skip
def a10_recency_skill(spark, d):
    """Recency-weighted median skill."""
    return lo.recency_skill(pa.cell_losses(spark, d), ["h"], "2001-01-01")


@query(sql(", m AS (SELECT channel, h, entity, avg(mae) AS m FROM losses GROUP BY ALL) SELECT m.channel, m.h, exp(avg(ln(m.m / n.m))) AS rel_mae FROM m JOIN m n ON n.channel = 'naive' AND n.h = m.h AND n.entity = m.entity GROUP BY ALL", "losses"), "rel_mae")
def a11_relative_mae(spark, d):
    """Geometric mean of relative errors."""
    return lo.relative_mae(pa.cell_losses(spark, d))


@query(sql("SELECT channel, h, origin, avg(mape) AS mape, count(DISTINCT entity) AS n, count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM losses) AS complete FROM losses GROUP BY ALL", "losses"), "mape")
def a12_weekly_means(spark, d):
    """Weekly cross-section means."""
    return lo.weekly_means(pa.cell_losses(spark, d))


@query(sql("SELECT channel, h, (entity, origin) IN (SELECT DISTINCT (entity, week) FROM evw) AS flag, avg(mape) AS mape, count(*) AS n FROM losses GROUP BY ALL", "losses", "events"), "mape")
def a13_by_flag(spark, d):
    """Losses in event weeks and in others."""
    return lo.by_flag(pa.cell_losses(spark, d), pa.event_weeks(spark, d).select("entity", F.col("week").alias("origin")))


@query(sql("SELECT fold, regime, h, count(DISTINCT origin) AS weeks FROM val GROUP BY ALL", "val"))
def a14_support(spark, d):
    """Distinct weeks per fold, regime and horizon."""
    return lo.support(fu.validation(pa.cell_losses(spark, d), pa.folds(spark)))


@query(sql("SELECT coalesce(CAST(fold AS VARCHAR), 'all') AS fold, coalesce(regime, 'all') AS regime, count(*) AS n FROM losses WHERE fold IS NOT NULL GROUP BY CUBE (fold, regime)", "losses"))
def a15_crosstab(spark, d):
    """Fold by regime with margins."""
    return lo.crosstab(pa.cell_losses(spark, d).where("fold IS NOT NULL"), "fold", "regime")


@query(sql("SELECT channel, avg(mape) FILTER (h = 4) AS h4, avg(mape) FILTER (h = 8) AS h8, avg(mape) FILTER (h = 13) AS h13 FROM losses GROUP BY 1", "losses"), "h4 h8 h13")
def a15_pivoted(spark, d):
    """Method by horizon."""
    return lo.pivoted(pa.cell_losses(spark, d), pa.HORIZONS)


@query(sql("SELECT fold, h, count(*) AS n_cells, count(*) FILTER (last >= DATE '2001-01-01') AS n_reserved FROM (SELECT f.fold, entity, origin, h, max(target_date) AS last FROM cells JOIN folds f ON origin BETWEEN test_start AND test_end GROUP BY ALL) GROUP BY ALL", "cells"))
def a19_cell_counts(spark, d):
    """Cells per fold and horizon, and those that reach the reserved window."""
    return lo.cell_counts(jo.fold_of(pa.cells(spark, d), pa.folds(spark)).where("fold IS NOT NULL"), pa.RESERVED)


@query(sql(", m AS (SELECT channel, h, (origin - DATE '1970-01-01') // 7 % 3 AS run, avg(mape) / 100 AS m FROM losses GROUP BY ALL) SELECT channel, h, avg(m) AS mean, stddev_pop(m) AS sd, count(*) AS n_runs FROM m GROUP BY ALL", "losses"), "mean sd")
def a20_repeated_runs(spark, d):
    """Mean and deviation over runs."""
    return lo.repeated_runs(pa.runs(spark, d))


@query(sql(_SKC + f", v AS (SELECT c.h, CASE WHEN ref > 0 THEN 1 - mape / ref END AS s, coalesce(CASE WHEN e.age <= 8 THEN e.confidence END, 0.0) AS conf FROM c JOIN {_LIVE} e USING (entity, origin) WHERE c.channel = 'snaive') SELECT h, avg(s) FILTER (conf > 0) AS skill_active, avg(s) FILTER (conf <= 0) AS skill_quiet, corr(conf, s) AS corr, count(*) FILTER (conf > 0) AS n_active FROM v GROUP BY 1", "losses", "events"), "skill_active skill_quiet corr")
def a21_skill_by_flag(spark, d):
    """Skill with and without a live event."""
    s = pa.series(spark, d)
    conf = ch.event_flat(s, pa.origins(spark, d, s), pa.event_weeks(spark, d)).where("step = 1").select("entity", "origin", "confidence")
    return lo.skill_by_flag(pa.cell_losses(spark, d), conf, "snaive")


@query(sql("SELECT fold, l.h, (sum(mape) FILTER (channel = 'naive') - sum(mape) FILTER (channel = 'snaive')) / any_value(n) AS effect FROM losses l JOIN (SELECT h, count(*) AS n FROM losses WHERE channel = 'naive' AND fold IS NOT NULL GROUP BY 1) k ON k.h = l.h WHERE fold IS NOT NULL GROUP BY ALL", "losses"), "effect")
def a22_router_effect(spark, d):
    """What one mode saves against another, by fold."""
    t = pa.cell_losses(spark, d).where("fold IS NOT NULL AND channel IN ('naive', 'snaive')")
    return lo.router_effect(t.withColumn("mode", F.when(F.col("channel") == "naive", "fold").otherwise("adaptive")))


@query(sql("SELECT channel, h, avg(mape) AS with_reserved, avg(mape) FILTER (origin + 7 * h < DATE '2001-01-01') AS without_reserved FROM losses WHERE fold IS NOT NULL GROUP BY ALL", "losses"), "with_reserved without_reserved")
def a23_headline_with_reserved(spark, d):
    """Headlines with and without cells that reach the reserved window."""
    t = pa.cell_losses(spark, d).where("fold IS NOT NULL")
    return lo.headline_with_reserved(t.withColumn("bleed", F.expr("date_add(origin, 7 * h)") >= F.lit(pa.RESERVED).cast("date")))


# Weights and fusion


def _base(spark, d, system=False):
    """(steps, losses, validation losses, folds); steps and losses are written once, as much reads them."""
    steps = settled(pa.cells(spark, d, system), "cells")
    losses = settled(pa.cell_losses(spark, d, steps), "losses")
    f = pa.folds(spark)
    return steps, losses, fu.validation(losses, f), f


def _val_steps(steps, f):
    return gu.in_validation(steps, f)


def _test_steps(steps, f):
    return jo.fold_of(steps, f).where("fold IS NOT NULL")


_ERR = ", e AS (SELECT fold, channel, avg(mape) AS mape FROM val GROUP BY ALL)"


@query(sql(_ERR + " SELECT fold, channel, (1 / greatest(mape, 1e-6)) / sum(1 / greatest(mape, 1e-6)) OVER (PARTITION BY fold) AS w FROM e", "val"), "w")
def g1_inverse_loss(spark, d):
    """Inverse-loss weights."""
    val = _base(spark, d)[2]
    return fu.inverse_loss(val.groupBy("fold", "channel").agg(F.avg("mape").alias("mape")), ["fold"]).select("fold", "channel", "w")


@query(sql("SELECT fold, channel, pow(greatest(skill, 0.001), 2) / sum(pow(greatest(skill, 0.001), 2)) OVER (PARTITION BY fold) AS w FROM fsk", "skills"), "w")
def g2_floored_skill(spark, d):
    """Floored-skill weights."""
    return fu.floored_skill(lo.median_skill(_base(spark, d)[2], ["fold"]), ["fold"], 2.0).select("fold", "channel", "w")


@query(sql("SELECT fold, channel, skill, w FROM fw", "skills"), "skill w")
def g6_fold_weights(spark, d):
    """Softmax fold weights from validation skill (G3, G6)."""
    return fu.fold_weights(_base(spark, d)[2]).select("fold", "channel", "skill", "w")


_FUSED = ", ts AS (SELECT f.fold, c.*, w.w FROM cells c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end JOIN fw w ON w.fold = f.fold AND w.channel = c.channel)"


@query(sql(_FUSED + " SELECT fold, entity, origin, h, step, greatest(round(sum(w * yhat), 2), 0.0) AS yhat FROM ts GROUP BY ALL", "skills"), "yhat")
def g4_fuse(spark, d):
    """Weighted fusion of the test cells, two decimals."""
    steps, _, val, f = _base(spark, d)
    return fu.fuse(fu.weigh(_test_steps(steps, f), "fold", fu.fold_weights(val)), ["fold", "entity", "origin", "h", "step"])


@query(sql(_FUSED + " SELECT fold, entity, origin, h, step, sum(w * yhat) / sum(w) AS yhat FROM ts WHERE channel <> 'snaive' GROUP BY ALL", "skills"), "yhat")
def g5_fuse_present(spark, d):
    """Fusion renormalised without one channel."""
    steps, _, val, f = _base(spark, d)
    return fu.fuse_present(fu.weigh(_test_steps(steps, f), "fold", fu.fold_weights(val)), ["snaive"], ["fold", "entity", "origin", "h", "step"])


_GRID = """, rsk AS (SELECT fold, regime, h, channel, coalesce(median(s), -1) AS skill, count(s) AS n FROM sk GROUP BY ALL),
grid AS (SELECT f.fold, r.regime, hs.h, c.channel, coalesce(k.skill, -1.0) AS skill, coalesce(k.n, 0) AS n FROM folds f CROSS JOIN (SELECT unnest(['hiking', 'cutting', 'stable']) AS regime) r CROSS JOIN hs CROSS JOIN (SELECT DISTINCT channel FROM val) c
  LEFT JOIN rsk k ON k.fold = f.fold AND k.regime = r.regime AND k.h = hs.h AND k.channel = c.channel),
gw AS (SELECT *, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY fold, regime, h) AS w FROM grid)"""


@query(sql(_GRID + " SELECT fold, regime, h, channel, skill, n, w FROM gw", "skills"), "skill w")
def g7_regime_weights(spark, d):
    """The grid of weights by regime and horizon."""
    _, _, val, f = _base(spark, d)
    return fu.regime_weights(val, f, pa.REGIMES, pa.HORIZONS).select("fold", "regime", "h", "channel", "skill", "n", "w")


@query(sql(", k AS (SELECT fold, h, channel, coalesce(median(s), -1) AS skill FROM sk GROUP BY ALL) SELECT fold, h, channel, skill, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY fold, h) AS w FROM k", "skills"), "skill w")
def g8_horizon_weights(spark, d):
    """Weights by horizon only."""
    return fu.horizon_weights(_base(spark, d)[2]).select("fold", "h", "channel", "skill", "w")


@query(sql(_GRID + ", wk2 AS (SELECT fold, regime, h, count(DISTINCT origin) AS weeks FROM val GROUP BY ALL) SELECT g.fold, g.regime, g.h, g.channel, CASE WHEN coalesce(weeks, 0) >= 13 THEN g.w ELSE fw.w END AS w, CASE WHEN coalesce(weeks, 0) >= 13 THEN 'regime' ELSE 'fold' END AS source FROM gw g JOIN fw ON fw.fold = g.fold AND fw.channel = g.channel LEFT JOIN wk2 k ON k.fold = g.fold AND k.regime = g.regime AND k.h = g.h", "skills"), "w")
def g9_with_fallback(spark, d):
    """Fold weights where a regime has too few weeks."""
    _, _, val, f = _base(spark, d)
    return fu.with_fallback(fu.regime_weights(val, f, pa.REGIMES, pa.HORIZONS), fu.fold_weights(val), val).select("fold", "regime", "h", "channel", "w", "source")


def _router(spark, d):
    steps, losses, val, f = _base(spark, d)
    fold_w = fu.fold_weights(val)
    grid = fu.with_fallback(fu.regime_weights(val, f, pa.REGIMES, pa.HORIZONS), fold_w, val)
    return steps, losses, val, f, fold_w, grid


_MODES = _GRID + """, wk2 AS (SELECT fold, regime, h, count(DISTINCT origin) AS weeks FROM val GROUP BY ALL),
gf AS (SELECT g.fold, g.regime, g.h, g.channel, CASE WHEN coalesce(weeks, 0) >= 13 THEN g.w ELSE fw.w END AS w FROM gw g JOIN fw ON fw.fold = g.fold AND fw.channel = g.channel LEFT JOIN wk2 k ON k.fold = g.fold AND k.regime = g.regime AND k.h = g.h),
vs AS (SELECT f.fold, c.* FROM cells c JOIN folds f ON c.origin BETWEEN f.train_end - 728 AND f.train_end AND c.origin + 7 * c.h <= f.train_end),
vf AS (SELECT s.fold, s.regime, s.entity, s.origin, s.h, s.step, any_value(s.y) AS y, greatest(round(sum(w.w * yhat), 2), 0.0) AS a, greatest(round(sum(g.w * yhat), 2), 0.0) AS b FROM vs s JOIN fw w ON w.fold = s.fold AND w.channel = s.channel JOIN gf g ON g.fold = s.fold AND g.regime = s.regime AND g.h = s.h AND g.channel = s.channel GROUP BY ALL),
vl AS (SELECT fold, regime, entity, origin, h, 100 * avg(abs((y - a) / nullif(y, 0))) AS fm, 100 * avg(abs((y - b) / nullif(y, 0))) AS rm FROM vf GROUP BY ALL),
modes AS (SELECT fold, h, CASE WHEN round(avg(rm), 9) < round(avg(fm), 9) THEN 'regime' ELSE 'fold' END AS mode, avg(fm) AS fold_mape, avg(rm) AS regime_mape FROM vl GROUP BY ALL)"""


@query(sql(_MODES + " SELECT fold, h, mode, fold_mape, regime_mape FROM modes", "skills"), "fold_mape regime_mape")
def g10_select_modes(spark, d):
    """Fold or regime weights per fold and horizon, by validation loss."""
    steps, _, _, f, fold_w, grid = _router(spark, d)
    return fu.select_modes(_val_steps(steps, f), fold_w, grid)


@query(sql(_MODES + " SELECT fold, h, regime, CASE WHEN round(avg(rm), 9) < round(avg(fm), 9) THEN 'regime' ELSE 'fold' END AS mode, avg(fm) AS fold_mape, avg(rm) AS regime_mape FROM vl GROUP BY ALL", "skills"), "fold_mape regime_mape")
def g11_granular_modes(spark, d):
    """The same per regime."""
    steps, _, _, f, fold_w, grid = _router(spark, d)
    return fu.select_modes(_val_steps(steps, f), fold_w, grid, True).select("fold", "h", "regime", "mode", "fold_mape", "regime_mape")


_ADAPT = _MODES + """, tf AS (SELECT f.fold, c.regime, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, greatest(round(sum(CASE WHEN m.mode = 'regime' THEN g.w ELSE w.w END * yhat), 2), 0.0) AS yhat FROM cells c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end
  JOIN fw w ON w.fold = f.fold AND w.channel = c.channel JOIN gf g ON g.fold = f.fold AND g.regime = c.regime AND g.h = c.h AND g.channel = c.channel JOIN modes m ON m.fold = f.fold AND m.h = c.h GROUP BY ALL),
tl AS (SELECT fold, regime, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM tf GROUP BY ALL)"""


@query(sql(_ADAPT + " SELECT fold, entity, h, regime, avg(mape) AS mape, avg(rmse) AS rmse, count(*) AS n_origins FROM tl GROUP BY ALL", "skills"), "mape rmse")
def h3_backtest(spark, d):
    """The adaptive backtest: weights, modes, fusion and results in one plan (G12, H3)."""
    steps, losses, _, f = _base(spark, d)
    return bt.results(bt.backtest(steps, losses, f, pa.HORIZONS, pa.REGIMES))


@query(sql(", r AS (SELECT fold, h, channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM (SELECT * FROM val) v JOIN (SELECT fold, entity, origin, h, mape FROM val WHERE channel = 'histmean') n USING (fold, entity, origin, h) GROUP BY ALL) SELECT fold, h, channel, skill FROM r", "val"), "skill")
def g13_other_reference(spark, d):
    """Skill against another channel than the naive one."""
    return lo.median_skill(_base(spark, d)[2], ["fold", "h"], "histmean").select("fold", "h", "channel", "skill")


@query(sql(_GRID + ", k AS (SELECT fold, h, channel, coalesce(median(s), -1) AS all_skill FROM sk GROUP BY ALL) SELECT g.fold, g.h, g.regime, g.channel, 'down-weight ' || g.channel || ' in ' || g.regime || ' at ' || g.h || ' weeks' || CASE WHEN g.n < 30 THEN ' (n=' || g.n || ')' ELSE '' END AS rule FROM grid g JOIN k USING (fold, h, channel) WHERE g.skill < 0 AND all_skill - g.skill > 0.02 AND g.n > 0", "skills"))
def g14_gating_rules(spark, d):
    """Channels that lose in a regime."""
    _, _, val, f = _base(spark, d)
    return fu.gating_rules(fu.regime_weights(val, f, pa.REGIMES, pa.HORIZONS), lo.median_skill(val, ["fold", "h"]), 0.02)


@query(sql(_MODES + " SELECT w.fold, m.h, m.mode, string_agg(w.channel || '=' || printf('%.4f', round(w.w, 4)), ', ' ORDER BY w.channel) AS weights, CAST(0 AS BIGINT) AS n_rules, 'fold ' || w.fold || ', ' || m.h || ' weeks: ' || m.mode || ' weights' AS sentence FROM fw w JOIN modes m ON m.fold = w.fold GROUP BY w.fold, m.h, m.mode", "skills"))
def g15_report(spark, d):
    """Weights, mode and rules per fold and horizon, as a sentence."""
    steps, _, val, f, fold_w, grid = _router(spark, d)
    weights = fold_w.crossJoin(F.broadcast(pa.horizons(spark)))
    rules = fu.gating_rules(fu.regime_weights(val, f, pa.REGIMES, pa.HORIZONS), lo.median_skill(val, ["fold", "h"]), 99.0)
    return fu.report(weights, fu.select_modes(_val_steps(steps, f), fold_w, grid), rules)


@query(sql(_ERR + f""", k AS (SELECT fold, h, channel, coalesce(median(s), -1) AS skill FROM sk GROUP BY ALL), tg AS (SELECT * FROM (SELECT {_doubles([0.02, 0.05, 0.2])} AS temperature), (SELECT {_doubles([0.0, 0.5])} AS shrinkage)),
tw AS (SELECT fold, h, channel, temperature, shrinkage, (1 - shrinkage) * exp(skill / temperature) / sum(exp(skill / temperature)) OVER g + shrinkage / count(*) OVER g AS w FROM k, tg WINDOW g AS (PARTITION BY fold, h, temperature, shrinkage)),
vs AS (SELECT f.fold, c.* FROM cells c JOIN folds f ON c.origin BETWEEN f.train_end - 728 AND f.train_end AND c.origin + 7 * c.h <= f.train_end),
fz AS (SELECT fold, temperature, shrinkage, entity, origin, h, step, any_value(y) AS y, greatest(round(sum(w * yhat), 2), 0.0) AS yhat FROM vs JOIN tw USING (fold, h, channel) GROUP BY ALL),
lz AS (SELECT fold, temperature, shrinkage, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM fz GROUP BY ALL),
mz AS (SELECT fold, h, temperature, shrinkage, round(avg(mape), 9) AS mape FROM lz GROUP BY ALL)
SELECT fold, h, temperature, shrinkage, mape FROM (SELECT *, row_number() OVER (PARTITION BY fold, h ORDER BY mape, temperature, shrinkage) AS r FROM mz) WHERE r = 1""", "skills"), "temperature shrinkage mape")
def g16_tuned_router(spark, d):
    """Temperature and shrinkage per fold and horizon, in one plan."""
    steps, _, val, f = _base(spark, d)
    return fu.tuned_router(lo.median_skill(val, ["fold", "h"]), _val_steps(steps, f), [0.02, 0.05, 0.2], [0.0, 0.5])


@query(sql(""", vs AS (SELECT f.fold, c.* FROM cells c JOIN folds f ON c.origin BETWEEN f.train_end - 728 AND f.train_end AND c.origin + 7 * c.h <= f.train_end),
r AS (SELECT fold, entity, origin, h, step, any_value(y) AS y, max(yhat) FILTER (channel = 'naive') AS f0, max(yhat) FILTER (channel = 'snaive') AS f1, max(yhat) FILTER (channel = 'histmean') AS f2 FROM vs GROUP BY ALL),
s AS (SELECT fold, h, sum((f1/f0-1)*(f1/f0-1)) AS pp, sum((f1/f0-1)*(f2/f0-1)) AS pq, sum((f2/f0-1)*(f2/f0-1)) AS qq, sum((f1/f0-1)*(y/f0-1)) AS pz, sum((f2/f0-1)*(y/f0-1)) AS qz FROM r WHERE f0 > 0 GROUP BY ALL),
u AS (SELECT *, (pz*qq-qz*pq)/(pp*qq-pq*pq) AS u1, (qz*pp-pz*pq)/(pp*qq-pq*pq) AS u2, greatest(pz/pp, 0) AS o1, greatest(qz/qq, 0) AS o2 FROM s)
SELECT fold, h, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN o1*pz >= o2*qz THEN o1 ELSE 0 END AS b1, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN o1*pz >= o2*qz THEN 0 ELSE o2 END AS b2 FROM u""", "cells"), "b1 b2")  # fmt: skip
def g17_delta_fusion(spark, d):
    """Non-negative fusion of relative differences."""
    steps, _, _, f = _base(spark, d)
    return fu.delta_fusion(_val_steps(steps, f), "naive", "snaive", "histmean")


@query(sql("SELECT fold, h, channel, mape FROM (SELECT *, row_number() OVER (PARTITION BY fold, h ORDER BY mape, list_position(['snaive', 'naive', 'histmean'], channel)) AS r FROM (SELECT fold, h, channel, round(avg(mape), 9) AS mape FROM val GROUP BY ALL)) WHERE r = 1", "val"), "mape")
def g18_select_best(spark, d):
    """The best single channel on validation."""
    return fu.select_best(_base(spark, d)[2], ["snaive", "naive", "histmean"])


@query(sql(""", v AS (SELECT h, channel, avg(mape) AS m FROM val GROUP BY ALL), t AS (SELECT fold, h, channel, avg(mape) AS m FROM losses WHERE fold IS NOT NULL GROUP BY ALL),
a AS (SELECT v.h, v.channel, v.m < b.m AS val_win FROM v JOIN v b ON b.h = v.h AND b.channel = 'naive' WHERE v.channel <> 'naive'),
b AS (SELECT t.h, t.channel, count(*) FILTER (t.m < n.m) AS folds_better FROM t JOIN t n ON n.h = t.h AND n.fold = t.fold AND n.channel = 'naive' WHERE t.channel <> 'naive' GROUP BY ALL)
SELECT h, channel, val_win, folds_better, val_win AND folds_better >= 3 AS promoted FROM a JOIN b USING (h, channel)""", "val"))  # fmt: skip
def g19_promote(spark, d):
    """Channels that win in validation and in most test folds."""
    _, losses, val, _ = _base(spark, d)
    return fu.promote(val, losses.where("fold IS NOT NULL"), "naive", 3)


@query(sql(_FUSED + " SELECT fold, entity, origin, h, step, channel, w * yhat AS level_part, w * (yhat - y0) AS change_part FROM ts JOIN (SELECT entity, origin, y0 FROM origins) USING (entity, origin)", "skills"), "level_part change_part")
def g20_attribution(spark, d):
    """Each channel's part of the level and of the change."""
    steps, _, val, f = _base(spark, d)
    s = pa.series(spark, d)
    y0 = ch.last_value(s, pa.origins(spark, d, s))
    return fu.attribution(fu.weigh(_test_steps(steps, f), "fold", fu.fold_weights(val)), y0).select("fold", "entity", "origin", "h", "step", "channel", "level_part", "change_part")


@query(sql(_MODES + " , q AS (SELECT g.*, CASE WHEN coalesce(k.weeks, 0) >= 13 THEN 'regime' ELSE 'fold' END AS source FROM gf g LEFT JOIN wk2 k USING (fold, regime, h)), m AS (SELECT fold, regime, source, channel, avg(w) AS mean_w FROM q GROUP BY ALL) SELECT *, sum(CASE WHEN channel = 'naive' THEN mean_w ELSE 0 END) OVER (PARTITION BY fold, regime, source) AS naive_share FROM m", "skills"), "mean_w naive_share")
def g21_weight_profile(spark, d):
    """Mean weights by source, and the share of naive-like channels."""
    grid = _router(spark, d)[5]
    return fu.weight_profile(grid, ["naive"]).select("fold", "regime", "source", "channel", "mean_w", "naive_share")


@query(sql("SELECT a.fold, a.channel, abs(a.w - b.w) AS change FROM fw a JOIN fw b ON b.fold = a.fold - 1 AND b.channel = a.channel", "skills"), "change")
def g22_weight_changes(spark, d):
    """How far weights move between folds."""
    return fu.weight_changes(fu.fold_weights(_base(spark, d)[2]))


@query(sql(_MODES + """ SELECT g.fold, g.regime, g.h, max(d) AS largest_move, max(d) > 1e-9 AS moved, max(m.mode = 'regime' AND coalesce(k.weeks, 0) >= 13) AS source_flipped, max(m.mode = 'regime') AS mode_flipped
  FROM (SELECT gf.*, abs(gf.w - fw.w) AS dw FROM gf JOIN fw ON fw.fold = gf.fold AND fw.channel = gf.channel) g JOIN modes m ON m.fold = g.fold AND m.h = g.h LEFT JOIN wk2 k ON k.fold = g.fold AND k.regime = g.regime AND k.h = g.h,
  LATERAL (SELECT CASE WHEN m.mode = 'regime' THEN g.dw ELSE 0.0 END AS d) GROUP BY ALL""", "skills"), "largest_move")
def g22_config_audit(spark, d):
    """Fold against adaptive routing, cell by cell: how far weights move, whose source and whose mode flips."""
    steps, _, _, f, fold_w, grid = _router(spark, d)
    grid = settled(grid, "grid")
    modes = fu.select_modes(_val_steps(steps, f), fold_w, grid)
    return fu.config_audit(fu.in_use(fold_w, grid), fu.in_use(fold_w, grid, modes), ["fold", "regime", "h"])


_MEMBERS = """, chosen_ets AS (SELECT fold, h, CASE WHEN avg(mape) FILTER (channel = 'fa_ets_d') < avg(mape) FILTER (channel = 'fa_ets') THEN 'fa_ets_d' ELSE 'fa_ets' END AS ets FROM val GROUP BY 1, 2),
members AS (SELECT fold, h, unnest(CASE WHEN h = 4 THEN ['holt', 'seasonal', 'macro'] ELSE [ets, 'seasonal', 'macro'] END) AS channel FROM chosen_ets),
msk AS (SELECT v.fold, v.h, v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM val v JOIN members USING (fold, h, channel)
  JOIN val n ON n.channel = 'fa_ets_d' AND n.fold = v.fold AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY ALL),
mw AS (SELECT fold, h, channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY fold, h) AS w FROM msk),
mf AS (SELECT f.fold, c.regime, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, greatest(round(sum(w * yhat), 2), 0.0) AS yhat FROM cells c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end JOIN mw ON mw.fold = f.fold AND mw.h = c.h AND mw.channel = c.channel GROUP BY ALL),
ml2 AS (SELECT fold, regime, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM mf GROUP BY ALL)"""


@query(sql(_MEMBERS + " SELECT fold, entity, h, regime, avg(mape) AS mape, avg(rmse) AS rmse, count(*) AS n_origins FROM ml2 GROUP BY ALL", "val", forecasts=_SYSTEM), "mape rmse")
def g23_final_system(spark, d):
    """The assembled system: Holt, seasonal and macro at four weeks; the chosen smoothing, seasonal and macro at eight and thirteen."""
    steps, _, val, f = _base(spark, d, True)
    ets = ch.choose_damping(val, "fa_ets", "fa_ets_d").where("h > 4")
    fixed = [(4, c) for c in ("holt", "seasonal", "macro")] + [(h, c) for h in (8, 13) for c in ("seasonal", "macro")]
    members = f.select("fold").crossJoin(F.broadcast(spark.createDataFrame(fixed, "h int, channel string"))).unionByName(ets.select("fold", "h", "channel"))
    return bt.results(fu.final_system(val, _test_steps(steps, f), members, reference="fa_ets_d"))


@query(sql(_ADAPT + " SELECT fold, entity, h, regime, avg(mape) AS mape, avg(rmse) AS rmse, count(*) AS n_origins FROM tl GROUP BY ALL", "skills", forecasts=_SYSTEM), "mape rmse")
def h3_system_backtest(spark, d):
    """The adaptive backtest over the fitted channels."""
    steps, losses, _, f = _base(spark, d, True)
    return bt.results(bt.backtest(steps, losses, f, pa.HORIZONS, pa.REGIMES))


@query(sql("SELECT entity, origin, h, step, greatest(round(0.5 * sum(yhat), 2), 0.0) AS yhat FROM cells WHERE channel IN ('naive', 'snaive') GROUP BY ALL", "cells"), "yhat")
def g24_fixed_weights(spark, d):
    """Equal fixed weights on two channels."""
    return fu.fuse(fu.fixed_weights(pa.cells(spark, d), {"naive": 0.5, "snaive": 0.5}))


# Backtest


@query(sql("SELECT fold, train_start, train_end, test_start, test_end, (SELECT count(*) FROM series s WHERE s.date BETWEEN test_start AND test_end) AS n_rows FROM folds", "folds"))
def h1_fold_table(spark, d):
    """Folds, and the panel rows of their test windows."""
    n = jo.fold_of(pa.series(spark, d).withColumnRenamed("date", "origin"), pa.folds(spark)).groupBy("fold").agg(F.count("*").alias("n_rows"))
    return pa.folds(spark).join(n, "fold", "left").select("fold", "train_start", "train_end", "test_start", "test_end", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query(sql("SELECT entity, origin, widx FROM origins", "origins"))
def h2_origin_set(spark, d):
    """Origins of all validation and test windows."""
    return pa.origins(spark, d)


_ABL = _FUSED + """, vr AS (SELECT unnest(['full', 'no naive', 'no snaive', 'no histmean']) AS variant), fz AS (SELECT variant, entity, origin, h, step, any_value(y) AS y, sum(w * yhat) FILTER ('no ' || channel <> variant) / sum(w) FILTER ('no ' || channel <> variant) AS yhat FROM ts, vr GROUP BY ALL),
lz AS (SELECT variant, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM fz GROUP BY ALL), tz AS (SELECT h, variant, avg(mape) AS mape FROM lz GROUP BY ALL)"""


def _weighted(spark, d):
    steps, losses, val, f = _base(spark, d)
    return fu.weigh(_test_steps(steps, f), "fold", fu.fold_weights(val)), losses, val


@query(sql(_ABL + " SELECT t.h, t.variant, t.mape, t.mape - f.mape AS delta FROM tz t JOIN tz f ON f.h = t.h AND f.variant = 'full'", "skills"), "mape delta")
def h4_ablation(spark, d):
    """The fusion without each channel."""
    return bt.ablation(_weighted(spark, d)[0], pa.CHANNELS)


@query(sql("SELECT channel, h, avg(mape) AS mape, 'all cells' AS scope FROM losses GROUP BY ALL UNION ALL SELECT 'external', h, avg(mape) * 2, 'fold 1' FROM losses WHERE fold = 1 AND channel = 'naive' GROUP BY h", "losses"), "mape")
def h5_append_external(spark, d):
    """Rows of another system under their scope."""
    losses = pa.cell_losses(spark, d)
    ext = losses.where("fold = 1 AND channel = 'naive'").groupBy("h").agg((F.avg("mape") * 2).alias("mape")).withColumn("channel", F.lit("external"))
    return bt.append_external(lo.headline(losses), ext, "fold 1").select("channel", "h", "mape", "scope")


@query(sql(_ABL + ", mw AS (SELECT h, channel, avg(w) AS mean_weight FROM ts GROUP BY ALL), so AS (SELECT h, channel, avg(mape) AS solo_mape FROM losses WHERE fold IS NOT NULL GROUP BY ALL) SELECT t.h, substr(t.variant, 4) AS channel, t.mape - f.mape AS drop_delta, mean_weight, solo_mape FROM tz t JOIN tz f ON f.h = t.h AND f.variant = 'full' JOIN mw ON mw.h = t.h AND mw.channel = substr(t.variant, 4) JOIN so ON so.h = t.h AND so.channel = substr(t.variant, 4)", "skills"), "drop_delta mean_weight solo_mape")
def h6_contribution(spark, d):
    """What each channel is worth, alone and in the fusion."""
    w, losses, _ = _weighted(spark, d)
    return bt.contribution(bt.ablation(w, pa.CHANNELS), w, losses.where("fold IS NOT NULL"))


@query(sql(_FUSED + f""", od AS (SELECT entity, h, origin, rep, row_number() OVER (PARTITION BY entity, h, rep ORDER BY origin) AS a, row_number() OVER (PARTITION BY entity, h, rep ORDER BY {draw_sql("17", "rep", "date_diff('day', DATE '1970-01-01', origin)", "h")}, origin) AS b
  FROM (SELECT DISTINCT entity, h, origin FROM ts), (SELECT unnest(range(10)) AS rep)),
mv AS (SELECT x.entity, x.h, x.rep, x.origin, z.origin AS other FROM od x JOIN od z ON z.entity = x.entity AND z.h = x.h AND z.rep = x.rep AND z.b = x.a),
br AS (SELECT m.rep, g.shuffled, t.entity, t.origin, t.h, t.step, any_value(t.y) AS y, greatest(round(sum(t.w * CASE WHEN t.channel = g.shuffled THEN o.yhat ELSE t.yhat END), 2), 0.0) AS yhat FROM ts t JOIN mv m ON m.entity = t.entity AND m.h = t.h AND m.origin = t.origin
  CROSS JOIN (SELECT unnest(['naive', 'snaive', 'histmean']) AS shuffled) g JOIN ts o ON o.entity = t.entity AND o.origin = m.other AND o.h = t.h AND o.step = t.step AND o.channel = t.channel GROUP BY ALL),
bm AS (SELECT h, shuffled, rep, avg(mape) AS m FROM (SELECT shuffled, rep, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM br GROUP BY ALL) GROUP BY ALL),
fb AS (SELECT entity, origin, h, step, any_value(y) AS y, greatest(round(sum(w * yhat), 2), 0.0) AS yhat FROM ts GROUP BY ALL),
fm AS (SELECT h, avg(mape) AS base FROM (SELECT entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM fb GROUP BY ALL) GROUP BY 1)
SELECT h, shuffled AS channel, avg(m - base) AS mean_increase, stddev_pop(m - base) AS sd_increase FROM bm JOIN fm USING (h) GROUP BY ALL""", "skills"), "mean_increase sd_increase")
def h7_permutation_importance(spark, d):
    """Loss increase when a channel is dealt to other origins."""
    return bt.permutation_importance(_weighted(spark, d)[0], pa.CHANNELS, 10)


_SWEEP = f""", sc AS (SELECT scale, c.entity, c.origin, c.h, 100 * avg(abs((c.y - e.y0 * CASE WHEN age <= 8 THEN 1 + impact * scale ELSE 1 END) / nullif(c.y, 0))) AS mape FROM cells c JOIN {_LIVE} e USING (entity, origin), (SELECT CAST(unnest([0.0, 0.05, 0.1, 0.2]) AS DOUBLE) AS scale) WHERE c.channel = 'naive' GROUP BY ALL),
sw AS (SELECT scale, f.fold, avg(mape) AS mape, count(*) AS n FROM sc JOIN folds f ON origin BETWEEN f.train_end - 728 AND f.train_end AND origin + 7 * h <= f.train_end GROUP BY ALL)"""


def _scored(spark, d):
    s = pa.series(spark, d)
    o = pa.origins(spark, d, s)
    made = ch.event_scaled(s, o, pa.event_weeks(spark, d), bt.literal_grid(spark, scale=[0.0, 0.05, 0.1, 0.2], window=[8]))
    actual = jo.forward_actuals(s, o, pa.horizons(spark))
    return actual.join(made, ["entity", "origin", "step"])


@query(sql(_SWEEP + " SELECT scale, fold, mape, n FROM sw", "cells", "events"), "scale mape")
def h8_sweep(spark, d):
    """A parameter sweep on validation windows (H8, H11)."""
    return bt.sweep(_scored(spark, d), pa.folds(spark), "scale")


@query(sql(_SWEEP + """, dd AS (SELECT a.scale, a.mape - b.mape AS x, a.n FROM sw a JOIN sw b ON b.fold = a.fold AND b.scale = 0 WHERE a.scale <> 0), g AS (SELECT scale, count(*) FILTER (x < -0.01 AND n >= 30) AS better, count(*) FILTER (x > 0.01 AND n >= 30) AS worse, count(*) FILTER (abs(x) <= 0.01 OR n < 30) AS neutral, avg(x) AS mean_change FROM dd GROUP BY 1)
SELECT scale, better, worse, neutral, mean_change, better >= 3 AND mean_change < 0 AND row_number() OVER (ORDER BY CASE WHEN better >= 3 AND mean_change < 0 THEN round(mean_change, 9) END NULLS LAST, scale) = 1 AS approved FROM g""", "cells", "events"), "scale mean_change")  # fmt: skip
def h9_consistency(spark, d):
    """The fold-consistency gate over the sweep."""
    return bt.consistency(bt.sweep(_scored(spark, d), pa.folds(spark), "scale"), "scale", 0.0, least_folds=3)


@query(sql(_SWEEP.replace("origin BETWEEN f.train_end - 728 AND f.train_end AND origin + 7 * h <= f.train_end", "origin BETWEEN f.test_start AND f.test_end") + " SELECT scale, fold, mape, n FROM sw WHERE scale = 0.05", "cells", "events"), "scale mape")
def h10_sweep_test(spark, d):
    """The chosen value on the test windows."""
    return bt.sweep(_scored(spark, d).where("scale = 0.05"), pa.folds(spark), "scale", window="test")


@query(sql(_SWEEP + " SELECT fold, scale, round(mape, 9) AS mape FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(mape, 9), scale) AS r FROM sw) WHERE r = 1", "cells", "events"), "scale mape")
def h12_select_param(spark, d):
    """The best value per fold."""
    return bt.select_param(bt.sweep(_scored(spark, d), pa.folds(spark), "scale"), "scale")


WINDOWS = (1, 3, 5, 7)
#: Factors of every smoothing window, the seasonal forecasts with them, and the window of least validation loss in each fold.
_NESTED = _FACTORS[: _FACTORS.index("smo AS")] + f"""sm AS (SELECT CAST(unnest({list(WINDOWS)}) AS INT) AS smooth),
smo AS (SELECT sm.smooth, a.entity, a.origin, a.widx, a.week, avg(b.raw) AS s FROM sm JOIN fullw a ON true JOIN fullw b ON b.entity = a.entity AND b.origin = a.origin AND least((a.week - b.week + 53) % 53, (b.week - a.week + 53) % 53) <= sm.smooth // 2 GROUP BY ALL),
factors AS (SELECT smooth, entity, origin, week, CASE WHEN widx < 53 THEN 1.0 ELSE s / avg(s) OVER (PARTITION BY smooth, entity, origin) END AS factor FROM smo),
sfc AS (SELECT a.smooth, o.entity, o.origin, st.step, greatest(round(CASE WHEN a.factor > 0 THEN y0 * (b.factor / a.factor) ELSE y0 END, 2), 0.0) AS yhat FROM origins o CROSS JOIN st
  JOIN factors a ON a.entity = o.entity AND a.origin = o.origin AND a.week = weekofyear(o.origin) JOIN factors b ON b.smooth = a.smooth AND b.entity = o.entity AND b.origin = o.origin AND b.week = (weekofyear(o.origin) - 1 + st.step) % 53 + 1),
scl AS (SELECT f.smooth, a.entity, a.origin, a.h, a.step, a.y, f.yhat FROM act a JOIN sfc f USING (entity, origin, step) WHERE a.n = a.h),
sls AS (SELECT smooth, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM scl GROUP BY ALL),
svl AS (SELECT f.fold, s.* FROM sls s JOIN folds f ON s.origin BETWEEN f.train_end - 728 AND f.train_end AND s.origin + 7 * s.h <= f.train_end),
nst AS (SELECT fold, smooth, mape FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mape, smooth) AS r FROM (SELECT fold, smooth, round(avg(mape), 9) AS mape FROM svl GROUP BY ALL)) WHERE r = 1)"""


def _seasonal_steps(spark, d):
    """(base steps, steps of the seasonal channel with the smoothing window as a column)."""
    base = settled(pa.cells(spark, d), "cells")
    s = settled(pa.series(spark, d), "series")
    o = pa.origins(spark, d, s)
    made = ch.seasonal_windows(s, o, WINDOWS).withColumn("entity", F.struct("entity", "smooth")).drop("smooth")
    actuals = jo.forward_actuals(s, o, pa.horizons(spark)).crossJoin(F.broadcast(spark.createDataFrame([(w,) for w in WINDOWS], "smooth int")))
    steps = lo.cell_steps(actuals.withColumn("entity", F.struct("entity", "smooth")).drop("smooth"), made.crossJoin(F.broadcast(pa.horizons(spark))).where("step <= h"))
    return base, settled(steps.withColumn("smooth", F.col("entity.smooth")).withColumn("entity", F.col("entity.entity")), "seasonal-cells")


@query(sql(_NESTED + " SELECT fold, smooth, mape FROM nst", "cells"), "mape")
def h12_smoothing_window(spark, d):
    """The smoothing window of the seasonal factors, chosen in each fold on its validation window."""
    return bt.select_param(bt.sweep(_seasonal_steps(spark, d)[1], pa.folds(spark), "smooth"), "smooth")


@query(sql(_NESTED + """, own AS (SELECT v.fold, v.channel, v.entity, v.origin, v.h, v.mape FROM val v UNION ALL SELECT s.fold, 'seasonal', s.entity, s.origin, s.h, s.mape FROM svl s JOIN nst USING (fold, smooth)),
k AS (SELECT v.fold, v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM own v JOIN own n ON n.channel = 'naive' AND n.fold = v.fold AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY 1, 2),
w AS (SELECT fold, channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY fold) AS w FROM k),
tst AS (SELECT f.fold, c.channel, c.entity, c.origin, c.h, c.step, c.y, c.yhat FROM cells c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end UNION ALL SELECT f.fold, 'seasonal', c.entity, c.origin, c.h, c.step, c.y, c.yhat FROM scl c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end JOIN nst ON nst.fold = f.fold AND nst.smooth = c.smooth),
fz AS (SELECT fold, entity, origin, h, step, any_value(y) AS y, greatest(round(sum(w * yhat), 2), 0.0) AS yhat FROM tst JOIN w USING (fold, channel) GROUP BY ALL)
SELECT fold, any_value(smooth) AS smooth, h, avg(mape) AS mape, count(*) AS n FROM (SELECT fold, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM fz GROUP BY ALL) JOIN nst USING (fold) GROUP BY fold, h""".replace("any_value(smooth) AS smooth, h, avg(mape)", "any_value(smooth) AS smooth, h, avg(l.mape)").replace("GROUP BY ALL) JOIN nst USING (fold)", "GROUP BY ALL) l JOIN nst USING (fold)"), "losses", "val"), "mape")  # fmt: skip
def h12_nested_system(spark, d):
    """The fused system whose seasonal channel has the window chosen in each fold: validation losses, weights and test cells all follow it."""
    base, tried = _seasonal_steps(spark, d)
    f = pa.folds(spark)
    chosen = settled(bt.select_param(bt.sweep(tried, f, "smooth"), "smooth").select("fold", "smooth"), "chosen")
    every = base.withColumn("smooth", F.lit(None).cast("int")).unionByName(tried, allowMissingColumns=True)
    losses = settled(every.groupBy("channel", "smooth", "entity", "origin", "h").agg((F.avg(F.abs(F.try_divide(F.col("y") - F.col("yhat"), F.col("y")))) * 100).alias("mape")), "losses")
    keep = lambda rows: rows.join(F.broadcast(chosen.withColumnRenamed("smooth", "_own")), "fold").where("smooth IS NULL OR smooth = _own").drop("_own", "smooth")
    weights = fu.fold_weights(keep(fu.validation(losses, f)))
    fused = fu.fused_losses(fu.weigh(keep(_test_steps(every, f)), "fold", weights), ["fold"])
    return fused.groupBy("fold", "h").agg(F.avg("mape").alias("mape"), F.count("*").alias("n")).join(chosen, "fold").select("fold", "smooth", "h", "mape", "n")


@query(sql("SELECT variant, channel, avg(yhat) AS yhat, count(*) AS n FROM (SELECT 'base' AS variant, channel, yhat FROM cells UNION ALL SELECT 'swapped', channel, yhat FROM cells WHERE channel <> 'naive' UNION ALL SELECT 'swapped', 'naive', yhat FROM cells WHERE channel = 'histmean') GROUP BY ALL", "cells"), "yhat")
def h13_variants(spark, d):
    """Cells with one channel standing in for another."""
    v = bt.variants(pa.cells(spark, d), {"base": {}, "swapped": {"naive": "histmean"}})
    return v.groupBy("variant", "channel").agg(F.avg("yhat").alias("yhat"), F.count("*").alias("n"))


@query(sql("SELECT cut, h, channel, avg(mape) AS mape, count(*) AS n FROM (SELECT 'raw' AS cut, * FROM losses WHERE extract(day FROM origin) > 9 UNION ALL SELECT 'smooth', * FROM losses WHERE extract(day FROM origin) > 9) GROUP BY ALL", "losses"), "mape")
def h14_same_cells(spark, d):
    """Two cuts of the series over the cells that both have."""
    losses = pa.cell_losses(spark, d)
    return bt.same_cells(losses, losses.where(F.dayofmonth("origin") > 9)).groupBy("cut", "h", "channel").agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))


_CUTS = {"series": pa.SQL["series"].replace("series AS (", "one_series AS (") + """,
series AS (SELECT 'raw:' || entity AS entity, date, y, widx FROM one_series UNION ALL SELECT 'smooth:' || entity, date, avg(y) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), widx FROM one_series)"""}


@query(sql(""", c AS (SELECT split_part(entity, ':', 1) AS cut, split_part(entity, ':', 2) AS e, origin, h, channel, mape, fold FROM losses),
vv AS (SELECT split_part(entity, ':', 1) AS cut, * FROM val), k AS (SELECT v.cut, v.fold, v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM vv v JOIN vv n ON n.channel = 'naive' AND n.fold = v.fold AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY 1, 2, 3),
w AS (SELECT cut, fold, channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY cut, fold) AS w FROM k),
fz AS (SELECT w.cut, f.fold, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, greatest(round(sum(w.w * yhat), 2), 0.0) AS yhat FROM cells c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end JOIN w ON w.cut = split_part(c.entity, ':', 1) AND w.fold = f.fold AND w.channel = c.channel GROUP BY ALL),
a AS (SELECT cut, e, origin, h, channel, mape FROM c WHERE fold IS NOT NULL UNION ALL SELECT cut, split_part(entity, ':', 2), origin, h, 'fused', 100 * avg(abs((y - yhat) / nullif(y, 0))) FROM fz GROUP BY cut, entity, origin, h)
SELECT cut, h, channel, avg(mape) AS mape, count(*) AS n FROM a WHERE (e, origin, h, channel) IN (SELECT (e, origin, h, channel) FROM a WHERE cut = 'raw') AND (e, origin, h, channel) IN (SELECT (e, origin, h, channel) FROM a WHERE cut = 'smooth') GROUP BY ALL""", "losses", "val", **_CUTS), "mape")  # fmt: skip
def h14_raw_and_smoothed(spark, d):
    """Raw against smoothed series on the cells that both have: channels, weights and fusion made anew from each."""
    steps = settled(pa.cells(spark, d, s=pa.two_cuts(pa.series(spark, d))), "cells")
    f, parts = pa.folds(spark), []
    for cut in ("raw", "smooth"):
        own = steps.where(F.col("entity").startswith(f"{cut}:")).withColumn("entity", F.substring_index("entity", ":", -1))
        losses = settled(pa.cell_losses(spark, d, own), "losses")
        fused = bt.backtest(own, losses, f, pa.HORIZONS, pa.REGIMES, "fold").withColumn("channel", F.lit("fused"))
        cols = ["entity", "origin", "h", "channel", "mape"]
        parts.append(settled(losses.where("fold IS NOT NULL").select(*cols).unionByName(fused.select(*cols)), "losses"))
    return bt.same_cells(*parts).groupBy("cut", "h", "channel").agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))


@query(sql(_GRID + ", z AS (SELECT fold, regime, h FROM grid GROUP BY ALL HAVING max(n) = 0) SELECT fold, regime, h, channel AS mode, count(*) AS n_cells, avg(mape) AS mape FROM losses JOIN z USING (fold, regime, h) GROUP BY ALL", "skills"), "mape")
def h15_zero_support(spark, d):
    """Test cells whose regime had no validation data."""
    _, losses, val, f = _base(spark, d)
    return bt.zero_support(fu.regime_weights(val, f, pa.REGIMES, pa.HORIZONS), losses.where("fold IS NOT NULL").withColumn("mode", F.col("channel")))


@query(sql("SELECT h, avg(b) AS base, round(avg(f) + 1.23e-08, 6) AS full_path, avg(CASE WHEN act THEN f ELSE b END) AS gated, avg(b - f) FILTER (act) AS gain_open, avg(b - f) FILTER (NOT act) AS gain_shut, avg(CAST(act AS DOUBLE)) AS activation FROM (SELECT entity, origin, h, max(mape) FILTER (channel = 'snaive') AS f, max(mape) FILTER (channel = 'naive') AS b, (entity, origin) IN (SELECT DISTINCT (entity, week) FROM evw) AS act FROM losses GROUP BY entity, origin, h) GROUP BY 1", "losses", "events"), "base gated gain_open gain_shut activation")
def h16_gate_value(spark, d):
    """What running the full path only on event weeks gives."""
    losses = pa.cell_losses(spark, d)
    live = pa.event_weeks(spark, d).select("entity", F.col("week").alias("origin")).distinct().withColumn("activate", F.lit(True))
    cells = losses.select("entity", "origin").distinct().join(live, ["entity", "origin"], "left").withColumn("activate", F.coalesce("activate", F.lit(False)))
    return bt.gate_value(losses, cells, "snaive", "naive").withColumnRenamed("full", "full_path").withColumn("full_path", F.round(F.col("full_path") + NUDGE, 6))


@query()
def h17_placebo(spark, d):
    """Regime labels permuted in blocks 50 times, the adaptive backtest anew for each, and how often that does better."""
    steps, losses, _, f = _base(spark, d)
    labels = bt.placebo_labels(pa.regimes(spark, d).select(F.col("origin").alias("date"), "regime"), 50)
    return bt.placebo_share(bt.regime_placebo(steps, losses, f, labels, pa.HORIZONS, pa.REGIMES))


_PERIOD = """
rx AS (SELECT DISTINCT origin FROM origins), regimes AS (SELECT origin, CASE WHEN origin < DATE '1998-01-05' THEN 'stable' ELSE 'hiking' END AS regime FROM rx)"""


@query("WITH " + ",".join(pa.SQL[n] for n in ("weekly", "series", "folds", "origins")) + "," + _PERIOD + "," + ",".join(pa.SQL[n] for n in ("forecasts", "cells", "losses", "val", "skills")) + _ADAPT + " SELECT h, avg(mape) AS mape, count(*) AS n_cells FROM tl GROUP BY ALL", "mape")
def h17_period_labels(spark, d):
    """The adaptive backtest where a date, not the regime, parts the origins: what labels of two periods reach beside the placebo's."""
    steps, losses, _, f = _base(spark, d)
    steps, losses = (bt.by_period(x, "1998-01-05", "stable", "hiking") for x in (steps, losses))
    return bt.by_horizon(bt.backtest(steps, losses, f, pa.HORIZONS, pa.REGIMES))


@query(sql(""", rw AS (SELECT v.fold, v.h, v.channel, v.entity, v.origin, round(1 - v.mape / n.mape, 9) AS s, pow(0.5, (f.train_end - v.origin) / 7 / 26.0) AS w FROM val v
  JOIN val n ON n.channel = 'naive' AND n.fold = v.fold AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h JOIN folds f ON f.fold = v.fold WHERE n.mape > 0 AND v.mape IS NOT NULL),
ks AS (SELECT 'recency' AS weights, fold, h, channel, min(s) AS skill FROM (SELECT *, sum(w) OVER (PARTITION BY fold, h, channel ORDER BY s, entity, origin ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY fold, h, channel) AS p FROM rw)
  WHERE p >= 0.5 - 1e-12 GROUP BY ALL UNION ALL SELECT 'horizon', fold, h, channel, coalesce(median(s), -1) FROM sk GROUP BY fold, h, channel),
kw AS (SELECT *, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY weights, fold, h) AS w FROM ks),
kf AS (SELECT weights, f.fold, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, greatest(round(sum(k.w * yhat), 2), 0.0) AS yhat FROM cells c JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end
  JOIN kw k ON k.fold = f.fold AND k.h = c.h AND k.channel = c.channel GROUP BY ALL),
kl AS (SELECT weights, fold, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM kf GROUP BY ALL)
SELECT weights, h, avg(mape) AS mape, count(*) AS n_cells FROM kl GROUP BY ALL""", "skills"), "mape")  # fmt: skip
def h17_weights_without_labels(spark, d):
    """The backtest without regime labels: weights by horizon alone, and by recency-weighted skill."""
    steps, _, val, f = _base(spark, d)
    test, fold_w = _test_steps(steps.drop("fold"), f), fu.fold_weights(val)
    own = {"horizon": fu.horizon_weights(val), "recency": fu.recency_weights(val, f)}
    parts = [bt.by_horizon(fu.fused_losses(fu.weigh(test, "horizon", fold_w, by_h=w), ["fold", "regime"])).withColumn("weights", F.lit(name)) for name, w in own.items()]
    return parts[0].unionByName(parts[1]).select("weights", "h", "mape", "n_cells")


@query(sql(""", v AS (SELECT * FROM losses WHERE origin BETWEEN DATE '1999-01-04' - 728 AND DATE '1999-01-04' AND origin + 7 * h <= DATE '1999-01-04'),
k AS (SELECT v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM v JOIN v n ON n.channel = 'naive' AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY 1),
w AS (SELECT channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER () AS w FROM k),
fz AS (SELECT entity, origin, h, step, any_value(y) AS y, greatest(round(sum(w * yhat), 2), 0.0) AS yhat FROM cells JOIN w USING (channel) WHERE origin >= DATE '1999-01-04' + 98 GROUP BY ALL)
SELECT h, avg(mape) AS mape, count(*) AS n FROM (SELECT entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM fz GROUP BY ALL) GROUP BY 1""", "losses"), "mape")
def h18_single_split(spark, d):
    """One split only."""
    steps, losses, _, _ = _base(spark, d)
    return bt.single_split(steps, losses, "1999-01-04").groupBy("h").agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))


@query(sql(""", bad AS (SELECT DISTINCT entity, origin, h FROM cells WHERE origin BETWEEN DATE '1999-06-07' AND DATE '1999-10-04' OR target_date BETWEEN DATE '1999-06-07' AND DATE '1999-10-04'),
v AS (SELECT f.fold, l.* EXCLUDE (fold) FROM losses l ANTI JOIN bad USING (entity, origin, h) JOIN folds f ON l.origin BETWEEN f.train_end - 728 AND f.train_end AND l.origin + 7 * l.h <= f.train_end),
k AS (SELECT v.fold, v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM v JOIN v n ON n.channel = 'naive' AND n.fold = v.fold AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY 1, 2),
w AS (SELECT fold, channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY fold) AS w FROM k),
fz AS (SELECT f.fold, c.regime, c.entity, c.origin, c.h, c.step, any_value(c.y) AS y, greatest(round(sum(w.w * yhat), 2), 0.0) AS yhat FROM cells c ANTI JOIN bad USING (entity, origin, h) JOIN folds f ON c.origin BETWEEN f.test_start AND f.test_end JOIN w ON w.fold = f.fold AND w.channel = c.channel GROUP BY ALL),
lz AS (SELECT fold, regime, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM fz GROUP BY ALL)
SELECT fold, entity, h, regime, avg(mape) AS mape, avg(rmse) AS rmse, count(*) AS n_origins FROM lz GROUP BY ALL""", "losses"), "mape rmse")
def h19_backtest_excluding(spark, d):
    """The backtest without cells that touch a window."""
    steps, losses, _, f = _base(spark, d)
    return bt.results(bt.backtest(steps, losses, f, pa.HORIZONS, pa.REGIMES, "fold", ("1999-06-07", "1999-10-04")))


@query(sql(""", lf AS (SELECT lag, 'naive' AS channel, o.entity, o.origin, h, step, s.y AS yhat FROM (SELECT unnest([0, 2]) AS lag) JOIN origins o ON true JOIN series s ON s.entity = o.entity AND s.widx = o.widx - lag CROSS JOIN hs CROSS JOIN st WHERE step <= h
  UNION ALL SELECT lag, 'snaive', o.entity, o.origin, h, step, s.y FROM (SELECT unnest([0, 2]) AS lag) JOIN origins o ON true CROSS JOIN hs CROSS JOIN st JOIN series s ON s.entity = o.entity AND s.widx = o.widx + step - 52 WHERE step <= h AND o.widx > lag),
lc AS (SELECT lag, a.entity, a.origin, a.h, a.step, f.channel, a.y, f.yhat FROM act a JOIN lf f USING (entity, origin, h, step) JOIN regimes USING (origin) WHERE a.n = a.h),
ll AS (SELECT lag, entity, origin, h, channel, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM lc GROUP BY ALL),
v AS (SELECT * FROM ll WHERE origin BETWEEN DATE '2000-07-03' - 728 AND DATE '2000-07-03' AND origin + 7 * h <= DATE '2000-07-03'),
k AS (SELECT v.lag, v.channel, coalesce(median(CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END), -1) AS skill FROM v JOIN v n ON n.channel = 'naive' AND n.lag = v.lag AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h GROUP BY 1, 2),
w AS (SELECT lag, channel, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY lag) AS w FROM k),
fz AS (SELECT lag, entity, origin, h, step, any_value(y) AS y, greatest(round(sum(w * yhat), 2), 0.0) AS yhat FROM lc JOIN w USING (lag, channel) WHERE origin >= DATE '2000-07-03' + 98 GROUP BY ALL)
SELECT lag, h, avg(mape) AS mape, count(*) AS n FROM (SELECT lag, entity, origin, h, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape FROM fz GROUP BY ALL) GROUP BY ALL""", "cells"), "mape")  # fmt: skip
def h20_holdout(spark, d):
    """A fixed training end and all origins after its embargo, with data on time and two weeks late."""
    s = settled(pa.series(spark, d), "series")
    o, r = pa.origins(spark, d, s), settled(pa.regimes(spark, d), "regimes")
    actuals, hs = jo.forward_actuals(s, o, pa.horizons(spark)), F.broadcast(pa.horizons(spark))
    out = None
    for lag in (0, 2):
        made = ch.publication_lagged(ch.naive, s, o, lag).unionByName(ch.publication_lagged(ch.seasonal_naive, s, o, lag))
        steps, losses = bt.losses_with_regime(lo.cell_steps(actuals, made.crossJoin(hs).where("step <= h")), r)
        part = bt.single_split(steps, losses, "2000-07-03").groupBy("h").agg(F.avg("mape").alias("mape"), F.count("*").alias("n")).withColumn("lag", F.lit(lag))
        out = part if out is None else out.unionByName(part)
    return out.select("lag", "h", "mape", "n")


@query(sql("SELECT f.fold, s.entity, hs.h, c.channel, 100 * abs((t.y - c.yhat) / nullif(t.y, 0)) AS ape FROM folds f JOIN series s ON s.date = f.train_end CROSS JOIN hs JOIN series t ON t.entity = s.entity AND t.date = s.date + 7 * hs.h JOIN forecasts c ON c.entity = s.entity AND c.origin = s.date AND c.h = 13 AND c.step = hs.h AND c.channel = 'naive'", "forecasts"), "ape")
def h21_single_origin(spark, d):
    """Forecasts made at each training end."""
    s = pa.series(spark, d)
    return bt.single_origin(s, ch.naive(s, pa.origins(spark, d, s)), pa.folds(spark), pa.horizons(spark))


@query(sql(f"SELECT h, CASE WHEN impact > 0 THEN 'up' ELSE 'down' END AS event, count(*) AS n_cells FROM (SELECT DISTINCT entity, origin, h FROM cells) JOIN {_LIVE} e USING (entity, origin) WHERE age <= 8 AND impact <> 0 AND y0 <> 0 GROUP BY ALL", "cells", "events"))
def h22_event_provenance(spark, d):
    """Cells in which the event channel departs from the naive one, by the kind of the live event."""
    s = pa.series(spark, d)
    o = pa.origins(spark, d, s)
    weeks = pa.event_weeks(spark, d)
    made = ch.event_scaled(s, o, weeks, bt.literal_grid(spark, scale=[0.05], window=[8])).select("channel", "entity", "origin", "step", "yhat")
    actuals = jo.forward_actuals(s, o, pa.horizons(spark))
    steps = lo.cell_steps(actuals, made.unionByName(ch.naive(s, o)).crossJoin(F.broadcast(pa.horizons(spark))).where("step <= h"))
    live = jo.active_event(o.select("entity", F.col("origin").alias("week")), weeks, 8).where("live")
    return bt.event_provenance(steps, live.select("entity", F.col("week").alias("origin"), F.when(F.col("impact") > 0, "up").otherwise("down").alias("event")))


# Statistics


_WD = ", wd AS (SELECT h, origin, avg(d) AS d FROM (SELECT h, origin, entity, max(mape) FILTER (channel = 'snaive') - max(mape) FILTER (channel = 'naive') AS d FROM losses WHERE fold IS NOT NULL GROUP BY ALL) GROUP BY ALL)"
_LRV = """, r AS (SELECT h, row_number() OVER (PARTITION BY h ORDER BY origin) AS i, count(*) OVER (PARTITION BY h) AS n, avg(d) OVER (PARTITION BY h) AS m, d - avg(d) OVER (PARTITION BY h) AS e FROM wd),
lr AS (SELECT a.h, any_value(a.n) AS n, any_value(a.m) AS mean, sum(CASE WHEN a.i = b.i THEN 1.0 ELSE 2 * (1 - (a.i - b.i) / CAST(a.h AS DOUBLE)) END * a.e * b.e) / any_value(a.n) AS lrv FROM r a JOIN r b ON b.h = a.h AND a.i - b.i BETWEEN 0 AND a.h - 1 GROUP BY a.h)"""


def _tested(spark, d):
    return settled(pa.cell_losses(spark, d).where("fold IS NOT NULL"), "tested-losses")


def _weekly_d(spark, d):
    diffs = stt.paired_differences(_tested(spark, d), "snaive", "naive", ["h", "origin", "entity"])
    return settled(diffs.groupBy("h", "origin").agg(F.avg("d").alias("d")), "weekly-differences")


@query(sql(_WD + _LRV + " SELECT h, mean, n, lrv FROM lr", "losses"), "mean lrv")
def t1_long_run_variance(spark, d):
    """Newey-West variance of weekly differences."""
    return stt.long_run_variance(_weekly_d(spark, d), ["h"], "d", F.col("h") - 1)


@query(sql(_WD + _LRV + " SELECT h, n, mean, mean / sqrt(lrv / n) * sqrt((n + 1 - 2 * h + h * (h - 1) / CAST(n AS DOUBLE)) / n) AS stat FROM lr", "losses"), "mean stat")
def t2_weekly_dm(spark, d):
    """Diebold-Mariano on weekly means."""
    return stt.weekly_dm(_tested(spark, d), "snaive", "naive").select("h", "n", "mean", "stat")


@query()
def t3_entity_dm(spark, d):
    """The test per entity, after Benjamini-Hochberg."""
    return stt.entity_dm(_tested(spark, d), "snaive", "naive")


_PV = "(SELECT CAST(c_custkey AS BIGINT) AS id, c_nationkey % 5 AS g, ((c_custkey * 7919) % 9973 + 1) / 400000.0 AS p_value FROM customer)"


def _pvalues(spark, d):
    k = F.col("c_custkey").cast("bigint")
    return pa.table(spark, d, "customer").select(k.alias("id"), (F.col("c_nationkey") % 5).alias("g"), (((k * 7919) % 9973 + 1) / 400000.0).cast("double").alias("p_value"))


@query(f"SELECT id, coalesce(r <= max(CASE WHEN p_value <= 0.005 * r / m THEN r END) OVER (PARTITION BY g), false) AS reject FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p_value) AS r, count(*) OVER (PARTITION BY g) AS m FROM {_PV})")
def t4_benjamini_hochberg(spark, d):
    """The step-up procedure."""
    return stt.benjamini_hochberg(_pvalues(spark, d), ["g"], 0.005).select("id", "reject")


@query(f"SELECT id, max(least((m - r + 1) * p_value, 1.0)) OVER (PARTITION BY g ORDER BY r ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p_value) AS r, count(*) OVER (PARTITION BY g) AS m FROM {_PV})", "p_holm")
def t5_holm(spark, d):
    """Step-down adjusted values."""
    return stt.holm(_pvalues(spark, d), ["g"]).select("id", "p_holm")


_BOOT = _WD + f""", r AS (SELECT h, d, row_number() OVER (PARTITION BY h ORDER BY origin) - 1 AS i, count(*) OVER (PARTITION BY h) AS n FROM wd),
pl AS (SELECT g.h, rep, b, k, {draw_sql('5', 'rep', 'b')} % greatest(g.n - 13 + 1, 1) + k AS i FROM (SELECT h, any_value(n) AS n FROM r GROUP BY 1) g, (SELECT unnest(range(5000)) AS rep), (SELECT unnest(range(40)) AS b), (SELECT unnest(range(13)) AS k) WHERE b <= ceil(g.n / 13.0) - 1 AND b * 13 + k < g.n),
ms AS (SELECT pl.h, rep, avg(r.d) AS m FROM pl JOIN r ON r.h = pl.h AND r.i = pl.i GROUP BY ALL)"""


@query(sql(_BOOT + " SELECT h, mean, low, high FROM (SELECT h, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM ms GROUP BY 1) JOIN (SELECT h, avg(d) AS mean FROM wd GROUP BY 1) USING (h)", "losses"), "mean low high")
def t6_block_bootstrap(spark, d):
    """Moving-block intervals of the weekly difference."""
    return stt.block_bootstrap(_weekly_d(spark, d), ["h"], "d")


_IID = f""", ip AS (SELECT g.h, rep, {draw_sql('5', 'rep', 'b')} % g.n AS i FROM (SELECT h, any_value(n) AS n FROM r GROUP BY 1) g, (SELECT unnest(range(5000)) AS rep), (SELECT unnest(range(520)) AS b) WHERE b < g.n),
im AS (SELECT ip.h, rep, avg(r.d) AS m FROM ip JOIN r ON r.h = ip.h AND r.i = ip.i GROUP BY ALL)"""


@query(sql(_BOOT + _IID + """ SELECT h, low, high, iid_low, iid_high, (high - low) / nullif(iid_high - iid_low, 0) AS width_ratio FROM (SELECT h, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM ms GROUP BY 1)
  JOIN (SELECT h, quantile_cont(m, 0.025) AS iid_low, quantile_cont(m, 0.975) AS iid_high FROM im GROUP BY 1) USING (h)""", "losses"), "low high iid_low iid_high width_ratio")
def t6_blocks_against_iid(spark, d):
    """Block intervals beside those that independent weeks would give."""
    return stt.against_iid(_weekly_d(spark, d), ["h"], "d")


@query(sql(_BOOT + ", ci AS (SELECT h, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high FROM ms GROUP BY 1), ref AS (SELECT h, avg(mape) AS ref FROM losses WHERE fold IS NOT NULL AND channel = 'naive' GROUP BY 1) SELECT h, low, high, low > -0.02 * ref AND high < 0.02 * ref AS equivalent FROM ci JOIN ref USING (h)", "losses"), "low high")
def t7_equivalence(spark, d):
    """Whether the 90 % interval lies within two per cent of the reference."""
    ref = lo.headline(_tested(spark, d).where("channel = 'naive'"))
    return stt.equivalence(stt.block_bootstrap(_weekly_d(spark, d), ["h"], "d", level=0.9), ref, ["h"]).select("h", "low", "high", "equivalent")


@query()
def t8_model_confidence_set(spark, d):
    """Methods that none of the others beats."""
    return stt.model_confidence_set(lo.weekly_means(_tested(spark, d)))


@query()
def t9_pair_bundle(spark, d):
    """All statistics of all pairs of channels."""
    return stt.pair_bundle(_tested(spark, d), [("snaive", "naive"), ("histmean", "naive"), ("histmean", "snaive")])


@query(sql(", z AS (SELECT entity, date, qty, (lead(y, 4) OVER w - y) / nullif(y, 0) AS z, lag(qty, 0) OVER w AS x0, lag(qty, 4) OVER w AS x4, lag(qty, 8) OVER w AS x8 FROM aligned WINDOW w AS (PARTITION BY entity ORDER BY date)), l AS (SELECT 0 AS lag, x0 AS x, z FROM z UNION ALL SELECT 4, x4, z FROM z UNION ALL SELECT 8, x8, z FROM z), c AS (SELECT CAST(lag AS INT) AS lag, corr(x, z) AS r, count(*) AS n FROM l WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY 1) SELECT *, row_number() OVER (ORDER BY round(abs(r), 9) DESC, lag) = 1 AS best FROM c", "aligned"), "r")
def t10_lag_correlation(spark, d):
    """Correlation over lags, the best one marked."""
    a = wi.forward_change(pa.aligned(spark, d, ["qty"]), 4, "z")
    return stt.lag_correlation(a, "qty", [0, 4, 8])


def _edges(spark, d):
    s = pa.series(spark, d)
    return stt.spillover_graph(jo.ordered_pairs(s), s)


@query()
def t11_granger(spark, d):
    """Granger screen of all pairs of entities, lags 1 to 8."""
    s = pa.series(spark, d)
    return stt.granger(jo.ordered_pairs(s), s)


@query()
def t12_spillover_graph(spark, d):
    """The same on the series without common movement, with significance."""
    return _edges(spark, d)


#: Dates at which graphs are estimated: every 13 weeks.
GRAPH_DATES = [dt.date(1997, 6, 30) + dt.timedelta(weeks=13 * k) for k in range(17)]


@query()
def t11_granger_at(spark, d):
    """The screen of all pairs, lags 1 to 8, from the two years up to each of seventeen dates."""
    s = settled(pa.series(spark, d), "series")
    return sc.granger_at(jo.ordered_pairs(s), s, GRAPH_DATES)


@query()
def t12_graph_at(spark, d):
    """The graph of own movements, lags 1 to 8, as it was known at each date."""
    s = settled(pa.series(spark, d), "series")
    return sc.graph_at(jo.ordered_pairs(s), s, GRAPH_DATES)


@query()
def t13_factor_scores(spark, d):
    """Factor correlations beside their Granger tests, lags 1 to 8, both from the two years up to one date."""
    a = pa.aligned(spark, d)
    corr = wi.factor_correlation(a, ["disc", "tax", "qty"], "2000-06-05", 4)
    long = a.unpivot(["date"], ["disc", "tax", "qty"], "entity", "y").where("y IS NOT NULL").distinct()
    s = a.select("date", "entity", "y").unionByName(long.select("date", "entity", "y"))
    at = [dt.date(2000, 6, 5)]
    names = a.select("entity").distinct().crossJoin(F.broadcast(spark.createDataFrame([("disc",), ("tax",), ("qty",)], "source string"))).select("source", F.col("entity").alias("target"))
    return stt.factor_scores(corr, sc.granger_at(names, s, at))


@query()
def a16_factor_summary(spark, d):
    """Summary of the factor scores over entities."""
    return lo.factor_summary(t13_factor_scores(spark, d))


def _panel(spark, d):
    a = wi.forward_change(pa.aligned(spark, d, ["qty"]), 4, "z").withColumn("q", F.col("qty") / 1000).withColumn("x", F.col("q") * F.ascii("entity") % 7)
    return a.withColumn("period", F.concat_ws("-", F.year("date"), F.quarter("date")))


@query(sql(""", p AS (SELECT entity, z, x FROM (SELECT entity, (lead(y, 4) OVER (PARTITION BY entity ORDER BY date) - y) / nullif(y, 0) AS z, (qty / 1000 * ascii(entity)) % 7 AS x FROM aligned) WHERE z IS NOT NULL AND x IS NOT NULL),
w AS (SELECT entity, z - avg(z) OVER (PARTITION BY entity) AS z, x - avg(x) OVER (PARTITION BY entity) AS x FROM p), b AS (SELECT sum(x * z) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM w),
s AS (SELECT entity, sum((z - b * x) * x) AS s FROM w, b GROUP BY 1) SELECT 'x' AS term, b AS coef, sqrt((SELECT sum(s * s) * (count(*) / (count(*) - 1.0)) FROM s) * ((n - 1.0) / (n - 1)) ) / sxx AS se, n FROM b""", "aligned"), "coef se")  # fmt: skip
def t14_panel_regression(spark, d):
    """Entity effects, errors clustered by entity."""
    return stt.panel_regression(_panel(spark, d), "z", ["x"], effects=[["entity"]]).select("term", "coef", "se", "n")


#: The two-way fit by sweeps in turn, sixty of them, over rows.
_TWO_WAY = """, p AS (SELECT entity, date, year(date) * 10 + quarter(date) AS period, z, x FROM (SELECT entity, date, (lead(y, 4) OVER (PARTITION BY entity ORDER BY date) - y) / nullif(y, 0) AS z, (qty / 1000 * ascii(entity)) % 7 AS x FROM aligned) WHERE z IS NOT NULL AND x IS NOT NULL),
sw AS (WITH RECURSIVE r(k, entity, date, period, z, x) AS (SELECT 0, entity, date, period, z, x FROM p UNION ALL
  SELECT k + 1, entity, date, period, z - avg(z) OVER (PARTITION BY period), x - avg(x) OVER (PARTITION BY period) FROM (SELECT k, entity, date, period, z - avg(z) OVER (PARTITION BY entity) AS z, x - avg(x) OVER (PARTITION BY entity) AS x FROM r) WHERE k < 60) SELECT * FROM r WHERE k = 60),
b AS (SELECT sum(x * z) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM sw), e AS (SELECT entity, date, x, z - b * x AS e FROM sw, b)"""


@query(sql(_TWO_WAY + " SELECT 'x' AS term, b AS coef, sqrt((SELECT sum(s * s) * (count(*) / (count(*) - 1.0)) FROM (SELECT sum(e * x) AS s FROM e GROUP BY entity)) * ((n - 1.0) / (n - 1))) / sxx AS se, n FROM b", "aligned"), "coef se")
def t14_panel_regression_two_way(spark, d):
    """Entity and quarter effects, errors clustered by entity."""
    return stt.panel_regression(_panel(spark, d), "z", ["x"], effects=[["entity"], ["period"]]).select("term", "coef", "se", "n")


@query(sql(""", p AS (SELECT entity, date, z, x FROM (SELECT entity, date, (lead(y, 4) OVER (PARTITION BY entity ORDER BY date) - y) / nullif(y, 0) AS z, (qty / 1000 * ascii(entity)) % 7 AS x FROM aligned) WHERE z IS NOT NULL AND x IS NOT NULL),
w AS (SELECT date, z - avg(z) OVER (PARTITION BY entity) AS z, x - avg(x) OVER (PARTITION BY entity) AS x FROM p), b AS (SELECT sum(x * z) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM w),
s AS (SELECT row_number() OVER (ORDER BY date) AS i, s FROM (SELECT date, sum((z - b * x) * x) AS s FROM w, b GROUP BY 1)),
m AS (SELECT sum(CASE WHEN a.i = c.i THEN 1 ELSE 2 * (1 - (a.i - c.i) / 5.0) END * a.s * c.s) AS m FROM s a JOIN s c ON a.i - c.i BETWEEN 0 AND 4) SELECT 'x' AS term, b AS coef, sqrt(m) / sxx AS se, n FROM b, m""", "aligned"), "coef se")  # fmt: skip
def t15_driscoll_kraay(spark, d):
    """Kernel errors over dates."""
    return stt.driscoll_kraay(_panel(spark, d), "z", ["x"]).select("term", "coef", "se", "n")


@query()
def t16_wild_cluster(spark, d):
    """Restricted wild cluster bootstrap."""
    return stt.wild_cluster(_panel(spark, d), "z", "x", ["q"])


@query()
def t17_distributed_lag(spark, d):
    """Lags 0 to 26, and sums over two ranges of them with their errors."""
    return stt.distributed_lag(_panel(spark, d), "z", "x", 26, ranges=[(0, 12), (13, 26)])


@query()
def t18_lag_grid(spark, d):
    """A regression per feature and lag from 4 to 26 weeks, on all weeks and without a window."""
    p, out = settled(_panel(spark, d), "panel"), []
    for name, window in (("all", None), ("without", ("1999-01-04", "1999-06-28"))):
        out.append(stt.lag_grid(p, "z", ["x", "q"], list(range(4, 27)), window).withColumn("weeks", F.lit(name)))
    return out[0].unionByName(out[1])


@query(sql(_TWO_WAY + """, l AS (SELECT entity, e, lag(e) OVER (PARTITION BY entity ORDER BY date) AS past FROM e), q AS (SELECT * FROM l WHERE past IS NOT NULL),
c AS (SELECT entity, e - avg(e) OVER () AS e, past - avg(past) OVER () AS past FROM q), f AS (SELECT sum(past * e) / sum(past * past) AS r, sum(past * past) AS pp, count(*) AS n FROM c),
s AS (SELECT entity, sum((e - r * past) * past) AS s FROM c, f GROUP BY 1), o AS (SELECT entity, corr(e, past) AS rho FROM q GROUP BY 1)
SELECT 'past' AS term, r AS coef, sqrt((SELECT sum(s * s) * (count(*) / (count(*) - 1.0)) FROM s) * ((n - 1.0) / (n - 1))) / pp AS se, n, (SELECT avg(rho) FROM o) AS mean_rho, (SELECT avg(rho) / (stddev_samp(rho) / sqrt(count(rho))) FROM o) AS t_rho FROM f""", "aligned"), "coef se mean_rho t_rho")  # fmt: skip
def t19_serial_correlation(spark, d):
    """Own lag of the residuals of the two-way fit, pooled and by entity."""
    e = stt.panel_residuals(_panel(spark, d), "z", ["x"], [["entity"], ["period"]])
    pooled, own = stt.serial_correlation(e)
    return pooled.select("term", "coef", "se", "n").crossJoin(F.broadcast(own.select("mean_rho", F.col("t").alias("t_rho"))))


# Graph, gate, boundary


#: The share of false edges that the graphs of one lag may hold, and the least probability: under it the finite sum loses digits.
EDGE_RATE, LEAST_P = 0.05, 1e-6
_SERIES_OF_T = """list_reduce(range(1, CAST(v / 2 AS BIGINT) + 1), lambda s, j: CASE WHEN v % 2 = 1
  THEN {'t': CASE WHEN j = 1 THEN cos(th) ELSE s.t * (2 * j - 2) / (2 * j - 1) * cos(th) * cos(th) END, 's': s.s + CASE WHEN j = 1 THEN cos(th) ELSE s.t * (2 * j - 2) / (2 * j - 1) * cos(th) * cos(th) END}
  ELSE {'t': CASE WHEN j = 1 THEN 1.0 ELSE s.t * (2 * j - 3) / (2 * j - 2) * cos(th) * cos(th) END, 's': s.s + CASE WHEN j = 1 THEN 1.0 ELSE s.t * (2 * j - 3) / (2 * j - 2) * cos(th) * cos(th) END} END,
  {'t': CAST(0 AS DOUBLE), 's': CAST(0 AS DOUBLE)}).s"""
#: Edges of one lag as of each date: the F test with one restriction is a t test, whose tail is a finite sum for whole degrees of freedom.
_GRAPH = f""", gdt AS (SELECT CAST(DATE '1997-06-30' + CAST(91 * k AS INT) AS DATE) AS as_of FROM (SELECT unnest(range(17)) AS k)),
gro AS (SELECT entity, date, coalesce(c - avg(c) OVER (PARTITION BY date), 0.0) AS g FROM (SELECT entity, date, (y - lag(y) OVER w) / nullif(lag(y) OVER w, 0) AS c FROM series WINDOW w AS (PARTITION BY entity ORDER BY date))),
gix AS (SELECT as_of, entity, date, product(CASE WHEN n = 1 THEN 1.0 ELSE 1 + g END) OVER (PARTITION BY as_of, entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS v
  FROM (SELECT as_of, entity, date, g, row_number() OVER (PARTITION BY as_of, entity ORDER BY date) AS n FROM gro JOIN gdt ON date BETWEEN as_of - 728 AND as_of)),
gdf AS (SELECT as_of, entity, date, dv, lag(dv) OVER (PARTITION BY as_of, entity ORDER BY date) AS l FROM (SELECT as_of, entity, date, v - lag(v) OVER (PARTITION BY as_of, entity ORDER BY date) AS dv FROM gix)),
gsm AS (SELECT t.as_of, s.entity AS source, t.entity AS target, count(*) AS n, var_pop(t.dv) * count(*) AS zz, var_pop(t.l) * count(*) AS aa, var_pop(s.l) * count(*) AS bb, covar_pop(t.dv, t.l) * count(*) AS za, covar_pop(t.dv, s.l) * count(*) AS zb, covar_pop(t.l, s.l) * count(*) AS ab
  FROM gdf t JOIN gdf s ON s.as_of = t.as_of AND s.date = t.date AND s.entity <> t.entity WHERE t.l IS NOT NULL AND s.l IS NOT NULL GROUP BY ALL HAVING count(*) >= 60),
gft AS (SELECT as_of, source, target, n, n - 3 AS v, greatest((r0 - r1) / greatest(r1 / (n - 3), 1e-300), 0.0) AS f FROM (SELECT *, zz - za * za / aa AS r0, zz - (za * za * bb - 2 * za * zb * ab + zb * zb * aa) / (aa * bb - ab * ab) AS r1 FROM gsm)),
gpv AS (SELECT as_of, source, target, n, f, greatest({LEAST_P}, 1 - CASE WHEN v % 2 = 1 THEN 2 / pi() * (th + sin(th) * {_SERIES_OF_T}) ELSE sin(th) * {_SERIES_OF_T} END) AS p FROM (SELECT *, atan(sqrt(f / v)) AS th FROM gft)),
gdg AS (SELECT *, coalesce(r <= max(CASE WHEN p <= {EDGE_RATE} * r / m THEN r END) OVER (PARTITION BY as_of), false) AS significant FROM (SELECT *, rank() OVER (PARTITION BY as_of ORDER BY p) + count(*) OVER (PARTITION BY as_of, p) - 1 AS r, count(*) OVER (PARTITION BY as_of) AS m FROM gpv))"""


def _graph(spark, d, s):
    """Edges of one lag as of each date: the tested form that SQL can repeat."""
    edges = sc.graph_at(jo.ordered_pairs(s), s, GRAPH_DATES, 1, q=EDGE_RATE)
    return settled(edges.withColumn("p_value", F.greatest("p_value", F.lit(LEAST_P))), "edges")


@query(sql(_GRAPH + " SELECT as_of, source, target, CAST(1 AS INT) AS best_lag, f AS f_stat, p AS p_value, n AS n_obs, significant FROM gdg"), "f_stat p_value")
def t12_graph_of_one_lag(spark, d):
    """The graph of own movements at lag 1 as it was known at each date."""
    return _graph(spark, d, settled(pa.series(spark, d), "series"))


@query(sql(_GRAPH + """ SELECT as_of, source, target, p_value, strength, rank, significant AND rank <= 3 AS top FROM (SELECT as_of, source, target, p AS p_value, significant, -log10(greatest(p, 1e-12)) AS strength,
  CAST(row_number() OVER (PARTITION BY as_of, target ORDER BY CAST(significant AS INT) DESC, round(p, 12), source) AS INT) AS rank FROM gdg)"""), "p_value strength")
def k1_package_at(spark, d):
    """Tested edges with strength and inbound rank, a graph for each date."""
    s = settled(pa.series(spark, d), "series")
    return gr.package(_graph(spark, d, s), s, by=["as_of"])[0].select("as_of", "source", "target", "p_value", "strength", "rank", "top")


@query(sql(_GRAPH + """ SELECT n.as_of, n.entity, coalesce(k, 0) AS in_degree, k IS NULL AS isolated FROM (SELECT as_of, entity FROM (SELECT DISTINCT as_of FROM gdg), (SELECT DISTINCT entity FROM series)) n
  LEFT JOIN (SELECT as_of, target, count(*) AS k FROM gdg WHERE significant GROUP BY ALL) g ON g.as_of = n.as_of AND g.target = n.entity"""))
def k1_nodes_at(spark, d):
    """Nodes of each date's graph with their in-degree."""
    s = settled(pa.series(spark, d), "series")
    return gr.package(_graph(spark, d, s), s, by=["as_of"])[1]


_SIGNAL = _GRAPH + """, fe AS (SELECT as_of, source, target, greatest(p, 1e-12) AS p, 1 AS lag FROM gdg WHERE significant),
te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, target ORDER BY round(p, 12), source) AS r FROM fe) WHERE r <= 3),
ml AS (SELECT entity, date, (lag(y, 1) OVER w - lag(y, 4) OVER w) / nullif(lag(y, 4) OVER w, 0) AS m FROM series WINDOW w AS (PARTITION BY entity ORDER BY date)),
og AS (SELECT entity, origin, (SELECT max(as_of) FROM gdt WHERE as_of <= origin) AS as_of FROM origins),
mv AS (SELECT o.entity, o.origin, t.source, 1 / t.p AS w, ml.m FROM og o JOIN te t ON t.target = o.entity AND t.as_of = o.as_of JOIN ml ON ml.entity = t.source AND ml.date = o.origin WHERE ml.m IS NOT NULL),
sg AS (SELECT entity, origin, count(*) AS n_neighbours, sum(w * m) / sum(w) AS trend, arg_max(m, {'a': round(abs(m), 12), 'b': source}) AS max_shock, arg_max(source, {'a': round(abs(m), 12), 'b': source}) AS shocked FROM mv GROUP BY ALL)"""


def _signal(spark, d, s, o):
    """Neighbour moves on the edges that were known at each origin."""
    return gr.spillover_signal(s, _graph(spark, d, s), sc.known_at(o.select("entity", "origin"), GRAPH_DATES), by=["as_of"])


@query(sql(_SIGNAL + " SELECT entity, origin, n_neighbours, trend, max_shock, shocked FROM sg", "origins"), "trend max_shock")
def k3_signal_at(spark, d):
    """Weighted moves of the neighbours that were known at each origin."""
    s = settled(pa.series(spark, d), "series")
    return _signal(spark, d, s, pa.origins(spark, d, s)).drop("contributors")


def _fixed_edges(spark, d):
    """Edges by rule, so that SQL can make them too: each entity to those whose name is longer or later."""
    pairs = jo.ordered_pairs(pa.table(spark, d, "customer").select(F.col("c_mktsegment").alias("entity")))
    p = (F.length("source") * 3 + F.length("target")) / 1000.0
    return pairs.withColumn("p_value", p.cast("double")).withColumn("best_lag", F.length("source") % 4).withColumn("significant", F.col("source") < F.col("target"))


_FE = """, fe AS (SELECT source, target, CAST((length(source) * 3 + length(target)) / 1000.0 AS DOUBLE) AS p, greatest(length(source) % 4, 1) AS lag FROM (SELECT DISTINCT c_mktsegment AS source FROM customer), (SELECT DISTINCT c_mktsegment AS target FROM customer) WHERE source < target),
te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(p, 12), source) AS r FROM fe) WHERE r <= 3),
ml AS (SELECT entity, date, k AS lag, CASE k WHEN 1 THEN (lag(y, 1) OVER w - lag(y, 4) OVER w) / nullif(lag(y, 4) OVER w, 0) WHEN 2 THEN (lag(y, 2) OVER w - lag(y, 5) OVER w) / nullif(lag(y, 5) OVER w, 0) ELSE (lag(y, 3) OVER w - lag(y, 6) OVER w) / nullif(lag(y, 6) OVER w, 0) END AS m
  FROM series, (SELECT unnest([1, 2, 3]) AS k) WINDOW w AS (PARTITION BY entity, k ORDER BY date)),
mv AS (SELECT o.entity, o.origin, t.source, 1 / t.p AS w, ml.m FROM origins o JOIN te t ON t.target = o.entity JOIN ml ON ml.entity = t.source AND ml.lag = t.lag AND ml.date = o.origin WHERE ml.m IS NOT NULL),
sg AS (SELECT entity, origin, count(*) AS n_neighbours, sum(w * m) / sum(w) AS trend, arg_max(m, {'a': round(abs(m), 12), 'b': source}) AS max_shock, arg_max(source, {'a': round(abs(m), 12), 'b': source}) AS shocked FROM mv GROUP BY ALL)"""


_ALL_EDGES = """, ae AS (SELECT source, target, CAST((length(source) * 3 + length(target)) / 1000.0 AS DOUBLE) AS p_value, CAST(length(source) % 4 AS INT) AS best_lag, source < target AS significant FROM (SELECT DISTINCT c_mktsegment AS source FROM customer), (SELECT DISTINCT c_mktsegment AS target FROM customer) WHERE source <> target)"""


@query(sql(_ALL_EDGES + """ SELECT *, significant AND rank <= 3 AS top FROM (SELECT *, CAST(greatest(best_lag, 1) AS INT) AS lag, -log10(greatest(p_value, 1e-12)) AS strength, CAST(row_number() OVER (PARTITION BY target ORDER BY CAST(significant AS INT) DESC, round(p_value, 12), source) AS INT) AS rank FROM ae)""", "weekly"), "p_value strength")
def k1_package(spark, d):
    """Edges with strength and inbound rank."""
    return gr.package(_fixed_edges(spark, d), pa.series(spark, d))[0]


@query(sql(_ALL_EDGES + " SELECT target, source, 1 / greatest(p_value, 1e-12) AS weight FROM ae WHERE significant", "weekly"), "weight")
def k2_edge_matrix(spark, d):
    """Weights of the significant edges by target and source."""
    return gr.edge_weights(_fixed_edges(spark, d))


@query(sql(_FE + " SELECT entity, origin, n_neighbours, trend, max_shock, shocked FROM sg", "origins"), "trend max_shock")
def k3_spillover_signal(spark, d):
    """Weighted neighbour moves at each origin."""
    s = pa.series(spark, d)
    return gr.spillover_signal(s, _fixed_edges(spark, d), pa.origins(spark, d, s)).drop("contributors")



_DECIDED = """, e8 AS (SELECT entity, date, CASE WHEN n + 1 < 4 OR ape IS NULL THEN NULL WHEN sd < 1e-12 THEN 0.0 ELSE (ape - m) / sd END AS z FROM (SELECT entity, date, ape, count(ape) OVER w AS n, avg(ape) OVER w AS m, stddev_pop(ape) OVER w AS sd
  FROM (SELECT entity, date, abs((y - lag(y) OVER (PARTITION BY entity ORDER BY date)) / nullif(y, 0)) AS ape FROM series) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING))),
e9 AS (SELECT entity, date, CASE WHEN n < 12 THEN NULL WHEN sd < 1e-12 THEN 0.0 ELSE abs(mv) / sd END AS z FROM (SELECT entity, date, mv, count(mv) OVER w AS n, stddev_pop(mv) OVER w AS sd
  FROM (SELECT entity, date, (y - lag(y, 4) OVER (PARTITION BY entity ORDER BY date)) / nullif(lag(y, 4) OVER (PARTITION BY entity ORDER BY date), 0) AS mv FROM series) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))),
gd AS (SELECT o.entity, o.origin, CASE WHEN (o.entity, o.origin) IN (SELECT DISTINCT (entity, week) FROM evw) THEN 'event' WHEN a.z > 2.0 THEN 'own_error' WHEN b.z > 2.5 THEN 'neighbour_shock' ELSE 'none' END AS trigger FROM origins o
  LEFT JOIN e8 a ON a.entity = o.entity AND a.date = o.origin LEFT JOIN sg ON sg.entity = o.entity AND sg.origin = o.origin LEFT JOIN e9 b ON b.entity = sg.shocked AND b.date = o.origin)"""
_GATE = _FE + _DECIDED


@query(sql(_GATE + " SELECT entity, origin, trigger FROM gd", "origins", "events"))
def k4_gate(spark, d):
    """Gate decisions: event, own error, neighbour's shock, none."""
    return _gated(spark, d).select("entity", "origin", "trigger")


def _gated(spark, d, tested=False):
    s = settled(pa.series(spark, d), "series")
    o = pa.origins(spark, d, s)
    live = pa.event_weeks(spark, d).select("entity", F.col("week").alias("origin")).distinct().withColumn("event_live", F.lit(True))
    signal = _signal(spark, d, s, o) if tested else gr.spillover_signal(s, _fixed_edges(spark, d), o)
    shocks = gr.shock_z(signal, wi.move_zscore(s))
    return gr.gate(gr.gate_inputs(s, o, wi.error_zscore(s), live, shocks))


@query(sql(_GATE + " SELECT coalesce(trigger, 'all') AS trigger, count(*) AS n, count(*) FILTER (trigger <> 'none') AS n_active, count(*) / CAST((SELECT count(*) FROM gd) AS DOUBLE) AS share FROM gd GROUP BY ROLLUP (trigger)", "origins", "events"), "share")
def a17_gate_report(spark, d):
    """Gate decisions by trigger."""
    return lo.gate_report(_gated(spark, d))


@query(sql(_SIGNAL + _DECIDED + " SELECT entity, origin, trigger FROM gd", "origins", "events"))
def k4_gate_at(spark, d):
    """Gate decisions, the neighbours being those of the graph that was known at the origin."""
    return _gated(spark, d, True).select("entity", "origin", "trigger")


@query(sql(_SIGNAL + _DECIDED + " SELECT coalesce(trigger, 'all') AS trigger, count(*) AS n, count(*) FILTER (trigger <> 'none') AS n_active, count(*) / CAST((SELECT count(*) FROM gd) AS DOUBLE) AS share FROM gd GROUP BY ROLLUP (trigger)", "origins", "events"), "share")
def a17_gate_report_at(spark, d):
    """Those decisions by trigger."""
    return lo.gate_report(_gated(spark, d, True))


_BD = ", bd AS (SELECT entity, 0.4 * coalesce(max(abs(c)), 1.0) AS bound FROM (SELECT entity, (y - lag(y) OVER (PARTITION BY entity ORDER BY date)) / nullif(lag(y) OVER (PARTITION BY entity ORDER BY date), 0) AS c FROM series) GROUP BY 1)"


def _bounded(spark, d):
    s = pa.series(spark, d)
    o = pa.origins(spark, d, s)
    bounds = wi.historical_bound(s).withColumn("bound", F.col("bound") * 0.4)
    return ch.seasonal_naive(s, o, 8), ch.last_value(s, o), bounds, ch.naive(s, o, 8)


@query(sql(_BD + """ SELECT channel, entity, origin, step, yhat, previous, 'jump' AS problem FROM (SELECT f.channel, f.entity, f.origin, f.step, f.yhat, coalesce(lag(f.yhat) OVER (PARTITION BY f.entity, f.origin ORDER BY f.step), o.y0) AS previous, b.bound
  FROM forecasts f JOIN origins o USING (entity, origin) JOIN bd b ON b.entity = f.entity WHERE f.h = 8 AND f.channel = 'snaive') WHERE abs((yhat - previous) / nullif(previous, 0)) > bound""", "forecasts"), "yhat previous")  # fmt: skip
def k5_boundary_check(spark, d):
    """Steps that move more than a part of the largest move on record."""
    f, last, bounds, _ = _bounded(spark, d)
    return gr.boundary_check(f, last, bounds)


def _problems(path: str) -> str:
    """Kinds of problems along a path, each step against the one before."""
    before = f"CASE WHEN i = 1 THEN y0 ELSE {path}[i - 1] END"
    kind = f"CASE WHEN {path}[i] < 0 THEN 'floor' WHEN abs(({path}[i] - {before}) / nullif({before}, 0)) > bound + 1e-12 THEN 'jump' END"
    return f"list_filter(list_transform(range(1, len({path}) + 1), lambda i: {kind}), lambda v: v IS NOT NULL)"


def _within_bounds(path: str) -> str:
    v = "greatest(least(greatest(y, s.prev - abs(s.prev) * bound), s.prev + abs(s.prev) * bound), 0.0)"
    return f"list_reduce({path}, lambda s, y: {{'prev': {v}, 'out': list_append(s.out, {v})}}, {{'prev': y0, 'out': CAST([] AS DOUBLE[])}}).out"


_ENFORCED = _BD + f""", e0 AS (SELECT f.entity, f.origin, list(f.yhat ORDER BY f.step) AS path, any_value(o.y0) AS y0, any_value(b.bound) AS bound FROM forecasts f JOIN origins o USING (entity, origin) JOIN bd b ON b.entity = f.entity WHERE f.h = 8 AND f.channel = 'snaive' GROUP BY ALL),
e1 AS (SELECT *, {_problems("path")} AS violations FROM e0),
e2 AS (SELECT *, len(violations) > 0 AS bad1, CASE WHEN len(violations) > 0 THEN {_within_bounds("path")} ELSE path END AS path1 FROM e1),
e3 AS (SELECT *, len({_problems("path1")}) > 0 AS bad2, CASE WHEN len({_problems("path1")}) > 0 THEN {_within_bounds("path1")} ELSE path1 END AS path2 FROM e2),
e4 AS (SELECT *, len({_problems("path2")}) > 0 AS fell_back FROM e3),
enforced AS (SELECT entity, origin, violations, CAST(bad1 AS INT) + CAST(bad2 AS INT) AS attempts, len(violations) > 0 AND NOT fell_back AS corrected, fell_back, CASE WHEN fell_back THEN list_transform(path2, lambda v: y0) ELSE path2 END AS path FROM e4)"""


def _enforced(spark, d):
    f, last, bounds, base = _bounded(spark, d)
    return gr.enforce(f, last, bounds, base)


@query(sql(_ENFORCED + " SELECT 'snaive' AS channel, entity, origin, CAST(i AS INT) AS step, path[i] AS yhat, len(violations) AS n_violations, attempts, corrected, fell_back FROM enforced, (SELECT unnest(range(1, 9)) AS i) WHERE i <= len(path)", "forecasts"), "yhat")
def k6_enforce(spark, d):
    """Paths clamped step by step, with the outcome."""
    rows = _enforced(spark, d).select("*", F.posexplode("path").alias("k", "yhat"))
    return rows.select("channel", "entity", "origin", (F.col("k") + 1).alias("step"), "yhat", F.size("violations").cast("bigint").alias("n_violations"), "attempts", "corrected", "fell_back")


@query(sql(_ENFORCED + """ SELECT count(*) AS n, count(*) FILTER (len(violations) = 0) AS n_clean, count(*) FILTER (corrected) AS n_corrected, count(*) FILTER (fell_back) AS n_fell_back, avg(attempts) AS mean_attempts,
  CAST(sum(len(list_filter(violations, lambda v: v = 'floor'))) AS BIGINT) AS n_floor, CAST(sum(len(list_filter(violations, lambda v: v = 'jump'))) AS BIGINT) AS n_jump FROM enforced""", "forecasts"), "mean_attempts")
def a18_boundary_report(spark, d):
    """Outcomes of the bounds in one row."""
    return lo.boundary_report(_enforced(spark, d))
