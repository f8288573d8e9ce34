"""Panels that Spark derives from the given tables, each with the SQL that makes the same rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import settled
from ..operators import backtest, channels, joins, losses, windows
from ..sources import ingest

FIRST, LAST = "1995-01-02", "2001-07-23"
TRAIN_START, RESERVED, CAP = "1996-01-01", "2001-01-01", "2001-07-23"
HORIZONS = [4, 8, 13]
REGIMES = ["hiking", "cutting", "stable"]
CHANNELS = ["naive", "snaive", "histmean"]
LAGS = {"disc": 32, "tax": 35, "qty": 42}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def counts(spark: SparkSession, d: str, key: str = "c_mktsegment") -> DataFrame:
    """(entity, date, y): orders per week and customer group, where there are any; entity is the key as it is stored."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    return joined.groupBy(F.col(key).alias("entity"), week.alias("date")).agg(F.count("*").cast("double").alias("y"))


def weekly(spark: SparkSession, d: str, key: str = "c_mktsegment") -> DataFrame:
    """Orders per week and customer group, on the full grid of weeks; null where there is none."""
    found = counts(spark, d, key).withColumn("entity", F.col("entity").cast("string"))
    entities = table(spark, d, "customer").select(F.col(key).cast("string").alias("entity")).distinct()
    grid = entities.crossJoin(F.broadcast(ingest.week_grid(spark, FIRST, LAST)))
    return grid.join(found, ["entity", "date"], "left")


def series(spark: SparkSession, d: str) -> DataFrame:
    """(entity, date, y, widx): gaps filled from the same entity, leading gaps left out."""
    filled, _ = joins.ffill_log(weekly(spark, d))
    return windows.with_row_index(filled.where("y IS NOT NULL"))


def two_cuts(s: DataFrame, rows: int = 3) -> DataFrame:
    """The series raw and smoothed (mean of the last `rows` rows, so no later row), the cut being part of each entity's name: whatever is made of them keeps them apart."""
    w = Window.partitionBy("entity").orderBy("date").rowsBetween(1 - rows, 0)
    smooth = s.withColumn("y", F.avg("y").over(w)).withColumn("entity", F.concat(F.lit("smooth:"), "entity"))
    return s.withColumn("entity", F.concat(F.lit("raw:"), "entity")).unionByName(smooth)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """(series, obs_date, value): monthly means of line discounts and taxes, and quantities."""
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    by = table(spark, d, "lineitem").groupBy(month.alias("obs_date")).agg(
        F.round(F.avg(F.col("l_discount").cast("double")), 6).alias("disc"), F.round(F.avg(F.col("l_tax").cast("double")), 6).alias("tax"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("qty")
    )
    return by.unpivot("obs_date", ["disc", "tax", "qty"], "series", "value").select("series", "obs_date", "value")


def with_factors(spark: SparkSession, d: str, rows: DataFrame, names: Iterable[str]) -> DataFrame:
    """rows (date, ...) with the named factors as they were known at each date. The monthly table is written once."""
    available = settled(ingest.with_availability(monthly(spark, d), LAGS), "factors")
    for name in names:
        right = available.where(F.col("series") == name).select("available_date", F.col("value").alias(name))
        rows = joins.asof_join(rows, right, "date", "available_date", [name])
    return rows


def aligned(spark: SparkSession, d: str, names: Iterable[str] = LAGS) -> DataFrame:
    """series with the named factors as they were known at each date; written, since most readers take it several times."""
    return settled(with_factors(spark, d, series(spark, d), names), "aligned")


def regimes(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    """(origin, regime): direction of the discount over 13 weeks, in hundredths of a point."""
    dates = (s if s is not None else series(spark, d)).select("date").distinct()
    known = with_factors(spark, d, dates, ["disc"]).select("date", (F.col("disc") * 1000).alias("x"), F.lit("all").alias("entity"))
    return windows.regime(known, "x").select(F.col("date").alias("origin"), "regime")


def folds(spark: SparkSession) -> DataFrame:
    return backtest.fold_table(spark, TRAIN_START, RESERVED)


def horizons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in HORIZONS], "h int")


def origins(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    return backtest.origin_set(s if s is not None else series(spark, d), folds(spark))


def forecasts(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    """(channel, entity, origin, h, step, yhat) of the three base channels."""
    s = s if s is not None else series(spark, d)
    o = origins(spark, d, s)
    flat = channels.naive(s, o).unionByName(channels.seasonal_naive(s, o)).crossJoin(F.broadcast(horizons(spark))).where("step <= h")
    return flat.select("channel", "entity", "origin", "h", "step", "yhat").unionByName(channels.historical_mean(s, o, HORIZONS, 0.317))


def system_paths(spark: SparkSession, d: str, s: DataFrame, o: DataFrame, steps: int = channels.MAX_STEP) -> DataFrame:
    """(channel, entity, origin, step, yhat) of the fitted channels: Holt, seasonal, factor-adjusted smoothing undamped and damped, macro; and naive."""
    states = settled(channels.seasonal_states(s, o, kinds=("fa_ets", "fa_ets_d")), "seasonal-states")
    macro = aligned(spark, d, ["qty"]).withColumn("qty", F.col("qty") / 1000)
    made = [channels.naive(s, o, steps), channels.holt(s, o, steps), channels.seasonal(s, o, steps, states=states), channels.anchored(channels.exogenous_modifier(macro, o, {"qty": 6}), steps)]
    made += [channels.adjusted_trend(s, o, steps, damped=damped, states=states) for damped in (False, True)]
    return reduce(DataFrame.unionByName, made)


def system_forecasts(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """(channel, entity, origin, h, step, yhat) of system_paths at the origins of the folds."""
    flat = system_paths(spark, d, s, origins(spark, d, s))
    return flat.crossJoin(F.broadcast(horizons(spark))).where("step <= h").select("channel", "entity", "origin", "h", "step", "yhat")


def cells(spark: SparkSession, d: str, system: bool = False, s: DataFrame | None = None) -> DataFrame:
    """cell_steps of the base (or the fitted) channels, with the regime of the origin. The series, which all parts read, is written once."""
    s = settled(s if s is not None else series(spark, d), "series")
    actuals = joins.forward_actuals(s, origins(spark, d, s), horizons(spark))
    steps = losses.cell_steps(actuals, system_forecasts(spark, d, s) if system else forecasts(spark, d, s))
    return steps.join(F.broadcast(settled(regimes(spark, d, s), "regimes")), "origin")  # a row per week


def cell_losses(spark: SparkSession, d: str, steps: DataFrame | None = None) -> DataFrame:
    """losses of the base channels with the regime and the test fold (null outside)."""
    steps = steps if steps is not None else cells(spark, d)
    out = losses.cell_losses(steps.withColumn("entity", F.struct("entity", "regime")))
    out = out.withColumn("regime", F.col("entity.regime")).withColumn("entity", F.col("entity.entity"))
    return joins.fold_of(out, folds(spark))


def statics(spark: SparkSession, d: str) -> DataFrame:
    """(entity, n_customers, mean_balance) per market segment."""
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("entity")).agg(F.count("*").cast("double").alias("n_customers"), F.round(F.avg(F.col("c_acctbal").cast("double")), 4).alias("mean_balance"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """(entity, event, begin_date, end_date, impact, confidence): urgent orders as dated events of their segment."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    top = orders.where(F.col("o_orderpriority") == "1-URGENT").join(customer, orders["o_custkey"] == customer["c_custkey"])
    begin = F.to_date("o_orderdate")
    k = F.col("o_orderkey").cast("bigint")
    return top.select(
        F.col("c_mktsegment").alias("entity"), k.alias("event"), begin.alias("begin_date"), F.date_add(begin, (k % 20).cast("int")).alias("end_date"),
        ((k % 21 - 10) / 10.0).cast("double").alias("impact"), ((k % 11) / 10.0).cast("double").alias("confidence"),
    )


def major_events(spark: SparkSession, d: str) -> DataFrame:
    """The events that are the dearest order of their entity's quarter."""
    price = table(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("event"), F.col("o_totalprice").cast("double").alias("price"))
    quarter = F.date_trunc("quarter", "begin_date")
    top = events(spark, d).join(price, "event").groupBy("entity", quarter.alias("quarter")).agg(F.max(F.struct("price", "event", "begin_date", "end_date", "impact", "confidence")).alias("x"))
    return top.select("entity", "x.event", "x.begin_date", "x.end_date", "x.impact", "x.confidence")


def event_weeks(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    """The events on every active Monday."""
    e = e if e is not None else events(spark, d)
    return ingest.expand_active_weeks(e).join(e.dropDuplicates(["entity", "event"]), ["entity", "event"])


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Losses with a run number, for repeated-run statistics: origins dealt over three runs."""
    return cell_losses(spark, d).withColumn("run", (F.datediff("origin", F.lit("1970-01-01").cast("date")) / 7).cast("int") % 3)


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


#: The same tables in SQL, as common table expressions.
SQL = {
    "weekly": """
wk AS (SELECT c_mktsegment AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
weekly AS (SELECT g.entity, g.date, wk.y FROM (SELECT e.entity, CAST(t.d AS DATE) AS date FROM (SELECT DISTINCT c_mktsegment AS entity FROM customer) e,
  generate_series(TIMESTAMP '1995-01-02', TIMESTAMP '2001-07-23', INTERVAL 7 DAY) t(d)) g LEFT JOIN wk ON wk.entity = g.entity AND wk.date = g.date)""",
    "series": """
filled AS (SELECT entity, date, y AS raw, last_value(y IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS y FROM weekly),
series AS (SELECT entity, date, y, CAST(row_number() OVER (PARTITION BY entity ORDER BY date) AS INT) AS widx FROM filled WHERE y IS NOT NULL)""",
    "monthly": """
mon AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS obs_date, round(avg(CAST(l_discount AS DOUBLE)), 6) AS disc, round(avg(CAST(l_tax AS DOUBLE)), 6) AS tax,
  round(sum(CAST(l_quantity AS DOUBLE)), 2) AS qty FROM lineitem GROUP BY 1),
monthly AS (SELECT 'disc' AS series, obs_date, disc AS value, obs_date + 32 AS available_date FROM mon UNION ALL SELECT 'tax', obs_date, tax, obs_date + 35 FROM mon
  UNION ALL SELECT 'qty', obs_date, qty, obs_date + 42 FROM mon)""",
    "aligned": """
aligned AS (SELECT s.*, a.value AS disc, b.value AS tax, c.value AS qty FROM series s
  ASOF LEFT JOIN (SELECT * FROM monthly WHERE series = 'disc') a ON s.date >= a.available_date
  ASOF LEFT JOIN (SELECT * FROM monthly WHERE series = 'tax') b ON s.date >= b.available_date
  ASOF LEFT JOIN (SELECT * FROM monthly WHERE series = 'qty') c ON s.date >= c.available_date)""",
    "regimes": """
rx AS (SELECT date AS origin, x - lag(x, 13) OVER (ORDER BY date) AS m FROM (SELECT DISTINCT date, disc * 1000 AS x FROM aligned)),
regimes AS (SELECT origin, CASE WHEN m > 0.25 THEN 'hiking' WHEN m < -0.25 THEN 'cutting' ELSE 'stable' END AS regime FROM rx)""",
    "folds": """
folds AS (SELECT CAST(k + 1 AS INT) AS fold, DATE '1996-01-01' AS train_start, CAST(DATE '1998-03-30' + k * 273 - 98 AS DATE) AS train_end,
  CAST(DATE '1998-03-30' + k * 273 AS DATE) AS test_start, CAST(DATE '1998-03-30' + k * 273 + 175 AS DATE) AS test_end FROM (SELECT CAST(unnest(range(4)) AS INT) AS k))""",
    "origins": """
origins AS (SELECT entity, date AS origin, widx, y AS y0 FROM series s WHERE EXISTS (SELECT 1 FROM folds f
  WHERE s.date BETWEEN f.train_end - 728 AND f.train_end OR s.date BETWEEN f.test_start AND f.test_end))""",
    "forecasts": """
hs AS (SELECT CAST(unnest([4, 8, 13]) AS INT) AS h), st AS (SELECT CAST(unnest(range(1, 14)) AS INT) AS step),
lvl AS (SELECT entity, date AS origin, avg(y) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) AS level FROM series),
forecasts AS (SELECT 'naive' AS channel, entity, origin, h, step, y0 AS yhat FROM origins, hs, st WHERE step <= h
  UNION ALL SELECT 'snaive', o.entity, origin, h, step, s.y FROM origins o, hs, st JOIN series s ON s.entity = o.entity AND s.widx = o.widx + step - 52 WHERE step <= h
  UNION ALL SELECT 'histmean', o.entity, o.origin, h, step, greatest(round(y0 + 0.317 * pow(step / h, 2) * (level - y0), 2), 0.0)
  FROM origins o JOIN lvl USING (entity, origin), hs, st WHERE step <= h)""",
    "cells": """
act AS (SELECT o.entity, o.origin, h, step, s.date AS target_date, s.y, count(*) OVER (PARTITION BY o.entity, o.origin, h) AS n
  FROM origins o, hs, st JOIN series s ON s.entity = o.entity AND s.widx = o.widx + step WHERE step <= h),
cells AS (SELECT a.entity, a.origin, a.h, a.step, a.target_date, f.channel, a.y, f.yhat, r.regime FROM act a JOIN forecasts f USING (entity, origin, h, step) JOIN regimes r USING (origin) WHERE a.n = a.h)""",
    "losses": """
raw_losses AS (SELECT entity, origin, h, channel, regime, 100 * avg(abs((y - yhat) / nullif(y, 0))) AS mape, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae
  FROM cells GROUP BY ALL),
losses AS (SELECT l.*, f.fold FROM raw_losses l LEFT JOIN folds f ON l.origin BETWEEN f.test_start AND f.test_end)""",
    "events": """
ev AS (SELECT c_mktsegment AS entity, CAST(o_orderkey AS BIGINT) AS event, CAST(o_orderdate AS DATE) AS begin_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT) AS end_date,
  (o_orderkey % 21 - 10) / 10.0 AS impact, (o_orderkey % 11) / 10.0 AS confidence FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'),
evw AS (SELECT DISTINCT entity, event, CAST(w AS DATE) AS week, begin_date, end_date, CAST(impact AS DOUBLE) AS impact, CAST(confidence AS DOUBLE) AS confidence
  FROM ev, generate_series(TIMESTAMP '1994-12-26', TIMESTAMP '2003-01-06', INTERVAL 7 DAY) t(w) WHERE CAST(w AS DATE) BETWEEN begin_date AND end_date)""",
    "val": """
val AS (SELECT l.* EXCLUDE (fold), f.fold FROM losses l JOIN folds f ON l.origin BETWEEN f.train_end - 728 AND f.train_end AND l.origin + 7 * l.h <= f.train_end)""",
    "skills": """
sk AS (SELECT v.fold, v.regime, v.h, v.channel, v.entity, v.origin, CASE WHEN n.mape > 0 THEN 1 - v.mape / n.mape END AS s
  FROM val v JOIN val n ON n.channel = 'naive' AND n.fold = v.fold AND n.entity = v.entity AND n.origin = v.origin AND n.h = v.h),
fsk AS (SELECT fold, channel, coalesce(median(s), -1) AS skill FROM sk GROUP BY ALL),
fw AS (SELECT fold, channel, skill, exp(skill / 0.05) / sum(exp(skill / 0.05)) OVER (PARTITION BY fold) AS w FROM fsk)""",
}
ORDER = list(SQL)


def sql(body: str, upto: str = "series", *more: str, **other: str) -> str:
    """WITH the tables up to the named one (and more by name), or other text in their place, and the body."""
    names = ORDER[: ORDER.index(upto) + 1]
    names += [n for n in more if n not in names]
    return "WITH " + ",".join(other.get(n, SQL[n]) for n in names) + "\n" + body
