"""Joins over time: as-of, fills, lags, forward actuals, folds, completeness, parity. Linear: equi-joins and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Right rows that a keyless as-of join sends to every task as one sorted array.
FEW = 512


def searched(left: DataFrame, right: DataFrame, on: str, right_on: str, values: list[str]) -> DataFrame:
    """The keyless as-of join with a right side of at most FEW rows: one sorted array, searched by each left row; nothing is shuffled."""
    entry = F.struct(F.col(right_on).alias("at"), F.struct(*[F.col(c).alias(f"_r_{c}") for c in values]).alias("value"))
    table = right.where(F.col(right_on).isNotNull()).agg(F.sort_array(F.collect_list(entry), asc=False).alias("_marks"))
    latest = F.get(F.filter("_marks", lambda m: m["at"] <= F.col(on)), F.lit(0))["value"]
    found = left.crossJoin(F.broadcast(table)).withColumn("_value", latest)  # one row
    return found.select(*left.columns, *[F.col(f"_value._r_{c}").alias(c) for c in values])


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """left with the values of the latest right row whose right_on is at or before on; null where there is none.

    One union and one window by key: no inequality join, so the work is linear. Without `by` the right side holds for all left rows: if it
    has at most FEW rows (counted, so let it be a written table) every task gets them; beyond, the left keys are matched once per distinct
    date, within spans of time, and each span hands its last value on to the next one.
    """
    by = by or []
    if not by and right.limit(FEW + 1).count() <= FEW:
        return searched(left, right, on, right_on, values)
    keys = left.select(*by, on).distinct()
    side = [F.col(c).alias(f"_r_{c}") for c in values]
    marks = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(*side).alias("_value"))
    asks = keys.select(*by, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_value"].dataType).alias("_value"))
    rows = marks.unionByName(asks)
    order = [F.col("_at"), F.col("_side"), F.col("_value")]
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = rows.withColumn("_value", F.last("_value", True).over(w)).where("_side = 1")
    else:
        rows = rows.withColumn("_span", _span(rows, "_at"))
        ends = rows.where("_side = 0").groupBy("_span").agg(F.max(F.struct("_at", "_value")).alias("_last"))
        # A row per span of time: the last value of all spans before.
        before = F.last("_last._value", True).over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
        carried = rows.select("_span").distinct().join(ends, "_span", "left").select("_span", before.alias("_before"))
        w = Window.partitionBy("_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = rows.withColumn("_value", F.last("_value", True).over(w)).where("_side = 1").join(carried, "_span", "left")
        found = found.withColumn("_value", F.coalesce("_value", "_before"))
    found = found.select(*by, F.col("_at").alias(on), *[F.col(f"_value._r_{c}").alias(c) for c in values])
    return left.join(found, [*by, on], "left")


def _span(df: DataFrame, column: str) -> Column:
    """The month of a date, the day of a time, the hundred thousands of a number."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "date":
        return F.trunc(column, "month")
    if kind.startswith("timestamp"):
        return F.date_trunc("day", F.col(column))
    return F.floor(F.col(column) / 100_000)


def ffill_log(df: DataFrame, column: str = "y", by: str = "entity", order: str = "date") -> tuple[DataFrame, DataFrame]:
    """(filled, log): gaps take the last value of the same entity, leading gaps stay null; the log holds every filled row."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = df.withColumn("_raw", F.col(column)).withColumn(column, F.last(column, True).over(w))
    log = both.where(F.col("_raw").isNull() & F.col(column).isNotNull()).select(order, by, F.col(column).alias("filled_value"))
    return both.drop("_raw"), log


def calendar_lag(df: DataFrame, column: str, weeks: int, out: str) -> DataFrame:
    """The value exactly 7 * weeks days before, else null."""
    past = df.select("entity", F.date_add("date", 7 * weeks).alias("date"), F.col(column).alias(out))
    return df.join(past, ["entity", "date"], "left")


def positional(df: DataFrame, column: str, rows: int, out: str) -> DataFrame:
    """The value `rows` rows before (after, if negative)."""
    w = Window.partitionBy("entity").orderBy("date")
    return df.withColumn(out, F.lag(column, rows).over(w) if rows >= 0 else F.lead(column, -rows).over(w))


def forward_actuals(series: DataFrame, origins: DataFrame, horizons: DataFrame) -> DataFrame:
    """(entity, origin, h, step, target_date, y): the h rows after each origin; a cell with fewer goes.

    series has widx; origins (entity, origin, widx); horizons (h).
    """
    asked = origins.select("entity", "origin", "widx").crossJoin(F.broadcast(horizons.select("h")))  # a few horizons
    asked = asked.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("h")))).withColumn("at", F.col("widx") + F.col("step"))
    ahead = series.select("entity", F.col("widx").alias("at"), F.col("date").alias("target_date"), "y")
    found = asked.join(ahead, ["entity", "at"])
    n = F.count("*").over(Window.partitionBy("entity", "origin", "h"))
    return found.withColumn("_n", n).where("_n = h").select("entity", "origin", "h", "step", "target_date", "y")


def calendar_targets(series: DataFrame, origins: DataFrame, horizons: DataFrame) -> DataFrame:
    """Value exactly h weeks after the origin, missing ones left out."""
    asked = origins.select("entity", "origin").crossJoin(F.broadcast(horizons.select("h")))
    asked = asked.withColumn("target_date", F.expr("date_add(origin, 7 * h)"))
    return asked.join(series.select("entity", F.col("date").alias("target_date"), "y"), ["entity", "target_date"]).where("y IS NOT NULL")


def active_event(asks: DataFrame, weekly: DataFrame, window: int = 8) -> DataFrame:
    """asks (entity, week) with the latest event week at or before it: first by begin date and id, its age in weeks, live while age <= window."""
    one = weekly.groupBy("entity", "week").agg(F.min(F.struct("begin_date", "event", "impact", "confidence")).alias("x"))
    one = one.select("entity", F.col("week").alias("event_week"), "x.event", "x.impact", "x.confidence")
    found = asof_join(asks, one, "week", "event_week", ["event_week", "event", "impact", "confidence"], ["entity"])
    age = F.datediff("week", "event_week") / 7
    return found.withColumn("age_weeks", age.cast("int")).withColumn("live", F.coalesce(age <= window, F.lit(False)))


def fold_of(df: DataFrame, folds: DataFrame, date: str = "origin", fallback: bool = False) -> DataFrame:
    """df with the fold whose test window holds the date; null outside, or the last fold with `fallback`. folds: a few rows."""
    joined = df.join(F.broadcast(folds.select("fold", "test_start", "test_end")), F.col(date).between(F.col("test_start"), F.col("test_end")), "left")
    joined = joined.drop("test_start", "test_end")
    if not fallback:
        return joined
    last = folds.agg(F.max("fold").alias("_last"))
    return joined.crossJoin(F.broadcast(last)).withColumn("fold", F.coalesce("fold", "_last")).drop("_last")


def ordered_pairs(entities: DataFrame) -> DataFrame:
    """(source, target) of different entities: the pairs that are asked for, one test each."""
    a, b = entities.select(F.col("entity").alias("source")).distinct(), entities.select(F.col("entity").alias("target")).distinct()
    return a.crossJoin(b).where("source <> target")


def complete_cells(forecasts: DataFrame, channels: list[str]) -> DataFrame:
    """Rows of cells (entity, origin, h) for which every channel has all its steps."""
    wanted = forecasts.where(F.col("channel").isin(channels) & F.col("yhat").isNotNull())
    full = wanted.groupBy("entity", "origin", "h").agg(F.count_distinct("channel", "step").alias("n")).where(F.col("n") == len(channels) * F.col("h"))
    return forecasts.join(full.select("entity", "origin", "h"), ["entity", "origin", "h"], "left_semi")


def complete_weeks(losses: DataFrame, methods: list[str]) -> DataFrame:
    """Losses without the (h, origin) weeks in which some entity lacks a method."""
    have = losses.where(F.col("channel").isin(methods) & F.col("mape").isNotNull()).groupBy("h", "origin", "entity").agg(F.count_distinct("channel").alias("n"))
    every = losses.select("h", "origin", "entity").distinct().join(have, ["h", "origin", "entity"], "left")
    bad = every.where(F.coalesce("n", F.lit(0)) < len(methods)).select("h", "origin").distinct()
    return losses.join(bad, ["h", "origin"], "left_anti")


def snap_to_grid(df: DataFrame, grid: DataFrame, date: str, out: str = "snapped") -> DataFrame:
    """The last grid date at or before the date."""
    return asof_join(df, grid.select(F.col("date").alias("_grid"), F.col("date").alias(out)), date, "_grid", [out])


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of two runs over the same keys: rows in both, in one only, and largest, 99 % and median differences."""
    joined = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), keys, "full")
    diff = F.abs(F.col("_a") - F.col("_b"))
    return joined.agg(
        F.count(F.when(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull(), 1)).alias("n_both"),
        F.count(F.when(F.col("_in_b").isNull(), 1)).alias("n_first_only"),
        F.count(F.when(F.col("_in_a").isNull(), 1)).alias("n_second_only"),
        F.max(diff).alias("max_abs"),
        F.max(F.try_divide(diff, F.abs("_a"))).alias("max_rel"),
        F.percentile(diff, F.lit(0.99)).alias("p99_abs"),
        F.median(diff).alias("median_abs"),
    )
