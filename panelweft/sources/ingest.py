"""Sources, sinks and ingestion of weekly panels: long and wide series, availability dates, events, stores, revisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; lines that begin with # are configuration and are skipped."""
    reader = spark.read.option("header", True).option("comment", "#")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def unpivot_weekly(df: DataFrame, id_column: str, labels: dict[str, str] | DataFrame | None = None, cap: str | None = None) -> DataFrame:
    """Wide to long: one row per (entity, date) from a column per ISO date, columns after `cap` never read; nulls kept.

    labels maps source names to entities (rows of other names go); a DataFrame of labels (name, entity) is joined.
    """
    dates = [c for c in df.columns if len(c) == 10 and c[4] == c[7] == "-" and (cap is None or c <= cap)]
    long = df.select(F.col(id_column).alias("name"), *[F.col(f"`{c}`").cast("double").alias(c) for c in dates]).unpivot("name", dates, "date", "y")
    long = long.withColumn("date", F.to_date("date"))
    if labels is None:
        return long.withColumnRenamed("name", "entity")
    if isinstance(labels, dict):
        labels = df.sparkSession.createDataFrame(sorted(labels.items()), "name string, entity string")
    return long.join(labels, "name").select("entity", "date", "y")


def merge_metrics(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row per (entity, date) from long frames (entity, date, y), each metric carried forward within its entity."""
    frames = [df.select("entity", "date", F.col("y").alias(name)) for name, df in metrics.items()]
    merged = reduce(lambda a, b: a.join(b, ["entity", "date"], "full"), frames)
    w = Window.partitionBy("entity").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return merged.select("entity", "date", *[F.last(name, True).over(w).alias(name) for name in metrics])


def gap_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per (entity, metric): first valid date and interior gaps (nulls after it)."""
    long = df.unpivot(["entity", "date"], columns, "metric", "y")
    w = Window.partitionBy("entity", "metric")
    long = long.withColumn("first_valid", F.min(F.when(F.col("y").isNotNull(), F.col("date"))).over(w))
    return long.groupBy("entity", "metric").agg(
        F.min("first_valid").alias("first_valid"), F.sum(F.when(F.col("y").isNull() & (F.col("date") > F.col("first_valid")), 1).otherwise(0)).alias("interior_gaps")
    )


def with_availability(df: DataFrame, lag_days: dict[str, int], default: int = 0) -> DataFrame:
    """available_date = obs_date + the series' publication lag; rows without a value go."""
    lag: Column = F.lit(default)
    for name, days in lag_days.items():
        lag = F.when(F.col("series") == name, F.lit(days)).otherwise(lag)
    return df.where(F.col("value").isNotNull()).withColumn("available_date", F.date_add("obs_date", lag))


def week_grid(spark: SparkSession, start: str, end: str, anchor: str = "Mon") -> DataFrame:
    """Every `anchor` weekday from start to end."""
    first = F.next_day(F.date_sub(F.lit(start).cast("date"), 1), anchor)
    return spark.range(1).select(F.explode(F.sequence(first, F.lit(end).cast("date"), F.expr("interval 7 days"))).alias("date"))


def build_static(population: DataFrame, area: DataFrame) -> DataFrame:
    """Attributes of each entity: the sources joined, density = population / area (null where there is no area)."""
    return population.join(area, "entity", "left").withColumn("density", F.try_divide(F.col("population"), F.col("area")))


def crosswalk(df: DataFrame, state: str, county: str, entity: str) -> DataFrame:
    """(code, entity): two-digit state and three-digit county, zero-padded; rows with a missing part go."""
    df = df.where(F.col(state).isNotNull() & F.col(county).isNotNull() & F.col(entity).isNotNull())
    code = F.concat(F.lpad(F.col(state).cast("string"), 2, "0"), F.lpad(F.col(county).cast("string"), 3, "0"))
    return df.select(code.alias("code"), F.col(entity).alias("entity")).distinct()


def impact_counts(events: DataFrame, xwalk: DataFrame, entities: DataFrame, damage: list[str]) -> DataFrame:
    """Events with any damage per entity; entities without one count 0."""
    hit = events.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0)) > 0 for c in damage]))
    counted = hit.join(xwalk, "code").groupBy("entity").agg(F.count("*").alias("n_events"))
    return entities.select("entity").distinct().join(counted, "entity", "left").select("entity", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def expand_active_weeks(events: DataFrame, anchor: str = "Mon") -> DataFrame:
    """(entity, event, week): a row per anchor weekday on which the event was active; missing begin or end is the other, end >= begin."""
    begin = F.coalesce("begin_date", "end_date")
    end = F.greatest(F.coalesce("end_date", "begin_date"), begin)
    first = F.next_day(F.date_sub(begin, 1), anchor)
    weeks = F.when(first <= end, F.sequence(first, end, F.expr("interval 7 days")))
    return events.where(begin.isNotNull()).select("entity", "event", F.explode(weeks).alias("week")).distinct()


def attach_interpretation(weekly: DataFrame, interpretations: DataFrame) -> DataFrame:
    """The one interpretation of each (entity, event), of least values on ties, on every active week."""
    others = [c for c in interpretations.columns if c not in ("entity", "event")]
    one = interpretations.groupBy("entity", "event").agg(F.min(F.struct(*others)).alias("x")).select("entity", "event", "x.*")
    return weekly.join(one, ["entity", "event"], "left")


def import_external(cells: DataFrame, forecasts: DataFrame, channel: str) -> DataFrame:
    """cells (entity, origin, h, step, ...) with yhat of an external system; a cell keeps it only with exactly h steps present."""
    joined = cells.join(forecasts.select("entity", "origin", "step", F.col("yhat").alias("_ext")), ["entity", "origin", "step"], "left")
    have = F.count("_ext").over(Window.partitionBy("entity", "origin", "h"))
    return joined.select("entity", "origin", "h", "step", F.lit(channel).alias("channel"), F.when(have == F.col("h"), F.col("_ext")).alias("yhat"))


def missing_cells(store: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys that the store does not hold; a stored null forecast counts as held."""
    return required.select(*keys).distinct().join(store.select(*keys), keys, "left_anti")


def read_cells(store: DataFrame, required: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Stored rows of the required keys; with `strict` a key that is not stored is an error."""
    if strict and (gone := missing_cells(store, required, keys).take(1)):
        raise KeyError(f"not in the store: {gone[0].asDict()}")
    return store.join(required.select(*keys).distinct(), keys, "left_semi")


def write_result(df: DataFrame, path: str, config: dict) -> None:
    """A parquet table that carries its configuration as columns."""
    df.withColumns({f"config_{k}": F.lit(str(v)) for k, v in config.items()}).write.mode("overwrite").parquet(path)


def revision_diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], cap: str | None = None) -> DataFrame:
    """Rows of one panel only, and values that differ (null equals null): keys, change, column, old_value, new_value."""
    if cap:
        old, new = old.where(F.col("date") <= cap), new.where(F.col("date") <= cap)
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("in_old"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("in_new"))
    both = a.join(b, keys, "full")
    gone = both.where("in_old IS NULL OR in_new IS NULL").select(
        *keys, F.when(F.col("in_new").isNull(), "removed").otherwise("added").alias("change"), F.lit("").alias("column"), F.lit(None).cast("double").alias("old_value"), F.lit(None).cast("double").alias("new_value")
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"old_{c}").cast("double").alias("old_value"), F.col(f"new_{c}").cast("double").alias("new_value")) for c in columns])
    changed = both.where("in_old AND in_new").select(*keys, F.lit("changed").alias("change"), F.explode(pairs).alias("x")).select(*keys, "change", "x.*")
    return gone.unionByName(changed.where(~F.col("old_value").eqNullSafe(F.col("new_value"))))


def revision_materiality(diff: DataFrame, total: DataFrame, small: float = 0.005, share: float = 0.01) -> DataFrame:
    """Share of the panel's cells that changed by over `small`, whether it passes `share`, median and largest relative change."""
    relative = F.abs(F.try_divide(F.col("new_value") - F.col("old_value"), F.col("old_value")))
    changed = diff.where("change = 'changed'").agg(
        F.sum(F.when(relative > small, 1).otherwise(0)).alias("n_large"), F.median(relative).alias("median_change"), F.max(relative).alias("max_change")
    )
    joined = changed.crossJoin(total.agg(F.count("*").alias("n_cells")))  # one row each
    part = F.try_divide(F.coalesce("n_large", F.lit(0)), F.col("n_cells"))
    return joined.select(part.alias("share_large"), (part > share).alias("material"), "median_change", "max_change")


def coverage(df: DataFrame) -> DataFrame:
    """Per entity: rows, nulls, date range, leading and interior gaps of y."""
    w = Window.partitionBy("entity")
    df = df.withColumn("_first", F.min(F.when(F.col("y").isNotNull(), F.col("date"))).over(w))
    gap = F.col("y").isNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy("entity").agg(
        F.count("*").alias("n_rows"),
        count(gap).alias("n_null"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        count(gap & (F.col("_first").isNull() | (F.col("date") < F.col("_first")))).alias("leading_gaps"),
        count(gap & (F.col("date") > F.col("_first"))).alias("interior_gaps"),
    )
