"""Window operators over panels (entity, date, y, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("entity").orderBy("date")


def pct(a: Column, b: Column) -> Column:
    """(a - b) / b; null where b is 0 or missing."""
    return F.try_divide(a - b, b)


def with_row_index(df: DataFrame, by: str = "entity", order: str = "date") -> DataFrame:
    """widx: 1, 2, ... within each entity."""
    return df.withColumn("widx", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def centred_average(df: DataFrame, before: int = 26, after: int = 25, least: int = 26, by: list[str] | None = None) -> DataFrame:
    """cma: mean of rows -before..+after, null with fewer than `least` values. Cut the panel at an origin, or pass by=[entity, origin]."""
    w = Window.partitionBy(*(by or ["entity"])).orderBy("date").rowsBetween(-before, after)
    return df.withColumn("cma", F.when(F.count("y").over(w) >= least, F.avg("y").over(w)))


def centred_average_at(series: DataFrame, origins: DataFrame, before: int = 26, after: int = 25, least: int = 26) -> DataFrame:
    """(entity, origin, date, widx, y, cma) of every row up to each origin, as if the panel ended there.

    A row's average is a difference of running sums, and only its right end is cut at the origin, so each (origin, row) costs one
    lookup instead of a window over the whole history.
    """
    w = by_date().rowsBetween(Window.unboundedPreceding, 0)
    run = series.select("entity", "date", "widx", "y", F.sum("y").over(w).alias("s"), F.count("y").over(w).alias("n"))
    at = run.select("entity", F.col("widx").alias("k"), F.col("s").alias("s_hi"), F.col("n").alias("n_hi"))
    below = run.select("entity", F.col("widx").alias("j"), F.col("s").alias("s_lo"), F.col("n").alias("n_lo"))
    asked = origins.select("entity", "origin", F.col("widx").alias("last")).join(run.select("entity", "date", "widx", "y"), "entity").where("widx <= last")
    asked = asked.withColumn("k", F.least(F.col("widx") + after, F.col("last"))).withColumn("j", F.col("widx") - before - 1)
    found = asked.join(at, ["entity", "k"]).join(below, ["entity", "j"], "left")
    n = F.col("n_hi") - F.coalesce("n_lo", F.lit(0))
    total = F.col("s_hi") - F.coalesce("s_lo", F.lit(0.0))
    return found.select("entity", "origin", "date", "widx", "y", F.when(n >= least, total / n).alias("cma"))


def weekly_change(df: DataFrame, column: str = "y", out: str = "change") -> DataFrame:
    """Change against the row before."""
    return df.withColumn(out, pct(F.col(column), F.lag(column).over(by_date())))


def forward_change(df: DataFrame, h: int, out: str = "forward") -> DataFrame:
    """Relative change over the next h rows, and the plain difference."""
    ahead = F.lead("y", h).over(by_date())
    return df.withColumn(out, pct(ahead, F.col("y"))).withColumn(f"{out}_diff", ahead - F.col("y"))


def regime(df: DataFrame, column: str = "x", rows: int = 13, threshold: float = 0.25, by: str = "entity") -> DataFrame:
    """regime: hiking or cutting where x moved by more than the threshold over `rows` rows, else stable."""
    move = F.col(column) - F.lag(column, rows).over(Window.partitionBy(by).orderBy("date"))
    return df.withColumn("regime", F.when(move > threshold, "hiking").when(move < -threshold, "cutting").otherwise("stable"))


def threshold_sensitivity(df: DataFrame, thresholds: list[float], base: float, near: float, column: str = "x", rows: int = 13) -> DataFrame:
    """Per threshold: labels that flip against the base one; and the rows whose move lies within `near` of the base."""
    moved = df.withColumn("move", F.col(column) - F.lag(column, rows).over(by_date()))
    label = lambda t: F.when(F.col("move") > t, 1).when(F.col("move") < -t, -1).otherwise(0)
    grid = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    both = moved.crossJoin(F.broadcast(grid))
    return both.groupBy("threshold").agg(
        F.count("*").alias("n_rows"),
        F.sum(F.when(label(F.col("threshold")) != label(F.lit(base)), 1).otherwise(0)).alias("n_flipped"),
        F.sum(F.when(F.abs(F.abs("move") - base) <= near, 1).otherwise(0)).alias("n_near"),
    )


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over the rows that have both; null where a side does not vary, which F.corr fails on."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def factor_correlation(df: DataFrame, factors: list[str], as_of: str, h: int, window: int = 52, lookback: int = 104, least: int = 10) -> DataFrame:
    """(entity, factor, corr, n): correlation of each factor with the h-row change ahead, over the last `window` pairs known at as_of; 0 when weak."""
    recent = df.where((F.col("date") <= as_of) & (F.col("date") > F.date_sub(F.lit(as_of).cast("date"), 7 * lookback)))
    ahead = recent.withColumn("z", pct(F.lead("y", h).over(by_date()), F.col("y")))
    long = ahead.unpivot(["entity", "date", "z"], factors, "factor", "x").where("x IS NOT NULL AND z IS NOT NULL")
    last = long.withColumn("_r", F.row_number().over(Window.partitionBy("entity", "factor").orderBy(F.desc("date")))).where(F.col("_r") <= window)
    flat = (F.count("*") < least) | (F.stddev_pop("x") < 1e-12) | (F.stddev_pop("z") < 1e-12)
    return last.groupBy("entity", "factor").agg(F.when(flat, 0.0).otherwise(correlation("x", "z")).alias("corr"), F.count("*").alias("n"))


def error_zscore(df: DataFrame, weeks: int = 12, least: int = 4) -> DataFrame:
    """z: the last one-step error of the naive forecast against the mean and population deviation of those before, `weeks` in all."""
    ape = F.abs(F.try_divide(F.col("y") - F.lag("y").over(by_date()), F.col("y")))
    rows = df.withColumn("ape", ape)
    w = by_date().rowsBetween(-(weeks - 1), -1)
    n, mean, sd = F.count("ape").over(w), F.avg("ape").over(w), F.stddev_pop("ape").over(w)
    z = F.when((n + 1 < least) | F.col("ape").isNull(), None).when(sd < 1e-12, 0.0).otherwise((F.col("ape") - mean) / sd)
    return rows.withColumn("z", z)


def move_zscore(df: DataFrame, rows: int = 4, window: int = 104, least: int = 12) -> DataFrame:
    """z: size of the last `rows`-row move in population deviations of such moves over the window."""
    moves = df.withColumn("move", pct(F.col("y"), F.lag("y", rows).over(by_date())))
    w = by_date().rowsBetween(-(window - rows - 1), 0)
    n, sd = F.count("move").over(w), F.stddev_pop("move").over(w)
    return moves.withColumn("z", F.when(n < least, None).when(sd < 1e-12, 0.0).otherwise(F.abs("move") / sd))


def lagged_move(df: DataFrame, lag: int, span: int = 3, out: str = "recent") -> DataFrame:
    """Change over the `span` steps that end `lag` rows before."""
    return df.withColumn(out, pct(F.lag("y", lag).over(by_date()), F.lag("y", lag + span).over(by_date())))


def strip_common(df: DataFrame) -> DataFrame:
    """own: an index from 1, the running product of 1 + each entity's change beyond the week's mean change over entities; missing changes count 0.

    A factor of 0 or less is multiplied like any other: the index stays 0, or changes its sign.
    """
    moved = weekly_change(df)
    own = F.coalesce(F.col("change") - F.avg("change").over(Window.partitionBy("date")), F.lit(0.0))
    w = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn("_own", own).withColumn("own", F.product(1 + F.col("_own")).over(w)).drop("_own")


def historical_bound(df: DataFrame) -> DataFrame:
    """Per entity: the largest absolute change on record, 1 if there is none."""
    return weekly_change(df).groupBy("entity").agg(F.coalesce(F.max(F.abs("change")), F.lit(1.0)).alias("bound"))


def historical_bound_filled(seen: DataFrame, last: str) -> DataFrame:
    """(entity, n_weeks, bound): rows and historical_bound of the weekly series that filling the gaps of seen (entity, date, y; y not null), up to the week of `last`, would give.

    A filled row repeats the value before it, so all changes of a gap are that of the value against itself: no row is made for a week without a value.
    """
    end = F.lit(last).cast("date")
    ahead = F.coalesce(F.lead("date").over(by_date()), F.date_add(end, 7))
    still = F.when(F.datediff(ahead, "date") > 7, F.abs(pct(F.col("y"), F.col("y"))))
    moved = F.abs(pct(F.col("y"), F.lag("y").over(by_date())))
    n_weeks = (F.floor(F.datediff(end, F.min("date")) / 7) + 1).cast("bigint")
    rows = seen.select("entity", "date", F.greatest(moved, still).alias("_c"))
    return rows.groupBy("entity").agg(n_weeks.alias("n_weeks"), F.coalesce(F.max("_c"), F.lit(1.0)).alias("bound"))


def reversals(df: DataFrame, window: int = 13) -> DataFrame:
    """Per entity: sign changes of the rolling mean's moves (zero moves skipped), mean, deviation and their ratio."""
    w = by_date().rowsBetween(-(window - 1), 0)
    rolled = df.withColumn("_m", F.when(F.count("y").over(w) == window, F.avg("y").over(w)))
    # Rounded, so that equal means in another order of summation are no move.
    signs = rolled.withColumn("_s", F.signum(F.round(F.col("_m") - F.lag("_m").over(by_date()), 9))).where("_s <> 0")
    turned = signs.withColumn("_t", (F.col("_s") != F.lag("_s").over(by_date())).cast("int")).groupBy("entity").agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("reversals"))
    spread = df.groupBy("entity").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), F.try_divide(F.stddev_samp("y"), F.avg("y")).alias("cv"))
    return spread.join(turned, "entity", "left").withColumn("reversals", F.coalesce("reversals", F.lit(0)))


def lagged_change(df: DataFrame, column: str, k: int, lag: int, out: str) -> DataFrame:
    """The k-row difference of a variable, `lag` rows before."""
    return df.withColumn(out, F.lag(column, lag).over(by_date()) - F.lag(column, lag + k).over(by_date()))


def contexts(series: DataFrame, origins: DataFrame, rows: int = 52) -> DataFrame:
    """(entity, origin, context): the last `rows` values up to each origin, oldest first."""
    w = by_date().rowsBetween(-(rows - 1), 0)
    lists = series.select("entity", F.col("date").alias("origin"), F.collect_list("y").over(w).alias("context"))
    return origins.select("entity", "origin").join(lists, ["entity", "origin"]).where(F.size("context") == rows)


def episodes(df: DataFrame, label: str = "regime", by: str = "entity") -> DataFrame:
    """Runs of one label: (entity, label, episode, weeks, first_date, last_date)."""
    w = Window.partitionBy(by).orderBy("date")
    change = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & F.lag("date").over(w).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("_c", change).withColumn("episode", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, label, "episode").agg(F.count("*").alias("weeks"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def label_disagreement(df: DataFrame, label: str = "regime") -> DataFrame:
    """Dates on which entities carry different labels."""
    return df.groupBy("date").agg(F.count_distinct(label).alias("n_labels")).where("n_labels > 1")
