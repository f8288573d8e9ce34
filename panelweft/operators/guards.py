"""Constraints and guards: each returns the violating rows, or the rows with a flag. Nothing is raised but on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBARGO_DAYS = 91
#: Known event types.
EVENT_TYPES = ["hurricane", "flood", "fire", "severe_storm", "tornado", "earthquake", "winter_storm", "pandemic", "policy", "economic", "other"]


def lookahead_violations(df: DataFrame, as_of: str | Column, date: str = "date", lag_days: int = 0) -> DataFrame:
    """Rows dated after as_of less the lag."""
    limit = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return df.where(F.col(date) > F.date_sub(limit, lag_days))


def scoring_guard(cells: DataFrame, reserved: str, cap: str, disclosed: bool = False, strict: bool = False) -> DataFrame:
    """Cells with bleed (a target in the reserved window); past the cap never scored, reserved ones only if disclosed.

    With `strict` a cell that may not be scored is an error; otherwise it goes.
    """
    flagged = cells.withColumn("bleed", F.col("target_date") >= F.lit(reserved).cast("date"))
    bad = F.col("target_date") > F.lit(cap).cast("date")
    if not disclosed:
        bad = bad | F.col("bleed")
    if strict and flagged.where(bad).take(1):
        raise ValueError("a target lies in a window that may not be scored")
    return flagged.where(~bad)


def contract_violations(forecasts: DataFrame, channels: list[str]) -> DataFrame:
    """(entity, origin, h, channel, problem): wrong length, negative or missing value, unknown channel, confidence outside 0..1, channel absent."""
    keys = ["entity", "origin", "h", "channel"]
    confidence = F.col("confidence") if "confidence" in forecasts.columns else F.lit(None).cast("double")
    checks = forecasts.groupBy(*keys).agg(
        (F.count_distinct("step") != F.col("h")).alias("length"),
        (F.max("step") > F.col("h")).alias("step"),
        F.max(F.col("yhat").isNull() | F.isnan("yhat")).alias("missing"),
        F.coalesce(F.min("yhat") < 0, F.lit(False)).alias("negative"),
        (~F.col("channel").isin(channels)).alias("channel_name"),
        F.coalesce(F.max((confidence < 0) | (confidence > 1)), F.lit(False)).alias("confidence"),
    )
    names = ["length", "step", "missing", "negative", "channel_name", "confidence"]
    own = checks.select(*keys, F.explode(F.array(*[F.when(F.col(n), n) for n in names])).alias("problem")).where("problem IS NOT NULL")
    known = forecasts.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    cells = forecasts.select("entity", "origin", "h").distinct().crossJoin(F.broadcast(known))
    absent = cells.join(forecasts.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("absent").alias("problem"))
    return own.unionByName(absent)


def embargo_violations(folds: DataFrame, days: int = EMBARGO_DAYS) -> DataFrame:
    """Folds whose test window starts fewer than `days` days after training ends."""
    gap = F.datediff("test_start", "train_end")
    return folds.withColumn("gap_days", gap).where(gap < days)


def exclude_window(cells: DataFrame, start: str, end: str, any_target: bool = True) -> DataFrame:
    """Cells (entity, origin, h, step rows) without those whose origin or any target (or only the last one) lies in the window."""
    inside = lambda c: F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    target = inside("target_date") if any_target else inside("target_date") & (F.col("step") == F.col("h"))
    bad = cells.where(inside("origin") | target).select("entity", "origin", "h").distinct()
    return cells.join(bad, ["entity", "origin", "h"], "left_anti")


def touches_filled(cells: DataFrame, log: DataFrame, with_origin: bool = False) -> DataFrame:
    """(entity, origin, h, touched): whether a filled date is a target (or the origin)."""
    dates = cells.select("entity", "origin", "h", F.col("target_date").alias("date"))
    if with_origin:
        dates = dates.unionByName(cells.select("entity", "origin", "h", F.col("origin").alias("date")).distinct())
    hit = dates.join(log.select("entity", "date", F.lit(1).alias("_hit")), ["entity", "date"], "left")
    return hit.groupBy("entity", "origin", "h").agg(F.max(F.coalesce("_hit", F.lit(0))).cast("boolean").alias("touched"))


def in_validation(cells: DataFrame, folds: DataFrame, weeks: int = 104, bound_targets: bool = True) -> DataFrame:
    """Cells (entity, origin, h, ...) of each fold's validation window: origin within `weeks` before train_end, last target no later."""
    f = folds.select("fold", "train_end")
    inside = F.col("origin").between(F.date_sub("train_end", 7 * weeks), F.col("train_end"))
    if bound_targets:
        inside = inside & (F.expr("date_add(origin, 7 * h)") <= F.col("train_end"))
    return cells.join(F.broadcast(f), inside).drop("train_end")


def gate_events(events: DataFrame, types: list[str] | None = None, floor: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): unknown type, numbers out of bounds or empty text are rejected; at or under the floor of confidence impact is 0, raw kept."""
    good = (
        F.col("event_type").isin(types or EVENT_TYPES)
        & F.col("impact").between(-1, 1)
        & F.col("confidence").between(0, 1)
        & (F.length(F.trim(F.coalesce("reasoning", F.lit("")))) > 0)
    )
    good = F.coalesce(good, F.lit(False))
    gated = F.col("confidence") <= floor
    accepted = events.where(good).withColumn("raw_impact", F.col("impact")).withColumn("gated", gated).withColumn("impact", F.when(gated, 0.0).otherwise(F.col("impact")))
    return accepted, events.where(~good)


def severity(events: DataFrame, flags: list[str]) -> DataFrame:
    """n_programs (how many flags are set), note (by declaration kind), programs (the set ones, joined), sentence."""
    n = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags), F.lit(0))
    names = F.concat_ws(", ", *[F.when(F.col(f), f) for f in flags])
    note = F.when(F.col("declaration_type") == "DR", "major disaster").when(F.col("declaration_type") == "EM", "emergency").otherwise("other")
    out = events.withColumn("n_programs", n).withColumn("note", note).withColumn("programs", names)
    return out.withColumn("sentence", F.format_string("%s with %d of %d programs: %s", "note", "n_programs", F.lit(len(flags)), F.when(n > 0, F.col("programs")).otherwise("none")))


def rubric_band(events: DataFrame) -> DataFrame:
    """Whether |impact| lies in the band that the number of programs implies: 0-.2, .2-.4, .4-.6, .6-1."""
    n, size = F.least(F.col("n_programs"), F.lit(3)), F.abs("impact")
    low, high = n * 0.2, F.when(n == 3, 1.0).otherwise((n + 1) * 0.2)
    return events.withColumn("band_low", low).withColumn("band_high", high).withColumn("in_band", (size >= low - 1e-9) & (size <= high + 1e-9))


def sign_consistent(events: DataFrame, down: str = "decline|decrease|fall|drop|lower|reduce", up: str = "increase|rise|surge|higher|grow") -> DataFrame:
    """Whether the text's words and the number's sign agree; texts with words of both kinds or neither agree with any."""
    text = F.lower(F.coalesce("reasoning", F.lit("")))
    falls, rises = text.rlike(rf"\b(?:{down})"), text.rlike(rf"\b(?:{up})")
    return events.withColumn("consistent", ~((falls & ~rises & (F.col("impact") > 0)) | (rises & ~falls & (F.col("impact") < 0))))


def short_title(column: str, rules: dict[str, str], default: str = "other") -> Column:
    """The label of the first pattern that the title holds."""
    out: Column | None = None
    for pattern, label in rules.items():
        hit = F.lower(F.col(column)).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if out is not None else F.lit(default)


def calendar_features(df: DataFrame, date: str = "target_date") -> DataFrame:
    """iso_week, month, quarter, spring (weeks 13 to 26), holiday (from the fourth Thursday of November to New Year)."""
    d = F.col(date)
    november = F.make_date(F.year(d), F.lit(11), F.lit(1))
    thanksgiving = F.date_add(F.next_day(F.date_sub(november, 1), "Thu"), 21)
    return df.withColumns(
        {
            "iso_week": F.weekofyear(d),
            "month": F.month(d),
            "quarter": F.quarter(d),
            "spring": F.weekofyear(d).between(13, 26),
            "holiday": (d >= thanksgiving) | ((F.month(d) == 1) & (F.dayofmonth(d) == 1)),
        }
    )


def exogenous_problems(df: DataFrame) -> DataFrame:
    """(factor, problem) of a lag-tagged table (factor, lag, date, value): negative lag, a factor with two lags, a repeated date."""
    negative = df.where("lag < 0").select("factor", F.lit("negative lag").alias("problem"))
    double = df.groupBy("factor").agg(F.count_distinct("lag").alias("n")).where("n > 1").select("factor", F.lit("two lags").alias("problem"))
    repeated = df.groupBy("factor", "date").count().where("count > 1").select("factor", F.lit("repeated date").alias("problem"))
    return negative.unionByName(double).unionByName(repeated).distinct()


def payload_problems(df: DataFrame, a: str = "dates", b: str = "values") -> DataFrame:
    """Rows of array payloads with the reason why they fail: unequal lengths, negative or missing values."""
    problem = (
        F.when(F.size(a) != F.size(b), "length").when(F.exists(b, lambda x: x.isNull()), "missing").when(F.exists(b, lambda x: x < 0), "negative")
    )
    return df.withColumn("problem", problem).where("problem IS NOT NULL")
