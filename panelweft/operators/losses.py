"""Losses of forecast cells and their aggregates.

cell_steps (entity, origin, h, step, channel, y, yhat); losses (entity, origin, h, channel, mape, rmse, mae), joined as needed with
fold, regime and flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import correlation


def ape(y: str = "y", f: str = "yhat") -> Column:
    return F.abs(F.try_divide(F.col(y) - F.col(f), F.col(y)))


def cell_steps(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecasts (channel, entity, origin[, h], step, yhat) beside the actual values of every cell."""
    keys = ["entity", "origin", "step"] + (["h"] if "h" in forecasts.columns else [])
    return actuals.join(forecasts, keys).select("entity", "origin", "h", "step", "target_date", "channel", "y", "yhat")


def cell_losses(cells: DataFrame, fraction: bool = False) -> DataFrame:
    """(entity, origin, h, channel, mape, rmse, mae) over the finite terms of each cell; null where there is none."""
    diff = F.col("y") - F.col("yhat")
    scale = 1.0 if fraction else 100.0
    return cells.groupBy("entity", "origin", "h", "channel").agg(
        (F.avg(ape()) * scale).alias("mape"), F.sqrt(F.avg(diff * diff)).alias("rmse"), F.avg(F.abs(diff)).alias("mae")
    )


def regime_results(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean loss and number of origins per group; rmse is the mean of the cells' rmse."""
    return losses.groupBy(*(by or ["fold", "entity", "h", "regime", "channel"])).agg(F.avg("mape").alias("mape"), F.avg("rmse").alias("rmse"), F.count("*").alias("n_origins"))


def headline(losses: DataFrame, mode: str = "cells") -> DataFrame:
    """(channel, h, mape): mean over cells, over group rows, or over group rows weighted by their origins."""
    if mode == "cells":
        return losses.groupBy("channel", "h").agg(F.avg("mape").alias("mape"))
    rows = regime_results(losses)
    if mode == "rows":
        return rows.groupBy("channel", "h").agg(F.avg("mape").alias("mape"))
    return rows.groupBy("channel", "h").agg((F.sum(F.col("mape") * F.col("n_origins")) / F.sum("n_origins")).alias("mape"))


def entity_skill(losses: DataFrame, reference: str = "naive") -> DataFrame:
    """(channel, h, entity, mape, skill, beats): each entity against the reference."""
    means = losses.groupBy("channel", "h", "entity").agg(F.avg("mape").alias("mape"))
    ref = means.where(F.col("channel") == reference).select("h", "entity", F.col("mape").alias("ref"))
    joined = means.join(ref, ["h", "entity"])
    return joined.select("channel", "h", "entity", "mape", (1 - F.try_divide(F.col("mape"), F.col("ref"))).alias("skill"), (F.round("mape", 9) < F.round("ref", 9)).alias("beats"))


def skill_spread(skills: DataFrame) -> DataFrame:
    """Mean, deviation and range of the skill over entities, and how many beat the reference."""
    return skills.groupBy("channel", "h").agg(
        F.avg("skill").alias("mean_skill"), F.stddev_samp("skill").alias("sd_skill"), F.min("skill").alias("min_skill"), F.max("skill").alias("max_skill"), F.sum(F.col("beats").cast("int")).alias("n_beats")
    )


def win_counts(losses: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Per group: entities where a's mean loss is less than b's, the other way, and equal; mean and median losses."""
    by = by or ["h"]
    m = losses.where(F.col("channel").isin(a, b)).groupBy(*by, "entity").agg(F.avg(F.when(F.col("channel") == a, F.col("mape"))).alias("a"), F.avg(F.when(F.col("channel") == b, F.col("mape"))).alias("b"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return m.groupBy(*by).agg(
        count(F.round("a", 9) < F.round("b", 9)).alias("a_wins"), count(F.round("a", 9) > F.round("b", 9)).alias("b_wins"), count(F.round("a", 9) == F.round("b", 9)).alias("ties"),
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.median("a").alias("median_a"), F.median("b").alias("median_b"),
    )


def best_of(losses: DataFrame) -> DataFrame:
    """(h, channel, n_best): entities for which the channel has the least mean loss; ties to the first name."""
    m = losses.groupBy("h", "entity", "channel").agg(F.round(F.avg("mape"), 9).alias("m"))
    best = m.groupBy("h", "entity").agg(F.min_by("channel", F.struct("m", "channel")).alias("channel"))
    return best.groupBy("h", "channel").agg(F.count("*").alias("n_best"))


def with_reference(losses: DataFrame, reference: str = "naive", column: str = "mape") -> DataFrame:
    """losses with ref, the reference channel's loss of the same cell (one, even where the cell serves several folds)."""
    ref = losses.where(F.col("channel") == reference).groupBy("entity", "origin", "h").agg(F.first(column).alias("ref"))
    return losses.join(ref, ["entity", "origin", "h"])


def median_skill(losses: DataFrame, by: list[str], reference: str = "naive") -> DataFrame:
    """(by, channel, skill, n): median of 1 - loss / reference loss over cells with a positive reference; a failed cell is -1, no cell -1."""
    cells = with_reference(losses, reference)
    point = F.when(F.col("ref") > 0, F.when(F.col("mape").isNull(), -1.0).otherwise(1 - F.col("mape") / F.col("ref")))
    return cells.groupBy(*by, "channel").agg(F.coalesce(F.median(point), F.lit(-1.0)).alias("skill"), F.count(point).alias("n"))


def pooled_skill(losses: DataFrame, by: list[str], reference: str = "naive", column: str = "mape") -> DataFrame:
    """1 - mean loss / mean reference loss."""
    cells = with_reference(losses, reference, column)
    return cells.groupBy(*by, "channel").agg((1 - F.try_divide(F.avg(column), F.avg("ref"))).alias("skill"))


def recency_skill(losses: DataFrame, by: list[str], end: str | Column, half_life: float = 26.0, reference: str = "naive") -> DataFrame:
    """Weighted median of the cells' skill, weight 0.5 ^ (age in weeks at `end` / half life): the first cell at half of the weight."""
    cells = with_reference(losses, reference).where("ref > 0 AND mape IS NOT NULL")
    age = F.datediff(F.lit(end).cast("date"), "origin") / 7
    cells = cells.select(*by, "channel", "entity", "origin", "h", F.round(1 - F.col("mape") / F.col("ref"), 9).alias("s"), F.pow(F.lit(0.5), age / half_life).alias("w"))
    keys = [*dict.fromkeys([*by, "channel"])]
    w = Window.partitionBy(*keys)
    run = F.sum("w").over(w.orderBy("s", "entity", "origin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(w)
    return cells.withColumn("part", run).where(F.col("part") >= 0.5 - 1e-12).groupBy(*keys).agg(F.min("s").alias("skill"))


def relative_mae(losses: DataFrame, reference: str = "naive") -> DataFrame:
    """(channel, h, rel_mae): geometric mean over entities of the ratio of mean absolute errors."""
    m = losses.groupBy("channel", "h", "entity").agg(F.avg("mae").alias("m"))
    ref = m.where(F.col("channel") == reference).select("h", "entity", F.col("m").alias("r"))
    ratio = F.try_divide(F.col("m"), F.col("r"))
    return m.join(ref, ["h", "entity"]).groupBy("channel", "h").agg(F.exp(F.avg(F.when(ratio > 0, F.log(ratio)))).alias("rel_mae"))


def weekly_means(losses: DataFrame, n_entities: int | None = None) -> DataFrame:
    """(channel, h, origin, mape, complete): cross-section mean per week, and whether every entity is in it."""
    out = losses.groupBy("channel", "h", "origin").agg(F.avg("mape").alias("mape"), F.count_distinct("entity").alias("n"))
    if n_entities is None:
        total = losses.agg(F.count_distinct("entity").alias("total"))
        out = out.crossJoin(F.broadcast(total)).withColumn("complete", F.col("n") == F.col("total")).drop("total")
    else:
        out = out.withColumn("complete", F.col("n") == n_entities)
    return out


def by_flag(losses: DataFrame, flagged: DataFrame) -> DataFrame:
    """(channel, h, flag, mape, n): cells with and without a flag (entity, origin)."""
    flag = flagged.select("entity", "origin").distinct().withColumn("_f", F.lit(True))
    return losses.join(flag, ["entity", "origin"], "left").groupBy("channel", "h", F.coalesce("_f", F.lit(False)).alias("flag")).agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))


def support(losses: DataFrame) -> DataFrame:
    """(fold, regime, h, weeks): distinct origin weeks."""
    return losses.groupBy("fold", "regime", "h").agg(F.count_distinct("origin").alias("weeks"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a and b with margins; a margin's value is 'all'."""
    counted = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    name = lambda c, g: F.when(F.col(g) == 1, "all").otherwise(F.col(c).cast("string")).alias(c)
    return counted.select(name(a, "_a"), name(b, "_b"), "n")


def pivoted(losses: DataFrame, horizons: list[int]) -> DataFrame:
    """(channel, h4, h8, ...): mean loss by method and horizon."""
    out = losses.groupBy("channel").pivot("h", horizons).agg(F.avg("mape"))
    return out.select("channel", *[F.col(f"`{h}`").alias(f"h{h}") for h in horizons])


def factor_summary(scores: DataFrame, p: float = 0.05) -> DataFrame:
    """Per factor over entities: mean correlation, how many are significant, median p."""
    return scores.groupBy("factor").agg(F.avg("corr").alias("mean_corr"), F.sum(F.when(F.col("p_value") < p, 1).otherwise(0)).alias("n_significant"), F.median("p_value").alias("median_p"))


def gate_report(decisions: DataFrame) -> DataFrame:
    """Counts by trigger with the total (trigger 'all') and the share of all decisions."""
    counts = decisions.rollup("trigger").agg(F.count("*").alias("n"), F.sum(F.col("activate").cast("int")).alias("n_active"), F.grouping("trigger").alias("g"))
    named = counts.select(F.when(F.col("g") == 1, "all").otherwise(F.col("trigger")).alias("trigger"), "n", "n_active")
    total = decisions.agg(F.count("*").alias("total"))
    return named.crossJoin(F.broadcast(total)).select("trigger", "n", "n_active", F.try_divide(F.col("n"), F.col("total")).alias("share"))


def boundary_report(outcomes: DataFrame) -> DataFrame:
    """One row: forecasts, clean, corrected, fell back, mean attempts, violations by kind."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kinds = lambda k: F.sum(F.size(F.filter("violations", lambda v: v == k)))
    return outcomes.agg(
        F.count("*").alias("n"), count(F.size("violations") == 0).alias("n_clean"), count(F.col("corrected")).alias("n_corrected"), count(F.col("fell_back")).alias("n_fell_back"),
        F.avg("attempts").alias("mean_attempts"), kinds("floor").alias("n_floor"), kinds("jump").alias("n_jump"),
    )


def cell_counts(cells: DataFrame, reserved: str) -> DataFrame:
    """(fold, h, n_cells, n_reserved): cells, and those with a target in the reserved window."""
    one = cells.groupBy("fold", "entity", "origin", "h").agg(F.max("target_date").alias("last"))
    return one.groupBy("fold", "h").agg(F.count("*").alias("n_cells"), F.sum(F.when(F.col("last") >= F.lit(reserved).cast("date"), 1).otherwise(0)).alias("n_reserved"))


def repeated_runs(runs: DataFrame) -> DataFrame:
    """(channel, h, mean, sd): a run's mean loss as a fraction, then mean and population deviation over runs."""
    one = runs.groupBy("channel", "h", "run").agg((F.avg("mape") / 100).alias("m"))
    return one.groupBy("channel", "h").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.count("*").alias("n_runs"))


def skill_by_flag(losses: DataFrame, confidence: DataFrame, channel: str, reference: str = "naive") -> DataFrame:
    """One row per h: the channel's skill where an event is live and where not, and the correlation of confidence with skill."""
    cells = with_reference(losses, reference).where(F.col("channel") == channel).join(confidence, ["entity", "origin"], "left")
    skill = F.when(F.col("ref") > 0, 1 - F.col("mape") / F.col("ref"))
    live = F.coalesce("confidence", F.lit(0.0)) > 0
    return cells.groupBy("h").agg(F.avg(F.when(live, skill)).alias("skill_active"), F.avg(F.when(~live, skill)).alias("skill_quiet"), correlation(F.coalesce("confidence", F.lit(0.0)), skill).alias("corr"), F.sum(live.cast("int")).alias("n_active"))


def router_effect(losses: DataFrame) -> DataFrame:
    """(fold, h, effect): summed loss under fold weights less that of the adaptive mode, per cell of the horizon."""
    n = losses.where("mode = 'fold'").groupBy("h").agg(F.count("*").alias("n"))
    sums = losses.groupBy("fold", "h").agg((F.sum(F.when(F.col("mode") == "fold", F.col("mape")).otherwise(0.0)) - F.sum(F.when(F.col("mode") == "adaptive", F.col("mape")).otherwise(0.0))).alias("d"))
    return sums.join(F.broadcast(n), "h").select("fold", "h", (F.col("d") / F.col("n")).alias("effect"))


def headline_with_reserved(losses: DataFrame) -> DataFrame:
    """(channel, h, with_reserved, without_reserved): mean loss over all cells, and over those that do not bleed."""
    return losses.groupBy("channel", "h").agg(F.avg("mape").alias("with_reserved"), F.avg(F.when(~F.col("bleed"), F.col("mape"))).alias("without_reserved"))
