"""Weights from validation skill, fusion, selection and attribution.

Weight tables are long: (fold, [regime], h, channel, w). Weight and fold tables are a few rows per fold and are joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guards import in_validation
from .losses import median_skill, recency_skill

TEMPERATURE = 0.05


def _normalised(df: DataFrame, by: list[str], raw: Column) -> DataFrame:
    total = F.sum("_raw").over(Window.partitionBy(*by))
    return df.withColumn("_raw", raw).withColumn("w", F.col("_raw") / total).drop("_raw")


def inverse_loss(errors: DataFrame, by: list[str], power: float = 1.0, column: str = "mape") -> DataFrame:
    """Weights in proportion to 1 / loss^power, losses at least 1e-6."""
    return _normalised(errors, by, F.pow(1 / F.greatest(F.col(column), F.lit(1e-6)), F.lit(power)))


def floored_skill(skills: DataFrame, by: list[str], power: float = 1.0, floor: float = 1e-3) -> DataFrame:
    """Weights in proportion to max(skill, floor)^power."""
    return _normalised(skills, by, F.pow(F.greatest(F.col("skill"), F.lit(floor)), F.lit(power)))


def softmax(skills: DataFrame, by: list[str], temperature: float = TEMPERATURE) -> DataFrame:
    """Weights in proportion to exp(skill / temperature)."""
    top = F.max("skill").over(Window.partitionBy(*by))
    return _normalised(skills.withColumn("_top", top), by, F.exp((F.col("skill") - F.col("_top")) / temperature)).drop("_top")


def fuse(steps: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weighted sum of steps (..., channel, yhat, w), two decimals, not under 0; null where a channel of positive weight is missing."""
    keys = keys or ["entity", "origin", "h", "step"]
    missing = F.max(F.coalesce((F.col("w") > 0) & F.col("yhat").isNull(), F.lit(False)))
    total = F.sum(F.col("w") * F.col("yhat"))
    return steps.groupBy(*keys).agg(F.when(~missing, F.greatest(F.round(total, 2), F.lit(0.0))).alias("yhat"))


def fuse_present(steps: DataFrame, drop: list[str] | None = None, keys: list[str] | None = None, naive: str = "naive") -> DataFrame:
    """Fusion renormalised over the channels that are present and not dropped; the naive forecast where none is left."""
    keys = keys or ["entity", "origin", "h", "step"]
    on = F.col("yhat").isNotNull() & ~F.col("channel").isin(drop or [])
    total = F.sum(F.when(on, F.col("w") * F.col("yhat")))
    weight = F.sum(F.when(on, F.col("w")))
    base = F.max(F.when(F.col("channel") == naive, F.col("yhat")))
    return steps.groupBy(*keys).agg(F.when(F.coalesce(weight, F.lit(0.0)) > 0, total / weight).otherwise(base).alias("yhat"))


def validation(losses: DataFrame, folds: DataFrame, weeks: int = 104, bound_targets: bool = True) -> DataFrame:
    """losses with the fold in whose validation window they lie (a cell may serve several folds)."""
    return in_validation(losses.drop("fold"), folds, weeks, bound_targets)


def fold_weights(val: DataFrame, temperature: float = TEMPERATURE, reference: str = "naive") -> DataFrame:
    """(fold, channel, skill, w) from the median skill pooled over horizons and regimes."""
    return softmax(median_skill(val, ["fold"], reference), ["fold"], temperature)


def regime_weights(val: DataFrame, folds: DataFrame, regimes: list[str], horizons: list[int], temperature: float = TEMPERATURE, reference: str = "naive") -> DataFrame:
    """(fold, regime, h, channel, skill, n, w): every cell of the grid; one without data gets uniform weights."""
    spark = val.sparkSession
    grid = spark.createDataFrame([(r, h) for r in regimes for h in horizons], "regime string, h int")
    full = folds.select("fold").crossJoin(F.broadcast(grid)).crossJoin(val.select("channel").distinct())
    skills = full.join(median_skill(val, ["fold", "regime", "h"], reference), ["fold", "regime", "h", "channel"], "left")
    skills = skills.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("skill", F.coalesce("skill", F.lit(-1.0)))
    return softmax(skills, ["fold", "regime", "h"], temperature)


def horizon_weights(val: DataFrame, temperature: float = TEMPERATURE, reference: str = "naive") -> DataFrame:
    """(fold, h, channel, skill, w)."""
    return softmax(median_skill(val, ["fold", "h"], reference), ["fold", "h"], temperature)


def recency_weights(val: DataFrame, folds: DataFrame, temperature: float = TEMPERATURE, half_life: float = 26.0, reference: str = "naive") -> DataFrame:
    """(fold, h, channel, skill, w) from each fold's median skill, cells weighted by their age at its training end."""
    aged = val.join(F.broadcast(folds.select("fold", "train_end")), "fold")
    return softmax(recency_skill(aged, ["fold", "h"], F.col("train_end"), half_life, reference), ["fold", "h"], temperature)


def with_fallback(grid: DataFrame, fold_w: DataFrame, val: DataFrame, least_weeks: int = 13) -> DataFrame:
    """The grid with fold weights where a (fold, regime, h) has fewer than least_weeks distinct weeks; source says which."""
    weeks = val.groupBy("fold", "regime", "h").agg(F.count_distinct("origin").alias("weeks"))
    joined = grid.join(weeks, ["fold", "regime", "h"], "left").join(fold_w.select("fold", "channel", F.col("w").alias("_f")), ["fold", "channel"])
    enough = F.coalesce("weeks", F.lit(0)) >= least_weeks
    return joined.withColumn("w", F.when(enough, F.col("w")).otherwise(F.col("_f"))).withColumn("source", F.when(enough, "regime").otherwise("fold")).drop("_f", "weeks")


def weigh(steps: DataFrame, mode: str, fold_w: DataFrame, grid: DataFrame | None = None, modes: DataFrame | None = None, by_h: DataFrame | None = None) -> DataFrame:
    """steps (fold, regime, h, channel, ...) with w under fold, regime, horizon, adaptive (modes by fold and h) or granular (and regime)."""
    f = fold_w.select("fold", "channel", F.col("w").alias("_wf"))
    out = steps.join(f, ["fold", "channel"], "left")
    if mode == "fold":
        return out.withColumn("w", F.col("_wf")).drop("_wf")
    if mode == "horizon":
        return out.drop("_wf").join(by_h.select("fold", "h", "channel", "w"), ["fold", "h", "channel"], "left")
    out = out.join(grid.select("fold", "regime", "h", "channel", F.col("w").alias("_wr")), ["fold", "regime", "h", "channel"], "left")
    if mode == "regime":
        return out.withColumn("w", F.col("_wr")).drop("_wf", "_wr")
    keys = ["fold", "h"] + (["regime"] if mode == "granular" else [])
    out = out.join(modes.select(*keys, "mode"), keys, "left")
    return out.withColumn("w", F.when(F.col("mode") == "regime", F.col("_wr")).otherwise(F.col("_wf"))).drop("_wf", "_wr", "mode")


def fused_losses(steps: DataFrame, extra: list[str]) -> DataFrame:
    """Losses of the fused forecast of weighted steps, by the extra keys and cell."""
    keys = [*extra, "entity", "origin", "h", "step"]
    actual = steps.groupBy(*keys).agg(F.first("y").alias("y"))
    both = fuse(steps, keys).join(actual, keys)
    value = F.abs(F.try_divide(F.col("y") - F.col("yhat"), F.col("y")))
    diff = F.col("y") - F.col("yhat")
    return both.groupBy(*extra, "entity", "origin", "h").agg((F.avg(value) * 100).alias("mape"), F.sqrt(F.avg(diff * diff)).alias("rmse"))


def select_modes(val_steps: DataFrame, fold_w: DataFrame, grid: DataFrame, by_regime: bool = False) -> DataFrame:
    """(fold, h[, regime], mode, fold_mape, regime_mape): regime only where its validation loss is less and finite."""
    extra = ["fold", "regime"]
    keys = ["fold", "h"] + (["regime"] if by_regime else [])
    a = fused_losses(weigh(val_steps, "fold", fold_w), extra).groupBy(*keys).agg(F.avg("mape").alias("fold_mape"))
    b = fused_losses(weigh(val_steps, "regime", fold_w, grid), extra).groupBy(*keys).agg(F.avg("mape").alias("regime_mape"))
    better = F.coalesce(F.round("regime_mape", 9) < F.round("fold_mape", 9), F.lit(False))
    return a.join(b, keys).select(*keys, F.when(better, "regime").otherwise("fold").alias("mode"), "fold_mape", "regime_mape")


def gating_rules(grid: DataFrame, overall: DataFrame, gap: float = 0.10, thin: int = 30) -> DataFrame:
    """(fold, rule): channels that lose to the reference in a regime and trail their overall skill; notes for thin cells."""
    joined = grid.join(overall.select("fold", "h", "channel", F.col("skill").alias("all_skill")), ["fold", "h", "channel"])
    bad = (F.col("skill") < 0) & (F.col("all_skill") - F.col("skill") > gap) & (F.col("n") > 0)
    note = F.when(F.col("n") < thin, F.format_string(" (n=%d)", F.col("n").cast("int"))).otherwise("")
    return joined.where(bad).select("fold", "h", "regime", "channel", F.concat(F.format_string("down-weight %s in %s at %d weeks", "channel", "regime", F.col("h").cast("int")), note).alias("rule"))


def report(weights: DataFrame, modes: DataFrame, rules: DataFrame) -> DataFrame:
    """(fold, h, mode, weights, n_rules, sentence): the weights in use as a map, the mode and the rules."""
    w = weights.groupBy("fold", "h").agg(F.array_sort(F.collect_list(F.struct("channel", F.round("w", 4).alias("w")))).alias("weights"))
    r = rules.groupBy("fold", "h").agg(F.count("*").alias("n_rules"))
    out = w.join(modes.select("fold", "h", "mode"), ["fold", "h"]).join(r, ["fold", "h"], "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)))
    listed = F.array_join(F.transform("weights", lambda x: F.concat_ws("=", x["channel"], F.format_string("%.4f", x["w"]))), ", ")
    return out.select("fold", "h", "mode", listed.alias("weights"), "n_rules", F.format_string("fold %d, %d weeks: %s weights", F.col("fold").cast("int"), F.col("h").cast("int"), "mode").alias("sentence"))


def tuned_router(val_skills: DataFrame, val_steps: DataFrame, temperatures: list[float], shrinkages: list[float]) -> DataFrame:
    """(fold, h, temperature, shrinkage, mape): softmax weights shrunk to uniform, the grid point of least validation loss; ties to the smallest."""
    grid = val_skills.sparkSession.createDataFrame([(float(t), float(s)) for t in temperatures for s in shrinkages], "temperature double, shrinkage double")
    w = Window.partitionBy("fold", "h", "temperature", "shrinkage")
    rows = val_skills.crossJoin(F.broadcast(grid))
    rows = rows.withColumn("e", F.exp((F.col("skill") - F.max("skill").over(w)) / F.col("temperature")))
    rows = rows.withColumn("w", (1 - F.col("shrinkage")) * F.col("e") / F.sum("e").over(w) + F.col("shrinkage") / F.count("*").over(w))
    steps = val_steps.join(rows.select("fold", "h", "channel", "temperature", "shrinkage", "w"), ["fold", "h", "channel"])
    loss = fused_losses(steps, ["fold", "temperature", "shrinkage"]).groupBy("fold", "h", "temperature", "shrinkage").agg(F.round(F.avg("mape"), 9).alias("mape"))
    best = loss.groupBy("fold", "h").agg(F.min(F.struct("mape", "temperature", "shrinkage")).alias("x"))
    return best.select("fold", "h", "x.temperature", "x.shrinkage", "x.mape")


def delta_fusion(val_steps: DataFrame, base: str, a: str, b: str) -> DataFrame:
    """(fold, h, b1, b2): non-negative least squares of the base channel's relative error on those of two others against it."""
    keys = ["fold", "entity", "origin", "h", "step"]
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("yhat")))
    rows = val_steps.groupBy(*keys).agg(F.first("y").alias("y"), pick(base).alias("f0"), pick(a).alias("f1"), pick(b).alias("f2")).where("f0 > 0")
    rows = rows.select("fold", "h", (F.col("y") / F.col("f0") - 1).alias("z"), (F.col("f1") / F.col("f0") - 1).alias("p"), (F.col("f2") / F.col("f0") - 1).alias("q"))
    s = rows.groupBy("fold", "h").agg(*[F.sum(F.col(i) * F.col(j)).alias(i + j) for i, j in ("pp", "pq", "qq", "pz", "qz")])
    det = F.col("pp") * F.col("qq") - F.col("pq") * F.col("pq")
    u1 = F.try_divide(F.col("pz") * F.col("qq") - F.col("qz") * F.col("pq"), det)
    u2 = F.try_divide(F.col("qz") * F.col("pp") - F.col("pz") * F.col("pq"), det)
    only1 = F.greatest(F.coalesce(F.try_divide(F.col("pz"), F.col("pp")), F.lit(0.0)), F.lit(0.0))
    only2 = F.greatest(F.coalesce(F.try_divide(F.col("qz"), F.col("qq")), F.lit(0.0)), F.lit(0.0))
    inside = F.coalesce((u1 >= 0) & (u2 >= 0), F.lit(False))
    # Outside the quadrant the solution has one coefficient at 0: the one whose use lowers the error more.
    first = only1 * F.col("pz") >= only2 * F.col("qz")
    return s.select("fold", "h", F.when(inside, u1).when(first, only1).otherwise(0.0).alias("b1"), F.when(inside, u2).when(first, 0.0).otherwise(only2).alias("b2"))


def select_best(losses: DataFrame, candidates: list[str], by: list[str] | None = None) -> DataFrame:
    """(fold, h, channel, mape): the candidate of least validation loss; list order breaks ties."""
    by = by or ["fold", "h"]
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("channel"))
    m = losses.where(F.col("channel").isin(candidates)).groupBy(*by, "channel").agg(F.round(F.avg("mape"), 9).alias("mape"))
    best = m.groupBy(*by).agg(F.min(F.struct("mape", rank.alias("rank"), "channel")).alias("x"))
    return best.select(*by, "x.channel", "x.mape")


def promote(val: DataFrame, test: DataFrame, base: str, least_folds: int = 5) -> DataFrame:
    """(h, channel, val_win, folds_better, promoted): better than the base in validation and in least_folds test folds."""
    def against(df: DataFrame, by: list[str]) -> DataFrame:
        m = df.groupBy(*by, "channel").agg(F.avg("mape").alias("m"))
        b = m.where(F.col("channel") == base).select(*by, F.col("m").alias("b"))
        return m.where(F.col("channel") != base).join(b, by)

    v = against(val, ["h"]).select("h", "channel", (F.col("m") < F.col("b")).alias("val_win"))
    t = against(test, ["fold", "h"]).groupBy("h", "channel").agg(F.sum(F.when(F.col("m") < F.col("b"), 1).otherwise(0)).alias("folds_better"))
    return v.join(t, ["h", "channel"]).withColumn("promoted", F.col("val_win") & (F.col("folds_better") >= least_folds))


def attribution(steps: DataFrame, origins: DataFrame) -> DataFrame:
    """steps with level_part = w yhat and change_part = w (yhat - y0), and each one's share of the absolute total of the step."""
    rows = steps.join(origins.select("entity", "origin", "y0"), ["entity", "origin"])
    rows = rows.withColumn("level_part", F.col("w") * F.col("yhat")).withColumn("change_part", F.col("w") * (F.col("yhat") - F.col("y0")))
    w = Window.partitionBy("entity", "origin", "h", "step")
    return rows.withColumn("change_share", F.try_divide(F.abs("change_part"), F.sum(F.abs("change_part")).over(w))).withColumn("level_share", F.try_divide(F.col("level_part"), F.sum("level_part").over(w)))


def weight_profile(weights: DataFrame, naive_like: list[str]) -> DataFrame:
    """(fold, regime, source, channel, mean_w) with the share of weight on naive-like channels of the group."""
    m = weights.groupBy("fold", "regime", "source", "channel").agg(F.avg("w").alias("mean_w"))
    w = Window.partitionBy("fold", "regime", "source")
    return m.withColumn("naive_share", F.sum(F.when(F.col("channel").isin(naive_like), F.col("mean_w")).otherwise(0.0)).over(w))


def weight_changes(weights: DataFrame) -> DataFrame:
    """(fold, channel, change): absolute change of a channel's weight since the fold before."""
    past = weights.select((F.col("fold") + 1).alias("fold"), "channel", F.col("w").alias("_past"))
    return weights.join(past, ["fold", "channel"]).select("fold", "channel", F.abs(F.col("w") - F.col("_past")).alias("change"))


def in_use(fold_w: DataFrame, grid: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """(fold, regime, h, channel, w, source, mode): the weights that a run uses for each cell of the grid.

    With modes (fold, h, mode) the regime's weights where the mode says so, and where they came from; without, the fold's everywhere.
    """
    rows = grid.select("fold", "regime", "h", "channel", F.col("w").alias("_r"), "source").join(fold_w.select("fold", "channel", F.col("w").alias("_f")), ["fold", "channel"])
    rows = rows.join(modes.select("fold", "h", "mode"), ["fold", "h"], "left") if modes is not None else rows.withColumn("mode", F.lit("fold"))
    own = F.coalesce(F.col("mode") == "regime", F.lit(False))
    return rows.select("fold", "regime", "h", "channel", F.when(own, F.col("_r")).otherwise(F.col("_f")).alias("w"), F.when(own, F.col("source")).otherwise("fold").alias("source"), "mode")


def config_audit(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Two runs' weights in use, cell by cell: (keys, largest_move, moved, source_flipped, mode_flipped); a cell or channel of one run only counts as weight 0."""
    side = lambda df, n: df.select(*keys, "channel", *[F.col(c).alias(f"{c}_{n}") for c in ("w", "source", "mode")])
    both = side(a, "a").join(side(b, "b"), [*keys, "channel"], "full")
    move = F.max(F.abs(F.coalesce("w_a", F.lit(0.0)) - F.coalesce("w_b", F.lit(0.0))))
    flipped = lambda c: F.max(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")))
    rows = both.groupBy(*keys).agg(move.alias("largest_move"), flipped("source").alias("source_flipped"), flipped("mode").alias("mode_flipped"))
    return rows.select(*keys, "largest_move", (F.col("largest_move") > tolerance).alias("moved"), "source_flipped", "mode_flipped")


def fixed_weights(steps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """steps of the named channels with the given weights."""
    table = steps.sparkSession.createDataFrame(sorted(weights.items()), "channel string, w double")
    return steps.join(F.broadcast(table), "channel")


def final_system(val_losses: DataFrame, test_steps: DataFrame, members: DataFrame, temperature: float = TEMPERATURE, reference: str = "naive") -> DataFrame:
    """Losses of the assembled system: weights of each fold's and horizon's members (fold, h, channel), fused on the test cells.

    Members are scored against the reference channel, which gets no weight unless it is a member.
    """
    skills = median_skill(val_losses, ["fold", "h"], reference).join(F.broadcast(members), ["fold", "h", "channel"], "left_semi")
    w = softmax(skills, ["fold", "h"], temperature)
    return fused_losses(test_steps.join(w.select("fold", "h", "channel", "w"), ["fold", "h", "channel"]), ["fold", "regime"])
