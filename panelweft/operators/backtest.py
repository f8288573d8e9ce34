"""Folds, origins, the backtest as one plan, ablation, calibration sweeps and placebos."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.tables import settled
from . import fusion
from .guards import exclude_window, in_validation
from .joins import calendar_targets, fold_of
from .losses import cell_losses, median_skill, regime_results

Channel = Callable[[DataFrame, DataFrame, int], DataFrame]


def fold_table(spark: SparkSession, train_start: str, reserved: str, folds: int = 4, initial_weeks: int = 104, embargo_weeks: int = 13) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end): expanding folds with an embargo, equal test windows before the reserved date."""
    start, limit = date.fromisoformat(train_start), date.fromisoformat(reserved)
    first_test = start + timedelta(weeks=initial_weeks + embargo_weeks)
    weeks = ((limit - first_test).days // 7 - (folds - 1) * embargo_weeks) // folds
    if weeks < 1:
        raise ValueError("the reserved date leaves no test weeks")
    k = F.col("id")
    test_start = F.date_add(F.lit(first_test), (k * 7 * (weeks + embargo_weeks)).cast("int"))
    out = spark.range(folds).select((k + 1).cast("int").alias("fold"), F.lit(start).alias("train_start"), test_start.alias("test_start"))
    out = out.withColumn("train_end", F.date_sub("test_start", 7 * (embargo_weeks + 1))).withColumn("test_end", F.date_add("test_start", 7 * (weeks - 1)))
    return out.select("fold", "train_start", "train_end", "test_start", "test_end")


def origin_set(series: DataFrame, folds: DataFrame, lookback_weeks: int = 104) -> DataFrame:
    """(entity, origin, widx): rows in some fold's validation or test window. folds: a few rows."""
    f = F.broadcast(folds.select("train_end", "test_start", "test_end"))
    inside = F.col("date").between(F.date_sub("train_end", 7 * lookback_weeks), F.col("train_end")) | F.col("date").between(F.col("test_start"), F.col("test_end"))
    return series.join(f, inside, "left_semi").select("entity", F.col("date").alias("origin"), "widx")


def backtest(steps: DataFrame, losses: DataFrame, folds: DataFrame, horizons: list[int], regimes: list[str], mode: str = "adaptive", exclude: tuple[str, str] | None = None, temperature: float = fusion.TEMPERATURE, least_weeks: int = 13) -> DataFrame:
    """(fold, regime, entity, origin, h, mape, rmse) of the fused forecast on the test cells.

    steps (entity, origin, h, step, target_date, channel, y, yhat) and losses carry regime. Weights come from the validation window
    of each fold only: skill against the naive forecast, softmax per fold and per (regime, horizon), and the mode of less
    validation loss.
    """
    if exclude:
        steps, losses = exclude_window(steps, *exclude), losses.join(exclude_window(steps, *exclude).select("entity", "origin", "h").distinct(), ["entity", "origin", "h"], "left_semi")
    val = fusion.validation(losses, folds)
    fold_w = fusion.fold_weights(val, temperature)
    test = fold_of(steps.drop("fold"), folds).where("fold IS NOT NULL")
    if mode == "fold":
        return fusion.fused_losses(fusion.weigh(test, "fold", fold_w), ["fold", "regime"])
    if mode == "horizon":
        return fusion.fused_losses(fusion.weigh(test, "horizon", fold_w, by_h=fusion.horizon_weights(val, temperature)), ["fold", "regime"])
    grid = fusion.with_fallback(fusion.regime_weights(val, folds, regimes, horizons, temperature), fold_w, val, least_weeks)
    modes = None
    if mode in ("adaptive", "granular"):
        modes = fusion.select_modes(in_validation(steps.drop("fold"), folds), fold_w, grid, mode == "granular")
    return fusion.fused_losses(fusion.weigh(test, mode, fold_w, grid, modes), ["fold", "regime"])


def ablation(weighted: DataFrame, channels: list[str], routed: DataFrame | None = None) -> DataFrame:
    """(h, variant, mape, delta): the full fusion, without each channel (weights renormalised), and without the router (other weights)."""
    variants = weighted.sparkSession.createDataFrame([("full", "")] + [(f"no {c}", c) for c in channels], "variant string, gone string")
    rows = weighted.crossJoin(F.broadcast(variants)).withColumn("w", F.when(F.col("channel") == F.col("gone"), 0.0).otherwise(F.col("w")))
    rows = rows.withColumn("yhat", F.when(F.col("channel") == F.col("gone"), None).otherwise(F.col("yhat")))
    if routed is not None:
        rows = rows.unionByName(routed.withColumn("variant", F.lit("no router")).withColumn("gone", F.lit("")))
    keys = ["variant", "entity", "origin", "h", "step"]
    fused = fusion.fuse_present(rows, keys=keys).join(rows.groupBy(*keys).agg(F.first("y").alias("y")), keys)
    mape = fused.groupBy("variant", "entity", "origin", "h").agg((F.avg(F.abs(F.try_divide(F.col("y") - F.col("yhat"), F.col("y")))) * 100).alias("mape"))
    table = mape.groupBy("h", "variant").agg(F.avg("mape").alias("mape"))
    full = table.where("variant = 'full'").select("h", F.col("mape").alias("_full"))
    return table.join(full, "h").select("h", "variant", "mape", (F.col("mape") - F.col("_full")).alias("delta"))


def append_external(table: DataFrame, external: DataFrame, scope: str) -> DataFrame:
    """The table with rows of other systems, labelled with what they were scored on."""
    return table.withColumn("scope", F.lit("all cells")).unionByName(external.withColumn("scope", F.lit(scope)), allowMissingColumns=True)


def contribution(ablated: DataFrame, weights: DataFrame, losses: DataFrame) -> DataFrame:
    """(h, channel, drop_delta, mean_weight, solo_mape)."""
    drop = ablated.where("variant LIKE 'no %'").select("h", F.substring("variant", 4, 100).alias("channel"), F.col("delta").alias("drop_delta"))
    mean = weights.groupBy("h", "channel").agg(F.avg("w").alias("mean_weight"))
    solo = losses.groupBy("h", "channel").agg(F.avg("mape").alias("solo_mape"))
    return drop.join(mean, ["h", "channel"]).join(solo, ["h", "channel"])


def permutation_importance(weighted: DataFrame, channels: list[str], repeats: int = 5, seed: int = 17) -> DataFrame:
    """(h, channel, mean_increase, sd_increase): how much the fused loss grows when a channel's forecasts are dealt to other origins of the entity.

    Positions come from ranks by a draw and by date, joined on (entity, h, channel, repeat): no collect and no loop over repeats.
    """
    spark = weighted.sparkSession
    reps = spark.range(repeats).select(F.col("id").cast("int").alias("rep"))
    origins = weighted.select("entity", "h", "origin").distinct().crossJoin(F.broadcast(reps))
    w = Window.partitionBy("entity", "h", "rep")
    day = F.datediff("origin", F.lit("1970-01-01").cast("date"))
    ranked = origins.withColumn("a", F.row_number().over(w.orderBy("origin"))).withColumn("b", F.row_number().over(w.orderBy(draw(seed, F.col("rep"), day, F.col("h")), "origin")))
    moved = ranked.select("entity", "h", "rep", F.col("a").alias("k"), "origin").join(ranked.select("entity", "h", "rep", F.col("b").alias("k"), F.col("origin").alias("other")), ["entity", "h", "rep", "k"]).drop("k")
    gone = spark.createDataFrame([(c,) for c in channels], "shuffled string")
    y0 = weighted.select("entity", "origin", "h", "step", "channel", "yhat")
    rows = weighted.join(moved, ["entity", "h", "origin"]).crossJoin(F.broadcast(gone))
    other = y0.select("entity", F.col("origin").alias("other"), "h", "step", "channel", F.col("yhat").alias("_o"))
    rows = rows.join(other, ["entity", "other", "h", "step", "channel"]).withColumn("yhat", F.when(F.col("channel") == F.col("shuffled"), F.col("_o")).otherwise(F.col("yhat")))
    broken = fusion.fused_losses(rows, ["shuffled", "rep"]).groupBy("h", "shuffled", "rep").agg(F.avg("mape").alias("m"))
    base = fusion.fused_losses(weighted, []).groupBy("h").agg(F.avg("mape").alias("base"))
    return broken.join(base, "h").groupBy("h", F.col("shuffled").alias("channel")).agg(F.avg(F.col("m") - F.col("base")).alias("mean_increase"), F.stddev_pop(F.col("m") - F.col("base")).alias("sd_increase"))


def sweep(steps: DataFrame, folds: DataFrame, param: str, only: DataFrame | None = None, window: str = "validation") -> DataFrame:
    """(param, fold, mape, n): mean loss of each parameter value over the folds' validation (or test) windows; `only` keeps affected origins.

    steps carry the parameter as a column, so all values run in one plan.
    """
    keys = [param, "entity", "origin", "h"]
    losses = steps.groupBy(*keys).agg((F.avg(F.abs(F.try_divide(F.col("y") - F.col("yhat"), F.col("y")))) * 100).alias("mape"))
    if only is not None:
        losses = losses.join(only.select("entity", "origin").distinct(), ["entity", "origin"], "left_semi")
    placed = in_validation(losses, folds) if window == "validation" else fold_of(losses, folds).where("fold IS NOT NULL")
    return placed.groupBy(param, "fold").agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))


def cap_sweep(actuals: DataFrame, last: DataFrame, levels: DataFrame, folds: DataFrame, caps: list[float]) -> DataFrame:
    """(rho, fold, mape, n): validation loss of the reversion to each fold's levels (fold, entity, level) under every cap of its strength.

    last (entity, origin, y0). A cell is one row with its path inside, so a candidate costs a row per cell and no shuffle of steps.
    """
    path = actuals.groupBy("entity", "origin", "h").agg(F.array_sort(F.collect_list(F.struct("step", "y"))).alias("path"))
    rows = in_validation(path.join(last.select("entity", "origin", "y0"), ["entity", "origin"]), folds).join(F.broadcast(levels), ["fold", "entity"])  # folds x entities
    rows = rows.withColumn("rho", F.explode(F.array(*[F.lit(float(c)) for c in caps])))
    moved = lambda x: F.greatest(F.round(F.col("y0") + F.col("rho") * F.pow(x["step"] / F.col("h"), 2) * (F.col("level") - F.col("y0")), 2), F.lit(0.0))
    terms = F.filter(F.transform("path", lambda x: F.abs(F.try_divide(x["y"] - moved(x), x["y"]))), lambda v: v.isNotNull())
    scored = rows.withColumn("mape", F.try_divide(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v), F.size(terms)) * 100)
    return scored.groupBy("rho", "fold").agg(F.avg("mape").alias("mape"), F.count("*").alias("n"))


def noisy_runs(forecasts: DataFrame, base: DataFrame, runs: int, seed: int = 23, spread: float = 0.5) -> DataFrame:
    """(run, channel, entity, origin, step, yhat): forecasts whose distance from the base (entity, origin, step, yhat) is drawn anew in each run, by origin, within the spread."""
    numbers = forecasts.sparkSession.range(1, runs + 1).select(F.col("id").cast("int").alias("run"))
    rows = forecasts.join(base.select("entity", "origin", "step", F.col("yhat").alias("_base")), ["entity", "origin", "step"]).crossJoin(F.broadcast(numbers))
    day = F.datediff("origin", F.lit("1970-01-01").cast("date"))
    share = 1 + spread * (draw(seed, F.col("run"), day) % 2001 - 1000) / 1000
    return rows.select("run", "channel", "entity", "origin", "step", (F.col("_base") + (F.col("yhat") - F.col("_base")) * share).alias("yhat"))


def consistency(scores: DataFrame, param: str, current: float, dead_band: float = 0.01, least_n: int = 30, least_folds: int = 5) -> DataFrame:
    """(param, better, worse, neutral, mean_change, approved): directions per fold against the current value; the one value that improves in
    enough folds and most on average is approved."""
    base = scores.where(F.col(param) == current).select("fold", F.col("mape").alias("_b"))
    joined = scores.where(F.col(param) != current).join(base, "fold").withColumn("d", F.col("mape") - F.col("_b"))
    way = F.when((F.abs("d") <= dead_band) | (F.col("n") < least_n), 0).otherwise(F.signum("d"))
    count = lambda v: F.sum(F.when(way == v, 1).otherwise(0))
    out = joined.groupBy(param).agg(count(-1).alias("better"), count(1).alias("worse"), count(0).alias("neutral"), F.avg("d").alias("mean_change"))
    good = (F.col("better") >= least_folds) & (F.col("mean_change") < 0)
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.when(good, F.round("mean_change", 9)).asc_nulls_last(), param))
    return out.withColumn("approved", good & (best == 1))


def select_param(scores: DataFrame, param: str) -> DataFrame:
    """(fold, param, mape): the value of least validation loss, ties to the smallest value."""
    best = scores.groupBy("fold").agg(F.min(F.struct(F.round("mape", 9).alias("mape"), param)).alias("x"))
    return best.select("fold", F.col(f"x.{param}").alias(param), "x.mape")


def variants(steps: DataFrame, overrides: dict[str, dict[str, str]], exclude: dict[str, DataFrame] | None = None) -> DataFrame:
    """steps once per variant: overrides says which channel stands in for another; exclude leaves out cells (entity, origin, h)."""
    parts = []
    for name, swaps in overrides.items():
        rows = steps
        for old, new in swaps.items():
            stand = steps.where(F.col("channel") == new).withColumn("channel", F.lit(old))
            rows = rows.where(F.col("channel") != old).unionByName(stand)
        if exclude and name in exclude:
            rows = rows.join(exclude[name].select("entity", "origin", "h").distinct(), ["entity", "origin", "h"], "left_anti")
        parts.append(rows.withColumn("variant", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def same_cells(raw: DataFrame, smooth: DataFrame) -> DataFrame:
    """Losses of the raw and the smoothed series over the cells that both have, with column cut."""
    keys = ["entity", "origin", "h", "channel"]
    both = raw.select(*keys).intersect(smooth.select(*keys))
    return raw.withColumn("cut", F.lit("raw")).unionByName(smooth.withColumn("cut", F.lit("smooth"))).join(both, keys, "left_semi")


def zero_support(grid: DataFrame, test_losses: DataFrame) -> DataFrame:
    """Per (fold, regime, h) of the grid without validation data: test cells and their mean loss by mode."""
    empty = grid.groupBy("fold", "regime", "h").agg(F.max("n").alias("n")).where("n = 0").drop("n")
    return test_losses.join(empty, ["fold", "regime", "h"], "left_semi").groupBy("fold", "regime", "h", "mode").agg(F.count("*").alias("n_cells"), F.avg("mape").alias("mape"))


def gate_value(losses: DataFrame, decisions: DataFrame, full: str, base: str) -> DataFrame:
    """Per h: loss of always base, always full and gated, and what the full path gains where the gate is open and where it is shut."""
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("mape")))
    cells = losses.where(F.col("channel").isin(full, base)).groupBy("entity", "origin", "h").agg(pick(full).alias("f"), pick(base).alias("b"))
    joined = cells.join(decisions.select("entity", "origin", "activate"), ["entity", "origin"])
    gain = F.col("b") - F.col("f")
    return joined.groupBy("h").agg(
        F.avg("b").alias("base"), F.avg("f").alias("full"), F.avg(F.when(F.col("activate"), F.col("f")).otherwise(F.col("b"))).alias("gated"),
        F.avg(F.when(F.col("activate"), gain)).alias("gain_open"), F.avg(F.when(~F.col("activate"), gain)).alias("gain_shut"), F.avg(F.col("activate").cast("double")).alias("activation"),
    )


def placebo_labels(labels: DataFrame, permutations: int, seed: int = 11, block: int = 13) -> DataFrame:
    """(perm, date, regime): labels (date, regime) cut into blocks of rows whose order is permuted; permutation 0 is the true one."""
    w = Window.orderBy("date")  # one row per date of the grid
    numbered = labels.withColumn("i", F.row_number().over(w) - 1).withColumn("blk", F.floor(F.col("i") / block))
    perms = labels.sparkSession.range(permutations + 1).select(F.col("id").cast("int").alias("perm"))
    blocks = numbered.select("blk").distinct().crossJoin(F.broadcast(perms))
    order = F.when(F.col("perm") == 0, F.col("blk")).otherwise(draw(seed, F.col("perm"), F.col("blk")))
    dealt = blocks.withColumn("order", F.row_number().over(Window.partitionBy("perm").orderBy(order, "blk")))
    rows = numbered.join(dealt, "blk").withColumn("j", F.row_number().over(Window.partitionBy("perm").orderBy("order", "i")) - 1)
    return rows.select("perm", "j", "regime").join(numbered.select(F.col("i").alias("j"), "date"), "j").select("perm", "date", "regime")


def _wide(steps: DataFrame) -> DataFrame:
    """One row per cell of steps (fold, entity, origin, h, step, channel, y, yhat): path, its steps with y and the forecasts by channel name."""
    keys = ["fold", "entity", "origin", "h"]
    one = steps.groupBy(*keys, "step").agg(F.first("y").alias("y"), F.array_sort(F.collect_list(F.struct("channel", "yhat"))).alias("fs"))
    one = one.select(*keys, F.struct("step", "y", F.transform("fs", lambda x: x["yhat"]).alias("f")).alias("x"))
    return one.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("path"))


def _path_loss(w: str) -> Column:
    """Mean percentage error of the fusion, two decimals and not under 0, of a path by an array of weights."""
    fused = lambda x: F.greatest(F.round(F.aggregate(F.zip_with(x["f"], w, lambda f, v: f * v), F.lit(0.0), lambda s, v: s + v), 2), F.lit(0.0))
    terms = F.filter(F.transform("path", lambda x: F.abs(F.try_divide(x["y"] - fused(x), x["y"]))), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v), F.size(terms)) * 100


def regime_placebo(steps: DataFrame, losses: DataFrame, folds: DataFrame, labels: DataFrame, horizons: list[int], regimes: list[str], least_weeks: int = 13) -> DataFrame:
    """(perm, h, mape): the adaptive backtest under every labelling (perm, date, regime): weights, fallback, modes and fusion anew for each.

    Cells are one row each with their steps inside, so a labelling costs a row per cell; weight tables are a few rows per labelling.
    """
    val, test = fusion.validation(losses.drop("fold", "regime"), folds), fold_of(steps.drop("fold", "regime"), folds).where("fold IS NOT NULL")
    labels = settled(labels.select("perm", F.col("date").alias("origin"), "regime"), "placebo-labels")
    perms = labels.select("perm").distinct()
    key = (F.col("perm") * 1000 + F.col("fold")).cast("int")  # a fold of its own for each labelling
    fold_w = fusion.fold_weights(val)
    own_w = fold_w.crossJoin(F.broadcast(perms)).withColumn("fold", key)
    relabelled = val.join(labels, "origin").withColumn("fold", key)
    own_folds = folds.select("fold").crossJoin(F.broadcast(perms)).withColumn("fold", key)
    grid = fusion.with_fallback(fusion.regime_weights(relabelled, own_folds, regimes, horizons), own_w, relabelled, least_weeks)
    by_name = lambda w: F.transform(F.array_sort(F.collect_list(F.struct("channel", "w"))), lambda x: x["w"]).alias(w)
    flat = settled(fold_w.groupBy("fold").agg(by_name("wf")), "placebo-fold-weights")
    cells = grid.groupBy("fold", "regime", "h").agg(by_name("wr")).select(F.floor(F.col("fold") / 1000).cast("int").alias("perm"), F.pmod(F.col("fold"), F.lit(1000)).alias("fold"), "regime", "h", "wr")
    cells = settled(cells, "placebo-weights")

    def weighed(rows: DataFrame) -> DataFrame:
        """A row per labelling and cell, with its loss under fold and under regime weights."""
        rows = rows.join(F.broadcast(flat), "fold").withColumn("lf", _path_loss("wf")).drop("wf")
        return rows.join(F.broadcast(labels), "origin").join(F.broadcast(cells), ["perm", "fold", "regime", "h"]).withColumn("lr", _path_loss("wr"))

    tried = weighed(_wide(in_validation(steps.drop("fold", "regime"), folds))).groupBy("perm", "fold", "h").agg(F.avg("lf").alias("f"), F.avg("lr").alias("r"))
    modes = tried.select("perm", "fold", "h", F.coalesce(F.round("r", 9) < F.round("f", 9), F.lit(False)).alias("by_regime"))
    scored = weighed(_wide(test)).join(F.broadcast(modes), ["perm", "fold", "h"])
    return scored.groupBy("perm", "h").agg(F.avg(F.when(F.col("by_regime"), F.col("lr")).otherwise(F.col("lf"))).alias("mape"))


def by_period(rows: DataFrame, split: str, before: str, after: str) -> DataFrame:
    """rows whose regime is that of a period: `before` for origins before the date `split`, else `after`."""
    return rows.withColumn("regime", F.when(F.col("origin") < F.lit(split).cast("date"), before).otherwise(after))


def by_horizon(fused: DataFrame) -> DataFrame:
    """(h, mape, n_cells): mean loss of the fused test cells."""
    return fused.groupBy("h").agg(F.avg("mape").alias("mape"), F.count("*").alias("n_cells"))


def placebo_share(losses: DataFrame) -> DataFrame:
    """(h, true_mape, placebo_mean, share_better): how often a permuted labelling does better than the true one. losses carry perm."""
    m = losses.groupBy("h", "perm").agg(F.avg("mape").alias("m"))
    true = m.where("perm = 0").select("h", F.col("m").alias("true_mape"))
    return m.where("perm > 0").join(true, "h").groupBy("h").agg(F.first("true_mape").alias("true_mape"), F.avg("m").alias("placebo_mean"), F.avg((F.col("m") < F.col("true_mape")).cast("double")).alias("share_better"))


def single_split(steps: DataFrame, losses: DataFrame, train_end: str, embargo_weeks: int = 13) -> DataFrame:
    """Fused test losses of one split: weights from the 104 weeks before train_end, test origins after the embargo."""
    spark = steps.sparkSession
    start = F.date_add(F.lit(train_end).cast("date"), 7 * (embargo_weeks + 1))
    fold = spark.range(1).select(F.lit(1).alias("fold"), F.lit(train_end).cast("date").alias("train_end"), start.alias("test_start"), F.lit("9999-12-31").cast("date").alias("test_end"))
    return backtest(steps, losses, fold, [], [], "fold")


def single_split_systems(steps: DataFrame, losses: DataFrame, train_end: str, blended: list[str], embargo_weeks: int = 13) -> DataFrame:
    """(system, entity, origin, h, mape, rmse) of one split: each channel, the equal-weight blend of some, and the fusion by validation skill, on the same cells."""
    start = F.date_add(F.lit(train_end).cast("date"), 7 * (embargo_weeks + 1))
    fused = single_split(steps, losses, train_end, embargo_weeks).select(F.lit("fusion").alias("system"), "entity", "origin", "h", "mape", "rmse")
    test = steps.where(F.col("origin") >= start)
    members = test.where(F.col("channel").isin(blended)).withColumn("w", F.lit(1.0 / len(blended)))
    blend = fusion.fused_losses(members, []).select(F.lit("blend").alias("system"), "entity", "origin", "h", "mape", "rmse")
    solo = losses.where(F.col("origin") >= start).select(F.col("channel").alias("system"), "entity", "origin", "h", "mape", "rmse")
    cells = fused.select("entity", "origin", "h").intersect(blend.select("entity", "origin", "h"))
    return fused.unionByName(blend).unionByName(solo).join(cells, ["entity", "origin", "h"], "left_semi")


def holdout_table(folds: DataFrame, reserved: str, cap: str, embargo_weeks: int = 13) -> DataFrame:
    """(part, fold, train_start, train_end, test_start, test_end): `pseudo` goes on from the last fold's training end up to the reserved window;
    `holdout` trains up to the embargo before that window and tests inside it, up to the cap."""
    first, last_day = F.lit(reserved).cast("date"), F.lit(cap).cast("date")
    last = folds.agg(F.max(F.struct("fold", "train_start", "train_end", "test_start")).alias("x")).select("x.*")
    pseudo = last.select(F.lit("pseudo").alias("part"), (F.col("fold") + 1).alias("fold"), "train_start", "train_end", "test_start", F.date_sub(first, 1).alias("test_end"))
    final = last.select(F.lit("holdout").alias("part"), (F.col("fold") + 2).alias("fold"), "train_start", F.date_sub(first, 7 * (embargo_weeks + 1)).alias("train_end"), first.alias("test_start"), last_day.alias("test_end"))
    return pseudo.unionByName(final)


def scorable(series: DataFrame, reserved: str, cap: str, disclosed: str | None = None) -> DataFrame:
    """The rows that may be targets: none past the cap, and none of the reserved window unless its use is disclosed, in words.

    Actuals made of these rows have no cell that reaches further, so there is nothing to leave out of a score later.
    """
    rows = series.where(F.col("date") <= F.lit(cap).cast("date"))
    if disclosed is None:
        return rows.where(F.col("date") < F.lit(reserved).cast("date"))
    if not disclosed.strip():
        raise ValueError("the reserved window opens only for a stated reason")
    return rows


def holdout(steps: DataFrame, fold: DataFrame, members: DataFrame, reference: str, external: str | None = None, temperature: float = fusion.TEMPERATURE) -> DataFrame:
    """(system, entity, origin, h, mape) on the test cells of one fold: every channel, the fusion of the members (fold, h, channel), and that with the external channel.

    Weights are validation skills against the reference. The external channel has a weight like a member; where it lacks a cell the others share it.
    """
    losses = settled(cell_losses(steps), "losses")
    own = members.select("fold", "h", "channel")
    if external:
        own = own.unionByName(members.select("fold", "h", F.lit(external).alias("channel")).distinct())
    skills = median_skill(fusion.validation(losses, fold), ["fold", "h"], reference).join(F.broadcast(own), ["fold", "h", "channel"], "left_semi")
    test = fold_of(steps, fold).where("fold IS NOT NULL")
    weighted = test.join(F.broadcast(fusion.softmax(skills, ["fold", "h"], temperature).select("fold", "h", "channel", "w")), ["fold", "h", "channel"])
    keys = ["entity", "origin", "h", "step"]
    y = weighted.groupBy(*keys).agg(F.first("y").alias("y"))
    parts = [fold_of(losses, fold).where("fold IS NOT NULL").select(F.col("channel").alias("system"), "entity", "origin", "h", "mape")]
    for name, gone in [("system", [external] if external else [])] + ([("system with external", [])] if external else []):
        fused = fusion.fuse_present(weighted, gone, keys).join(y, keys).withColumn("channel", F.lit(name))
        parts.append(cell_losses(fused).select(F.col("channel").alias("system"), "entity", "origin", "h", "mape"))
    return reduce(DataFrame.unionByName, parts)


def single_origin(series: DataFrame, forecasts: DataFrame, folds: DataFrame, horizons: DataFrame) -> DataFrame:
    """(fold, entity, h, channel, ape): forecasts made at train_end against the value exactly h weeks later."""
    origins = series.join(F.broadcast(folds.select("fold", F.col("train_end").alias("origin"))), F.col("date") == F.col("origin")).select("fold", "entity", "origin")
    targets = calendar_targets(series, origins.select("entity", "origin").distinct(), horizons)
    joined = targets.join(forecasts.withColumnRenamed("step", "h"), ["entity", "origin", "h"]).join(origins, ["entity", "origin"])
    return joined.select("fold", "entity", "h", "channel", (F.abs(F.try_divide(F.col("y") - F.col("yhat"), F.col("y"))) * 100).alias("ape"))


def event_provenance(steps: DataFrame, events: DataFrame) -> DataFrame:
    """(h, event, n_cells): cells in which the event channel differs from the naive one, by the live event."""
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("yhat")))
    cells = steps.groupBy("entity", "origin", "h", "step").agg(pick("event_scaled").alias("e"), pick("naive").alias("n")).where("e <> n").select("entity", "origin", "h").distinct()
    return cells.join(events.select("entity", "origin", "event"), ["entity", "origin"]).groupBy("h", "event").agg(F.count("*").alias("n_cells"))


def results(fused: DataFrame) -> DataFrame:
    """Rows of the result table: (fold, entity, h, regime, mape, rmse, n_origins)."""
    return regime_results(fused, ["fold", "entity", "h", "regime"])


def losses_with_regime(steps: DataFrame, regimes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, losses) with the regime (origin, regime) of each origin."""
    steps = steps.join(regimes.select("origin", "regime"), "origin")
    losses = cell_losses(steps).join(regimes.select("origin", "regime"), "origin")
    return steps, losses


def literal_grid(spark: SparkSession, **values: list[float]) -> DataFrame:
    """Every combination of parameter values, one column each."""
    grids = [spark.createDataFrame([(float(v),) for v in vs], f"{k} double") for k, vs in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), grids)


