"""Inference on losses and panels: long-run variance, paired tests, multiple testing, bootstrap, regressions, Granger screens."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draws
from ..functions.linalg import dot, f_tail, gram, solve, t_pvalue, with_coefficients
from ..functions.tables import settled
from .windows import by_date, correlation, strip_common


def long_run_variance(df: DataFrame, by: list[str], x: str, lag: Column | int, order: str = "origin") -> DataFrame:
    """(by, mean, n, lrv): Newey-West with Bartlett weights and divisor n. Lags are equi-joins on the row number."""
    w = Window.partitionBy(*by)
    rows = df.where(F.col(x).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg(x).over(w))
    rows = rows.withColumn("d", F.col(x) - F.col("mean")).withColumn("L", F.lit(lag) if isinstance(lag, int) else lag)
    left = rows.select(*by, "i", "n", "mean", "L", "d").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("L"))))
    right = rows.select(*by, F.col("i").alias("k"), F.col("d").alias("e"))
    pairs = left.withColumn("k", F.col("i") - F.col("j")).join(right, [*by, "k"])
    weight = F.when(F.col("j") == 0, 1.0).otherwise(2 * (1 - F.col("j") / (F.col("L") + 1)))
    return pairs.groupBy(*by).agg(F.first("mean").alias("mean"), F.first("n").alias("n"), (F.sum(weight * F.col("d") * F.col("e")) / F.first("n")).alias("lrv"))


def paired_differences(losses: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, d): loss of a less loss of b over cells that have both."""
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("mape")))
    return losses.where(F.col("channel").isin(a, b)).groupBy(*keys).agg((pick(a) - pick(b)).alias("d")).where("d IS NOT NULL")


def diebold_mariano(diffs: DataFrame, by: list[str], hln: bool = True) -> DataFrame:
    """(by, n, mean, stat, p_value) of the differences (by incl. h, origin, d): lag h - 1, small-sample factor, Student t with n - 1."""
    out = long_run_variance(diffs, by, "d", F.col("h") - 1)
    stat = F.when(F.col("lrv") > 1e-18, F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))
    if hln:
        n, h = F.col("n"), F.col("h")
        stat = stat * F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(0.0)))
    return out.withColumn("stat", stat).withColumn("p_value", t_pvalue(F.col("stat"), (F.col("n") - 1).cast("double"))).select(*by, "n", "mean", "stat", "p_value")


def weekly_dm(losses: DataFrame, a: str, b: str) -> DataFrame:
    """The test on weekly cross-section means, per horizon."""
    weekly = paired_differences(losses, a, b, ["h", "origin", "entity"]).groupBy("h", "origin").agg(F.avg("d").alias("d"))
    return diebold_mariano(weekly, ["h"])


def entity_dm(losses: DataFrame, a: str, b: str, q: float = 0.05) -> DataFrame:
    """(h, n_entities, a_better, b_better): entities whose test rejects after Benjamini-Hochberg, by sign."""
    tests = diebold_mariano(paired_differences(losses, a, b, ["h", "entity", "origin"]), ["h", "entity"])
    flagged = benjamini_hochberg(tests, ["h"], q)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return flagged.groupBy("h").agg(F.count("*").alias("n_entities"), count(F.col("reject") & (F.col("mean") < 0)).alias("a_better"), count(F.col("reject") & (F.col("mean") > 0)).alias("b_better"))


def ranked(df: DataFrame, by: list[str], p: str = "p_value", parts: int = 32) -> DataFrame:
    """df with _r, the rank of p within its group (nulls last), and _m, the group's number of p values.

    Without a group the rows are dealt over ranges of p, so that no task sees them all; only range counts meet.
    """
    if by:
        w = Window.partitionBy(*by)
        return df.withColumn("_r", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))).withColumn("_m", F.count(p).over(w))
    splits = sorted({float(x) for x in df.where(F.col(p).isNotNull()).approxQuantile(p, [i / parts for i in range(1, parts)], 0.5 / parts)})
    part = F.size(F.filter(F.array(*[F.lit(x) for x in splits]), lambda x: x < F.col(p))) if splits else F.lit(0)
    dealt = df.withColumn("_part", F.when(F.col(p).isNull(), F.lit(len(splits) + 1)).otherwise(part))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.count(p).alias("_k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(every).alias("_m"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(p).asc_nulls_last()))
    return dealt.withColumn("_i", inside).join(F.broadcast(counts), "_part").withColumn("_r", F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")


def benjamini_hochberg(df: DataFrame, by: list[str], q: float = 0.05, p: str = "p_value") -> DataFrame:
    """df with reject: the step-up procedure within each group."""
    rows = ranked(df, by, p)
    good = F.when(F.col(p) <= q * F.col("_r") / F.col("_m"), F.col("_r"))
    if by:
        rows = rows.withColumn("_last", F.max(good).over(Window.partitionBy(*by)))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max(good).alias("_last"))))
    return rows.withColumn("reject", F.coalesce(F.col("_r") <= F.col("_last"), F.lit(False)) & F.col(p).isNotNull()).drop("_r", "_m", "_last")


def holm(df: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """df with p_holm: step-down adjusted p values within each group (all rows one group, if by is empty: a few hypotheses)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    raised = F.least((F.col("_m") - F.col("_r") + 1) * F.col(p), F.lit(1.0))
    return ranked(df, by, p).withColumn("_a", raised).withColumn("p_holm", F.max("_a").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m", "_a")


def replicate_means(weekly: DataFrame, by: list[str], value: str, replicates: int, block: int, seed: int = 5, order: str = "origin") -> DataFrame:
    """(by, n, mean, boot): a group's weekly values, a null being none, and the means of its moving-block replicates as one array.

    A block's sum is a difference of prefix sums, so a replicate costs one lookup per block and no row; a group is one row with its weeks.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = weekly.where(F.col(value).isNotNull()).select(*by, order, F.sum(value).over(w).alias("_s"))
    sums = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("_s")))), lambda x: x["_s"])

    @F.pandas_udf("array<double>")
    def drawn(sums: pd.Series) -> pd.Series:
        out = []
        for values in sums:
            total = np.r_[0.0, np.asarray(values, float)]
            n = len(total) - 1
            blocks = -(-n // block)
            ends = np.full(blocks, block)
            ends[-1] = n - (blocks - 1) * block
            start = draws(seed, np.arange(replicates)[:, None], np.arange(blocks)[None, :]) % max(n - block + 1, 1)
            out.append(((total[start + ends] - total[start]).sum(axis=1) / n).tolist())
        return pd.Series(out, dtype=object)

    groups = rows.groupBy(*by).agg(sums.alias("_s"))
    return groups.select(*by, F.size("_s").alias("n"), (F.element_at("_s", -1) / F.size("_s")).alias("mean"), drawn("_s").alias("boot"))


def block_bootstrap(weekly: DataFrame, by: list[str], value: str, replicates: int = 5000, block: int = 13, seed: int = 5, level: float = 0.95, order: str = "origin") -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean over moving blocks of whole weeks; block = 1 is the iid bootstrap."""
    tail = 50 * (1 - level)

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(boot: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([np.percentile(np.asarray(b, float), [tail, 100 - tail]) for b in boot], columns=["low", "high"])

    rows = replicate_means(weekly, by, value, replicates, block, seed, order)
    return rows.select(*by, "mean", interval("boot").alias("_i")).select(*by, "mean", "_i.low", "_i.high")


def against_iid(weekly: DataFrame, by: list[str], value: str, replicates: int = 5000, block: int = 13, seed: int = 5) -> DataFrame:
    """(by, low, high, iid_low, iid_high, width_ratio): what independent weeks would claim beside what blocks of weeks do."""
    whole = block_bootstrap(weekly, by, value, replicates, block, seed)
    single = block_bootstrap(weekly, by, value, replicates, 1, seed).select(*by, F.col("low").alias("iid_low"), F.col("high").alias("iid_high"))
    ratio = F.try_divide(F.col("high") - F.col("low"), F.col("iid_high") - F.col("iid_low"))
    return whole.drop("mean").join(single, by).withColumn("width_ratio", ratio)


def equivalence(ci: DataFrame, reference: DataFrame, by: list[str], margin: float = 0.02) -> DataFrame:
    """by with equivalent: whether the interval of the difference lies within margin times the reference's mean loss."""
    return ci.join(reference.select(*by, F.col("mape").alias("ref")), by).withColumn("equivalent", (F.col("low") > -margin * F.col("ref")) & (F.col("high") < margin * F.col("ref")))


def model_confidence_set(weekly: DataFrame, alpha: float = 0.10, replicates: int = 5000, block: int = 13, seed: int = 5) -> DataFrame:
    """(h, channel, p_value, member): the set of methods that none of the others beats, by the largest standardised excess loss.

    Excess losses are scaled by their bootstrap deviation. A method whose weekly losses equal those of another (within 1e-12) stands or
    falls with it. Spark makes the replicate means of each method as one array; the elimination over the few methods runs per horizon.
    """
    complete = weekly.withColumn("_n", F.count("*").over(Window.partitionBy("h", "origin"))).withColumn("_m", F.size(F.collect_set("channel").over(Window.partitionBy("h"))))
    complete = settled(complete.where("_n = _m").select("h", "origin", "channel", "mape"), "complete-weeks")
    w = Window.partitionBy("h", "channel")
    rows = complete.withColumn("i", F.row_number().over(w.orderBy("origin")) - 1)
    means = replicate_means(complete, ["h", "channel"], "mape", replicates, block, seed)
    other = rows.select("h", "i", F.col("channel").alias("twin"), F.col("mape").alias("_o"))
    apart = rows.join(other, ["h", "i"]).where("twin < channel").groupBy("h", "channel", "twin").agg(F.max(F.abs(F.col("mape") - F.col("_o"))).alias("d"))
    twins = apart.where("d <= 1e-12").groupBy("h", "channel").agg(F.min("twin").alias("twin"))

    def eliminate(pdf: pd.DataFrame) -> pd.DataFrame:
        twin = dict(pdf[["channel", "twin"]].dropna().drop_duplicates().itertuples(index=False))
        table = pdf[pdf["twin"].isna()].sort_values("channel")
        names, mean, boot = list(table["channel"]), table["mean"].to_numpy(), np.stack(table["boot"].to_list())
        alive, p, out = list(range(len(names))), 0.0, {}
        while len(alive) > 1:
            centre, cb = mean[alive] - mean[alive].mean(), boot[alive] - boot[alive].mean(0)
            dev, sd = cb - centre[:, None], cb.std(1, ddof=1)
            t = np.where(sd > 1e-12, centre / np.maximum(sd, 1e-12), 0.0)
            null = np.where(sd[:, None] > 1e-12, dev / np.maximum(sd, 1e-12)[:, None], 0.0).max(0)
            p = max(p, float((null >= t.max()).mean()))
            worst = alive[int(np.argmax(t))]
            out[worst] = p
            alive.remove(worst)
        for i in alive:
            out[i] = 1.0
        found = dict(zip(names, (out[i] for i in range(len(names))), strict=True))
        found |= {c: found[k] for c, k in twin.items()}
        return pd.DataFrame({"h": pdf["h"].iloc[0], "channel": list(found), "p_value": list(found.values()), "member": [v >= alpha for v in found.values()]})

    every = means.join(F.broadcast(twins), ["h", "channel"], "left")  # a row per method
    return every.groupBy("h").applyInPandas(eliminate, "h int, channel string, p_value double, member boolean")


def pair_bundle(losses: DataFrame, pairs: list[tuple[str, str]], replicates: int = 5000) -> DataFrame:
    """(h, a, b, mean, stat, p_value, low, high, a_better, b_better): all pairwise statistics; blocks of 13 weeks or half of them."""
    out = None
    for a, b in pairs:
        weekly = settled(paired_differences(losses, a, b, ["h", "origin", "entity"]).groupBy("h", "origin").agg(F.avg("d").alias("d")), "weekly-differences")
        row = diebold_mariano(weekly, ["h"]).join(block_bootstrap(weekly, ["h"], "d", replicates).select("h", "low", "high"), "h").join(entity_dm(losses, a, b).drop("n_entities"), "h")
        row = row.select("h", F.lit(a).alias("a"), F.lit(b).alias("b"), "mean", "stat", "p_value", "low", "high", "a_better", "b_better")
        out = row if out is None else out.unionByName(row)
    return out


def lag_correlation(df: DataFrame, feature: str, lags: list[int], target: str = "z") -> DataFrame:
    """(lag, r, n, best): correlation of the feature `lag` rows before with the target; best marks the largest |r|."""
    lagged = df.withColumns({f"_x{k}": F.lag(feature, k).over(by_date()) for k in lags})
    cols = [F.struct(F.lit(k).alias("lag"), F.col(f"_x{k}").alias("x")) for k in lags]
    long = lagged.select(target, F.explode(F.array(*cols)).alias("s")).select(target, "s.*").where(f"x IS NOT NULL AND {target} IS NOT NULL")
    out = long.groupBy("lag").agg(correlation("x", target).alias("r"), F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round(F.abs("r"), 9).desc_nulls_last(), "lag"))
    return out.withColumn("best", top == 1)


def change_correlation(cells: DataFrame, by: list[str], predicted: str = "predicted", realised: str = "realised") -> DataFrame:
    """(by, n, r, t, p): Pearson correlation of predicted and realised changes per group, with the two-sided probability of Student's t.

    r is null where a side does not vary or fewer than three rows have both; p is 0 where the correlation is exact.
    """
    ok = cells.where(F.col(predicted).isNotNull() & F.col(realised).isNotNull())
    out = ok.groupBy(*by).agg(F.count("*").alias("n"), correlation(predicted, realised).alias("r"))
    out = out.withColumn("r", F.when(F.col("n") >= 3, F.col("r"))).withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2.0), F.sqrt(1 - F.col("r") * F.col("r"))))
    p = F.when(F.abs("r") == 1, 0.0).otherwise(t_pvalue("t", (F.col("n") - 2).cast("double")))
    return out.withColumn("p", F.when(F.col("r").isNotNull(), p))


def granger(pairs: DataFrame, series: DataFrame, max_lag: int = 8, least: int = 60) -> DataFrame:
    """(source, target, best_lag, f_stat, p_value, n_obs): does the source's past help predict the target, beyond its own?

    pairs (source, target); series (entity, date, y). First differences; SSR F test at each lag; least p times lags, at most 1.
    Lags are columns made by windows once per entity; one Gram matrix per pair reaches NumPy.
    """
    w = by_date()
    diff = series.withColumn("d", F.col("y") - F.lag("y").over(w)).where("d IS NOT NULL")
    lagged = diff.select("entity", "date", "d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, max_lag + 1)])
    a = lagged.select(F.col("entity").alias("target"), "date", F.col("d").alias("z"), *[F.col(f"l{k}").alias(f"a{k}") for k in range(1, max_lag + 1)])
    b = lagged.select(F.col("entity").alias("source"), "date", *[F.col(f"l{k}").alias(f"b{k}") for k in range(1, max_lag + 1)])
    rows = pairs.select("source", "target").join(a, "target").join(b, ["source", "date"])
    xs = [f"{s}{k}" for s in "ab" for k in range(1, max_lag + 1)]
    sums = gram(rows, ["source", "target"], xs, "z").where(F.col("n") >= least)

    @F.pandas_udf("struct<best_lag:int,f_stat:double,p_value:double>")
    def test(n: pd.Series, sxx: pd.Series, sxy: pd.Series, syy: pd.Series) -> pd.DataFrame:
        out = []
        for m, xx, xy, yy in zip(n, sxx, sxy, syy, strict=True):
            xx, xy = np.asarray(xx, float).reshape(2 * max_lag, -1), np.asarray(xy, float)
            best = (0, 0.0, 2.0)
            for k in range(1, max_lag + 1):
                own, both = list(range(k)), [*range(k), *range(max_lag, max_lag + k)]
                ssr = [yy - solve(xx[np.ix_(c, c)], xy[c]) @ xy[c] for c in (own, both)]
                free = m - 2 * k - 1
                f = (ssr[0] - ssr[1]) / k / max(ssr[1] / free, 1e-300) if free > 0 and ssr[1] > 1e-12 else 0.0
                p = f_tail(f, k, free) if free > 0 else 1.0
                if p < best[2]:
                    best = (k, f, p)
            out.append((best[0], best[1], min(1.0, best[2] * max_lag)))
        return pd.DataFrame(out, columns=["best_lag", "f_stat", "p_value"])

    return sums.withColumn("t", test("n", "sxx", "sxy", "syy")).select("source", "target", "t.best_lag", "t.f_stat", "t.p_value", F.col("n").alias("n_obs"))


def spillover_graph(pairs: DataFrame, series: DataFrame, max_lag: int = 8, q: float = 0.05) -> DataFrame:
    """Granger edges of the series without their common movement, with significant (Benjamini-Hochberg over all pairs)."""
    own = strip_common(series).select("entity", "date", F.col("own").alias("y"))
    return benjamini_hochberg(granger(pairs, own, max_lag), [], q).withColumnRenamed("reject", "significant")


def factor_scores(correlations: DataFrame, tests: DataFrame) -> DataFrame:
    """(entity, factor, corr, p_value, best_lag): correlations with the tests (source = factor, target = entity)."""
    return correlations.join(tests.select(F.col("source").alias("factor"), F.col("target").alias("entity"), "p_value", "best_lag"), ["entity", "factor"])


#: Levels of the smaller of two effects up to which both are taken out by one solve.
LEVELS = 200


def _solved_offsets(cells: DataFrame, columns: list[str], large: list[str], small: list[str], common: list[str]) -> DataFrame:
    """cells with _o_ offsets of two effects, exactly: the large effect is eliminated, which leaves a small system per common group.

    Each task adds up its part of that system over the levels of the large effect; one solve per group, by least norm, gives the small
    effect's offsets, and the large effect's follow from its own sums.
    """
    own = [c for c in small if c not in common]
    levels = cells.select(*common, *own).distinct().withColumn("_t", F.row_number().over(Window.partitionBy(*common).orderBy(*own)) - 1)
    placed = cells.join(F.broadcast(levels), [*common, *own])  # at most LEVELS rows a group
    sums = [f"_s_{c}" for c in columns]
    rows = placed.groupBy(*large).agg(F.collect_list(F.struct("_t", F.col("_n").cast("double").alias("n"), *sums)).alias("_x"))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    head = "".join(f"{c} {kinds[c]}, " for c in common)
    width = len(columns)

    def parts(batches):
        found: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, xs in zip(pdf[common].itertuples(index=False, name=None), pdf["_x"], strict=True):
                table = np.array([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in xs], float)
                t, n, s = table[:, 0].astype(int), table[:, 1], table[:, 2:]
                m = found.get(key)
                if m is None:
                    m = found[key] = np.zeros((LEVELS, LEVELS + width))
                m[t, t] += n
                m[np.ix_(t, t)] -= np.outer(n, n) / n.sum()
                m[t, LEVELS:] += s - n[:, None] * s.sum(axis=0) / n.sum()
        for key, m in found.items():
            yield pd.DataFrame([(*key, m.ravel().tolist())], columns=[*common, "m"])

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sum([np.asarray(v) for v in pdf["m"]], axis=0).reshape(LEVELS, LEVELS + width)
        used = int(np.flatnonzero(np.diag(m) != 0).max(initial=0)) + 1
        g = np.linalg.lstsq(m[:used, :used], m[:used, LEVELS:], rcond=1e-12)[0]
        out = pd.DataFrame({"_t": np.arange(used)} | {f"_g_{c}": g[:, i] for i, c in enumerate(columns)})
        for c in common[::-1]:
            out.insert(0, c, pdf[c].iloc[0])
        return out

    made = rows.select(*common, "_x").mapInPandas(parts, f"{head}m array<double>")
    offsets = made.groupBy(*common).applyInPandas(solved, f"{head}_t int, " + ", ".join(f"_g_{c} double" for c in columns))
    both = placed.join(offsets, [*common, "_t"])
    w = Window.partitionBy(*large)
    rest = {f"_o_{c}": F.col(f"_g_{c}") + F.sum(F.col(f"_s_{c}") - F.col("_n") * F.col(f"_g_{c}")).over(w) / F.sum("_n").over(w) for c in columns}
    return both.withColumns(rest).select(*cells.columns)


def within(df: DataFrame, columns: list[str], effects: list[list[str]], tolerance: float = 1e-11, rounds: int = 200) -> DataFrame:
    """columns less the means of every effect, from the sums of their cells (one row for each combination of effects, not for each row of df).

    Of two effects, the one with at most LEVELS levels (within what both share) is solved for at once. More or larger effects are swept
    in turn until a round moves no mean by more than tolerance times the largest value.
    """
    others = [c for c in df.columns if c not in columns]
    if len(effects) == 1:
        w = Window.partitionBy(*effects[0])
        return df.select(*others, *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in columns])
    keys = list(dict.fromkeys(c for e in effects for c in e))
    cells = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in columns])
    cells = settled(cells.select("*", *[F.lit(0.0).alias(f"_o_{c}") for c in columns]), "cells-of-effects")
    if len(effects) == 2 and (common := [c for c in effects[0] if c in effects[1]]):
        most = lambda e: cells.select(*e).distinct().groupBy(*common).count().agg(F.max("count")).first()[0] or 0
        sizes = [most(e) for e in effects]
        if min(sizes) <= LEVELS:
            large, small = effects if sizes[1] <= sizes[0] else effects[::-1]
            offsets = _solved_offsets(cells, columns, large, small, common).select(*keys, *[f"_o_{c}" for c in columns])
            return df.join(offsets, keys).select(*others, *[(F.col(c) - F.col(f"_o_{c}")).alias(c) for c in columns])
    scale = cells.agg(*[F.max(F.abs(F.col(f"_s_{c}") / F.col("_n"))).alias(c) for c in columns]).first()
    limit = tolerance * max([1e-300, *(abs(x) for x in scale if x is not None)])
    for _ in range(rounds):
        swept = cells.select("*", *[F.col(f"_o_{c}").alias(f"_b_{c}") for c in columns])
        for e in effects:
            w = Window.partitionBy(*e)
            left = lambda c, w=w: F.sum(F.col(f"_s_{c}") - F.col("_n") * F.col(f"_o_{c}")).over(w) / F.sum("_n").over(w)
            swept = swept.withColumns({f"_o_{c}": F.col(f"_o_{c}") + left(c) for c in columns})
        swept = settled(swept, "cells-of-effects")
        moved = swept.agg(*[F.max(F.abs(F.col(f"_o_{c}") - F.col(f"_b_{c}"))).alias(c) for c in columns]).first()
        cells = swept.drop(*[f"_b_{c}" for c in columns])
        if max(x or 0.0 for x in moved) <= limit:
            break
    offsets = cells.select(*keys, *[f"_o_{c}" for c in columns])
    return df.join(offsets, keys).select(*others, *[(F.col(c) - F.col(f"_o_{c}")).alias(c) for c in columns])


def _sandwich(meat_groups: DataFrame, by: list[str], fit: DataFrame, p: int, factor: Column) -> DataFrame:
    meat = meat_groups.groupBy(*by).agg(F.array(*[F.sum(F.get("s", F.lit(i)) * F.get("s", F.lit(j))) for i in range(p) for j in range(p)]).alias("meat"), F.count("*").alias("n_groups"))

    @F.pandas_udf("array<double>")
    def errors(sxx: pd.Series, meat: pd.Series, scale: pd.Series) -> pd.Series:
        out = []
        for a, m, s in zip(sxx, meat, scale, strict=True):
            inv = np.linalg.pinv(np.asarray(a, float).reshape(p, p))
            out.append(np.sqrt(np.maximum(np.diag(inv @ np.asarray(m, float).reshape(p, p) @ inv) * s, 0)).tolist())
        return pd.Series(out, dtype=object)

    return fit.join(meat, by).withColumn("se", errors("sxx", "meat", factor))


def _within_fit(df: DataFrame, y: str, xs: list[str], by: list[str], effects: list[list[str]] | None, cluster: str) -> tuple[list[str], DataFrame, DataFrame, DataFrame]:
    """(group, rows without effects, fit per group, those rows with their residual _e)."""
    group = by or ["_all"]
    df = df.withColumn("_all", F.lit(1))
    effects = effects or [["entity"], ["period"]]
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])).select(*dict.fromkeys([*group, cluster, "date", *[c for e in effects for c in e]]), y, *xs)
    swept = within(rows, [y, *xs], [[*group, *e] for e in effects])
    fit = with_coefficients(gram(swept, group, xs, y))
    e = F.col(y) - sum((F.get("coef", F.lit(i)) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return group, swept, fit, swept.join(F.broadcast(fit.select(*group, "coef")), group).withColumn("_e", e)


def panel_residuals(df: DataFrame, y: str, xs: list[str], effects: list[list[str]] | None = None) -> DataFrame:
    """(entity, date, e): what the within regression leaves of y."""
    *_, resid = _within_fit(df, y, xs, [], effects, "entity")
    return settled(resid.select("entity", "date", F.col("_e").alias("e")), "residuals")


def panel_regression(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None, effects: list[list[str]] | None = None, cluster: str = "entity") -> DataFrame:
    """(by, term, coef, se, t, p_value, n): within regression with entity and quarter effects, errors clustered.

    Effects are taken out by the sums of their cells; Spark sums the Gram matrix and each cluster's scores, NumPy inverts a p-sided matrix.
    """
    by = by or []
    group, swept, fit, resid = _within_fit(df, y, xs, by, effects, cluster)
    p = len(xs)
    scores = resid.groupBy(*group, cluster).agg(F.array(*[F.sum(F.col("_e") * F.col(x)) for x in xs]).alias("s"))
    g, n = F.col("n_groups"), F.col("n")
    out = _sandwich(scores, group, fit, p, F.when(g > 1, g / (g - 1) * (n - 1) / (n - p)).otherwise(1.0))
    terms = F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.get("coef", F.lit(i)).alias("coef"), F.get("se", F.lit(i)).alias("se")) for i, x in enumerate(xs)])).alias("x")
    out = out.select(*by, "n", "n_groups", terms).select(*by, "n", "n_groups", "x.*").withColumn("t", F.try_divide("coef", "se"))
    return out.withColumn("p_value", t_pvalue(F.col("t"), (F.col("n_groups") - 1).cast("double"))).select(*by, "term", "coef", "se", "t", "p_value", "n")


def kernel_fit(df: DataFrame, y: str, xs: list[str], lag: int = 4, effects: list[list[str]] | None = None) -> DataFrame:
    """One row (n, coef, cov): the within fit and its Bartlett kernel covariance over dates, by per-date score sums and an equi-join per lag."""
    effects = effects or [["entity"]]
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])).withColumn("_all", F.lit(1))
    swept = within(rows.select("_all", "date", *dict.fromkeys(c for e in effects for c in e), y, *xs), [y, *xs], effects)
    fit = with_coefficients(gram(swept, ["_all"], xs, y))
    e = F.col(y) - sum((F.get("coef", F.lit(i)) * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    per = swept.join(F.broadcast(fit.select("_all", "coef")), "_all").withColumn("_e", e).groupBy("_all", "date").agg(F.array(*[F.sum(F.col("_e") * F.col(x)) for x in xs]).alias("s"))
    per = per.withColumn("i", F.row_number().over(Window.partitionBy("_all").orderBy("date")))  # a row per date
    left = per.select("_all", "i", "s", F.explode(F.sequence(F.lit(0), F.lit(lag))).alias("j")).withColumn("k", F.col("i") - F.col("j"))
    pairs = left.join(per.select("_all", F.col("i").alias("k"), F.col("s").alias("q")), ["_all", "k"])
    p = len(xs)
    w = F.when(F.col("j") == 0, 0.5).otherwise(1 - F.col("j") / F.lit(lag + 1.0))
    # Weighted products of the two score vectors, row by row, summed element by element; the transpose is added at the end.
    products = F.flatten(F.transform("s", lambda u: F.transform("q", lambda v: u * v)))
    long = pairs.select("_all", F.posexplode(F.transform(products, lambda v: v * w)).alias("at", "v")).groupBy("_all", "at").agg(F.sum("v").alias("v"))
    meat = long.groupBy("_all").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m")).select("_all", F.transform("m", lambda x: x["v"]).alias("meat"))

    @F.pandas_udf("array<double>")
    def covariance(sxx: pd.Series, meat: pd.Series) -> pd.Series:
        out = []
        for a, m in zip(sxx, meat, strict=True):
            inv, half = np.linalg.pinv(np.asarray(a, float).reshape(p, p)), np.asarray(m, float).reshape(p, p)
            out.append((inv @ (half + half.T) @ inv).ravel().tolist())
        return pd.Series(out, dtype=object)

    return fit.join(meat, "_all").select("n", "coef", covariance("sxx", "meat").alias("cov"))


def _tested(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.try_divide("coef", "se"))


def driscoll_kraay(df: DataFrame, y: str, xs: list[str], lag: int = 4, effects: list[list[str]] | None = None) -> DataFrame:
    """(term, coef, se, t, n): the same fit with kernel errors."""
    p = len(xs)
    se = lambda i: F.sqrt(F.greatest(F.get("cov", F.lit(i * p + i)), F.lit(0.0)))
    terms = F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.get("coef", F.lit(i)).alias("coef"), se(i).alias("se")) for i, x in enumerate(xs)])).alias("x")
    return _tested(kernel_fit(df, y, xs, lag, effects).select("n", terms).select("x.*", "n")).select("term", "coef", "se", "t", "n")


#: The six points of the Webb distribution, squared.
WEBB = (1.5, 1.0, 0.5)


def wild_cluster(df: DataFrame, y: str, x: str, controls: list[str], replicates: int = 9999, seed: int = 23, effects: list[list[str]] | None = None) -> DataFrame:
    """(term, t, p_value, n_replicates): restricted wild cluster bootstrap of one coefficient, six-point weights.

    A cluster enters as a few sums (its part of the Gram matrix and of the restricted fit). The design does not depend on the weights, so
    a replicate is two sums over clusters. A cluster is one row with an array of weights; sums over all replicates are matrix products
    within a task, and only a row per replicate and task is shuffled. Draws come from the integer generator by (replicate, crc32 of the
    cluster's name).
    """
    xs = [x, *controls]
    p = len(xs)
    rows = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])).withColumn("_all", F.lit(1)).select("_all", "entity", "date", *[c for e in effects or [] for c in e if c not in ("entity", "date")], y, *xs)
    swept = within(rows, [y, *xs], effects or [["entity"]])
    restricted = with_coefficients(gram(swept, ["_all"], controls, y)).select("_all", F.col("coef").alias("r")) if controls else None
    swept = swept.join(F.broadcast(restricted), "_all") if controls else swept
    fitted = sum((F.get("r", F.lit(i)) * F.col(c) for i, c in enumerate(controls)), F.lit(0.0))
    swept = swept.withColumn("_f", fitted).withColumn("_u", F.col(y) - fitted)
    per = swept.groupBy("entity").agg(
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in xs for b in xs]).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("_f")) for a in xs]).alias("xf"), F.array(*[F.sum(F.col(a) * F.col("_u")) for a in xs]).alias("xu")
    )
    total = per.select(F.lit(1).alias("_all"), F.posexplode("xx").alias("at", "v")).groupBy("_all", "at").agg(F.sum("v").alias("v"))
    total = total.groupBy("_all").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m")).select(F.transform("m", lambda x: x["v"]).alias("sxx"))  # p x p numbers

    @F.pandas_udf("array<double>")
    def inverse(sxx: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.pinv(np.asarray(a, float).reshape(p, p)).ravel().tolist() for a in sxx], dtype=object)

    per = per.crossJoin(F.broadcast(total.select(inverse("sxx").alias("inv"))))
    row0 = F.slice("inv", 1, p)
    # What a cluster adds to the first coefficient's score: a + w u - z b.
    per = per.select("entity", "xf", "xu", "inv", dot(row0, F.col("xf")).alias("a"), dot(row0, F.col("xu")).alias("u"), F.array(*[dot(row0, F.array(*[F.get("xx", F.lit(i * p + j)) for i in range(p)])) for j in range(p)]).alias("z"))
    per = settled(per, "clusters")
    inv = per.select("inv").first()

    def weights(names: pd.Series) -> np.ndarray:
        """A row of weights per cluster, a column per replicate; the first column is the sample itself."""
        k = draws(seed, np.arange(replicates + 1)[None, :], np.array([zlib.crc32(e.encode()) for e in names], np.int64)[:, None]) % 6
        w = np.sqrt(np.asarray(WEBB))[k % 3] * np.where(k < 3, 1.0, -1.0)
        w[:, 0] = 1.0
        return w

    def summed(each, columns: int) -> np.ndarray:
        """(replicates + 1) x columns: the sums over clusters of each(pdf, weights), added up within tasks first."""

        def run(batches):
            total = np.zeros((replicates + 1, columns))
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    total += each(part, weights(part["entity"]))
            yield pd.DataFrame({"rep": np.arange(replicates + 1)} | {f"v{i}": total[:, i] for i in range(columns)})

        parts = per.select("entity", "xf", "xu", "a", "u", "z").mapInPandas(run, "rep int, " + ", ".join(f"v{i} double" for i in range(columns)))
        found = parts.groupBy("rep").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(columns)]).toPandas().sort_values("rep")  # a row per replicate
        return found[[f"v{i}" for i in range(columns)]].to_numpy()

    if inv is None:
        return df.sparkSession.createDataFrame([], "term string, t double, p_value double, n_replicates bigint")
    stack = lambda part, c: np.stack(part[c].to_list())
    xy = summed(lambda part, w: stack(part, "xf").sum(axis=0) + w.T @ stack(part, "xu"), p)
    b = xy @ np.asarray(inv[0]).reshape(p, p).T
    v = summed(lambda part, w: ((part["a"].to_numpy()[:, None] + w * part["u"].to_numpy()[:, None] - stack(part, "z") @ b.T) ** 2).sum(axis=0)[:, None], 1)[:, 0]
    ts = np.where(v > 0, b[:, 0] / np.sqrt(np.where(v > 0, v, 1)), 0.0)
    # Ties with the sample's own statistic count, within the last digits.
    share = float((np.abs(ts[1:]) >= abs(ts[0]) - 1e-12).mean()) if replicates else None
    return df.sparkSession.createDataFrame([(x, float(ts[0]), share, replicates)], "term string, t double, p_value double, n_replicates bigint")


def distributed_lag(df: DataFrame, y: str, x: str, max_lag: int = 26, lag: int = 4, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """(first_lag, last_lag, coef, se, t, n): lags 0..max_lag of x with kernel errors, and sums over ranges of lags with the errors of the sums."""
    lagged = df.select("entity", "date", y, *[F.lag(x, k).over(by_date()).alias(f"{x}_{k}") for k in range(max_lag + 1)])
    fit = kernel_fit(lagged, y, [f"{x}_{k}" for k in range(max_lag + 1)], lag)
    p = max_lag + 1
    spans = [(k, k) for k in range(p)] + list(ranges or [])
    table = df.sparkSession.createDataFrame(spans, "first_lag int, last_lag int")
    rows = fit.crossJoin(F.broadcast(table))
    add = lambda s, v: s + v
    width = F.col("last_lag") - F.col("first_lag") + 1
    coef = F.aggregate(F.slice("coef", F.col("first_lag") + 1, width), F.lit(0.0), add)
    within_span = F.flatten(F.transform(F.sequence("first_lag", "last_lag"), lambda i: F.slice("cov", i * p + F.col("first_lag") + 1, width)))
    var = F.aggregate(within_span, F.lit(0.0), add)
    return _tested(rows.select("first_lag", "last_lag", coef.alias("coef"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"), "n")).select("first_lag", "last_lag", "coef", "se", "t", "n")


def lag_grid(df: DataFrame, y: str, features: list[str], lags: list[int], exclude: tuple[str, str] | None = None, q: float = 0.05) -> DataFrame:
    """(feature, lag, coef, se, p_value, n, stable_sign, reject): one regression per feature and lag, all in one plan."""
    if exclude:
        df = df.where(~F.col("date").between(*[F.lit(e).cast("date") for e in exclude]))
    df = df.withColumns({f"_{f}{k}": F.lag(f, k).over(by_date()) for f in features for k in lags})
    cols = [F.struct(F.lit(f).alias("feature"), F.lit(k).alias("lag"), F.col(f"_{f}{k}").alias("x")) for f in features for k in lags]
    long = df.select("entity", "date", y, F.explode(F.array(*cols)).alias("s")).select("entity", "date", y, "s.*")
    out = panel_regression(long, y, ["x"], ["feature", "lag"], [["entity"]]).drop("term")
    stable = F.abs(F.sum(F.signum("coef")).over(Window.partitionBy("feature"))) == F.count("*").over(Window.partitionBy("feature"))
    return benjamini_hochberg(out.withColumn("stable_sign", stable), [], q)


def serial_correlation(residuals: DataFrame, e: str = "e") -> tuple[DataFrame, DataFrame]:
    """(pooled, by entity): slope of the residual on its own past with clustered errors; lag-1 autocorrelations and their one-sample t."""
    rows = residuals.withColumn("past", F.lag(e).over(by_date())).where(f"past IS NOT NULL AND {e} IS NOT NULL")
    pooled = panel_regression(rows, e, ["past"], effects=[["_all"]])
    own = rows.groupBy("entity").agg(correlation(e, "past").alias("rho"), F.count("*").alias("n"))
    test = own.agg(F.avg("rho").alias("mean_rho"), F.stddev_samp("rho").alias("sd"), F.count("rho").alias("n")).select("mean_rho", (F.col("mean_rho") / (F.col("sd") / F.sqrt("n"))).alias("t"), "n")
    return pooled, test.withColumn("p_value", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double")))


