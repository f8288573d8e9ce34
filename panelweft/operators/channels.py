"""Forecast channels: series and origins in, long forecasts (channel, entity, origin, step, yhat) out.

series (entity, date, y, widx) without nulls; origins (entity, origin, widx). A channel never sees a row after its origin.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import dot, with_coefficients
from .joins import active_event
from .windows import by_date, pct

MAX_STEP = 13
SLOTS = 53


def last_value(series: DataFrame, origins: DataFrame) -> DataFrame:
    """origins with y0, the value at the origin."""
    return origins.join(series.select("entity", "widx", F.col("y").alias("y0")), ["entity", "widx"])


def long(df: DataFrame, channel: str, value: Column, steps: int = MAX_STEP, floor: bool = False) -> DataFrame:
    """A row per step; value may use `step`."""
    df = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    value = F.greatest(value, F.lit(0.0)) if floor else value
    return df.select(F.lit(channel).alias("channel"), "entity", "origin", "step", value.alias("yhat"))


def naive(series: DataFrame, origins: DataFrame, steps: int = MAX_STEP) -> DataFrame:
    """The last value, repeated."""
    return long(last_value(series, origins), "naive", F.col("y0"), steps)


def seasonal_naive(series: DataFrame, origins: DataFrame, steps: int = MAX_STEP, period: int = 52) -> DataFrame:
    """The value one period before the target row."""
    asked = origins.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("at", F.col("widx") + F.col("step") - period)
    past = series.select("entity", F.col("widx").alias("at"), F.col("y").alias("yhat"))
    return asked.join(past, ["entity", "at"]).select(F.lit("snaive").alias("channel"), "entity", "origin", "step", "yhat")


def _raw_factors(ys: np.ndarray, slots: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """A row per asked place: the median ratio to the centred average of each week slot, as if the series ended there; 1 with fewer than two.

    Only the averages of the last 25 rows depend on where the series ends. The ratios before them stay in one sorted list per slot.
    """
    total = np.r_[0.0, np.cumsum(ys)]
    fixed: list[list[float]] = [[] for _ in range(SLOTS)]
    settled_raw, out, done = np.ones(SLOTS), np.empty((len(asked), SLOTS)), 0

    def ratio(t: int, end: int) -> float | None:
        low, high = max(t - 26, 0), min(t + 25, end)
        n = high - low + 1
        mean = (total[high + 1] - total[low]) / n
        return ys[t] / mean if n >= 26 and mean != 0 else None

    def median(values: list[float]) -> float:
        half = len(values) // 2
        return 1.0 if len(values) < 2 else values[half] if len(values) % 2 else (values[half - 1] + values[half]) / 2

    for row, end in enumerate(asked.tolist()):
        while done <= end - 25:
            if (r := ratio(done, end)) is not None:
                insort(fixed[slots[done]], r)
                settled_raw[slots[done]] = median(fixed[slots[done]])
            done += 1
        out[row] = settled_raw
        open_: dict[int, list[float]] = {}
        for t in range(done, end + 1):
            if (r := ratio(t, end)) is not None:
                insort(open_.setdefault(slots[t], fixed[slots[t]].copy()), r)
        for k, values in open_.items():
            out[row, k] = median(values)
    return out


def _smoothed_factors(raw: np.ndarray, rows: np.ndarray, smooth: int) -> np.ndarray:
    """Means round the year, divided by their mean; all 1 with fewer than 53 rows."""
    half = smooth // 2
    s = sum(np.roll(raw, k, axis=1) for k in range(-half, half + 1)) / (2 * half + 1)
    m = s.mean(axis=1, keepdims=True)
    return np.where((rows[:, None] < SLOTS) | (m <= 0), 1.0, s / np.where(m > 0, m, 1.0))


#: What can be fitted on a series divided by its factors: smoothing without and with damping, and Theta.
ADJUSTED = ("fa_ets", "fa_ets_d", "fa_theta")


def seasonal_states(series: DataFrame, origins: DataFrame, smooth: int | tuple[int, ...] = 3, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(entity, origin, smooth, y0, factors, fits): all that the seasonal channels need of each origin, in one pass over each entity's rows.

    factors is an array of 53 week slots: median ratio to the centred average per ISO week up to the origin (1 with fewer than two),
    smoothed round the year over `smooth` weeks, divided by their mean; all 1 with fewer than 53 rows. Several values of smooth give a row
    each, from the same medians. fits maps each kind to (level, trend, alpha, phi, slope, n) of the rows up to the origin divided by their
    week's factor (those of a factor of 0 or less stay). Rows move once, whatever the number of origins: no row is made per origin and week. The fit of an origin is still a recursion over its rows, some 256 origins at a
    time: keeping it linear in the factors would take 53 x 53 sums per grid point and week, more than that below thousands of weeks.
    """
    windows = (smooth,) if isinstance(smooth, int) else smooth
    flat, damped = (np.array([(a, b, p) for a in ALPHAS for b in BETAS for p in ps]) for ps in ((1.0,), PHIS))
    single = np.array([(a, 0.0, 1.0) for a in ALPHAS])

    def fitted(kind: str, lists: list[np.ndarray]) -> list[tuple]:
        grid = {"fa_ets": flat, "fa_ets_d": damped, "fa_theta": single}[kind]
        level, trend, at = _recursion(lists, grid, kind != "fa_theta")
        slopes = []
        for v in lists:
            n = len(v)
            slopes.append(12 * float((np.arange(1, n + 1) - (n + 1) / 2) @ v) / (n * (n * n - 1)) if n > 1 else 0.0)
        return [(float(x), float(t), float(grid[g, 0]), float(grid[g, 2]), q, len(v)) for x, t, g, q, v in zip(level, trend, at, slopes, lists, strict=True)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        ys, slots, asked = pdf["y"].to_numpy(float), pdf["slot"].to_numpy(), np.flatnonzero(pdf["asked"].to_numpy())
        raw, names = _raw_factors(ys, slots, asked), ("level", "trend", "alpha", "phi", "slope", "n")
        parts = []
        for window in windows:
            f = _smoothed_factors(raw, asked + 1, window)
            fits: list[dict] = [{} for _ in asked]
            for at in range(0, len(asked) if kinds else 0, 256):
                lists = [ys[: e + 1] / np.where((g := f[at + i, slots[: e + 1]]) > 0, g, 1.0) for i, e in enumerate(asked[at : at + 256].tolist())]
                for kind in kinds:
                    for one, fit in zip(fits[at : at + 256], fitted(kind, lists), strict=True):
                        one[kind] = dict(zip(names, fit, strict=True))
            parts.append(pd.DataFrame({"entity": pdf["entity"].to_numpy()[asked], "origin": pdf["date"].to_numpy()[asked], "smooth": window, "y0": ys[asked], "factors": list(f), "fits": fits}))
        return pd.concat(parts)

    marks = origins.select("entity", F.col("origin").alias("date"), F.lit(True).alias("asked"))
    rows = series.join(marks, ["entity", "date"], "left").select("entity", "date", "y", (F.weekofyear("date") - 1).alias("slot"), F.coalesce("asked", F.lit(False)).alias("asked"))
    kind = series.schema["entity"].dataType.simpleString()
    fit = "struct<level:double,trend:double,alpha:double,phi:double,slope:double,n:int>"
    return rows.groupBy("entity").applyInPandas(run, f"entity {kind}, origin date, smooth int, y0 double, factors array<double>, fits map<string,{fit}>")


def seasonal_factors(series: DataFrame, origins: DataFrame, smooth: int = 3) -> DataFrame:
    """(entity, origin, week, factor) of seasonal_states, a row per week slot."""
    rows = seasonal_states(series, origins, smooth).select("entity", "origin", F.posexplode("factors").alias("week", "factor"))
    return rows.withColumn("week", F.col("week") + 1)


def slot(week: Column, step: Column) -> Column:
    """Week slot `step` weeks on; 53 slots every year."""
    return F.pmod(week - 1 + step, F.lit(SLOTS)) + 1


def seasonal_windows(series: DataFrame, origins: DataFrame, windows: tuple[int, ...], steps: int = MAX_STEP) -> DataFrame:
    """seasonal at several smoothing windows in one pass: (channel, entity, origin, step, yhat, smooth)."""
    states = seasonal_states(series, origins, windows).withColumn("entity", F.struct("entity", "smooth"))
    rows = seasonal(series, origins, steps, states=states)
    return rows.select("channel", F.col("entity.entity").alias("entity"), "origin", "step", "yhat", F.col("entity.smooth").alias("smooth"))


def _factor(states_at: Column, step: Column | int) -> Column:
    """The factor of the week slot `step` weeks after the origin."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.get(states_at, slot(F.weekofyear("origin"), step) - 1)


def seasonal(series: DataFrame, origins: DataFrame, steps: int = MAX_STEP, smooth: int = 3, states: DataFrame | None = None) -> DataFrame:
    """Seasonally adjusted naive: y0 * f(week + step) / f(week), two decimals, not under 0."""
    rows = states if states is not None else seasonal_states(series, origins, smooth)
    now, then = _factor(F.col("factors"), 0), _factor(F.col("factors"), F.col("step"))
    value = F.when(now > 0, F.col("y0") * (then / now)).otherwise(F.col("y0"))
    return long(rows, "seasonal", F.round(value, 2), steps, True)


def histories(series: DataFrame, origins: DataFrame, rows: int | None = None) -> DataFrame:
    """origins with ys: all values up to the origin (the last `rows` on request), oldest first."""
    first = Window.unboundedPreceding if rows is None else -(rows - 1)
    lists = series.select("entity", F.col("date").alias("origin"), F.collect_list("y").over(by_date().rowsBetween(first, 0)).alias("ys"))
    return origins.join(lists, ["entity", "origin"])


ALPHAS, BETAS, PHIS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.1, 0.3, 0.5), (0.8, 0.9, 0.95)


def _recursion(ys: pd.Series | list[np.ndarray], grid: np.ndarray, trended: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, trend, grid row) of the least one-step squared error for each list of values; all lists and grid rows step together.

    Level starts at the first value and trend at the first difference, or at 0 and stays there.
    """
    sizes = np.array([len(v) for v in ys])
    table = np.full((len(ys), max(int(sizes.max(initial=0)), 2)), np.nan)
    for row, v in zip(table, ys, strict=True):
        row[: len(v)] = v
    a, b, p = grid.T
    level = np.repeat(table[:, :1], len(grid), 1)
    first = np.where(sizes > 1, table[:, 1] - table[:, 0], 0.0) if trended else np.zeros(len(ys))
    trend, error = np.repeat(first[:, None], len(grid), 1), np.zeros((len(ys), len(grid)))
    for t in range(1, table.shape[1]):
        on = (t < sizes)[:, None]
        guess = level + p * trend
        e = np.where(on, table[:, t][:, None] - guess, 0.0)
        level, trend, error = np.where(on, guess + a * e, level), np.where(on, p * trend + a * b * e, trend), error + e * e
    at = np.argmin(np.round(error, 9), 1)  # the first of equal ones has the least parameters
    rows = np.arange(len(ys))
    return level[rows, at], trend[rows, at], at


def trend_fit(df: DataFrame, damped: bool = False) -> DataFrame:
    """df (with ys) with level, trend, alpha, beta, phi: the grid point of least one-step squared error, least parameters on ties."""
    grid = np.array([(a, b, p) for a in ALPHAS for b in BETAS for p in (PHIS if damped else (1.0,))])

    @F.pandas_udf("struct<level:double,trend:double,alpha:double,beta:double,phi:double>")
    def fit(ys: pd.Series) -> pd.DataFrame:
        level, trend, at = _recursion(ys, grid)
        return pd.DataFrame({"level": level, "trend": trend} | {c: grid[at, i] for i, c in enumerate(("alpha", "beta", "phi"))})

    return df.where(F.size("ys") > 0).withColumn("_f", fit("ys")).select("*", "_f.*").drop("_f")


def trend_states(series: DataFrame, damped: bool = False) -> DataFrame:
    """(entity, origin, level, trend, alpha, beta, phi) at every date: what trend_fit finds on the rows up to it.

    The recursion does not depend on where it ends, so one pass over an entity's rows serves all of its origins.
    """
    grid = np.array([(a, b, p) for a in ALPHAS for b in BETAS for p in (PHIS if damped else (1.0,))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        ys = pdf["y"].to_numpy()
        a, b, p = grid.T
        level, trend, error = np.full(len(grid), ys[0]), np.full(len(grid), ys[1] - ys[0] if len(ys) > 1 else 0.0), np.zeros(len(grid))
        out = np.empty((len(ys), 5))
        for t, y in enumerate(ys):
            if t:
                guess = level + p * trend
                e = y - guess
                level, trend, error = guess + a * e, p * trend + a * b * e, error + e * e
            at = int(np.argmin(np.round(error, 9)))  # the first of equal ones has the least parameters
            out[t] = level[at], trend[at] if t else 0.0, *grid[at]
        return pd.DataFrame({"entity": pdf["entity"].to_numpy(), "origin": pdf["date"].to_numpy()} | {c: out[:, i] for i, c in enumerate(("level", "trend", "alpha", "beta", "phi"))})

    kind = series.schema["entity"].dataType.simpleString()
    return series.select("entity", "date", "y").groupBy("entity").applyInPandas(run, f"entity {kind}, origin date, level double, trend double, alpha double, beta double, phi double")


def _damp(phi: Column, k: Column) -> Column:
    """phi + phi^2 + ... + phi^k."""
    return F.when(phi >= 1, k.cast("double")).otherwise(phi * (1 - F.pow(phi, k)) / (1 - phi))


def holt(series: DataFrame, origins: DataFrame, steps: int = MAX_STEP, damped: bool = False, rows: int | None = None) -> DataFrame:
    """Linear trend (damped on request), not under 0."""
    if rows is None:
        fit = origins.join(trend_states(series, damped), ["entity", "origin"])
    else:
        fit = trend_fit(histories(series, origins, rows), damped)
    return long(fit, "holt_damped" if damped else "holt", F.col("level") + F.col("trend") * _damp(F.col("phi"), F.col("step")), steps, True)


def adjusted_histories(series: DataFrame, origins: DataFrame, smooth: int = 3, rows: int | None = None, factors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(origins with ys, each of all values up to the origin, or the last `rows`, divided by its week's factor, and factors as known at the origin)."""
    f = factors if factors is not None else seasonal_factors(series, origins, smooth)
    rows_ = origins.select("entity", "origin", F.col("widx").alias("last")).join(series, "entity").where("widx <= last")
    if rows is not None:
        rows_ = rows_.where(F.col("widx") > F.col("last") - rows)
    rows_ = rows_.withColumn("week", F.weekofyear("date")).join(f, ["entity", "origin", "week"])
    value = F.when(F.col("factor") > 0, F.col("y") / F.col("factor")).otherwise(F.col("y"))
    lists = rows_.groupBy("entity", "origin").agg(F.array_sort(F.collect_list(F.struct("widx", value.alias("v")))).alias("z"))
    return origins.join(lists.select("entity", "origin", F.transform("z", lambda x: x["v"]).alias("ys")), ["entity", "origin"]), f


def _reseasoned(states: DataFrame, kind: str, value: Column, steps: int) -> DataFrame:
    """The fitted path of a kind times the factor of each step's week; value may use the fit's fields and step."""
    rows = states.select("entity", "origin", "factors", F.col("fits")[kind].alias("_fit")).where("_fit IS NOT NULL").select("entity", "origin", "factors", "_fit.*")
    return long(rows, kind, value * _factor(F.col("factors"), F.col("step")), steps, True)


def adjusted_trend(series: DataFrame, origins: DataFrame, steps: int = MAX_STEP, damped: bool = True, smooth: int = 3, states: DataFrame | None = None) -> DataFrame:
    """Factor-adjusted exponential smoothing: divide by the factors, fit, multiply back."""
    kind = "fa_ets_d" if damped else "fa_ets"
    states = states if states is not None else seasonal_states(series, origins, smooth, (kind,))
    return _reseasoned(states, kind, F.col("level") + F.col("trend") * _damp(F.col("phi"), F.col("step")), steps)


def adjusted_theta(series: DataFrame, origins: DataFrame, steps: int = MAX_STEP, smooth: int = 3, states: DataFrame | None = None) -> DataFrame:
    """Factor-adjusted Theta: simple smoothing with half the slope of the line as drift."""
    states = states if states is not None else seasonal_states(series, origins, smooth, ("fa_theta",))
    drift = F.col("slope") / 2 * (F.col("step") - 1 + (1 - F.pow(1 - F.col("alpha"), "n")) / F.col("alpha"))
    return _reseasoned(states, "fa_theta", F.col("level") + drift, steps)


def running_gram(rows: DataFrame, origins: DataFrame, xs: list[str], y: str, known: str) -> DataFrame:
    """gram of the rows (entity, known, xs, y) known by each origin, from running sums that serve all origins of an entity."""
    ok = rows
    for c in [*xs, y]:
        ok = ok.where(F.col(c).isNotNull())
    names = [*xs, y]
    # Less each entity's first values, which changes no centred sum and keeps the digits.
    first = Window.partitionBy("entity").orderBy(known, "date")
    ok = ok.select("entity", F.col(known).alias("_at"), *[F.first(c).over(first).alias(f"_o{i}") for i, c in enumerate(names)], *[(F.col(c) - F.first(c).over(first)).alias(f"_v{i}") for i, c in enumerate(names)])
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per = ok.groupBy("entity", "_at").agg(
        F.count("*").alias("_n"), *[F.first(f"_o{i}").alias(f"_o{i}") for i in range(k)], *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(k)], *[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_q{i}_{j}") for i, j in pairs]
    )
    w = Window.partitionBy("entity").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = ["_n", *[f"_s{i}" for i in range(k)], *[f"_q{i}_{j}" for i, j in pairs]]
    run = per.select("entity", "_at", *[F.sum(c).over(w).alias(c) for c in sums], *[f"_o{i}" for i in range(k)])
    from .joins import asof_join

    at = asof_join(origins.select("entity", "origin"), run, "origin", "_at", [*sums, *[f"_o{i}" for i in range(k)]], ["entity"]).where("_n > 0")
    n = F.col("_n")
    centred = lambda i, j: F.col(f"_q{min(i, j)}_{max(i, j)}") - F.col(f"_s{i}") * F.col(f"_s{j}") / n
    mean = lambda i: F.col(f"_s{i}") / n + F.col(f"_o{i}")
    p = k - 1
    return at.select(
        "entity", "origin", n.alias("n"), F.array(*[mean(i) for i in range(p)]).alias("mean_x"), mean(p).alias("mean_y"),
        F.array(*[centred(i, j) for i in range(p) for j in range(p)]).alias("sxx"), F.array(*[centred(i, p) for i in range(p)]).alias("sxy"), centred(p, p).alias("syy"),
    )


def exogenous_modifier(panel: DataFrame, origins: DataFrame, lags: dict[str, int], ridge: float = 1.0, least: int = 10, ahead: int = 0) -> DataFrame:
    """(entity, origin, modifier): ridge of the y change on the factors at calendar lags, fitted on rows up to the origin, predicted at it.

    With ahead = 0 the change is week on week; with ahead = h it is the change over the next h weeks, known by the origin.
    Spark adds up running sums of products once per entity; only a (p + 1)-sided system per (entity, origin) reaches NumPy.
    """
    xs = [f"x_{f}" for f in lags]
    rows = panel
    for f, weeks in lags.items():
        past = panel.select("entity", F.date_add("date", 7 * weeks).alias("date"), F.col(f).alias(f"x_{f}"))
        rows = rows.join(past, ["entity", "date"], "left")
    if ahead:
        rows = rows.withColumn("z", pct(F.lead("y", ahead).over(by_date()), F.col("y"))).withColumn("_known", F.date_add("date", 7 * ahead))
    else:
        rows = rows.withColumn("z", pct(F.col("y"), F.lag("y").over(by_date()))).withColumn("_known", F.col("date"))
    sums = running_gram(rows, origins, xs, "z", "_known").where(F.col("n") >= least)
    coefs = with_coefficients(sums, ridge)
    at = rows.select("entity", F.col("date").alias("origin"), F.array(*xs).alias("x0"), F.col("y").alias("y0"))
    known = coefs.join(at, ["entity", "origin"]).where(~F.exists("x0", lambda v: v.isNull()))
    return known.select("entity", "origin", "y0", (F.col("intercept") + dot(F.col("coef"), F.col("x0"))).alias("modifier"))


def anchored(modifiers: DataFrame, steps: int = MAX_STEP, compound: bool = False, channel: str = "macro") -> DataFrame:
    """y0 * (1 + m), or * (1 + m)^step; two decimals, not under 0."""
    factor = F.pow(1 + F.col("modifier"), F.col("step")) if compound else 1 + F.col("modifier")
    return long(modifiers, channel, F.round(F.col("y0") * factor, 2), steps, True)


def applied_to(modifiers: DataFrame, forecasts: DataFrame, channel: str) -> DataFrame:
    """Another channel's forecast times (1 + m)."""
    return forecasts.join(modifiers.select("entity", "origin", "modifier"), ["entity", "origin"]).select(
        F.lit(channel).alias("channel"), "entity", "origin", "step", (F.col("yhat") * (1 + F.col("modifier"))).alias("yhat")
    )


def mean_level(series: DataFrame, origins: DataFrame) -> DataFrame:
    """(entity, origin, level): mean of the history up to each origin."""
    run = series.select("entity", F.col("date").alias("origin"), F.avg("y").over(by_date().rowsBetween(Window.unboundedPreceding, 0)).alias("level"))
    return origins.select("entity", "origin").join(run, ["entity", "origin"])


def structural_level(series: DataFrame, origins: DataFrame, static: DataFrame, features: list[str], ridge: float = 1.0, leave_out: bool = False) -> DataFrame:
    """(entity, origin, level): mean level predicted from static features, standardised over entities; needs three entities.

    With leave_out an entity is not among the rows that its own prediction is fitted on: its part is taken off the sums of all.
    """
    rows = mean_level(series, origins).join(static.select("entity", *features), "entity")
    for f in features:
        rows = rows.where(F.col(f).isNotNull())
    names = [*features, "level"]
    k, p = len(names), len(features)
    w = Window.partitionBy("origin")
    # Less the mean over all entities, which changes no centred sum and keeps the digits.
    mid = {c: F.avg(c).over(w) for c in names}
    rows = rows.select("entity", "origin", *features, *[mid[c].alias(f"_o{i}") for i, c in enumerate(names)], *[(F.col(c) - mid[c]).alias(f"_v{i}") for i, c in enumerate(names)])
    own = F.lit(1 if leave_out else 0)
    less = lambda e: F.sum(e).over(w) - own * e
    sums = rows.select("entity", "origin", *features, *[f"_o{i}" for i in range(k)], (F.count("*").over(w) - own).alias("n"), *[less(F.col(f"_v{i}")).alias(f"_s{i}") for i in range(k)], *[less(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_q{i}_{j}") for i in range(k) for j in range(i, k)])
    sums = sums.where("n >= 3")
    n = F.col("n")
    centred = lambda i, j: F.col(f"_q{min(i, j)}_{max(i, j)}") - F.col(f"_s{i}") * F.col(f"_s{j}") / n
    mean = lambda i: F.col(f"_s{i}") / n + F.col(f"_o{i}")
    sd = [F.sqrt(F.greatest(centred(i, i) / n, F.lit(0.0))) for i in range(p)]
    flat = [s <= 1e-12 * (1 + F.abs(mean(i))) for i, s in enumerate(sd)]  # a feature that does not vary has no part
    scaled = lambda i, e: F.when(flat[i], 0.0).otherwise(e / sd[i])
    table = sums.select(
        "entity", "origin", "n", F.array(*[F.lit(0.0) for _ in features]).alias("mean_x"), mean(p).alias("mean_y"),
        F.array(*[F.when(flat[i] | flat[j], 0.0).otherwise(centred(i, j) / sd[i] / sd[j]) for i in range(p) for j in range(p)]).alias("sxx"), F.array(*[scaled(i, centred(i, p)) for i in range(p)]).alias("sxy"),
        F.array(*[scaled(i, F.col(f) - mean(i)) for i, f in enumerate(features)]).alias("_x0"),
    )
    return with_coefficients(table, ridge).select("entity", "origin", (F.col("intercept") + dot(F.col("coef"), F.col("_x0"))).alias("level"))


def reversion(series: DataFrame, origins: DataFrame, levels: DataFrame, horizons: list[int], rho: float = 0.3, channel: str = "reversion") -> DataFrame:
    """(channel, entity, origin, h, step, yhat): y0 + rho (k/h)^2 (level - y0), two decimals, not under 0. Depends on h."""
    rows = last_value(series, origins).join(levels, ["entity", "origin"]).withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("h"))))
    value = F.col("y0") + rho * F.pow(F.col("step") / F.col("h"), 2) * (F.col("level") - F.col("y0"))
    return rows.select(F.lit(channel).alias("channel"), "entity", "origin", "h", "step", F.greatest(F.round(value, 2), F.lit(0.0)).alias("yhat"))


def historical_mean(series: DataFrame, origins: DataFrame, horizons: list[int], rho: float = 0.3) -> DataFrame:
    """Mean reversion to the entity's own historical mean."""
    return reversion(series, origins, mean_level(series, origins), horizons, rho, "histmean")


def event_flat(series: DataFrame, origins: DataFrame, weekly: DataFrame, window: int = 8, steps: int = MAX_STEP) -> DataFrame:
    """The last value, with confidence 0 where no event is live."""
    live = active_event(origins.select("entity", F.col("origin").alias("week")), weekly, window).select("entity", F.col("week").alias("origin"), F.when(F.col("live"), F.col("confidence")).otherwise(0.0).alias("confidence"))
    flat = naive(series, origins, steps).withColumn("channel", F.lit("event"))
    return flat.join(live, ["entity", "origin"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def event_scaled(series: DataFrame, origins: DataFrame, weekly: DataFrame, grid: DataFrame, steps: int = MAX_STEP) -> DataFrame:
    """(scale, window, channel, entity, origin, step, yhat): y0 (1 + impact * scale) while the event is at most `window` weeks old. grid: a few rows."""
    asks = active_event(origins.select("entity", F.col("origin").alias("week")), weekly, 10_000).select("entity", F.col("week").alias("origin"), "impact", "age_weeks")
    rows = last_value(series, origins).join(asks, ["entity", "origin"], "left").crossJoin(F.broadcast(grid))
    rows = rows.withColumn("f", F.when(F.col("age_weeks") <= F.col("window"), 1 + F.col("impact") * F.col("scale")).otherwise(1.0))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return rows.select("scale", "window", F.lit("event_scaled").alias("channel"), "entity", "origin", "step", (F.col("y0") * F.col("f")).alias("yhat"))


def flow_regression(panel: DataFrame, origins: DataFrame, a: str, b: str, share: str, steps: int = 4, lag: int = 0) -> DataFrame:
    """Pooled direct regression: the k-step log change on (1, log(a / b), share) over all entities, one system per (origin, step)."""
    x1 = F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b)))
    rows = panel.where("y > 0").select("entity", "date", "y", F.lag(x1, lag).over(by_date()).alias("x1"), F.lag(share, lag).over(by_date()).alias("x2"))
    ks = range(1, steps + 1)
    led = rows.withColumns({f"z{k}": F.log(F.lead("y", k).over(by_date()) / F.col("y")) for k in ks} | {f"k{k}": F.lead("date", k).over(by_date()) for k in ks})
    ahead = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"z{k}").alias("z"), F.col(f"k{k}").alias("known")) for k in ks]))
    long_ = led.select("entity", "date", "x1", "x2", ahead.alias("s")).select("entity", "date", "x1", "x2", "s.*")
    at = origins.select("origin").distinct()
    # Sums by (known, step), added up over time: every origin's fit is a difference of running sums, made once.
    ok = long_.where("x1 IS NOT NULL AND x2 IS NOT NULL AND z IS NOT NULL")
    per = ok.groupBy("step", "known").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in ("x1", "x2", "z")], *[F.sum(F.col(p) * F.col(q)).alias(f"s_{p}{q}") for p, q in (("x1", "x1"), ("x1", "x2"), ("x2", "x2"), ("x1", "z"), ("x2", "z"))]
    )
    w = Window.partitionBy("step").orderBy("known").rowsBetween(Window.unboundedPreceding, 0)
    sums = [c for c in per.columns if c not in ("step", "known")]
    run = per.select("step", F.col("known"), *[F.sum(c).over(w).alias(c) for c in sums])
    asked = at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    from .joins import asof_join

    fit = asof_join(asked, run, "origin", "known", sums, ["step"]).where("n >= 4")
    c = lambda p, q: F.col(f"s_{p}{q}") - F.col(f"s_{p}") * F.col(f"s_{q}") / F.col("n")
    fit = fit.select("origin", "step", "n", F.array(F.col("s_x1") / F.col("n"), F.col("s_x2") / F.col("n")).alias("mean_x"), (F.col("s_z") / F.col("n")).alias("mean_y"), F.array(c("x1", "x1"), c("x1", "x2"), c("x1", "x2"), c("x2", "x2")).alias("sxx"), F.array(c("x1", "z"), c("x2", "z")).alias("sxy"))
    known = rows.select("entity", F.col("date").alias("origin"), "y", F.array("x1", "x2").alias("x0"))
    both = with_coefficients(fit).join(origins.select("entity", "origin"), "origin").join(known, ["entity", "origin"]).where(~F.exists("x0", lambda v: v.isNull()))
    return both.select(F.lit("flow").alias("channel"), "entity", "origin", "step", (F.col("y") * F.exp(F.col("intercept") + dot(F.col("coef"), F.col("x0")))).alias("yhat"))


def publication_lagged(channel, series: DataFrame, origins: DataFrame, lag: int, steps: int = MAX_STEP) -> DataFrame:
    """channel(series, origins, steps) as it would be with data `lag` rows late: forecast from the earlier row, keep steps past the lag."""
    dates = series.select("entity", "widx", "date")
    info = origins.select("entity", F.col("origin").alias("asked"), (F.col("widx") - lag).alias("widx")).join(dates, ["entity", "widx"]).withColumnRenamed("date", "origin")
    made = channel(series, info.select("entity", "origin", "widx"), steps + lag)
    back = made.join(info.select("entity", "origin", "asked"), ["entity", "origin"]).where(F.col("step") > lag)
    return back.select("channel", "entity", F.col("asked").alias("origin"), (F.col("step") - lag).alias("step"), "yhat")


def information_origins(series: DataFrame, origins: DataFrame, lags: Iterable[int]) -> DataFrame:
    """(entity, origin, widx): the rows that forecasts at the origins start from when data are so many rows late."""
    late = F.explode(F.array(*[F.col("widx") - lag for lag in lags]))
    return origins.select("entity", late.alias("widx")).distinct().join(series.select("entity", "widx", F.col("date").alias("origin")), ["entity", "widx"]).select("entity", "origin", "widx")


def choose_damping(losses: DataFrame, undamped: str, damped: str) -> DataFrame:
    """(fold, h, channel): the damped one only where its validation loss is less."""
    best = losses.groupBy("fold", "h").agg(F.avg(F.when(F.col("channel") == undamped, F.col("mape"))).alias("u"), F.avg(F.when(F.col("channel") == damped, F.col("mape"))).alias("d"))
    return best.select("fold", "h", F.when(F.col("d") < F.col("u"), damped).otherwise(undamped).alias("channel"))


def blend(forecasts: DataFrame, channel: str = "blend") -> DataFrame:
    """Mean of the channels."""
    return forecasts.groupBy("entity", "origin", "h", "step").agg(F.avg("yhat").alias("yhat")).select(F.lit(channel).alias("channel"), "entity", "origin", "h", "step", "yhat")


def with_spillover(forecasts: DataFrame, signals: DataFrame, h: int | Column, strength: float = 0.0) -> DataFrame:
    """yhat (1 + strength * trend * step / h); 0 leaves it."""
    joined = forecasts.join(signals.select("entity", "origin", "trend"), ["entity", "origin"], "left")
    return joined.withColumn("yhat", F.col("yhat") * (1 + strength * F.coalesce("trend", F.lit(0.0)) * F.col("step") / h)).drop("trend")


def slope_disagreement(series: DataFrame, origins: DataFrame, rows: int = 13) -> DataFrame:
    """Per entity: origins, and those whose fitted trend and whose move over the next rows have other signs."""
    fit = origins.join(trend_states(series), ["entity", "origin"])
    ahead = series.select("entity", F.col("date").alias("origin"), (F.lead("y", rows).over(by_date()) - F.col("y")).alias("move"))
    both = fit.join(ahead, ["entity", "origin"]).where("move IS NOT NULL")
    return both.groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.when(F.signum("trend") * F.signum("move") < 0, 1).otherwise(0)).alias("n_disagree"))


