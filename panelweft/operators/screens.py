"""Point-in-time Granger screens: who led whom, as far as could be known at each of several dates."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import f_tail
from .stats import benjamini_hochberg
from .windows import weekly_change

#: Entities of a block; a task meets one block of targets with one block of sources.
BLOCK = 64


def own_growth(series: DataFrame) -> DataFrame:
    """(entity, date, y): each entity's change beyond the week's mean change over entities; a missing change counts 0. Looks back one row only."""
    own = F.col("change") - F.avg("change").over(Window.partitionBy("date"))
    return weekly_change(series).select("entity", "date", F.coalesce(own, F.lit(0.0)).alias("y"))


def _differences(days: np.ndarray, values: np.ndarray, since: int, until: int, growth: bool, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one entity within the window: days, and beside each first difference its max_lag predecessors."""
    inside = (days >= since) & (days <= until)
    days, values = days[inside], values[inside]
    if growth and len(values):
        values = np.cumprod(np.r_[1.0, 1.0 + values[1:]])
    d = np.diff(values)
    n = len(d) - max_lag
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros((0, max_lag + 1))
    return days[1 + max_lag :], np.column_stack([d[max_lag - k : max_lag - k + n] for k in range(max_lag + 1)])


def _placed(found: list[tuple[np.ndarray, np.ndarray]], grid: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(days x entities x columns from `first` on, days x entities mask); 0 where an entity has no row."""
    width = found[0][1].shape[1] - first
    values, mask = np.zeros((len(grid), len(found), width)), np.zeros((len(grid), len(found)))
    for e, (days, rows) in enumerate(found):
        at = np.searchsorted(grid, days)
        values[at, e], mask[at, e] = rows[:, first:], 1.0
    return values, mask


def _cross_sums(a: np.ndarray, mask_a: np.ndarray, b: np.ndarray, mask_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, centred cross products) of the columns of target i beside those of source j, over the days that both have: a few matrix products for the block."""
    p, q = a.shape[2], b.shape[2]
    n = (mask_a.T @ mask_b)[i, j]
    own = lambda v, m: np.einsum("tei,tf->efi", v, m, optimize=True)
    squares = lambda v: (v[:, :, :, None] * v[:, :, None, :]).reshape(*v.shape[:2], -1)
    s = np.empty((len(i), p + q))
    s[:, :p], s[:, p:] = own(a, mask_b)[i, j], own(b, mask_a)[j, i]
    xx = np.empty((len(i), p + q, p + q))
    xx[:, :p, :p] = own(squares(a), mask_b)[i, j].reshape(-1, p, p)
    xx[:, p:, p:] = own(squares(b), mask_a)[j, i].reshape(-1, q, q)
    both = np.einsum("tei,tfj->efij", a, b, optimize=True)[i, j]
    xx[:, :p, p:], xx[:, p:, :p] = both, both.transpose(0, 2, 1)
    return n, xx - s[:, :, None] * s[:, None, :] / np.maximum(n, 1)[:, None, None]


def _left(xx: np.ndarray, columns: list[int]) -> np.ndarray:
    """What is left of the first column's square when the others are taken out, by least norm where they are dependent."""
    inner = np.linalg.pinv(xx[:, columns][:, :, columns], rcond=1e-12, hermitian=True)
    xy = xx[:, columns, 0]
    return xx[:, 0, 0] - np.einsum("ni,nij,nj->n", xy, inner, xy)


def granger_at(pairs: DataFrame, series: DataFrame, dates: list[dt.date], max_lag: int = 8, weeks: int = 104, least: int = 60, growth: bool = False, block: int = BLOCK) -> DataFrame:
    """(as_of, source, target, best_lag, f_stat, p_value, n_obs): does the source's past help predict the target, beyond the target's own?

    At each date only rows of the `weeks` up to it count; later ones change nothing. First differences (with growth, of the index from 1
    that the growth rates y make); an F test at each lag on the same rows; least p times the number of lags, at most 1; tests with fewer
    than `least` rows are left out. pairs (source, target); series (entity, date, y); a null y is no row.

    An entity's rows are one list. Entities are dealt over blocks, and a task gets one block of targets, one of sources and the pairs asked
    of them, so what moves is each list once per block and never a row per pair and week; cross products of a block are matrix products.
    """
    rows = series.where(F.col("y").isNotNull()).where(F.col("date").between(F.lit(min(dates) - dt.timedelta(weeks=weeks)), F.lit(max(dates))))
    lists = rows.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(F.datediff("date", F.lit(dt.date(1970, 1, 1))).alias("day"), F.col("y").cast("double").alias("v")))).alias("rows"))
    blocks = max(1, -(-series.select("entity").distinct().count() // block))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    parts = [F.transform("rows", lambda r: r["day"]).alias("days"), F.transform("rows", lambda r: r["v"]).alias("values")]
    targets = lists.select(of("entity").alias("bi"), every.alias("bj"), F.lit("target").alias("kind"), "entity", F.lit(None).cast("string").alias("other"), *parts)
    sources = lists.select(every.alias("bi"), of("entity").alias("bj"), F.lit("source").alias("kind"), "entity", F.lit(None).cast("string").alias("other"), *parts)
    none = [F.lit(None).cast("array<int>").alias("days"), F.lit(None).cast("array<double>").alias("values")]
    asked = pairs.select(of("target").alias("bi"), of("source").alias("bj"), F.lit("pair").alias("kind"), F.col("target").alias("entity"), F.col("source").alias("other"), *none)
    until = [(d, (d - dt.date(1970, 1, 1)).days) for d in dates]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {k: {r.entity: (np.asarray(r.days), np.asarray(r.values, float)) for r in pdf[pdf["kind"] == k][["entity", "days", "values"]].itertuples(index=False, name="Row")} for k in ("target", "source")}
        known = [(r.other, r.entity) for r in pdf[pdf["kind"] == "pair"].itertuples(index=False) if r.entity in side["target"] and r.other in side["source"]]
        out: list[tuple] = []
        if not known:
            return pd.DataFrame(out, columns=["as_of", "source", "target", "best_lag", "f_stat", "p_value", "n_obs"])
        names = {k: sorted(side[k]) for k in side}
        i = np.array([names["target"].index(t) for _, t in known])
        j = np.array([names["source"].index(s) for s, _ in known])
        for date, day in until:
            a, b = ([_differences(*side[k][e], day - 7 * weeks, day, growth, max_lag) for e in names[k]] for k in ("target", "source"))
            grid = np.unique(np.concatenate([days for days, _ in a + b]))
            if not len(grid):
                continue
            n, xx = _cross_sums(*_placed(a, grid, 0), *_placed(b, grid, 1), i, j)
            enough = np.flatnonzero(n >= least)
            n, xx = n[enough], xx[enough]
            best_p, best_f, best_k = np.full(len(n), 2.0), np.zeros(len(n)), np.zeros(len(n), int)
            for k in range(1, max_lag + 1):
                own, both = list(range(1, k + 1)), [*range(1, k + 1), *range(max_lag + 1, max_lag + 1 + k)]
                r0, r1 = _left(xx, own), _left(xx, both)
                free = n - 2 * k - 1
                f = np.where((free > 0) & (r1 > 1e-12), (r0 - r1) / k / np.maximum(r1 / np.maximum(free, 1), 1e-300), 0.0)
                p = np.array([f_tail(x, k, m) if m > 0 else 1.0 for x, m in zip(f.tolist(), free.tolist(), strict=True)])
                better = p < best_p
                best_p, best_f, best_k = np.where(better, p, best_p), np.where(better, f, best_f), np.where(better, k, best_k)
            out += [(date, *known[e], int(k), float(f), min(1.0, float(p) * max_lag), int(m)) for e, k, f, p, m in zip(enough.tolist(), best_k, best_f, best_p, n, strict=True)]
        return pd.DataFrame(out, columns=["as_of", "source", "target", "best_lag", "f_stat", "p_value", "n_obs"])

    shape = "as_of date, source string, target string, best_lag int, f_stat double, p_value double, n_obs bigint"
    return targets.unionByName(sources).unionByName(asked).groupBy("bi", "bj").applyInPandas(run, shape)


def graph_at(pairs: DataFrame, series: DataFrame, dates: list[dt.date], max_lag: int = 8, weeks: int = 104, least: int = 60, q: float = 0.05) -> DataFrame:
    """Edges as of each date, of the series without their common movement, with significant (Benjamini-Hochberg over the pairs of a date)."""
    edges = granger_at(pairs, own_growth(series), dates, max_lag, weeks, least, growth=True)
    return benjamini_hochberg(edges, ["as_of"], q).withColumnRenamed("reject", "significant")


def known_at(rows: DataFrame, dates: list[dt.date], on: str = "origin") -> DataFrame:
    """rows with as_of, the latest of the dates at or before `on`; rows before the first one are left out."""
    past = F.filter(F.array(*[F.lit(d) for d in sorted(dates, reverse=True)]), lambda d: d <= F.col(on))
    return rows.withColumn("as_of", F.get(past, F.lit(0))).where("as_of IS NOT NULL")
