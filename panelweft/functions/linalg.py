"""Small dense algebra on sums that Spark has made: normal equations, ridge and tail probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gram(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Per group: n, mean_x, mean_y, the centred cross products sxx (row by row) and sxy, and syy; rows with a null are left out."""
    for c in [*xs, y]:
        df = df.where(F.col(c).isNotNull())
    n = F.count("*")
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.array(*[F.avg(x) for x in xs]).alias("mean_x"),
        F.avg(y).alias("mean_y"),
        F.array(*[F.covar_pop(a, b) * n for a in xs for b in xs]).alias("sxx"),
        F.array(*[F.covar_pop(x, y) * n for x in xs]).alias("sxy"),
        (F.var_pop(y) * n).alias("syy"),
    )


def solve(sxx: np.ndarray, sxy: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """(sxx + ridge I) b = sxy, by least norm where it is singular."""
    return np.linalg.lstsq(sxx + ridge * np.eye(len(sxy)), sxy, rcond=1e-12)[0]


def with_coefficients(df: DataFrame, ridge: float = 0.0) -> DataFrame:
    """A gram table with coef (array) and intercept."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def coef(sxx: pd.Series, sxy: pd.Series) -> pd.Series:
        return pd.Series([solve(np.asarray(a, float).reshape(len(b), len(b)), np.asarray(b, float), ridge).tolist() for a, b in zip(sxx, sxy, strict=True)], dtype=object)

    df = df.withColumn("coef", coef("sxx", "sxy"))
    return df.withColumn("intercept", F.col("mean_y") - dot(F.col("coef"), F.col("mean_x")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for m in range(400):
        k = m // 2
        if m == 0:
            step = 1.0
        elif m % 2 == 0:
            step = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            step = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + step * d if abs(1 + step * d) > tiny else tiny)
        c = 1 + step / c if abs(1 + step / c) > tiny else tiny
        f *= c * d
        if m and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided probability of Student's t."""
    return 1.0 if t == 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper probability of the F distribution."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_tail(float(a), float(b)) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or c <= 0 else f_tail(float(a), float(b), float(c)) for a, b, c in zip(f, d1, d2, strict=True)], dtype="float64")
