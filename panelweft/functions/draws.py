"""Reproducible draws: an integer generator that any SQL engine can repeat."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the linear congruential step; all products stay within 63 bits.
MULTIPLIER, INCREMENT, MODULUS = 48271, 12345, 2147483647


def draw(*parts: Column | int) -> Column:
    """An integer from 0 to MODULUS - 1 that depends on all parts, each a non-negative integer."""
    out: Column = F.lit(1).cast("bigint")
    for p in parts:
        p = F.lit(p) if isinstance(p, int) else p
        out = ((out * MULTIPLIER + INCREMENT + p.cast("bigint") % MODULUS) % MODULUS).cast("bigint")
    for _ in range(3):
        out = ((out * MULTIPLIER + INCREMENT) % MODULUS).cast("bigint")
    return out


def draws(*parts: np.ndarray | int) -> np.ndarray:
    """The same over NumPy arrays."""
    out = np.int64(1)
    for p in parts:
        out = (out * MULTIPLIER + INCREMENT + np.asarray(p, np.int64) % MODULUS) % MODULUS
    for _ in range(3):
        out = (out * MULTIPLIER + INCREMENT) % MODULUS
    return out


def draw_sql(*parts: str) -> str:
    """The same in SQL."""
    out = "CAST(1 AS BIGINT)"
    for p in parts:
        out = f"(({out} * {MULTIPLIER} + {INCREMENT} + CAST({p} AS BIGINT) % {MODULUS}) % {MODULUS})"
    for _ in range(3):
        out = f"(({out} * {MULTIPLIER} + {INCREMENT}) % {MODULUS})"
    return out
