"""Scalar functions and coefficients used by the spectral methods; small arrays on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def jackson(n: int) -> np.ndarray:
    """Jackson damping factors g_0 .. g_{n-1}."""
    k, q = np.arange(n), np.pi / (n + 1)
    return ((n - k + 1) * np.cos(q * k) + np.sin(q * k) / np.tan(q)) / (n + 1)


def fermi_dirac(e: Column, mu: float, beta: float) -> Column:
    """Occupation, written so that neither sign overflows."""
    x = (e - mu) * beta
    z = F.exp(-F.abs(x))
    return F.when(x >= 0, z / (1 + z)).otherwise(1 / (1 + z))


def gaussian(e: Column, mu: float) -> Column:
    """exp(-(e - mu)^2)."""
    return F.exp(-(e - mu) * (e - mu))


def chebyshev_coefficients(f: Callable[[np.ndarray], np.ndarray], n: int, center: float = 0.0, half: float = 1.0) -> np.ndarray:
    """Jackson-damped coefficients of f on [center - half, center + half]; the first is halved."""
    m = 2 * n
    t = np.pi * (np.arange(m) + 0.5) / m
    y = np.asarray(f(center + half * np.cos(t)))
    c = np.array([2 / m * (y * np.cos(j * t)).sum() for j in range(n)]) * jackson(n)
    c[0] /= 2
    return c


def ozaki(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Poles and residues of the continued-fraction form of the Fermi function."""
    k = np.arange(1, 2 * m)
    off = 1 / (2 * np.sqrt((2 * k - 1.0) * (2 * k + 1.0)))
    values, vectors = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    up = values > 0
    return 1 / values[up], vectors[0, up] ** 2 / (4 * values[up] ** 2)


def bessel(n: int, x: float) -> np.ndarray:
    """J_0(x) .. J_{n-1}(x) by their integral on a fine grid."""
    t = (np.arange(4096) + 0.5) * np.pi / 4096
    return np.array([np.cos(j * t - x * np.sin(t)).mean() for j in range(n)])


def chebyshev_values(n: int, x: Column) -> list[Column]:
    """T_0(x) .. T_{n-1}(x) for x in [-1, 1]."""
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)))
    return [F.cos(angle * float(j)) for j in range(n)]


MASK = (1 << 64) - 1
#: Fixed values of the counter hash: the step and two multipliers of splitmix64, and one multiplier each for block, row and column.
STEP, MUL_1, MUL_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
KEY_BLOCK, KEY_ROW, KEY_COL = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93


def splitmix64(x: np.ndarray) -> np.ndarray:
    """Next value of the generator for each state (uint64)."""
    x = x.astype(np.uint64) + np.uint64(STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MUL_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MUL_2)
    return x ^ (x >> np.uint64(31))


def entry_hash(seed: int, b: np.ndarray, r: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Hash of (seed, block, row, column), so any partitioning draws the same."""
    with np.errstate(over="ignore"):
        h = splitmix64(np.full(len(b), (seed + STEP) & MASK, np.uint64))
        for part, key in ((b, KEY_BLOCK), (r, KEY_ROW), (col, KEY_COL)):
            h = splitmix64(h ^ (part.astype(np.uint64) * np.uint64(key)))
    return h


def uniform01(h: np.ndarray) -> np.ndarray:
    """In [0, 1), from the upper 53 bits."""
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def normal_from(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Box-Muller from two hashes."""
    return np.sqrt(-2 * np.log(np.maximum(uniform01(h1), 1e-300))) * np.cos(2 * np.pi * uniform01(h2))


def rademacher(seed: int, b: np.ndarray, r: np.ndarray, col: np.ndarray) -> np.ndarray:
    """+1 or -1 by the hash's upper bit."""
    return np.where(entry_hash(seed, b, r, col) >> np.uint64(63) == 1, 1.0, -1.0)


def draw(kind: str, seed: int, b: np.ndarray, r: np.ndarray, col: np.ndarray, complex_: bool) -> np.ndarray:
    """Entries of a random vector by name alone: "rademacher", "phase" (complex only) or "gaussian" of unit variance."""
    if kind == "rademacher":
        return rademacher(seed, b, r, col).astype(complex if complex_ else float)
    h = entry_hash(seed, b, r, col)
    if kind == "phase":
        if not complex_:
            raise ValueError("random phases need a complex vector")
        return np.exp(2j * np.pi * uniform01(h))
    if kind != "gaussian":
        raise ValueError(f"unknown kind {kind}")
    with np.errstate(over="ignore"):
        h2 = splitmix64(h)
        return (normal_from(h, h2) + 1j * normal_from(h2, splitmix64(h2))) / np.sqrt(2) if complex_ else normal_from(h, h2)


def random_values(kind: str, seed: int, complex_: bool):
    """``draw`` as a vectorised function of columns (block, row, column), with fields v and w."""
    if kind == "phase" and not complex_:
        raise ValueError("random phases need a complex vector")

    @pandas_udf("v double, w double")
    def values(b: pd.Series, r: pd.Series, col: pd.Series) -> pd.DataFrame:
        x = draw(kind, seed, b.to_numpy(), r.to_numpy(), col.to_numpy(), complex_)
        return pd.DataFrame({"v": np.real(x), "w": np.imag(x)})

    return values
