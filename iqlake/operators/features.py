"""Feature dictionaries: what a model's complex columns are, and the columns over lagged samples.

A feature is a pair of Columns (re, im). The driver enumerates terms; Spark sees one projection over lags that share one
window, so one sort per frame serves the whole dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.functions.scalar import Pair, amplitude, hat_basis, scale
from iqlake.operators.selection import exact_quantiles
from iqlake.operators.windows import shifted


def delayed(delay: int, cols: tuple[str, str] = ("i", "q")) -> Pair:
    return shifted(cols[0], delay), shifted(cols[1], delay)


def lagged_frame(df: DataFrame, delays: list[int], cols: tuple[str, str] = ("i", "q"), name: str = "x") -> DataFrame:
    """Columns name_i_d, name_q_d and the amplitude name_r_d of every delay, m for minus."""
    tag = lambda d: f"m{-d}" if d < 0 else str(d)
    df = df.withColumns({f"{name}_{p}_{tag(d)}": shifted(c, d) for d in delays for p, c in zip("iq", cols, strict=True)})
    return df.withColumns({f"{name}_r_{tag(d)}": amplitude(f"{name}_i_{tag(d)}", f"{name}_q_{tag(d)}") for d in delays})


def sample(d: int, name: str = "x") -> Pair:
    t = f"m{-d}" if d < 0 else str(d)
    return F.col(f"{name}_i_{t}"), F.col(f"{name}_q_{t}")


def radius(d: int, name: str = "x") -> Column:
    return F.col(f"{name}_r_{f'm{-d}' if d < 0 else d}")


def int_power(r: Column, e: int) -> Column:
    return F.lit(1.0) if e == 0 else reduce(lambda a, b: a * b, [r] * e)


@dataclass(frozen=True)
class Term:
    """x[n - signal] abs(x[n - envelope]) ** exponent."""

    exponent: int
    signal: int
    envelope: int

    def pair(self) -> Pair:
        return scale(sample(self.signal), int_power(radius(self.envelope), self.exponent))


def unique_ints(values: list[int], least: int) -> list[int]:
    """Whole numbers of at least ``least`` without repeats, or an error."""
    if not values or len(set(values)) != len(values) or min(values) < least or not all(isinstance(v, int) for v in values):
        raise ValueError("values must be distinct whole numbers in range")
    return list(values)


def memory_polynomial(orders: list[int], delays: list[int]) -> list[Term]:
    """Delay-major, then order: x[n-d] abs(x[n-d]) ** (p - 1)."""
    return [Term(p - 1, d, d) for d in unique_ints(delays, 0) for p in unique_ints(orders, 1)]


def generalized(ka: int, la: int, kb: int = 0, lb: int = 0, mb: int = 0, kc: int = 0, lc: int = 0, mc: int = 0, causal: bool = True) -> list[Term]:
    """Aligned, lagging and leading products; ``causal`` leaves out leads beyond the signal's own delay."""
    aligned = [Term(e, d, d) for e in range(ka) for d in range(la)]
    lagging = [Term(e, d, d + m) for e in range(1, kb + 1) for d in range(lb) for m in range(1, mb + 1)]
    leading = [Term(e, d, d - m) for e in range(1, kc + 1) for d in range(lc) for m in range(1, mc + 1) if not causal or m <= d]
    return aligned + lagging + leading


def fir(delays: list[int], conjugate: bool = False) -> list[tuple[int, bool]]:
    return [(d, conjugate) for d in unique_ints(delays, 0)]


def delays_of(terms: list[Term]) -> list[int]:
    return sorted({d for t in terms for d in (t.signal, t.envelope)})


def design(df: DataFrame, terms: list[Term], keep: list[str] | None = None) -> DataFrame:
    """Rows with ``phi``, the dictionary as interleaved re, im doubles."""
    wide = lagged_frame(df, delays_of(terms))
    return wide.select(*(keep or df.columns), F.array(*[c for t in terms for c in t.pair()]).alias("phi"))


def linear_design(df: DataFrame, taps: list[tuple[int, bool]], keep: list[str] | None = None, cols: tuple[str, str] = ("i", "q")) -> DataFrame:
    """x[n - d] or its conjugate for each tap."""
    wide = lagged_frame(df, sorted({d for d, _ in taps}), cols)
    pairs = [(sample(d)[0], -sample(d)[1] if c else sample(d)[1]) for d, c in taps]
    return wide.select(*(keep or df.columns), F.array(*[c for p in pairs for c in p]).alias("phi"))


def spline_design(df: DataFrame, knots: list[float], branches: list[tuple[int, int]], keep: list[str] | None = None) -> DataFrame:
    """x[n - m] B_k(abs(x[n - d])) for branches (m, d), branch-major."""
    knots = strict_knots(knots)
    wide = lagged_frame(df, sorted({d for b in branches for d in b}))
    parts = []
    for m, d in branches:
        si, sq = sample(m)
        parts.append(F.flatten(F.transform(hat_basis(radius(d), knots), _times(si, sq))))
    return wide.select(*(keep or df.columns), F.concat(*parts).alias("phi"))


def _times(si: Column, sq: Column):  # noqa: ANN202
    return lambda b: F.array(si * b, sq * b)


def strict_knots(knots: list[float]) -> list[float]:
    k = [float(x) for x in knots]
    if len(k) < 2 or not np.all(np.isfinite(k)) or k[0] < 0 or any(b <= a for a, b in zip(k, k[1:])):
        raise ValueError("knots must be finite, not negative and ascending, two at least")
    return k


def make_knots(df: DataFrame, count: int, strategy: str = "uniform_amplitude", bend: float = 2.0, unique: bool = True) -> list[float]:
    """Knots from one aggregate of the calibration samples.

    Strategies: uniform_amplitude, uniform_power, quantile (0 and the maximum forced; repeats dropped, or an error if not
    ``unique``), compression_aware (finer toward the top).
    """
    r = amplitude("i", "q")
    u = np.linspace(0.0, 1.0, count)
    if strategy == "quantile":
        got = exact_quantiles(df, r, [float(x) for x in u]).first()["q"]
        knots = [0.0, *got[1:-1], got[-1]]
        if len(set(knots)) < len(knots) and not unique:
            raise ValueError("repeated quantile knots")
        return strict_knots(sorted(set(knots)))
    top = df.agg(F.max(r).alias("m")).first()["m"]
    if not top:
        raise ValueError("calibration samples are all zero")
    shape = {"uniform_amplitude": u, "uniform_power": np.sqrt(u), "compression_aware": 1 - (1 - u) ** bend}
    if strategy not in shape:
        raise ValueError(f"unknown strategy {strategy}")
    return strict_knots((top * shape[strategy]).tolist())


def curvature(knots: list[float]) -> np.ndarray:
    """Second derivative of a piecewise-linear function at inner knots, rows weighted by the root of their share of the axis."""
    k = np.asarray(strict_knots(knots))
    h = np.diff(k)
    rows = np.zeros((max(0, len(k) - 2), len(k)))
    for j in range(len(rows)):
        a, b = h[j], h[j + 1]
        rows[j, j : j + 3] = np.array([2 / (a * (a + b)), -2 / (a * b), 2 / (b * (a + b))]) * np.sqrt((a + b) / 2)
    return rows
