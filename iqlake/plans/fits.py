"""Named fits: a least-squares design, the model it gives, and what is reported about the fit."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.operators import features
from iqlake.operators.models import FirCorrection, SplineModel, TermModel
from iqlake.operators.solve import Fit, fit, fit_dictionary


@dataclass(frozen=True)
class Report:
    """About one fit."""

    rows: int
    width: int
    ridge: float
    rank: int
    condition: float
    mse: float
    target_power: float
    nmse_db: float
    coefficient_norm: float
    warmup: int

    def row(self) -> dict:
        return asdict(self)


def _report(got: Fit, target_power: float, ridge: float, warmup: int) -> Report:
    if not target_power > 0:
        raise ValueError("the target has no power")
    return Report(got.rows, len(got.coef), ridge, got.rank, got.condition, got.residual_power, target_power, got.nmse_db(target_power), float(np.linalg.norm(got.coef)), warmup)


def _power(df: DataFrame, cols: tuple[str, str] = ("yi", "yq")) -> float:
    return df.agg(F.avg(F.col(cols[0]) * F.col(cols[0]) + F.col(cols[1]) * F.col(cols[1])).alias("p")).first()["p"] or 0.0


def fit_terms(df: DataFrame, terms: list[features.Term], ridge: float = 0.0, scaled: bool = True, rcond: float | None = None) -> tuple[TermModel, Report]:
    """A memory polynomial or generalised one over frames (frame, n, i, q, yi, yq)."""
    got = fit_dictionary(df, terms, ridge, scaled, rcond)
    model = TermModel(terms, list(got.coef))
    return model, _report(got, _power(df), ridge, model.warmup)


def fit_spline_memory(df: DataFrame, branches: list[tuple[int, int]], knots: list[float] | None = None, count: int = 8, strategy: str = "uniform_amplitude", ridge: float = 1e-8, bend: float = 2.0) -> tuple[SplineModel, Report]:
    """All branches (m, d) of a spline memory model jointly; history never crosses a frame. Knots from the input unless given."""
    if len(set(branches)) != len(branches) or not branches or min(min(b) for b in branches) < 0:
        raise ValueError("branches must be distinct and causal")
    knots = features.strict_knots(knots) if knots is not None else features.make_knots(df, count, strategy, bend)
    got = fit(features.spline_design(df, knots, branches), len(knots) * len(branches), ridge)
    coef = got.coef.reshape(len(branches), len(knots))
    model = SplineModel(knots, branches, [list(c) for c in coef])
    return model, _report(got, _power(df), ridge, model.warmup)


def fit_predistorter(df: DataFrame, gain: complex, branches: list[tuple[int, int]], **kw: object) -> tuple[SplineModel, Report]:
    """Indirect learning: the model that maps the measured output over ``gain`` back to the known input, to be run before the plant."""
    if not np.isfinite(gain) or gain == 0:
        raise ValueError("the gain must be finite and not 0")
    g = 1 / gain
    swapped = df.select("frame", "n", "pos", (F.col("yi") * g.real - F.col("yq") * g.imag).alias("i"), (F.col("yi") * g.imag + F.col("yq") * g.real).alias("q"), F.col("i").alias("yi"), F.col("q").alias("yq"))
    return fit_spline_memory(swapped, branches, **kw)


def fit_correction(df: DataFrame, delays: list[int], conjugate: bool = False, ridge: float = 1e-8) -> tuple[FirCorrection, Report]:
    """The second stage: FIR (or conjugate) taps on x that explain y - p of a first model (frame, n, i, q, yi, yq, pi, pq).

    Columns are scaled by their RMS before the ridge acts; a column without power, a memory as long as the shortest frame and
    as many taps as rows are errors.
    """
    delays = features.unique_ints(delays, 0)
    shortest = df.groupBy("frame").count().agg(F.min("count").alias("m")).first()["m"] or 0
    if max(delays) >= shortest:
        raise ValueError("the memory must be shorter than each frame")
    rest = df.withColumn("ri", F.col("yi") - F.col("pi")).withColumn("rq", F.col("yq") - F.col("pq"))
    target = ("ri", "rq")
    got = fit(features.linear_design(rest, features.fir(delays, conjugate)), len(delays), ridge, scaled=True, target=target)
    if got.rows <= len(delays):
        raise ValueError("more rows than taps are needed")
    model = FirCorrection(delays, list(got.coef), conjugate)
    return model, _report(got, _power(rest, target), ridge, max(delays))
