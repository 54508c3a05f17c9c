"""Frozen models as values, and their predictions as Column expressions over lagged samples.

A model is one row of the registry: type, structure, coefficients. ``predict`` adds (pi, pq) to a frame of samples; nothing
is collected, and one window per frame serves all lags.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.functions.scalar import FixedFormat, Pair, isqrt_even, monotone_codes, multiply, multiply_codes, divide_even, saturate, scale, shift_even, spline_value
from iqlake.operators.features import Term, delays_of, int_power, lagged_frame, radius, sample
from iqlake.operators.windows import shifted

OUT = ("pi", "pq")


def add(pairs: list[Pair]) -> Pair:
    return reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), pairs)


def constant(c: complex) -> Pair:
    return F.lit(float(c.real)), F.lit(float(c.imag))


@dataclass(frozen=True)
class TermModel:
    """Sum of coefficients times terms (memory polynomial, generalised memory polynomial)."""

    terms: list[Term]
    coef: list[complex]
    kind: str = "gmp_pa"

    def __post_init__(self) -> None:
        if len(self.terms) != len(self.coef):
            raise ValueError("one coefficient for each term")

    @property
    def warmup(self) -> int:
        return max(0, *(max(t.signal, t.envelope) for t in self.terms))

    @property
    def lookahead(self) -> int:
        return max(0, *(-t.envelope for t in self.terms))

    def predict(self, df: DataFrame, cols: tuple[str, str] = ("i", "q"), out: tuple[str, str] = OUT) -> DataFrame:
        """Factored by signal delay: one complex product for each, of x[n - q] with a sum over envelope powers."""
        groups: dict[int, list[tuple[Term, complex]]] = defaultdict(list)
        for t, c in zip(self.terms, self.coef, strict=True):
            groups[t.signal].append((t, c))
        wide = lagged_frame(df, delays_of(self.terms), cols)
        parts = [multiply(sample(d), add([scale(constant(c), int_power(radius(t.envelope), t.exponent)) for t, c in g])) for d, g in sorted(groups.items())]
        re, im = add(parts)
        return wide.select(*df.columns, re.alias(out[0]), im.alias(out[1]))


@dataclass(frozen=True)
class SplineModel:
    """Sum over branches (m, d) of x[n - m] C(abs(x[n - d])), C piecewise linear in the knots and clamped beyond them."""

    knots: list[float]
    branches: list[tuple[int, int]]
    coef: list[list[complex]]
    kind: str = "spline_memory_pa"
    coordinate: str = "amplitude"

    @property
    def warmup(self) -> int:
        return max(max(b) for b in self.branches)

    def predict(self, df: DataFrame, cols: tuple[str, str] = ("i", "q"), out: tuple[str, str] = OUT) -> DataFrame:
        wide = lagged_frame(df, sorted({d for b in self.branches for d in b}), cols)
        at = lambda d: radius(d) if self.coordinate == "amplitude" else radius(d) * radius(d)
        re, im = add([multiply(sample(m), spline_value(at(d), self.knots, c)) for (m, d), c in zip(self.branches, self.coef, strict=True)])
        return wide.select(*df.columns, re.alias(out[0]), im.alias(out[1]))


@dataclass(frozen=True)
class HammersteinModel:
    """A memoryless spline, then a FIR whose first tap is 1."""

    spline: SplineModel
    tail: list[complex]
    kind: str = "spline_hammerstein_pa"

    @property
    def warmup(self) -> int:
        return len(self.tail)

    def predict(self, df: DataFrame, cols: tuple[str, str] = ("i", "q"), out: tuple[str, str] = OUT) -> DataFrame:
        v = self.spline.predict(df, cols, ("_vi", "_vq"))
        taps = [(F.col("_vi"), F.col("_vq"))] + [multiply((shifted("_vi", k), shifted("_vq", k)), constant(h)) for k, h in enumerate(self.tail, 1)]
        re, im = add(taps)
        return v.select(*df.columns, re.alias(out[0]), im.alias(out[1]))


@dataclass(frozen=True)
class FirCorrection:
    """An addition to a base prediction: taps on x[n - d], or on its conjugate."""

    delays: list[int]
    coef: list[complex]
    conjugate: bool = False
    kind: str = "complex_fir_residual"

    @property
    def warmup(self) -> int:
        return max(self.delays)

    def correct(self, df: DataFrame, base: tuple[str, str] = OUT, cols: tuple[str, str] = ("i", "q")) -> DataFrame:
        sign = -1.0 if self.conjugate else 1.0
        taps = [multiply((shifted(cols[0], d), sign * shifted(cols[1], d)), constant(c)) for d, c in zip(self.delays, self.coef, strict=True)]
        re, im = add(taps)
        return df.withColumn("_ci", re).withColumn("_cq", im).withColumn(base[0], F.col(base[0]) + F.col("_ci")).withColumn(base[1], F.col(base[1]) + F.col("_cq")).drop("_ci", "_cq")


def cascade(df: DataFrame, predistorter, plant) -> DataFrame:  # noqa: ANN001
    """Desired x through the predistorter (di, dq), then through the plant (pi, pq)."""
    return plant.predict(predistorter.predict(df, out=("di", "dq")), ("di", "dq"))


def inverse_diagnostic(df: DataFrame, predistorter, gain: complex) -> DataFrame:  # noqa: ANN001
    """Measured y / gain through the predistorter, to compare with the known x: a labelled diagnostic, never the score."""
    g = 1 / gain
    ui, uq = multiply((F.col("yi"), F.col("yq")), constant(g))
    return predistorter.predict(df.withColumn("ui", ui).withColumn("uq", uq), ("ui", "uq"))


# --- integer models --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FixedConfig:
    """Formats and accumulator widths of the integer emulation."""

    data: FixedFormat = field(default_factory=lambda: FixedFormat(16, 12))
    coef: FixedFormat = field(default_factory=lambda: FixedFormat(16, 12))
    power: FixedFormat = field(default_factory=lambda: FixedFormat(18, 12))
    out: FixedFormat = field(default_factory=lambda: FixedFormat(16, 12))
    scalar_bits: int = 24
    sum_bits: int = 48
    weight_bits: int = 12


def _bits(c: Column, bits: int) -> Column:
    return saturate(c, FixedFormat(bits, 0))


def quantized(df: DataFrame, cfg: FixedConfig, cols: tuple[str, str] = ("i", "q")) -> DataFrame:
    return df.withColumn("ci", cfg.data.quantize(cols[0])).withColumn("cq", cfg.data.quantize(cols[1]))


def predict_fixed_terms(model: TermModel, df: DataFrame, cfg: FixedConfig) -> DataFrame:
    """Integer generalised memory polynomial: adds output codes (oi, oq).

    Amplitude by exact rounding root, powers by repeated products rounded to the power format; per signal delay a scalar sum
    rounded and saturated once, one complex product, one sum over delays saturated once, one output rounding.
    """
    top = max(t.exponent for t in model.terms)
    wide = quantized(df, cfg).withColumn("_p1", saturate(isqrt_even(F.col("ci") * F.col("ci") + F.col("cq") * F.col("cq")), cfg.power))
    for e in range(2, top + 1):
        wide = wide.withColumn(f"_p{e}", saturate(shift_even(F.col(f"_p{e - 1}") * F.col("_p1"), cfg.data.fraction), cfg.power))
    lags = {}
    for t in model.terms:
        lags[f"_ci_{t.signal}"] = _lag_code("ci", t.signal)
        lags[f"_cq_{t.signal}"] = _lag_code("cq", t.signal)
        if t.exponent:
            lags[f"_p{t.exponent}_{t.envelope}"] = _lag_code(f"_p{t.exponent}", t.envelope)
    wide = wide.withColumns(lags)
    groups: dict[int, list[tuple[Term, complex]]] = defaultdict(list)
    for t, c in zip(model.terms, model.coef, strict=True):
        groups[t.signal].append((t, c))
    one = F.lit(1 << cfg.power.fraction).cast("long")
    # Every stage is a column of its own, so that no rounding expression is repeated inside another.
    raw = {}
    for d, g in groups.items():
        for part in ("real", "imag"):
            raw[f"_t_{part}_{d}"] = reduce(lambda a, b: a + b, [F.lit(_code(getattr(c, part), cfg.coef)).cast("long") * (F.col(f"_p{t.exponent}_{t.envelope}") if t.exponent else one) for t, c in g])
    wide = wide.withColumns(raw)
    wide = wide.withColumns({k: shift_even(F.col(k), cfg.coef.fraction) for k in raw})
    parts = [multiply_codes((F.col(f"_ci_{d}"), F.col(f"_cq_{d}")), (_bits(F.col(f"_t_real_{d}"), cfg.scalar_bits), _bits(F.col(f"_t_imag_{d}"), cfg.scalar_bits))) for d in sorted(groups)]
    return _output(wide, parts, cfg.data.fraction + cfg.power.fraction - cfg.out.fraction, cfg).select(*df.columns, "oi", "oq")


def _output(wide: DataFrame, parts: list[Pair], shift: int, cfg: FixedConfig) -> DataFrame:
    """The sum over branches, saturated once; one rounding shift; the output format."""
    re, im = add(parts)
    wide = wide.withColumn("_ar", re).withColumn("_ai", im)
    wide = wide.withColumn("_ar", _bits(F.col("_ar"), cfg.sum_bits)).withColumn("_ai", _bits(F.col("_ai"), cfg.sum_bits))
    wide = wide.withColumn("_ar", shift_even(F.col("_ar"), shift)).withColumn("_ai", shift_even(F.col("_ai"), shift))
    return wide.withColumn("oi", saturate(F.col("_ar"), cfg.out)).withColumn("oq", saturate(F.col("_ai"), cfg.out))


def _lag_code(c: str, d: int) -> Column:
    from iqlake.operators.frames import in_order

    return F.lag(c, d, 0).over(in_order()) if d >= 0 else F.lead(c, -d, 0).over(in_order())


def _code(v: float, fmt: FixedFormat) -> int:
    return max(fmt.low, min(fmt.high, round(v * 2**fmt.fraction)))


def predict_fixed_spline(model: SplineModel, df: DataFrame, cfg: FixedConfig, float_root: bool = False) -> DataFrame:
    """Integer spline memory model: adds output codes (oi, oq).

    Integer radius (rounding root, or ``float_root`` for rint of a double root), weight rounded to ``weight_bits``,
    interpolated coefficients, one product per branch, one saturated sum, one output rounding.
    """
    if cfg.power.fraction != cfg.data.fraction:
        raise ValueError("radius and data need the same fraction bits")
    codes, _, _ = monotone_codes(model.knots, cfg.power)
    wide = quantized(df, cfg)
    p = F.col("ci") * F.col("ci") + F.col("cq") * F.col("cq")
    wide = wide.withColumn("_r", F.rint(F.sqrt(p.cast("double"))).cast("long") if float_root else isqrt_even(p))
    wide = wide.withColumns({f"_{c}_{d}": _lag_code(c if c != "r" else "_r", d) for b in model.branches for c, d in (("ci", b[0]), ("cq", b[0]), ("r", b[1]))})
    table = F.array(*[F.lit(c).cast("long") for c in codes])
    unit = 1 << cfg.weight_bits
    for d in sorted({b[1] for b in model.branches}):
        # Address and weight are shared by branches of one envelope delay.
        wide = wide.withColumn(f"_r_{d}", F.greatest(F.lit(codes[0]).cast("long"), F.least(F.lit(codes[-1]).cast("long"), F.col(f"_r_{d}"))))
        wide = wide.withColumn(f"_k_{d}", F.least(sum((F.when(F.col(f"_r_{d}") >= c, 1).otherwise(0) for c in codes[1:]), F.lit(0)), F.lit(len(codes) - 2)))
        low, high = F.element_at(table, F.col(f"_k_{d}") + 1), F.element_at(table, F.col(f"_k_{d}") + 2)
        wide = wide.withColumn(f"_n_{d}", (F.col(f"_r_{d}") - low) * unit).withColumn(f"_d_{d}", high - low)
        wide = wide.withColumn(f"_w_{d}", F.least(F.lit(unit).cast("long"), divide_even(f"_n_{d}", f"_d_{d}")))
    parts = []
    for b, ((m, d), coef) in enumerate(zip(model.branches, model.coef, strict=True)):
        for part in ("real", "imag"):
            cs = F.array(*[F.lit(_code(getattr(c, part), cfg.coef)).cast("long") for c in coef])
            wide = wide.withColumn(f"_a_{part}_{b}", F.element_at(cs, F.col(f"_k_{d}") + 1))
            wide = wide.withColumn(f"_s_{part}_{b}", F.col(f"_w_{d}") * (F.element_at(cs, F.col(f"_k_{d}") + 2) - F.col(f"_a_{part}_{b}")))
            wide = wide.withColumn(f"_s_{part}_{b}", F.col(f"_a_{part}_{b}") + shift_even(f"_s_{part}_{b}", cfg.weight_bits))
        parts.append(multiply_codes((F.col(f"_ci_{m}"), F.col(f"_cq_{m}")), (F.col(f"_s_real_{b}"), F.col(f"_s_imag_{b}"))))
    return _output(wide, parts, cfg.data.fraction + cfg.coef.fraction - cfg.out.fraction, cfg).select(*df.columns, "oi", "oq")


def half_precision(df: DataFrame, model: SplineModel) -> DataFrame:
    """Prediction with samples, knots and coefficients stored as binary16 and arithmetic in double: Arrow, as Spark has no half type."""
    @F.pandas_udf("double")
    def half(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy().astype(np.float16).astype(np.float64))

    h = lambda x: float(np.float16(x))
    stored = SplineModel(sorted({h(k) for k in model.knots}), model.branches, [[complex(h(c.real), h(c.imag)) for c in cs] for cs in model.coef])
    if len(stored.knots) != len(model.knots):
        raise ValueError("knots collide in binary16")
    return stored.predict(df.withColumn("hi", half("i")).withColumn("hq", half("q")), ("hi", "hq"))


def phase_check(df: DataFrame, model) -> DataFrame:  # noqa: ANN001
    """Largest difference between the output for j x and j times the output for x."""
    a = model.predict(df)
    b = model.predict(df.withColumn("ji", -F.col("q")).withColumn("jq", F.col("i")), ("ji", "jq"), ("bi", "bq"))
    both = a.select("n", "pi", "pq").join(b.select("n", "bi", "bq"), "n")
    return both.agg(F.max(F.abs(F.col("bi") + F.col("pq")) + F.abs(F.col("bq") - F.col("pi"))).alias("largest"))
