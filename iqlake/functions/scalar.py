"""Scalar expressions on complex samples and binary fixed-point codes; every function takes and gives Columns.

A complex value is a pair (re, im) of DOUBLE columns. Integer codes are BIGINT; ANSI mode makes overflow an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def power(i: Column | str, q: Column | str) -> Column:
    i, q = col(i), col(q)
    return i * i + q * q


def amplitude(i: Column | str, q: Column | str) -> Column:
    return F.sqrt(power(i, q))


def multiply(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conjugate(a: Pair) -> Pair:
    return a[0], -a[1]


def scale(a: Pair, k: Column | float) -> Pair:
    return a[0] * k, a[1] * k


def ratio_db(num: Column, den: Column, factor: float = 10.0) -> Column:
    """``factor`` log10(num / den): -inf for a zero numerator, null for nulls, an error for a denominator that is not positive."""
    checked = F.when((den > 0) | den.isNull(), den).otherwise(F.raise_error(F.lit("the denominator must be positive")).cast("double"))
    return F.when(num == 0, F.lit(float("-inf"))).otherwise(factor * F.log10(num / checked))


def complex_struct(i: Column | str, q: Column | str) -> Column:
    """{real, imag, abs, phase} of a complex value."""
    i, q = col(i), col(q)
    return F.struct(i.alias("real"), q.alias("imag"), F.hypot(i, q).alias("abs"), F.atan2(q, i).alias("phase"))


def coordinate(i: Column | str, q: Column | str, kind: str = "amplitude") -> Column:
    if kind not in ("amplitude", "power"):
        raise ValueError(f"unknown coordinate {kind}")
    return amplitude(i, q) if kind == "amplitude" else power(i, q)


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def rotate_to_input(ei: Column, eq: Column, xi: Column, xq: Column, floor: float = 0.0) -> tuple[Column, Column, Column]:
    """Radial and tangential parts of an error, e conj(x) / abs(x), and whether abs(x) is above ``floor``; null where it is not."""
    r = amplitude(xi, xq)
    ok = r > floor
    return F.when(ok, (ei * xi + eq * xq) / r), F.when(ok, (eq * xi - ei * xq) / r), ok


# --- knots ---------------------------------------------------------------------------------------------------------


def literal_array(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knot_index(r: Column, knots: list[float]) -> Column:
    """0-based interval of ``r`` in ascending ``knots``, right-closed search, clamped at both ends."""
    count = F.size(F.filter(literal_array(knots), lambda k: k <= r))
    return F.greatest(F.lit(0), F.least(count - 1, F.lit(len(knots) - 2)))


def knot_weight(r: Column, knots: list[float]) -> tuple[Column, Column]:
    """Interval and linear weight in it, the weight clamped to [0, 1]."""
    k = knot_index(r, knots)
    table = literal_array(knots)
    low, high = F.element_at(table, k + 1), F.element_at(table, k + 2)
    return k, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r - low) / (high - low)))


def hat_basis(r: Column, knots: list[float]) -> Column:
    """The linear hat functions of all knots at ``r``: two at most differ from 0, and they add up to 1."""
    k, w = knot_weight(r, knots)
    return F.transform(F.sequence(F.lit(0), F.lit(len(knots) - 1)), lambda j: F.when(j == k, 1 - w).when(j == k + 1, w).otherwise(F.lit(0.0)))


def spline_value(r: Column, knots: list[float], coef: list[complex]) -> Pair:
    """Piecewise-linear complex gain; beyond the knots the end values hold."""
    k, w = knot_weight(r, knots)
    out = []
    for part in ([c.real for c in coef], [c.imag for c in coef]):
        table = literal_array(part)
        low = F.element_at(table, k + 1)
        out.append(low + w * (F.element_at(table, k + 2) - low))
    return out[0], out[1]


def bin_index(v: Column, edges: list[float]) -> Column:
    """0-based bin of ``v``, right-closed search, the top edge in the last bin, null outside."""
    count = F.size(F.filter(literal_array(edges), lambda k: k <= v))
    return F.when((v >= edges[0]) & (v <= edges[-1]), F.least(count - 1, F.lit(len(edges) - 2)))


# --- binary fixed point ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FixedFormat:
    """Two's complement of ``bits`` with ``fraction`` bits after the point."""

    bits: int
    fraction: int

    def __post_init__(self) -> None:
        if not 2 <= self.bits <= 62:
            raise ValueError("bits must be 2 to 62")

    @property
    def low(self) -> int:
        return -(1 << (self.bits - 1))

    @property
    def high(self) -> int:
        return (1 << (self.bits - 1)) - 1

    @staticmethod
    def for_full_scale(bits: int, peak: float, guard: float = 1.001) -> FixedFormat:
        """As many fraction bits as keep ``peak`` times ``guard`` in range, 0 to bits - 1 of them; an error if none do."""
        need = peak * guard
        if not 0 < need < float("inf") or guard < 1:
            raise ValueError("full scale must be positive and finite, the guard 1 at least")
        for fraction in range(bits - 1, -1, -1):
            fmt = FixedFormat(bits, fraction)
            if fmt.high * 2.0**-fraction >= need:
                return fmt
        raise ValueError("no format of these bits covers the full scale")

    def quantize(self, v: Column | str) -> Column:
        return saturate(F.rint(col(v) * float(2**self.fraction)).cast("long"), self)

    def saturated(self, v: Column | str) -> Column:
        code = F.rint(col(v) * float(2**self.fraction))
        return (code < self.low) | (code > self.high)

    def dequantize(self, code: Column | str) -> Column:
        return col(code).cast("double") * float(2.0**-self.fraction)


def saturate(code: Column | str, fmt: FixedFormat) -> Column:
    return F.greatest(F.lit(fmt.low).cast("long"), F.least(F.lit(fmt.high).cast("long"), col(code)))


def divide_even(num: Column | str, den: Column | str | int) -> Column:
    """Nearest integer quotient of BIGINT by a positive BIGINT, ties to even."""
    n = col(num)
    d = F.lit(den).cast("long") if isinstance(den, int) else col(den)
    mag = F.abs(n)
    whole, rest = F.call_function("div", mag, d), mag % d
    up = (rest > d - rest) | ((rest == d - rest) & (whole % 2 == 1))
    return F.signum(n.cast("double")).cast("long") * (whole + F.when(up, 1).otherwise(0))


def shift_even(code: Column | str, shift: int) -> Column:
    """Rounding right shift, ties to even; exact for every BIGINT.

    The arithmetic shift rounds down. What it drops counts as one more if it is above half, or half of an odd result: if
    dropped + odd exceeds half. The sum stays within ``shift`` + 1 bits, so nothing overflows near the ends of BIGINT.
    """
    c = col(code)
    if shift <= 0:
        return F.shiftleft(c, -shift) if shift else c
    down = F.shiftright(c, shift)
    dropped = c.bitwiseAND(F.lit((1 << shift) - 1))
    return down + F.shiftright(dropped + F.lit((1 << (shift - 1)) - 1) + down.bitwiseAND(F.lit(1)), shift)


def isqrt_even(value: Column | str) -> Column:
    """Nearest integer square root of a BIGINT, exact for all that are not negative; r + 1/2 squared is never whole, so there are no ties.

    The double root is off by one at most, and never beyond the root of the largest BIGINT, so no square wraps.
    """
    v = col(value)
    most = F.lit(3037000499).cast("long")  # fixed value: the whole root of 2 ** 63 - 1
    guess = F.least(most, F.floor(F.sqrt(v.cast("double"))).cast("long"))
    low = guess - F.when(guess * guess > v, 1).otherwise(0)
    # (low + 1) ** 2 <= v, without the square of low + 1.
    floor = low + F.when(v - low * low > low + low, 1).otherwise(0)
    return floor + F.when(v - floor * floor > floor, 1).otherwise(0)


def multiply_codes(a: Pair, b: Pair) -> Pair:
    """Complex product of BIGINT codes; a wrap is an error in ANSI mode."""
    return multiply(a, b)


def checked_product(a: Column | str, b: Column | str) -> Column:
    """Product of BIGINTs; one that does not fit is an error, whatever the session's ANSI mode."""
    fits = F.call_function("try_multiply", col(a).cast("long"), col(b).cast("long"))
    both = col(a).isNotNull() & col(b).isNotNull()
    return F.when(both & fits.isNull(), F.raise_error(F.lit("a product does not fit 64 bits")).cast("long")).otherwise(fits)


def monotone_codes(knots: list[float], fmt: FixedFormat) -> tuple[list[int], int, int]:
    """Ascending codes of knots with collisions moved up by one; how many collided, and the largest shift. Knots out of range are an error."""
    raw = [round(k * 2**fmt.fraction) for k in knots]
    if min(raw) < fmt.low or max(raw) > fmt.high:
        raise ValueError("a knot is out of the format's range")
    out: list[int] = []
    for c in raw:
        out.append(c if not out or c > out[-1] else out[-1] + 1)
    if out[-1] > fmt.high:
        raise ValueError("the format is too narrow for these knots")
    return out, sum(a != b for a, b in zip(raw, out, strict=True)), max(b - a for a, b in zip(raw, out, strict=True))
