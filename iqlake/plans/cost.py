"""Operation counts of models per complex sample.

A model is written down as the stages that one sample runs through; counting walks the stages and adds up what each needs.
Nothing is derived in closed form here, so a changed structure changes its counts by itself. Candidate tables have the few
counts that selection needs as Columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOURCES = "add", "coef", "compare", "const", "div", "lookup", "mul", "nonlinear", "read", "state", "write"

#: What one run of a stage needs. A complex value is two real ones.
STAGES: dict[str, dict[str, int]] = {
    "sample": {"read": 2},
    "emit": {"write": 2},
    "power": {"mul": 2, "add": 1},  # of a complex value: the sum of two squares
    "root": {"nonlinear": 1},
    "times": {"mul": 1},  # real by real
    "minus": {"add": 1},  # real and real
    "over": {"div": 1},
    "scale": {"mul": 2},  # real by complex
    "sum": {"add": 2},  # complex and complex
    "product by 4": {"mul": 4, "add": 2},  # complex by complex, four products
    "product by 3": {"mul": 3, "add": 5},
    "coefficient": {"coef": 2, "read": 2},
    "knot value": {"lookup": 1, "read": 2},
    "value slot": {"coef": 2},  # of a table that lookups read
    "compare": {"compare": 1},
    "constant": {"const": 1},
    "word": {"lookup": 1, "read": 1},
    "kept word": {"write": 1},
    "delay": {"state": 2},  # of a complex value by one sample
    "delay word": {"state": 1},
    "weight": {"mul": 1, "coef": 1, "read": 1},
    "wave": {"mul": 1, "nonlinear": 1},
    "squash": {"nonlinear": 1},
    "fetch": {"read": 1},
    "stored": {"coef": 1},  # read by a fetch
}
PRODUCT = {"4m2a": "product by 4", "3m5a": "product by 3"}
Stage = tuple[str, int]


class Count(dict):
    """A number for each resource."""

    def __getattr__(self, name: str) -> int:
        return self[name]

    def row(self) -> dict[str, int]:
        return dict(self)

    def coefficient_bytes(self, bits: int) -> int:
        return math.ceil(self["coef"] * bits / 8)


def count(stages: Iterable[Stage]) -> Count:
    """Walks (stage, how often) pairs."""
    out = Count.fromkeys(RESOURCES, 0)
    for name, times in stages:
        for resource, n in STAGES[name].items():
            out[resource] += n * times
    return out


def envelope_powers(degrees: Iterable[int]) -> Iterator[Stage]:
    """The envelope of one sample raised to each of ``degrees``: even powers from its square, odd ones by one more root."""
    bent = [d for d in degrees if d]
    if not bent:
        return
    yield "power", 1
    yield "times", max(max(d // 2 for d in bent) - 1, 0)
    odd = [d for d in bent if d % 2]
    yield "root", 1 if odd else 0
    yield "times", len([d for d in odd if d > 1])


def memory_polynomial(orders: list[int], delays: list[int], product: str = "4m2a") -> Count:
    """Every delay computes its own powers; a delay is a stored number, compared with the place in the frame."""

    def stages() -> Iterator[Stage]:
        for _ in delays:
            yield from [("sample", 1), ("constant", 1), ("compare", 1)]
            yield from envelope_powers(p - 1 for p in orders)
            for p in orders:
                yield from [("scale", 1 if p > 1 else 0), ("coefficient", 1), (PRODUCT[product], 1)]
        yield from [("sum", max(len(delays) * len(orders) - 1, 0)), ("constant", len(orders)), ("delay", max(delays)), ("emit", 1)]

    return count(stages())


def gmp_terms(ka: int, la: int, kb: int, lb: int, mb: int, kc: int, lc: int, mc: int, causal: bool) -> list[tuple[int, int, int]]:
    """(degree, delay of the signal, delay of the envelope) of each term; causal models leave out an envelope to come."""
    out = [(k, d, d) for k in range(ka) for d in range(la)]
    out += [(k, d, d + m) for k in range(1, kb + 1) for d in range(lb) for m in range(1, mb + 1)]
    ahead = [(k, d, d - m) for k in range(1, kc + 1) for d in range(lc) for m in range(1, mc + 1)]
    return out + [t for t in ahead if t[2] >= 0 or not causal]


def generalized(ka: int, la: int, kb: int = 0, lb: int = 0, mb: int = 0, kc: int = 0, lc: int = 0, mc: int = 0, causal: bool = True, product: str = "4m2a") -> Count:
    """Factored by the signal's delay: envelope powers weigh coefficients, then one complex product for each delay.

    A sample's powers are made once and kept, each in a delay line as long as its oldest use; the model has nine settings.
    """
    terms = gmp_terms(ka, la, kb, lb, mb, kc, lc, mc, causal)

    def stages() -> Iterator[Stage]:
        top = max(ka - 1, kb, kc)
        if top:
            yield from [("power", 1), ("root", 1), ("times", max(top - 2, 0)), ("kept word", top)]
        for degree, _, _ in terms:
            yield "coefficient", 1
            if degree:
                yield from [("fetch", 1), ("scale", 1), ("sum", 1)]
        signal = {d for _, d, _ in terms}
        yield from [("sample", len(signal)), (PRODUCT[product], len(signal)), ("sum", len(signal) - 1)]
        ahead = max(0, *(-e for _, _, e in terms))
        yield "delay", ahead + max(signal)
        for k in range(1, top + 1):
            yield "delay word", ahead + max([0, *(e for degree, _, e in terms if degree == k)])
        yield from [("constant", 9), ("emit", 1)]

    return count(stages())


def searches(knots: int, indexing: str) -> int:
    """Comparisons to find an interval: halving, or the two ends of an even grid."""
    return (knots - 1).bit_length() if indexing == "binary" else {"uniform": 2}[indexing]


def _address(knots: int, indexing: str, reciprocal: bool = True, amplitude: bool = True) -> list[Stage]:
    """From a sample to the interval of its envelope and the weight in it."""
    return [*_magnitude(amplitude), *_interval(knots, indexing, reciprocal)]


def _magnitude(amplitude: bool) -> list[Stage]:
    return [("power", 1), ("root", int(amplitude))]


def _interval(knots: int, indexing: str, reciprocal: bool) -> list[Stage]:
    return [("compare", searches(knots, indexing)), ("minus", 1), ("times" if reciprocal else "over", 1)]


def _interpolated(knots: int, product: str) -> list[Stage]:
    """Between two knot values, and times the sample."""
    return [("knot value", 2), ("sum", 1), ("scale", 1), ("sum", 1), (PRODUCT[product], 1), ("value slot", knots)]


def _grid(knots: int, reciprocal: bool = True) -> list[Stage]:
    """Knots, and one over each interval."""
    return [("constant", knots + (knots - 1 if reciprocal else 0))]


def spline(knots: int, product: str = "4m2a", indexing: str = "binary", reciprocal: bool = True, amplitude: bool = True) -> Count:
    return count([("sample", 1), *_address(knots, indexing, reciprocal, amplitude), *_interpolated(knots, product), *_grid(knots, reciprocal), ("emit", 1)])


def spline_branches(knots: int, branches: int, product: str = "4m2a", shared: bool = False) -> Count:
    """Splines that are added, with one envelope for all if shared. A lower bound: delay lines are not counted."""

    def stages() -> Iterator[Stage]:
        for k in range(branches):
            if k == 0 or not shared:
                yield from _magnitude(True)
            yield from [("sample", 1), *_interval(knots, "binary", True), *_interpolated(knots, product), *_grid(knots), ("emit", 1)]
        yield "sum", branches - 1

    return count(stages())


def hammerstein(knots: int, taps: int, product: str = "4m2a", indexing: str = "binary", amplitude: bool = True) -> Count:
    """A spline whose output runs through taps, the first of them one. Knot and width are looked up, too."""

    def stages() -> Iterator[Stage]:
        yield from [("sample", 1), *_address(knots, indexing, True, amplitude), ("word", 2), *_interpolated(knots, product), *_grid(knots)]
        for _ in range(taps - 1):
            yield from [("sample", 1), ("coefficient", 1), (PRODUCT[product], 1), ("sum", 1), ("delay", 1)]
        yield "emit", 1

    return count(stages())


def spline_memory(knots: int, branches: list[tuple[int, int]], product: str = "4m2a", indexing: str = "binary") -> Count:
    """Branches (delay of the signal, of the envelope); those of one envelope share its address and weight. Only a kept sample is written."""
    deep = max(max(b) for b in branches)

    def stages() -> Iterator[Stage]:
        for _ in {e for _, e in branches}:
            yield from _address(knots, indexing)
        for _ in branches:
            yield from _interpolated(knots, product)
        yield from [("sum", len(branches) - 1), ("sample", len({d for b in branches for d in b})), *_grid(knots), ("delay", deep), ("emit", 1 if deep else 0)]

    return count(stages())


def correction(delays: list[int], product: str = "4m2a", stored: int | None = None) -> Count:
    """FIR or conjugate taps added to a base output; ``stored``: the deepest input delay that the base keeps anyway."""
    deep = max(delays)

    def stages() -> Iterator[Stage]:
        for _ in delays:
            yield from [("constant", 1), ("sample", 1), ("coefficient", 1), (PRODUCT[product], 1), ("sum", 1)]
        yield "delay", max(deep - (stored or 0), 0)
        yield "emit", 1 if stored is None and deep else 0

    return count(stages())


def echo_state(size: int, inputs: int = 2, squares: int = 5, waves: int = 8, nonzeros: int | None = None) -> Count:
    """A scalar-output reservoir with Fourier features; ``nonzeros`` of a sparse recurrence, dense if None."""
    pairs = 2 * waves * inputs
    features = size + squares + pairs

    def stages() -> Iterator[Stage]:
        # Inputs: clipped to a range, shifted and scaled by two stored numbers each.
        yield from [("fetch", 2 * inputs), ("compare", 2 * inputs), ("minus", inputs)]
        yield from [("fetch", 2 * inputs), ("stored", 2 * inputs)]
        # State: recurrence and inputs with a constant one, squashed, blended with the old state.
        links = size * size if nonzeros is None else nonzeros
        yield from [("weight", links), ("minus", max(links - size, 0)), ("fetch", size if nonzeros is None else links)]
        yield from [("weight", size * (inputs + 1)), ("fetch", 1), ("minus", size * inputs), ("minus", size)]
        yield from [("squash", size), ("times", 2 * size), ("minus", size), ("kept word", size), ("delay word", size)]
        # Features: the state, squares of some, waves of the inputs; each shifted and scaled, then weighed and added to a bias.
        yield from [("fetch", size + squares + pairs), ("times", squares), ("wave", pairs)]
        yield from [("minus", features), ("times", features), ("stored", 2 * features), ("fetch", 2 * features)]
        yield from [("weight", features), ("fetch", features), ("minus", features), ("stored", 1), ("kept word", 1)]

    return count(stages())


# --- the same over tables of candidates -----------------------------------------------------------------------------


def generalized_mul() -> Column:
    """Multiplications of a causal aligned and lagging candidate (columns ka, la, kb, lb, mb)."""
    top = F.greatest(F.expr("ka - 1"), F.col("kb"))
    return F.when(top == 0, 0).otherwise(2 + F.greatest(top - 2, F.lit(0))) + 2 * F.expr("ka*la + kb*lb*mb - la") + 4 * F.greatest("la", F.expr("if(kb > 0, lb, 0)"))


def candidate_grid(spark, **axes: list[int]) -> DataFrame:  # noqa: ANN001
    """All combinations of a few small axes."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} int")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def within_budget(candidates: DataFrame, limit: int) -> DataFrame:
    """Candidates strictly below the limit; repeated ones are an error."""
    cost = candidates.withColumn("mul", generalized_mul())
    seen = cost.groupBy(*candidates.columns).agg(F.count(F.lit(1)).alias("n"), F.max("mul").alias("mul"))
    ok = F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.lit("a candidate is listed twice")).cast("boolean"))
    return seen.filter(ok & (F.col("mul") < limit)).drop("n")
