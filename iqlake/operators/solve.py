"""Regularised complex least squares: partition QR, small triangular factors merged on the driver.

No normal equations: each partition reduces its rows to an R factor of at most P + 1 rows, executors stack and reduce these
again, and the singular values of the last R are those of the whole design. At most MERGE x P^2 numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.operators.blocks import SIZE, in_blocks, lists, placed
from iqlake.sources import io

MERGE = 64


@dataclass(frozen=True)
class Fit:
    coef: np.ndarray
    rank: int
    condition: float
    singular: np.ndarray
    rows: int
    residual_power: float

    def nmse_db(self, target_power: float) -> float:
        return float("-inf") if self.residual_power == 0 else 10 * float(np.log10(self.residual_power / target_power))


def _factor(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def _rows(batch: pa.RecordBatch | pa.Table, target: tuple[str, str]) -> np.ndarray:
    """[phi | target] as a complex matrix, from the values of the list column at once."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    phi = table.column("phi").combine_chunks()
    phi = phi.combine_chunks() if isinstance(phi, pa.ChunkedArray) else phi
    pairs = phi.flatten().to_numpy(zero_copy_only=False).reshape(len(phi), -1)
    t = [table.column(c).to_numpy() for c in target]
    return np.column_stack([pairs[:, 0::2] + 1j * pairs[:, 1::2], t[0] + 1j * t[1]])


def _factor_table(group: int, rows: int, r: np.ndarray) -> pa.Table:
    return pa.table({"group": pa.array([group], pa.int64()), "rows": pa.array([rows], pa.int64()), "r": pa.array([np.ascontiguousarray(r, np.complex128).tobytes()], pa.binary())})


FACTORS = "group long, rows long, r binary"


def r_factors(design: DataFrame, by: str | None = None, target: tuple[str, str] = ("yi", "yq")) -> DataFrame:
    """(group, rows, r): R of [phi | target] of each partition, or of each group of column ``by``; complex entries interleaved."""
    if by:
        def one(key: tuple, table: pa.Table) -> pa.Table:
            return _factor_table(key[0].as_py(), table.num_rows, _factor(_rows(table, target)))

        return design.select(by, "phi", *target).groupBy(by).applyInArrow(one, FACTORS)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        for batch in batches:
            if batch.num_rows:
                r = _factor(_rows(batch, target))
                held = r if held is None else _factor(np.vstack([held, r]))
                n += batch.num_rows
        if held is not None:
            yield from _factor_table(0, n, held).to_batches()

    return design.select("phi", *target).mapInArrow(parts, FACTORS)


#: Rows that are factored at a time, and blocks of a frame whose factors one task merges.
ROWS, STACK = 4096, 64


def term_factors(df: DataFrame, terms: list, by_frame: bool = False, skip: int = 0, target: tuple[str, str] = ("yi", "yq"), late: int | None = None) -> DataFrame:
    """``r_factors`` of the dictionary of ``terms`` over (frame, n, i, q, target), made where blocks of frames are arrays.

    A block has a halo as long as the longest lag, so a frame of any length is the work of many tasks; samples are moved once (those in a halo
    twice), lags, powers and products are numpy's there, and no row of features is ever built or sent. A frame's blocks are merged in two
    steps of at most STACK factors and what is left. ``skip`` leaves out the first samples of each frame (their past
    still counts). With ``late`` there are two factors a frame, the other without its first ``late`` samples: columns scored, steady.
    """
    signals, powers = sorted({t.signal for t in terms}), sorted({(t.envelope, t.exponent) for t in terms})
    lags = [0, *signals, *[d for d, _ in powers]]
    rows = in_blocks(placed(df).select("frame", "pos", "i", "q", *target), ["i", "q", *target], max(lags), -min(lags), SIZE)
    width, size, stack = len(terms) + 1, SIZE, STACK
    schema = FACTORS + (", scored long, steady binary" if late is not None else "")

    def lagged(x: np.ndarray, d: int, lo: int, hi: int) -> np.ndarray:
        """x[lo - d : hi - d], 0 outside the array: a halo covers lags, so that is outside the frame."""
        out = np.zeros(hi - lo, x.dtype)
        a, b = max(0, lo - d), min(len(x), hi - d)
        if a < b:
            out[a - (lo - d) : b - (lo - d)] = x[a:b]
        return out

    def factors(i: np.ndarray, q: np.ndarray, yi: np.ndarray, yq: np.ndarray, lo: int, hi: int) -> tuple[int, np.ndarray]:
        """Rows and R of the block's samples [lo, hi), some thousand rows at a time."""
        x, y = i + 1j * q, yi + 1j * yq
        r = np.abs(x)
        held = np.zeros((0, width), complex)
        for at in range(lo, hi, ROWS):
            to = min(hi, at + ROWS)
            xs = {d: lagged(x, d, at, to) for d in signals}
            rs = {(d, e): lagged(r, d, at, to) ** e if e else None for d, e in powers}
            a = np.empty((to - at, width), complex)
            for k, t in enumerate(terms):
                p = rs[t.envelope, t.exponent]
                a[:, k] = xs[t.signal] if p is None else xs[t.signal] * p
            a[:, -1] = y[at:to]
            held = _factor(np.vstack([held, a]))
        return max(0, hi - lo), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros((0, width), complex), 0
        for batch in batches:
            off, values = lists(batch, 3)
            for k, (frame, block, halo) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
                own = [v[off[k] : off[k + 1]] for v in values]
                hi = min(len(own[0]), halo + size)
                first = lambda n: min(hi, halo + max(0, n - block * size))  # noqa: B023, E731
                rows_, r = factors(*own, first(skip), hi)
                if not by_frame:
                    held, total = _factor(np.vstack([held, r])), total + rows_
                    continue
                out = {"group": [frame], "rows": [rows_], "r": [r.tobytes()], "stretch": [block // stack]}
                if late is not None:
                    scored, steady = (rows_, r) if first(late) == first(skip) else factors(*own, first(late), hi)
                    out |= {"scored": [scored], "steady": [steady.tobytes()]}
                yield pa.RecordBatch.from_pydict(out)
        if total and not by_frame:
            yield from _factor_table(0, total, held).to_batches()

    if not by_frame:
        return rows.mapInArrow(run, FACTORS)
    made = rows.mapInArrow(run, FACTORS + ", stretch long" + schema[len(FACTORS) :])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of factors as one factor each."""
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            for n in ("r", "steady"):
                if n in cols:
                    stacked = [x if len(x) == 1 else [_factor(np.vstack([_read(r, width) for r in x])).tobytes()] for x in cols[n].to_pylist()]
                    cols[n] = pa.array([x[0] for x in stacked], pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    extra = [n for n in ("scored", "steady") if late is not None]
    for keys in (["group", "stretch"], ["group"]):
        sums = [F.sum(n).alias(n) for n in ("rows", *extra[:1])]
        lists_ = [F.collect_list(n).alias(n) for n in ("r", *extra[1:])]
        order = ["group", "rows", "r", *(["stretch"] if "stretch" in keys else []), *extra]
        made = made.groupBy(*keys).agg(*sums, *lists_).select(*order)
        made = made.mapInArrow(merge, FACTORS + (", stretch long" if "stretch" in keys else "") + schema[len(FACTORS) :])
    return made.filter("rows > 0")


def _read(r: bytes, width: int) -> np.ndarray:
    return np.frombuffer(r, complex).reshape(-1, width)


def merged(factors: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Rows and R of all factors: executors merge them to at most MERGE, one after another, in the job that brings these here."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros((0, width), complex), 0
        for batch in batches:
            for rows, r in zip(batch.column("rows").to_pylist(), batch.column("r").to_pylist(), strict=True):
                held, n = _factor(np.vstack([held, _read(r, width)])), n + rows
        if n:
            yield from _factor_table(0, n, held).to_batches()

    got = factors.repartition(MERGE, F.xxhash64("r")).mapInArrow(merge, FACTORS).collect()
    if not got:
        raise ValueError("no rows to fit")
    return sum(g["rows"] for g in got), _factor(np.vstack([_read(g["r"], width) for g in got]))


def solve(rows: int, r: np.ndarray, ridge: float = 0.0, penalties: list[np.ndarray] | None = None, scaled: bool = False, rcond: float | None = None) -> Fit:
    """Minimises mean abs(Phi c - t)^2 + ridge abs(c)^2 + sum abs(P c)^2, from R of [Phi | t].

    ``scaled`` divides columns by their RMS first, so that the ridge acts on scaled coefficients; ``rcond`` truncates
    singular values instead of a ridge.
    """
    a, t = r[:, :-1] / np.sqrt(rows), r[:, -1] / np.sqrt(rows)
    p = a.shape[1]
    unit = np.sqrt((np.abs(a) ** 2).sum(0)) if scaled else np.ones(p)
    unit = np.where(unit > 0, unit, 1.0)
    a = a / unit
    s = np.linalg.svd(a, compute_uv=False)
    stack, right = [a], [t]
    if ridge:
        stack.append(np.sqrt(ridge) * np.eye(p))
        right.append(np.zeros(p))
    for q in penalties or []:
        stack.append(q / unit)
        right.append(np.zeros(len(q)))
    c, _, rank, sing = np.linalg.lstsq(np.vstack(stack), np.concatenate(right), rcond=rcond)
    left = a @ c - t
    return Fit(c / unit, int(np.sum(s > s[0] * max(rows, p) * np.finfo(float).eps)) if len(s) and s[0] > 0 else 0, float(sing[0] / sing[-1]) if sing[-1] > 0 else float("inf"), s, rows, float((np.abs(left) ** 2).sum()))


def fit_dictionary(df: DataFrame, terms: list, ridge: float = 0.0, scaled: bool = False, rcond: float | None = None, target: tuple[str, str] = ("yi", "yq")) -> Fit:
    """``fit`` of a dictionary of terms over frames, from ``term_factors``."""
    rows, r = merged(term_factors(df, terms, target=target), len(terms) + 1)
    if rows < len(terms) and not ridge:
        raise ValueError("fewer rows than features")
    return solve(rows, r, ridge, None, scaled, rcond)


def fit(design: DataFrame, width: int, ridge: float = 0.0, penalties: list[np.ndarray] | None = None, scaled: bool = False, rcond: float | None = None, target: tuple[str, str] = ("yi", "yq")) -> Fit:
    """Least squares of a design with ``width`` complex features."""
    rows, r = merged(r_factors(design, target=target), width + 1)
    if rows < width and not ridge:
        raise ValueError("fewer rows than features")
    return solve(rows, r, ridge, penalties, scaled, rcond)


#: Factors that one task takes prefix and suffix products of.
FAN = 256


def others(factors: DataFrame, width: int) -> DataFrame:
    """For each factor (group, rows, r) the rows and R of all others, by a tree of partial products on executors.

    Up to FAN factors are one task's work: what is left of each is a product of the ones before and of the ones after. More
    are dealt over buckets; a bucket's own others (this function again, of the buckets' products) join its prefixes.
    """

    def apart(table: pa.Table, rows: int, base: np.ndarray) -> pa.Table:
        """Others of the factors of ``table``, and of ``base``, which is outside."""
        table = table.sort_by("group")
        own = [_read(r, width) for r in table.column("r").to_pylist()]
        n = table.column("rows").to_pylist()
        before, after = [base], [np.zeros((0, width), complex)]
        for r in own[:-1]:
            before.append(_factor(np.vstack([before[-1], r])))
        for r in reversed(own[1:]):
            after.append(_factor(np.vstack([after[-1], r])))
        left = [_factor(np.vstack([x, y])) if len(x) + len(y) else x for x, y in zip(before, reversed(after), strict=True)]
        return pa.table({"group": table.column("group"), "rows": pa.array([rows + sum(n) - k for k in n], pa.int64()), "r": pa.array([x.tobytes() for x in left], pa.binary())})

    # Two numbers: one may not be the product of nothing.
    count = factors.count()
    if count <= FAN:
        return factors.withColumn("_b", F.lit(0)).groupBy("_b").applyInArrow(lambda t: apart(t.select(["group", "rows", "r"]), 0, np.zeros((0, width), complex)), FACTORS)
    dealt = factors.withColumn("_b", F.pmod(F.xxhash64("group"), F.lit(-(-2 * count // FAN))))

    def product(key: tuple, table: pa.Table) -> pa.Table:
        return _factor_table(key[0].as_py(), sum(table.column("rows").to_pylist()), _factor(np.vstack([_read(r, width) for r in table.column("r").to_pylist()])))

    up = others(dealt.groupBy("_b").applyInArrow(product, FACTORS), width).withColumnRenamed("group", "_b")

    def inside(own: pa.Table, base: pa.Table) -> pa.Table:
        return apart(own.select(["group", "rows", "r"]), base.column("rows")[0].as_py(), _read(base.column("r")[0].as_py(), width))

    return dealt.groupBy("_b").cogroup(up.groupBy("_b")).applyInArrow(inside, FACTORS)


def leave_one_out(design: DataFrame, width: int, ridge: float = 0.0, scaled: bool = False, target: tuple[str, str] = ("yi", "yq")) -> DataFrame:
    """For each frame the fit on all others, a row a frame: frame, rows, rank, condition, coef (interleaved), residual_power.

    One R factor a frame, written once, and merged over all others by a tree; no refit from rows, and nothing goes to the driver. An error if
    there are fewer than two frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [solve(n, _read(r, width + 1), ridge, scaled=scaled) if n else None for n, r in zip(batch.column("rows").to_pylist(), batch.column("r").to_pylist(), strict=True)]
            if None in fits:
                raise ValueError("two frames at least are needed")
            flat = [np.column_stack([f.coef.real, f.coef.imag]).reshape(-1).tolist() for f in fits]
            yield pa.RecordBatch.from_pydict({"frame": batch.column("group"), "rows": batch.column("rows"), "rank": pa.array([f.rank for f in fits], pa.int32()), "condition": pa.array([f.condition for f in fits], pa.float64()), "coef": pa.array(flat, pa.list_(pa.float64())), "residual_power": pa.array([f.residual_power for f in fits], pa.float64())})

    own = io.written(r_factors(design, "frame", target), "factors")
    return others(own, width + 1).mapInArrow(run, "frame long, rows long, rank int, condition double, coef array<double>, residual_power double")


def gram_gain(df: DataFrame) -> DataFrame:
    """Closed form for the two complex unknowns of y = a x + b x abs(x)^2, from sums of one pass: (a_re, a_im, b_re, b_im)."""
    p, c = "(i*i + q*q)", "i*yi + q*yq"
    d = "i*yq - q*yi"
    s = df.agg(*[F.sum(F.expr(e)).alias(n) for n, e in {"s1": p, "s2": f"{p}*{p}", "s3": f"{p}*{p}*{p}", "t1": c, "u1": d, "t2": f"{p}*({c})", "u2": f"{p}*({d})"}.items()])
    return s.selectExpr("(s3*t1 - s2*t2)/(s1*s3 - s2*s2) as a_re", "(s3*u1 - s2*u2)/(s1*s3 - s2*s2) as a_im", "(s1*t2 - s2*t1)/(s1*s3 - s2*s2) as b_re", "(s1*u2 - s2*u1)/(s1*s3 - s2*s2) as b_im")


@dataclass(frozen=True)
class Hammerstein:
    """A memoryless spline and the tail of a FIR whose first tap is 1, with the objective after each block."""

    knots: list[float]
    coef: np.ndarray
    tail: np.ndarray
    objective: list[float]
    converged: bool


def spline_moments(df: DataFrame, knots: list[float], taps: int) -> tuple[int, np.ndarray]:
    """Rows, and R of the hat-basis features x[n] B_k(abs(x[n])), their lags up to taps - 1, and the target, in one pass over blocks of frames.

    R holds all moments of lagged products, and better than their sums do. Columns are lag-major, the target last.
    """
    k, width = np.asarray(knots), len(knots) * taps + 1
    rows = in_blocks(placed(df).select("frame", "pos", "i", "q", "yi", "yq"), ["i", "q", "yi", "yq"], taps - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros((0, width), complex), 0
        for batch in batches:
            off, values = lists(batch, 3)
            for b, skip in enumerate(batch.column(2).to_pylist()):
                i, q, yi, yq = (v[off[b] : off[b + 1]] for v in values)
                x = i + 1j * q
                r = np.abs(x)
                at = np.clip(np.searchsorted(k, r, "right") - 1, 0, len(k) - 2)
                w = np.clip((r - k[at]) / (k[at + 1] - k[at]), 0.0, 1.0)
                basis = np.zeros((len(x) + taps - 1, len(k)), complex)  # nothing before a frame; a halo before other blocks
                place = np.arange(len(x)) + taps - 1
                basis[place, at], basis[place, at + 1] = x * (1 - w), x * w
                for lo in range(skip, len(x), ROWS):
                    hi = min(len(x), lo + ROWS)
                    a = np.column_stack([*[basis[lo + taps - 1 - d : hi + taps - 1 - d] for d in range(taps)], yi[lo:hi] + 1j * yq[lo:hi]])
                    held = _factor(np.vstack([held, a]))
                    total += hi - lo
        if total:
            yield from _factor_table(0, total, held).to_batches()

    return merged(rows.mapInArrow(run, FACTORS), width)


def fit_hammerstein(df: DataFrame, knots: list[float], taps: int, ridge: float = 0.0, smooth: float = 0.0, fir_ridge: float = 0.0, most: int = 20, least: int = 2, tolerance: float = 1e-7, rise: float = 1e-9) -> Hammerstein:
    """Alternating least squares over (frame, n, i, q, yi, yq): the tail for fixed controls, then the controls for a fixed tail.

    The samples are read once, for ``spline_moments``; all rounds work on its R, where fixed controls or a fixed tail are sums of columns.
    Stops when a round lowers the objective by less than ``tolerance`` of it, after ``least`` rounds; a block that raises the
    objective by more than ``rise`` of it is an error.
    """
    from iqlake.operators.features import curvature, strict_knots

    knots = strict_knots(knots)
    k = len(knots)
    rows, whole = spline_moments(df, knots, taps)
    if rows < k and not ridge:
        raise ValueError("fewer rows than features")
    lagged, target = [whole[:, d * k : (d + 1) * k] for d in range(taps)], whole[:, -1]
    bend = np.sqrt(smooth) * curvature(knots)
    penalties = [bend] if smooth else None

    def objective(power: float, c: np.ndarray, h: np.ndarray) -> float:
        return power + ridge * float((np.abs(c) ** 2).sum()) + float((np.abs(bend @ c) ** 2).sum()) + fir_ridge * float((np.abs(h) ** 2).sum())

    tail = np.zeros(taps - 1, complex)
    got = solve(rows, np.column_stack([lagged[0], target]), ridge, penalties)
    coef, seen = got.coef, [objective(got.residual_power, got.coef, tail)]
    done = taps == 1
    for r in range(most if taps > 1 else 0):
        before = seen[-1]
        got = solve(rows, np.column_stack([*[x @ coef for x in lagged[1:]], target - lagged[0] @ coef]), fir_ridge)
        tail = got.coef
        seen.append(objective(got.residual_power, coef, tail))
        got = solve(rows, np.column_stack([lagged[0] + sum(h * x for h, x in zip(tail, lagged[1:], strict=True)), target]), ridge, penalties)
        coef = got.coef
        seen.append(objective(got.residual_power, coef, tail))
        scale = max(before, 1e-12 * seen[0], 1e-300)  # below that, rounding
        if max(seen[-2] - before, seen[-1] - seen[-2]) > rise * scale:
            raise ValueError("a block raised the objective")
        if r + 1 >= least and before - seen[-1] <= tolerance * scale:
            done = True
            break
    return Hammerstein(list(knots), coef, tail, seen, done)
