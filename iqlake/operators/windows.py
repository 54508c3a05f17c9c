"""Lags, recurrences and filters inside frames."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.functions.scalar import power
from iqlake.operators.blocks import SIZE, affine_starts, in_blocks, lists, placed
from iqlake.operators.frames import in_frame, in_order


def shifted(c: str | Column, lag: int, keys: list[str] | None = None) -> Column:
    """c[n - lag], 0 outside the frame; a negative lag looks ahead."""
    w = in_order(keys)
    return F.lag(c, lag, 0.0).over(w) if lag >= 0 else F.lead(c, -lag, 0.0).over(w)


def safe_lag(df: DataFrame, c: str, lag: int, out: str = "lagged") -> DataFrame:
    """Lagged value, 0 and not valid across a frame boundary."""
    raw = (F.lag(c, lag) if lag >= 0 else F.lead(c, -lag)).over(in_order())
    return df.withColumn(out, F.coalesce(raw, F.lit(0.0))).withColumn(f"{out}_valid", raw.isNotNull())


def with_lags(df: DataFrame, cols: list[str], lags: list[int]) -> DataFrame:
    """One column per value and lag, all over one window specification, so one sort serves them."""
    named = {f"{c}_{'m' if k < 0 else ''}{abs(k)}": shifted(c, k) for c in cols for k in lags}
    return df.withColumns(named)


def moving_rms(half: int, i: str = "i", q: str = "q") -> Column:
    """Centred RMS over 2 half + 1 samples, zeros beyond the frame."""
    return F.sqrt(F.sum(power(i, q)).over(in_order().rowsBetween(-half, half)) / (2 * half + 1))


def centred_fir(c: str, taps: list[float]) -> Column:
    """An odd centred FIR, zeros beyond the frame: out[n] = sum of taps[k] c[n - (k - half)]."""
    half = len(taps) // 2
    if len(taps) % 2 == 0:
        raise ValueError("an odd number of taps is needed")
    terms = [t * shifted(c, k - half) for k, t in enumerate(taps) if t]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def smoothed(c: str, weights: list[float], order: str, keys: list[str]) -> Column:
    """Weighted centred mean along ``order``, the ends extended by their own value."""
    from pyspark.sql import Window

    half, w = len(weights) // 2, Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(c).over(whole), F.last(c).over(whole)
    total = sum(weights)
    terms = [weights[k + half] / total * (F.coalesce(F.lag(c, -k).over(w), last) if k > 0 else F.coalesce(F.lag(c, -k).over(w), first)) for k in range(-half, half + 1)]
    return sum(terms[1:], terms[0])


#: Samples that one matrix product of the one-pole filter covers.
SCAN = 128


def one_pole(values: np.ndarray, tau: float, start: float) -> np.ndarray:
    """s[n] = a s[n - 1] + (1 - a) values[n] with a = exp(-1 / tau), from ``start``: blocks by one product with the powers of a, then a carry a block."""
    a = math.exp(-1.0 / tau)
    k = np.arange(SCAN)
    lower = np.where(k[:, None] >= k[None, :], a ** np.maximum(k[:, None] - k[None, :], 0), 0.0)
    blocks = np.zeros((-(-len(values) // SCAN), SCAN))
    blocks.reshape(-1)[: len(values)] = values
    own = (1 - a) * blocks @ lower.T
    carry = np.empty(len(blocks))
    s, decay = start, a**SCAN
    for b in range(len(blocks)):
        carry[b] = s
        s = decay * s + own[b, -1]
    return (own + carry[:, None] * a ** (k + 1)[None, :]).reshape(-1)[: len(values)]


def slow_envelope(df: DataFrame, tau: float, start: float, keys: list[str] | None = None) -> DataFrame:
    """One-pole state s = a s + (1 - a) power with a = exp(-1 / tau), from ``start`` at each frame's first sample."""
    return slow_envelopes(df, {"state": tau}, start, keys)


def slow_envelopes(df: DataFrame, taus: dict[str, float], start: float, keys: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """A column for each named time constant, all in one pass; (keys, n, i, q) and these.

    Frames of any length: each block runs from a state of zero, a scan of the blocks' affine maps gives the state each really starts
    from, and its decay is added.
    """
    frame, names = keys or ["frame"], list(taus)
    rows = in_blocks(placed(df, frame).select(*frame, "pos", "n", "i", "q"), ["n", "i", "q"], size=size, keys=frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, (_, i, q) = lists(batch, len(frame) + 2)
            p = i * i + q * q
            states = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate([one_pole(p[x:y], tau, 0.0) for x, y in zip(off, off[1:])] or [p]))) for tau in taus.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *states], names=[*batch.schema.names, *names])

    made = rows.mapInArrow(run, rows.schema.simpleString()[len("struct<") : -1].replace(":", " ") + "".join(f", `{n}` array<double>" for n in names))
    ends = made.select(*frame, "block", F.size("v0").cast("long").alias("len"), F.array(*[F.element_at(n, -1) for n in names]).alias("carry"))
    starts = affine_starts(ends, [math.exp(-1.0 / tau) for tau in taus.values()], start, frame)
    flat = made.join(starts, [*frame, "block"], "left").select(*frame, "start", F.posexplode(F.arrays_zip("v0", "v1", "v2", *names)).alias("k", "s"))
    state = [(F.col(f"s.{n}") + F.pow(F.lit(math.exp(-1.0 / tau)), F.col("k") + 1) * F.coalesce(F.col("start")[j], F.lit(float(start)))).alias(n) for j, (n, tau) in enumerate(taus.items())]
    return flat.select(*frame, F.col("s.v0").alias("n"), F.col("s.v1").alias("i"), F.col("s.v2").alias("q"), *state)


def _decompose(delay: float) -> tuple[int, float]:
    whole = math.floor(delay + 0.5)
    return whole, delay - whole


def fractional_taps(delay: float, count: int = 65, beta: float = 8.6) -> tuple[int, list[float]]:
    """Whole part of a delay, and Kaiser-windowed sinc taps of unit gain at DC that undo the rest, in [-1/2, 1/2)."""
    whole, rest = _decompose(delay)
    half = count // 2
    if rest == 0.0:
        return whole, [float(k == half) for k in range(count)]
    taps = np.sinc(np.arange(-half, half + 1) + rest) * np.kaiser(count, beta)
    return whole, (taps / taps.sum()).tolist()


@dataclass(frozen=True)
class FrozenAlignment:
    """A fractional alignment as it was frozen on the training split: whole delay, taps, and a hash over all of it."""

    delay: float
    whole: int
    beta: float
    taps: tuple[float, ...]

    @property
    def guard(self) -> int:
        """Samples that both ends of a frame lose."""
        return len(self.taps) // 2

    def sha256(self) -> str:
        return hashlib.sha256(repr((self.delay, self.whole, self.beta, self.taps)).encode()).hexdigest()

    def apply(self, df: DataFrame) -> DataFrame:
        if self != freeze_fractional(self.delay, len(self.taps), self.beta):
            raise ValueError("the taps are not those of the frozen delay")
        return align_fractionally(df, self.delay, len(self.taps), self.beta)


def freeze_fractional(delay: float, count: int = 65, beta: float = 8.6) -> FrozenAlignment:
    """Checked settings and their taps; an even or too small count, and values that are not finite, are errors."""
    if not math.isfinite(delay) or not math.isfinite(beta) or beta < 0:
        raise ValueError("delay and beta must be finite, beta not negative")
    if count < 3 or count % 2 == 0:
        raise ValueError("an odd number of taps, three at least, is needed")
    whole, taps = fractional_taps(delay, count, beta)
    if abs(sum(taps) - 1) > 1e-9 or not -0.5 <= delay - whole < 0.5:
        raise ValueError("the taps have no unit gain")
    return FrozenAlignment(delay, whole, beta, tuple(taps))


#: Taps that differ from 0 up to which a sum over them is taken instead of a transform.
DIRECT = 32


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """sum of taps[k] x[n - (k - half)] for all n, zeros beyond x: few taps directly, many by one transform of the block."""
    half, used = len(taps) // 2, np.flatnonzero(taps)
    if len(used) <= DIRECT:
        wide, out = np.concatenate([np.zeros(half), x, np.zeros(half)]), np.zeros(len(x))
        for k in used:
            out += taps[k] * wide[2 * half - k : 2 * half - k + len(x)]
        return out
    size = 1 << (len(x) + len(taps) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[half : half + len(x)]


def block_fir(df: DataFrame, cols: list[str], taps: list[float], whole: int = 0, cropped: bool = False, keep: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """(frame, n, keep, cols) with each of ``cols`` filtered: out[n] = sum of taps[k] c[n + whole - (k - half)], zeros beyond the frame.

    Overlap-save over blocks of frames of any length, a halo of half the taps and the shift on both sides, one transform a block however many
    taps. ``cropped`` leaves out the samples whose taps, or whose shifted place, reach beyond their frame.
    """
    if len(taps) % 2 == 0:
        raise ValueError("an odd number of taps is needed")
    half, keep, weights = len(taps) // 2, keep or [], np.asarray(taps, float)
    ahead, behind = max(0, -whole) + half, max(0, whole) + half
    rows = in_blocks(placed(df).select("frame", "pos", "n", *keep, *cols), ["n", *keep, *cols], ahead, behind, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, values = lists(batch, 3)
            for b, (frame, block, skip) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
                own = [v[off[b] : off[b + 1]] for v in values]
                held, first = len(own[0]), block * size - skip
                lo, hi = skip, min(held, skip + size)
                if cropped:
                    # Beyond the halo the frame ends.
                    lo, hi = max(lo, ahead - first), min(hi, held - behind)
                if lo >= hi:
                    continue
                shown = [v[lo:hi] for v in own[: 1 + len(keep)]]
                for v in own[1 + len(keep) :]:
                    out = convolved(np.concatenate([np.zeros(max(0, -whole)), v, np.zeros(max(0, whole))]), weights)
                    shown.append(out[max(0, whole) + lo : max(0, whole) + hi])
                yield pa.RecordBatch.from_pydict({"frame": np.full(hi - lo, frame), **dict(zip(["n", *keep, *cols], shown, strict=True))})

    return rows.mapInArrow(run, "frame long, n long, " + ", ".join(f"`{c}` double" for c in [*keep, *cols]))


def align_fractionally(df: DataFrame, delay: float, count: int = 65, beta: float = 8.6) -> DataFrame:
    """Pairs x[n] with y at n + delay per frame: the whole part moves, the rest is the FIR, then a symmetric guard is cropped."""
    whole, taps = fractional_taps(delay, count, beta)
    got = block_fir(df, ["yi", "yq"], taps, whole, True, ["i", "q"])
    return got.select("frame", "n", "i", "q", "yi", "yq")


def windows_of(df: DataFrame, length: int, stride: int, cols: list[str]) -> DataFrame:
    """Arrays of ``length`` consecutive values inside frames, one row each ``stride`` samples."""
    w = in_order().rowsBetween(0, length - 1)
    got = df.select("frame", "n", "pos", *[F.collect_list(c).over(w).alias(c) for c in cols])
    return got.filter((F.size(cols[0]) == length) & (F.col("pos") % stride == 0))


def alignment_variants(df: DataFrame, delays: dict[str, float], count: int = 65, beta: float = 8.6) -> dict[str, DataFrame]:
    """The pairs of (frame, n, i, q, yi, yq) under each named delay, all on the samples that every variant has.

    Inputs of the variants are the same, bit for bit (checked: an error otherwise), so that their scores differ by the
    alignment alone.
    """
    made = {name: align_fractionally(df, d, count, beta) for name, d in delays.items()}
    shared = None
    for v in made.values():
        own = v.select("frame", "n", F.col("i").alias("_i"), F.col("q").alias("_q"))
        if shared is None:
            shared = own
        else:
            both = shared.join(own.select("frame", "n", F.col("_i").alias("_j"), F.col("_q").alias("_r")), ["frame", "n"])
            same = F.when((F.col("_i") == F.col("_j")) & (F.col("_q") == F.col("_r")), True).otherwise(F.raise_error(F.lit("inputs of the variants differ")).cast("boolean"))
            shared = both.filter(same).select("frame", "n", "_i", "_q")
    return {name: v.join(shared.select("frame", "n"), ["frame", "n"], "left_semi") for name, v in made.items()}


def first_batches(rows: DataFrame, size: int, most: int, *order: str) -> DataFrame:
    """The rows of the first ``most`` batches of ``size`` in ``order``: the cap of a smoke run."""
    if size < 1 or most < 1:
        raise ValueError("size and number of batches must be positive")
    return rows.orderBy(*order).limit(size * most)
