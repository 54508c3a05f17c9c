"""Stateful streaming: chunked evaluation that equals the batch result, whatever the chunks.

State is the history a model needs (oldest first) and the next expected sample; a gap, a repeat or disorder across chunks is
an error of the stream, raised with the frame and sample. Exact leading models look ahead and are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from iqlake.operators.blocks import in_blocks, lists, placed

OUTPUT = "frame long, n long, pi double, pq double"
STATE = "next long, hi array<double>, hq array<double>"


class Kernel(Protocol):
    """A causal kernel: output for ``x[warmup:]`` given ``warmup`` samples of history before it."""

    warmup: int

    def run(self, x: np.ndarray) -> np.ndarray: ...


class TermKernel:
    """A generalised memory polynomial of causal terms."""

    def __init__(self, model) -> None:  # noqa: ANN001
        if model.lookahead:
            raise ValueError("a model that looks ahead cannot stream")
        self.terms, self.coef, self.warmup = model.terms, model.coef, model.warmup

    def run(self, x: np.ndarray) -> np.ndarray:
        w, n = self.warmup, len(x) - self.warmup
        r = np.abs(x)
        out = np.zeros(n, complex)
        for t, c in zip(self.terms, self.coef, strict=True):
            out += c * x[w - t.signal : w - t.signal + n] * r[w - t.envelope : w - t.envelope + n] ** t.exponent
        return out


class SplineKernel:
    def __init__(self, model) -> None:  # noqa: ANN001
        self.model, self.warmup = model, model.warmup

    def run(self, x: np.ndarray) -> np.ndarray:
        w, n = self.warmup, len(x) - self.warmup
        r = np.abs(x)
        out = np.zeros(n, complex)
        for (m, d), c in zip(self.model.branches, self.model.coef, strict=True):
            g = np.interp(r[w - d : w - d + n], self.model.knots, np.real(c)) + 1j * np.interp(r[w - d : w - d + n], self.model.knots, np.imag(c))
            out += x[w - m : w - m + n] * g
        return out


class FirKernel:
    """Correction taps alone; the base prediction is added by the caller."""

    def __init__(self, model) -> None:  # noqa: ANN001
        self.model, self.warmup = model, model.warmup

    def run(self, x: np.ndarray) -> np.ndarray:
        w, n = self.warmup, len(x) - self.warmup
        x = np.conj(x) if self.model.conjugate else x
        return sum((c * x[w - d : w - d + n] for d, c in zip(self.model.delays, self.model.coef, strict=True)), np.zeros(n, complex))


class HammersteinKernel:
    """Spline, then FIR: the history is of inputs, from which the nonlinear history is formed again."""

    def __init__(self, model) -> None:  # noqa: ANN001
        self.inner, self.tail = SplineKernel(model.spline), model.tail
        self.warmup = self.inner.warmup + len(self.tail)

    def run(self, x: np.ndarray) -> np.ndarray:
        v, k = self.inner.run(x), len(self.tail)
        n = len(v) - k
        return v[k:] + sum((h * v[k - j : k - j + n] for j, h in enumerate(self.tail, 1)), np.zeros(n, complex))


class ChainKernel:
    """A base prediction and the correction added to it, from one history of inputs."""

    def __init__(self, base: Kernel, correction: Kernel) -> None:
        self.parts, self.warmup = (base, correction), max(base.warmup, correction.warmup)

    def run(self, x: np.ndarray) -> np.ndarray:
        return sum(k.run(x[self.warmup - k.warmup :]) for k in self.parts)


class FixedKernel:
    """Integer terms on codes carried as exact doubles (below 2 ** 53); inputs are quantised on the way in."""

    def __init__(self, model, cfg) -> None:  # noqa: ANN001
        if model.lookahead:
            raise ValueError("a model that looks ahead cannot stream")
        self.model, self.cfg, self.warmup = model, cfg, model.warmup

    @staticmethod
    def _shift(v: np.ndarray, s: int) -> np.ndarray:
        if s <= 0:
            return v << -s
        down = v >> s  # towards minus infinity; what is dropped rounds to even
        return down + (((v & ((1 << s) - 1)) + ((1 << (s - 1)) - 1) + (down & 1)) >> s)

    @staticmethod
    def _clip(v: np.ndarray, bits: int) -> np.ndarray:
        return np.clip(v, -(1 << (bits - 1)), (1 << (bits - 1)) - 1)

    def run(self, x: np.ndarray) -> np.ndarray:
        c, w, n = self.cfg, self.warmup, len(x) - self.warmup
        ci, cq = (self._clip(np.rint(v * 2.0**c.data.fraction).astype(np.int64), c.data.bits) for v in (x.real, x.imag))
        p = ci * ci + cq * cq
        root = np.sqrt(p.astype(float)).astype(np.int64)
        root = np.where(root * root > p, root - 1, np.where((root + 1) ** 2 <= p, root + 1, root))
        powers = {1: self._clip(root + (p - root * root > root), c.power.bits)}
        for e in range(2, max(t.exponent for t in self.model.terms) + 1):
            powers[e] = self._clip(self._shift(powers[e - 1] * powers[1], c.data.fraction), c.power.bits)
        acc = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        for d in sorted({t.signal for t in self.model.terms}):
            s = []
            for part in ("real", "imag"):
                total = np.zeros(n, np.int64)
                for t, k in zip(self.model.terms, self.model.coef, strict=True):
                    if t.signal == d:
                        code = max(c.coef.low, min(c.coef.high, round(getattr(k, part) * 2**c.coef.fraction)))
                        total += code * (powers[t.exponent][w - t.envelope : w - t.envelope + n] if t.exponent else np.int64(1 << c.power.fraction))
                s.append(self._clip(self._shift(total, c.coef.fraction), c.scalar_bits))
            di, dq = ci[w - d : w - d + n], cq[w - d : w - d + n]
            acc = [acc[0] + di * s[0] - dq * s[1], acc[1] + di * s[1] + dq * s[0]]
        shift = c.data.fraction + c.power.fraction - c.out.fraction
        re, im = (self._clip(self._shift(self._clip(a, c.sum_bits), shift), c.out.bits) for a in acc)
        return re + 1j * im


def predict_chunk(kernel: Kernel, x: np.ndarray, history: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Output of one chunk and the next history."""
    h = np.zeros(kernel.warmup, complex) if history is None else history
    both = np.concatenate([h, x])
    return kernel.run(both), both[len(both) - kernel.warmup :]


def stream(df: DataFrame, kernel: Kernel, length: int | None = None) -> DataFrame:
    """A streaming frame (frame, n, pos, i, q) through ``kernel``, state kept per frame; append mode.

    A frame's state goes when it has its ``length`` samples, so the state of a stream without end is that of its open frames. A
    sample for a frame that is over is an error, as it does not start at 0.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values("pos")
        after, history = 0, None
        if state.exists:
            after, hi, hq = state.get
            history = np.asarray(hi, float) + 1j * np.asarray(hq, float)
        pos = pdf["pos"].to_numpy()
        if len(pos) and (pos[0] != after or (np.diff(pos) != 1).any()):
            raise ValueError(f"frame {key[0]}: expected sample {after}, got {pos[0]}..{pos[-1]}")
        y, history = predict_chunk(kernel, pdf["i"].to_numpy() + 1j * pdf["q"].to_numpy(), history)
        if after + len(pos) == length:
            state.remove()
        else:
            state.update((int(after + len(pos)), history.real.tolist(), history.imag.tolist()))
        yield pd.DataFrame({"frame": key[0], "n": pdf["n"], "pi": y.real, "pq": y.imag})

    return df.select("frame", "n", "pos", "i", "q").groupBy("frame").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """Ordered files as micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def batch_outputs(df: DataFrame, kernel: Kernel) -> DataFrame:
    """The same kernel over whole frames of any length, in blocks with its history as halo."""
    rows = in_blocks(placed(df).select("frame", "pos", "n", "i", "q"), ["n", "i", "q"], kernel.warmup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, (n, i, q) = lists(batch, 3)
            for b, (frame, skip) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = slice(off[b], off[b + 1])
                x = i[own] + 1j * q[own]
                y, _ = predict_chunk(kernel, x[skip:], np.concatenate([np.zeros(kernel.warmup - skip), x[:skip]]))
                yield pa.RecordBatch.from_pydict({"frame": np.full(len(y), frame), "n": n[own][skip:], "pi": y.real.copy(), "pq": y.imag.copy()})

    return rows.mapInArrow(run, OUTPUT)
