"""Residual diagnostics: what a model's error y - p still has in common with lagged inputs and envelopes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.functions.scalar import power, rotate_to_input
from iqlake.operators.blocks import SIZE, in_blocks, lists, placed
from iqlake.operators.frames import checked_role, in_frame, in_order
from iqlake.operators.metrics import amplitude_regions, boundary_split, by_position, complex_correlations, frozen_reference, real_correlation
from iqlake.operators.windows import safe_lag, slow_envelope, slow_envelopes


def residual(df: DataFrame) -> DataFrame:
    """Adds ei, eq: measured minus predicted."""
    return df.withColumn("ei", F.col("yi") - F.col("pi")).withColumn("eq", F.col("yq") - F.col("pq"))


def lag_table(df: DataFrame, lags: list[int]) -> DataFrame:
    """Proper and pseudo correlation of x[n - lag] with the error for each lag, from one scan: all moments are columns of one aggregate."""
    lagged = df
    for k in lags:
        tag = f"m{-k}" if k < 0 else str(k)
        lagged = safe_lag(safe_lag(lagged, "i", k, f"li_{tag}"), "q", k, f"lq_{tag}")
    aggs, names = [], ["count", "proper_re", "proper_im", "pseudo_re", "pseudo_im"]
    for k in lags:
        tag = f"m{-k}" if k < 0 else str(k)
        cols = complex_correlations((F.col(f"li_{tag}"), F.col(f"lq_{tag}")), (F.col("ei"), F.col("eq")), F.col(f"li_{tag}_valid"))
        aggs.append(F.struct(F.lit(k).alias("lag"), *cols).alias(f"l{tag}"))
    wide = lagged.agg(*aggs)
    return wide.select(F.explode(F.array(*wide.columns)).alias("r")).select("r.lag", *[f"r.{n}" for n in names])


def envelope_table(df: DataFrame, lags: list[int], exponents: list[int]) -> DataFrame:
    """Pearson of abs(x[n - lag]) ** p with the radial and tangential error."""
    radial, tangential, ok = rotate_to_input(F.col("ei"), F.col("eq"), F.col("i"), F.col("q"))
    df = df.withColumn("radial", radial).withColumn("tangential", tangential).withColumn("ok", ok).withColumn("r", F.sqrt(power("i", "q")))
    for k in lags:
        df = safe_lag(df, "r", k, f"r_{k}")
    aggs = []
    for k in lags:
        for p in exponents:
            v, m = F.pow(F.col(f"r_{k}"), F.lit(p)), F.col(f"r_{k}_valid") & F.col("ok")
            aggs.append(F.struct(F.lit(k).alias("lag"), F.lit(p).alias("exponent"), real_correlation(v, F.col("radial"), m).alias("radial"), real_correlation(v, F.col("tangential"), m).alias("tangential")).alias(f"e_{k}_{p}"))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*wide.columns)).alias("r")).select("r.*")


def slow_state_table(df: DataFrame, taus: list[float], start: float, shortest: int = 3) -> DataFrame:
    """Pearson of each slow envelope state with the rotated error; observable if the longest frame has at least ``shortest`` time constants."""
    longest = df.groupBy("frame").count().agg(F.max("count").alias("m"))
    names = {f"_s{k}": float(tau) for k, tau in enumerate(taus)}
    radial, tangential, ok = rotate_to_input(F.col("ei"), F.col("eq"), F.col("i"), F.col("q"))
    # All states in one pass over frames, joined once; all correlations in one aggregate.
    wide = df.join(slow_envelopes(df, names, start).select("n", *names), "n")
    rows = [F.struct(F.lit(tau).alias("tau"), real_correlation(F.col(s), radial, ok).alias("radial"), real_correlation(F.col(s), tangential, ok).alias("tangential")) for s, tau in names.items()]
    out = wide.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    return out.crossJoin(F.broadcast(longest)).withColumn("observable", F.col("m") >= shortest * F.col("tau")).drop("m")


def projected_state(df: DataFrame, tau: float, start: float, lags: list[int]) -> DataFrame:
    """The slow state without what a least-squares fit on 1 and lagged powers explains: (n, state, rest)."""
    from iqlake.operators.solve import fit

    p = power("i", "q")
    s = slow_envelope(df, tau, start).select("n", "state")
    lagged = df.withColumns({f"_p{k}": F.lag(p, k, 0.0).over(in_order()) for k in lags}).join(s, "n")
    cols = [F.lit(1.0), *[F.col(f"_p{k}") for k in lags]]
    phi = F.array(*[c for v in cols for c in (v, F.lit(0.0))])
    got = fit(lagged.select("n", phi.alias("phi"), F.col("state").alias("yi"), F.lit(0.0).alias("yq")), len(cols))
    explained = sum((float(c.real) * v for c, v in zip(got.coef, cols, strict=True)), F.lit(0.0))
    return lagged.select("n", "state", (F.col("state") - explained).alias("rest"))


def report(df: DataFrame, split: str, purpose: str, lags: list[int], exponents: list[int], bins: int, warmup: int, train: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a residual report over (i, q, yi, yq, pi, pq); thresholds are frozen from ``train``. Not on the test split."""
    checked_role(split, purpose)
    if split == "test":
        raise ValueError("residuals of the test split are not for discovery")
    e = residual(df)
    ref = frozen_reference(train if train is not None else df, bins)
    q = ref.first()
    named = e.select("frame", "n", "pos", "i", "q", "ei", "eq", F.col("yi").alias("my"), F.col("yq").alias("mq"), F.col("pi"), F.col("pq"))
    scored = named.select("frame", "n", "pos", F.col("my").alias("i"), F.col("mq").alias("q"), F.col("pi").alias("yi"), F.col("pq").alias("yq")).withColumn("len", F.count(F.lit(1)).over(in_frame()))
    return {"lags": lag_table(e, lags), "envelope": envelope_table(e, lags, exponents), "position": by_position(scored, bins), "boundary": boundary_split(scored, warmup), "regions": amplitude_regions(scored, [q["q90"], q["q95"], q["q99"]]), "reference": ref}


def report_sums(df: DataFrame, lags: list[int], edges: list[float], width: int) -> DataFrame:
    """(part, key, count, mse, relative_power, cross_re, cross_im) of (frame, pos, i, q, ei, eq): one pass for a whole residual and nuisance report.

    ``part`` is lag (error against x[n - lag], samples whose past or future is in the frame), bin (of abs(x), by ``edges``) or
    position (``width`` samples from the frame's start each); cross is the mean of conj(x[n - lag]) e, at lag 0 in the other parts.
    Blocks of frames of any length send a row for each key; nothing else is moved but the samples, once.
    """
    rows = in_blocks(placed(df).select("frame", "pos", "i", "q", "ei", "eq"), ["i", "q", "ei", "eq"], max([0, *lags]), max([0, *[-k for k in lags]]))
    size, marks = SIZE, np.asarray(edges, float)
    names = ["part", "key", "count", "error", "power", "cross_re", "cross_im"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, values = lists(batch, 3)
            sums: dict[tuple[str, int], np.ndarray] = {}

            def add(part: str, key: np.ndarray, x: np.ndarray, e: np.ndarray) -> None:
                cross = np.conj(x) * e
                parts = np.column_stack([np.ones(len(e)), np.abs(e) ** 2, np.abs(x) ** 2, cross.real, cross.imag])
                for k in np.unique(key):
                    total = parts[key == k].sum(0)
                    sums[part, int(k)] = sums.get((part, int(k)), 0) + total  # noqa: B023

            for b, (block, skip) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                i, q, ei, eq = (v[off[b] : off[b + 1]] for v in values)
                x, e = i + 1j * q, ei + 1j * eq
                lo, hi = skip, min(len(x), skip + size)
                for k in lags:
                    at = np.arange(lo, hi)
                    at = at[(at - k >= 0) & (at - k < len(x))]  # a halo covers lags, so outside it is outside the frame
                    add("lag", np.full(len(at), k), x[at - k], e[at])
                x, e = x[lo:hi], e[lo:hi]
                bins = np.searchsorted(marks, np.abs(x), "right") - 1
                bins = np.where(np.abs(x) == marks[-1], len(marks) - 2, bins)
                held = (bins >= 0) & (bins < len(marks) - 1)
                add("bin", bins[held], x[held], e[held])
                add("position", (block * size + np.arange(len(x))) // width, x, e)
            if sums:
                cols = [[k[0] for k in sums], [k[1] for k in sums], *[np.array([float(v[j]) for v in sums.values()]) for j in range(5)]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), *map(pa.array, cols[2:])], names=names)

    made = rows.mapInArrow(run, "part string, key long, " + ", ".join(f"{n} double" for n in names[2:]))
    n, error, ref = F.sum("count"), F.sum("error"), F.sum("power")
    return made.groupBy("part", "key").agg(n.cast("long").alias("count"), (error / n).alias("mse"), F.when(ref > 0, error / ref).alias("relative_power"), (F.sum("cross_re") / n).alias("cross_re"), (F.sum("cross_im") / n).alias("cross_im"))
