"""Spectra, bands and leakage ratios.

A spectrum is rows (frame, k, freq, power), k ascending with frequency from -fs/2. Welch spectra of frames of any length come from
blocks with a halo. For short frames ``dft`` gives the same by a join with a table of twiddle factors, in SQL terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from iqlake.functions.scalar import power, ratio_db
from iqlake.operators.blocks import AT_ONCE, SIZE, in_blocks, lists, over_blocks, placed


def hann(length: int, periodic: bool = True) -> np.ndarray:
    if length == 1:
        return np.ones(1)
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / (length if periodic else length - 1))


def hann_column(pos: Column, length: int) -> Column:
    return F.lit(1.0) if length == 1 else 0.5 - 0.5 * F.cos(2 * np.pi * pos / length)


def welch(df: DataFrame, fs: float, nperseg: int, overlap: int | None = None, scaling: str = "spectrum", detrend: bool = True, periodic: bool = True, cols: tuple[str, str] = ("i", "q")) -> DataFrame:
    """Mean spectrum of the sliding windows of each frame; frames shorter than ``nperseg`` give none.

    Rows go by blocks: a block sums the spectra of the windows that start in it, reading on into its halo, and the sums of a frame's
    blocks are added map-side. Arrays (a row a frame) are taken as they are.
    """
    overlap = nperseg // 2 if overlap is None else overlap
    if not 0 <= overlap < nperseg or scaling not in ("spectrum", "density"):
        raise ValueError("bad overlap or scaling")
    w = hann(nperseg, periodic)
    unit = float(w.sum() ** 2) if scaling == "spectrum" else float(fs * (w * w).sum())
    freq = np.fft.fftshift(np.fft.fftfreq(nperseg, 1 / fs))

    hop = nperseg - overlap

    def spectra(x: list[np.ndarray], most: int) -> tuple[np.ndarray, int]:
        """Sums of the spectra of the windows that start before ``most``, a row a frame, and how many they are."""
        parts = np.lib.stride_tricks.sliding_window_view(x[0] + 1j * x[1], nperseg, axis=1)[:, :most:hop]
        if detrend:
            parts = parts - parts.mean(2, keepdims=True)
        return np.fft.fftshift((np.abs(np.fft.fft(parts * w, axis=2)) ** 2 / unit).sum(1), axes=1), parts.shape[1]

    def kernel(frame: np.ndarray, x: list[np.ndarray]) -> dict[str, np.ndarray]:
        n = len(frame) if x[0].shape[1] >= nperseg else 0
        if not n:
            return {"frame": frame[:0], "k": frame[:0], "freq": freq[:0], "power": freq[:0]}
        total, windows = spectra(x, x[0].shape[1])
        return {"frame": np.repeat(frame, nperseg), "k": np.tile(np.arange(nperseg), n), "freq": np.tile(freq, n), "power": (total / windows).ravel()}

    if isinstance(df.schema[cols[0]].dataType, ArrayType):
        return over_frames(df, list(cols), kernel, "frame long, k long, freq double, power double")
    size = hop * -(-max(SIZE, nperseg) // hop)

    def sums(frame: np.ndarray, skip: int, x: list[np.ndarray]) -> dict[str, np.ndarray]:
        n = len(frame) if x[0].shape[1] >= nperseg else 0
        if not n:
            return {"frame": frame[:0], "k": frame[:0], "freq": freq[:0], "total": freq[:0], "windows": frame[:0]}
        total, windows = spectra(x, size)
        return {"frame": np.repeat(frame, nperseg), "k": np.tile(np.arange(nperseg), n), "freq": np.tile(freq, n), "total": total.ravel(), "windows": np.full(n * nperseg, windows)}

    blocks = in_blocks(placed(df).select("frame", "pos", *cols), list(cols), after=nperseg - hop, size=size)
    made = over_blocks(blocks, sums, "frame long, k long, freq double, total double, windows long")
    return made.groupBy("frame", "k").agg(F.first("freq").alias("freq"), (F.sum("total") / F.sum("windows")).alias("power"))


def over_frames(df: DataFrame, cols: list[str], kernel: Callable[[np.ndarray, list[np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``kernel(frames, matrices)`` over frames of one length at a time: a row per frame and a matrix per column, ordered by n.

    Frames become arrays in the JVM, so many short frames cost one Arrow batch instead of one group each. A ``df`` that has a
    row a frame and arrays in ``cols`` is taken as it is, without a shuffle.
    """
    whole = isinstance(df.schema[cols[0]].dataType, ArrayType)
    rows = df.select("frame", *cols) if whole else df.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("n", *cols))).alias("s")).select("frame", *[F.col(f"s.{c}").alias(c) for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, (off, values) = batch.column(0).to_numpy(), lists(batch, 1)
            length = np.diff(off)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                step = max(1, AT_ONCE // max(1, int(n)))
                for lo in range(0, len(own), step):
                    at = off[:-1][own[lo : lo + step]][:, None] + np.arange(n)[None, :]
                    out = kernel(frame[own[lo : lo + step]], [v[at] for v in values])
                    if len(next(iter(out.values()))):
                        yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema)


def rectangular(df: DataFrame, fs: float, nperseg: int, cols: list[tuple[str, str]]) -> DataFrame:
    """Plain FFT of complete frames, no window: (frame, k, freq, re_0, im_0, re_1, ...), a pair for each of ``cols``."""
    freq = np.fft.fftshift(np.fft.fftfreq(nperseg, 1 / fs))
    names = [n for j in range(len(cols)) for n in (f"re_{j}", f"im_{j}")]

    def kernel(frame: np.ndarray, x: list[np.ndarray]) -> dict[str, np.ndarray]:
        n = len(frame) if x[0].shape[1] == nperseg else 0
        out = {"frame": np.repeat(frame[:n], nperseg), "k": np.tile(np.arange(nperseg), n), "freq": np.tile(freq, n)}
        for j, pair in enumerate(cols):
            a, b = (x[flat.index(c)][:n] for c in pair)
            y = np.fft.fftshift(np.fft.fft(a + 1j * b, axis=1), axes=1).ravel() if n else np.zeros(0, complex)
            out |= {f"re_{j}": y.real.copy(), f"im_{j}": y.imag.copy()}
        return out

    flat = list(dict.fromkeys(c for p in cols for c in p))
    return over_frames(df, flat, kernel, "frame long, k long, freq double, " + ", ".join(f"{n} double" for n in names))


def dft(df: DataFrame, points: int, windowed: bool = True) -> DataFrame:
    """Hann-windowed, mean-removed power of frames of exactly ``points`` rows, as a join with ``points`` bins; (frame, k, power).

    The cost is points squared per frame: for short frames only.
    """
    mean = df.groupBy(F.col("frame").alias("f")).agg(F.avg("i").alias("mi"), F.avg("q").alias("mq"), F.count(F.lit(1)).alias("len")).filter(F.col("len") == points)
    x = df.join(mean, F.col("frame") == F.col("f"))
    w = hann_column(F.col("pos"), points) if windowed else F.lit(1.0)
    x = x.select("frame", "pos", ((F.col("i") - F.col("mi")) * w).alias("a"), ((F.col("q") - F.col("mq")) * w).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    t = 2 * np.pi * ((F.col("k") * F.col("pos")) % points) / points
    unit = float(hann(points).sum() ** 2) if windowed else float(points**2)
    g = x.groupBy("frame", "k").agg(F.sum(F.col("a") * F.cos(t) + F.col("b") * F.sin(t)).alias("re"), F.sum(F.col("b") * F.cos(t) - F.col("a") * F.sin(t)).alias("im"))
    return g.select("frame", "k", (power("re", "im") / unit).alias("power"))


def power_spectrum(df: DataFrame, fs: float, nperseg: int, cols: tuple[str, str] = ("i", "q")) -> DataFrame:
    """Mean over complete frames of their Hann spectra: (k, freq, power)."""
    return welch(df, fs, nperseg, cols=cols).groupBy("k", "freq").agg(F.avg("power").alias("power"))


def layout(nperseg: int, fs: float, bandwidth: float, subchannels: int) -> tuple[int, int, int]:
    """First bin at or above -B/2, last at or below B/2, and whole bins of a subchannel; bins left over belong to none."""
    freq = np.fft.fftshift(np.fft.fftfreq(nperseg, 1 / fs))
    left, right = int(np.flatnonzero(freq >= -bandwidth / 2)[0]), int(np.flatnonzero(freq <= bandwidth / 2)[-1])
    width = int((right - left) / subchannels)
    if width < 1:
        raise ValueError("too few bins for the subchannels")
    return left, right, width


def subchannel(nperseg: int, fs: float, bandwidth: float, subchannels: int) -> Column:
    """Number of the subchannel that bin k lies in, null outside."""
    left, _, width = layout(nperseg, fs, bandwidth, subchannels)
    at = F.expr(f"(k - {left}) div {width}").cast("int")
    return F.when((F.col("k") >= left) & (at < subchannels), at)


def spectral_evm_db(df: DataFrame, fs: float, nperseg: int, bandwidth: float, subchannels: int, est: tuple[str, str] = ("yi", "yq"), ref: tuple[str, str] = ("i", "q")) -> DataFrame:
    """Per frame and subchannel mean abs error over mean abs reference; mean of the ratios, in dB."""
    s = rectangular(df, fs, nperseg, [est, ref]).withColumn("sub", subchannel(nperseg, fs, bandwidth, subchannels)).filter("sub is not null")
    e = F.sqrt(power(F.col("re_0") - F.col("re_1"), F.col("im_0") - F.col("im_1")))
    per = s.groupBy("frame", "sub").agg((F.avg(e) / F.avg(F.sqrt(power("re_1", "im_1")))).alias("ratio"))
    return per.agg(F.avg("ratio").alias("r")).select(ratio_db(F.col("r"), F.lit(1.0), 20.0).alias("evm_db"))


def subchannel_aclr_db(spectrum: DataFrame, fs: float, nperseg: int, bandwidth: float, subchannels: int) -> DataFrame:
    """Adjacent subchannel power over the strongest in-band subchannel; the right band begins at the main band's last bin."""
    left, right, width = layout(nperseg, fs, bandwidth, subchannels)
    if left < width or right + width > nperseg:
        raise ValueError("an adjacent subchannel is outside the spectrum")
    k = F.col("k")
    band = F.when((k >= left - width) & (k < left), "left").when((k >= right) & (k < right + width), "right")
    inside = spectrum.withColumn("sub", subchannel(nperseg, fs, bandwidth, subchannels)).filter("sub is not null").groupBy("sub").agg(F.sum("power").alias("p")).agg(F.max("p").alias("best"))
    side = spectrum.withColumn("band", band).agg(F.sum(F.when(F.col("band") == "left", F.col("power"))).alias("l"), F.sum(F.when(F.col("band") == "right", F.col("power"))).alias("r"))
    l, r = ratio_db(F.col("l"), F.col("best")), ratio_db(F.col("r"), F.col("best"))
    return side.crossJoin(F.broadcast(inside)).select(l.alias("left_db"), r.alias("right_db"), ((l + r) / 2).alias("mean_db"))


def band_power(spectrum: DataFrame, low: float, high: float) -> Column:
    inside = (F.col("freq") >= low) & (F.col("freq") < high)
    return F.sum(F.when(inside, F.col("power")))


def standard_aclr_db(spectrum: DataFrame, bandwidth: float, adjacent: float | None = None, guard: float = 0.0, centre: float = 0.0) -> DataFrame:
    """Adjacent power over all main-band power, half-open bands with a guard between."""
    adjacent = adjacent or bandwidth
    lo, hi = centre - bandwidth / 2, centre + bandwidth / 2
    sums = spectrum.agg(band_power(spectrum, lo, hi).alias("m"), band_power(spectrum, lo - guard - adjacent, lo - guard).alias("l"), band_power(spectrum, hi + guard, hi + guard + adjacent).alias("r"))
    l, r = ratio_db(F.col("l"), F.col("m")), ratio_db(F.col("r"), F.col("m"))
    return sums.select(l.alias("left_db"), r.alias("right_db"), ((l + r) / 2).alias("mean_db"))


def regions_frame(spark, regions: dict[str, tuple[float, float]]) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in regions.items()], "name string, low_hz double, high_hz double")


def region_report(before: DataFrame, after: DataFrame, regions: dict[str, tuple[float, float]], main: str = "main", quantiles: tuple[float, ...] = (0.0, 0.5, 0.95, 1.0)) -> DataFrame:
    """Per region: power before and after, dBc against the main region, suppression, leakage improvement and quantiles of the frames' suppression.

    Two per-frame spectra on one grid are joined by (frame, k); regions are a broadcast table of a few rows.
    """
    both = before.select("frame", "k", "freq", F.col("power").alias("p0")).join(after.select("frame", "k", F.col("power").alias("p1")), ["frame", "k"])
    table = F.broadcast(regions_frame(before.sparkSession, regions))
    inside = both.join(table, (F.col("freq") >= F.col("low_hz")) & (F.col("freq") < F.col("high_hz")))
    frames = inside.groupBy("name", "frame").agg(F.sum("p0").alias("p0"), F.sum("p1").alias("p1"))
    drop = F.when((F.col("p0") == 0) & (F.col("p1") == 0), F.raise_error(F.lit("both powers are zero")).cast("double")).when(F.col("p1") == 0, float("inf")).otherwise(ratio_db(F.col("p0"), F.when(F.col("p1") > 0, F.col("p1")).otherwise(1.0)))
    per = frames.withColumn("suppression", drop)
    pooled = per.groupBy("name").agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1"), F.percentile("suppression", F.array(*[F.lit(q) for q in quantiles])).alias("frame_quantiles"))
    m = F.broadcast(pooled.filter(F.col("name") == main).select(F.col("p0").alias("m0"), F.col("p1").alias("m1")))
    dbc0, dbc1 = ratio_db(F.col("p0"), F.col("m0")), ratio_db(F.col("p1"), F.col("m1"))
    return pooled.crossJoin(m).select("name", F.col("p0").alias("power_before"), F.col("p1").alias("power_after"), dbc0.alias("dbc_before"), dbc1.alias("dbc_after"), drop.alias("suppression_db"), (dbc0 - dbc1).alias("improvement_db"), "frame_quantiles")


def error_psd(df: DataFrame, fs: float, nperseg: int) -> DataFrame:
    """Density of the error, dB/Hz against the reference's total power: (k, freq, db); frames that are too short don't count."""
    e = df.withColumn("ei", F.col("yi") - F.col("i")).withColumn("eq", F.col("yq") - F.col("q"))
    err = welch(e, fs, nperseg, scaling="density", cols=("ei", "eq")).groupBy("k", "freq").agg(F.avg("power").alias("power"))
    ref = welch(df, fs, nperseg, scaling="density").groupBy("k").agg(F.avg("power").alias("power")).agg((F.sum("power") * (fs / nperseg)).alias("total"))
    return err.crossJoin(F.broadcast(ref)).select("k", "freq", ratio_db(F.col("power"), F.col("total")).alias("db"))


def band_error_db(df: DataFrame, fs: float, nperseg: int, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Error over reference power in each band, and the frames that are too short to count."""
    e = df.withColumn("ei", F.col("yi") - F.col("i")).withColumn("eq", F.col("yq") - F.col("q"))
    err = welch(e, fs, nperseg, scaling="density", cols=("ei", "eq")).select("frame", "k", "freq", F.col("power").alias("pe"))
    ref = welch(df, fs, nperseg, scaling="density").select("frame", "k", F.col("power").alias("pr"))
    table = F.broadcast(regions_frame(df.sparkSession, bands))
    both = err.join(ref, ["frame", "k"]).join(table, (F.col("freq") >= F.col("low_hz")) & (F.col("freq") < F.col("high_hz")))
    return both.groupBy("name").agg(ratio_db(F.sum("pe"), F.sum("pr")).alias("db"))


def excluded_frames(df: DataFrame, nperseg: int) -> DataFrame:
    return df.groupBy("frame").agg(F.count(F.lit(1)).alias("len")).filter(F.col("len") < nperseg)


def spectrum_db(spectrum: DataFrame, reference: float, tiny: float = 1e-300) -> DataFrame:
    return spectrum.withColumn("db", 10 * F.log10(F.greatest(F.col("power"), F.lit(tiny)) / reference))


SPEC = "input_signal_fs", "bw_main_ch", "n_sub_ch", "nperseg"


def spec_metrics(df: DataFrame, spec: dict, aclr: bool = True) -> DataFrame:
    """One row of the metrics that need a whole spec: mean frame NMSE, spectral EVM and leakage of the estimate.

    Without one of SPEC, or if the record is not whole frames of nperseg, ``available`` is false, ``reason`` says why and the
    rest is null.
    """
    from iqlake.operators.metrics import mean_frame_nmse

    names = ["nmse_db", "evm_db", "left_db", "right_db", "mean_db"]

    def without(reason: str) -> DataFrame:
        row = df.sparkSession.range(1)
        return row.select(F.lit(False).alias("available"), F.lit(reason).alias("reason"), *[F.lit(None).cast("double").alias(n) for n in names])

    missing = [k for k in SPEC if k not in spec]
    if missing:
        return without(f"the spec lacks {', '.join(missing)}")
    fs, width, subs, nperseg = (spec[k] for k in SPEC)
    if df.groupBy("frame").count().filter(F.col("count") != nperseg).limit(1).count():
        return without("the record is not whole frames")
    parts = [mean_frame_nmse(df, nperseg=nperseg).select("nmse_db"), spectral_evm_db(df, fs, nperseg, width, subs)]
    if aclr:
        parts.append(subchannel_aclr_db(power_spectrum(df, fs, nperseg, ("yi", "yq")), fs, nperseg, width, subs).select("left_db", "right_db", "mean_db"))
    out = df.sparkSession.range(1).select(F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason"))
    for p in parts:
        out = out.crossJoin(F.broadcast(p))
    return out.select("available", "reason", *[F.col(n) if n in out.columns else F.lit(None).cast("double").alias(n) for n in names])
