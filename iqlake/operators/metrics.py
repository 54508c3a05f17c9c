"""Error, power and characteristic metrics as one-pass aggregates; estimate e and reference r are pairs of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.functions.scalar import bin_index, power, ratio_db, rotate_to_input
from iqlake.operators.selection import exact_quantiles

EST, REF = ("yi", "yq"), ("i", "q")


def err_power(est: tuple[str, str] = EST, ref: tuple[str, str] = REF) -> Column:
    return power(F.col(est[0]) - F.col(ref[0]), F.col(est[1]) - F.col(ref[1]))


def masked_sum(c: Column, mask: Column | None = None) -> Column:
    return F.sum(c if mask is None else F.when(mask, c))


def nmse_db(est: tuple[str, str] = EST, ref: tuple[str, str] = REF, mask: Column | None = None) -> Column:
    """Pooled: total error power over total reference power, in dB."""
    return ratio_db(masked_sum(err_power(est, ref), mask), masked_sum(power(*ref), mask))


def mean_frame_nmse(df: DataFrame, est: tuple[str, str] = EST, ref: tuple[str, str] = REF, nperseg: int | None = None) -> DataFrame:
    """Two levels: dB of each frame, then their plain mean; with ``nperseg`` complete frames only."""
    per = df.groupBy("frame").agg(nmse_db(est, ref).alias("db"), F.count(F.lit(1)).alias("len"))
    full = F.lit(True) if nperseg is None else F.col("len") == nperseg
    return per.agg(F.avg(F.when(full, F.col("db"))).alias("nmse_db"), F.count_if(full).alias("frames"), F.coalesce(F.sum(F.when(~full, F.col("len"))), F.lit(0)).alias("discarded"))


def bundle(est: tuple[str, str] = EST, ref: tuple[str, str] = REF, mask: Column | None = None) -> list[Column]:
    """mse, reference power, relative power, NMSE and EVM on a mask, with scored and discarded counts."""
    use = F.lit(True) if mask is None else mask
    e, r = masked_sum(err_power(est, ref), use), masked_sum(power(*ref), use)
    n = F.count_if(use)
    return [n.alias("scored"), (F.count(F.lit(1)) - n).alias("discarded"), (e / n).alias("mse"), (r / n).alias("ref_power"), (e / r).alias("relative_power"), ratio_db(e, r).alias("nmse_db"), F.sqrt(e / r).alias("evm"), ratio_db(F.sqrt(e), F.sqrt(r), 20.0).alias("evm_db")]


def rolled_up(df: DataFrame, warmup: int, est: tuple[str, str] = EST, ref: tuple[str, str] = REF) -> DataFrame:
    """Pooled and per-frame, full and past the warm-up, in one pass; the pooled row has a null frame."""
    return df.rollup("frame").agg(F.count(F.lit(1)).alias("samples"), nmse_db(est, ref).alias("full_db"), nmse_db(est, ref, F.col("pos") >= warmup).alias("common_db"))


def papr_db(i: str = "i", q: str = "q") -> Column:
    return ratio_db(F.max(power(i, q)), F.avg(power(i, q)))


def waveform(i: str = "i", q: str = "q") -> list[Column]:
    p = power(i, q)
    return [F.sqrt(F.max(p)).alias("peak"), F.avg(p).alias("mean_power"), papr_db(i, q).alias("papr_db")]


def ls_gain(x: tuple[str, str] = REF, y: tuple[str, str] = EST) -> tuple[Column, Column]:
    """sum(conj(x) y) / sum(abs(x)^2)."""
    (xi, xq), (yi, yq) = map(F.col, x), map(F.col, y)
    d = F.sum(xi * xi + xq * xq)
    return F.sum(xi * yi + xq * yq) / d, F.sum(xi * yq - xq * yi) / d


def training_gain(df: DataFrame, strategy: str = "complex_ls", explicit: complex | None = None) -> DataFrame:
    """One row (re, im) by one of three strategies: complex least squares, peak ratio, explicit."""
    if strategy == "explicit":
        if not explicit:
            raise ValueError("an explicit gain must not be zero")
        return df.sparkSession.range(1).select(F.lit(explicit.real).alias("re"), F.lit(explicit.imag).alias("im"))
    if strategy == "peak":
        return df.agg(F.sqrt(F.max(power("yi", "yq")) / F.max(power("i", "q"))).alias("re"), F.lit(0.0).alias("im"))
    if strategy != "complex_ls":
        raise ValueError(f"unknown strategy {strategy}")
    re, im = ls_gain()
    return df.agg(re.alias("re"), im.alias("im"))


def characteristics(df: DataFrame, edges: list[float], floor: float = 0.0, x: tuple[str, str] = REF, y: tuple[str, str] = EST) -> DataFrame:
    """AM/AM and AM/PM by input amplitude: every bin, empty ones with nulls.

    count, mean_in, mean_out, gain (ratio of means), phase (angle of the mean phasor), concentration (its length).
    """
    (xi, xq), (yi, yq) = map(F.col, x), map(F.col, y)
    a, b = F.sqrt(power(xi, xq)), F.sqrt(power(yi, yq))
    rows = df.select(bin_index(a, edges).alias("bin"), a.alias("a"), b.alias("b"), F.atan2(yq * xi - yi * xq, yi * xi + yq * xq).alias("d")).filter(F.col("bin").isNotNull() & (F.col("a") > floor))
    c, s = F.avg(F.cos("d")), F.avg(F.sin("d"))
    got = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("a").alias("mean_in"), F.avg("b").alias("mean_out"), (F.avg("b") / F.avg("a")).alias("gain"), F.atan2(s, c).alias("phase"), F.hypot(c, s).alias("concentration"))
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def characteristic_residuals(predicted: DataFrame, measured: DataFrame) -> DataFrame:
    """Predicted minus measured characteristics per bin, the phase difference wrapped."""
    p, m = predicted.alias("p"), measured.alias("m")
    d = F.col("p.phase") - F.col("m.phase")
    return p.join(m, F.col("p.bin") == F.col("m.bin")).select(F.col("p.bin").alias("bin"), (F.col("p.gain") - F.col("m.gain")).alias("gain_delta"), F.atan2(F.sin(d), F.cos(d)).alias("phase_delta"))


def complex_correlations(a: tuple[Column, Column], b: tuple[Column, Column], mask: Column) -> list[Column]:
    """Mean-removed proper and pseudo correlation on a mask, from moment sums of one pass; null with fewer than two samples or no energy."""
    n = F.count_if(mask).cast("double")

    def s(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(mask, c)), F.lit(0.0))

    (ai, aq), (bi, bq) = a, b
    mai, maq, mbi, mbq = (s(c) / n for c in (ai, aq, bi, bq))
    ea = s(ai * ai + aq * aq) - n * (mai * mai + maq * maq)
    eb = s(bi * bi + bq * bq) - n * (mbi * mbi + mbq * mbq)
    norm = F.sqrt(ea * eb)
    ok = (n >= 2) & (ea > 1e-300) & (eb > 1e-300)
    pr = s(ai * bi + aq * bq) - n * (mai * mbi + maq * mbq)
    pi = s(ai * bq - aq * bi) - n * (mai * mbq - maq * mbi)
    qr = s(ai * bi - aq * bq) - n * (mai * mbi - maq * mbq)
    qi = s(ai * bq + aq * bi) - n * (mai * mbq + maq * mbi)
    safe = [F.when(ok, c / norm) for c in (pr, pi, qr, qi)]
    return [n.cast("long").alias("count"), safe[0].alias("proper_re"), safe[1].alias("proper_im"), safe[2].alias("pseudo_re"), safe[3].alias("pseudo_im")]


def real_correlation(a: Column, b: Column, mask: Column | None = None) -> Column:
    """Pearson; null at zero variance."""
    if mask is not None:
        a, b = F.when(mask, a), F.when(mask, b)
    return F.when((F.var_pop(F.when(b.isNotNull(), a)) > 0) & (F.var_pop(F.when(a.isNotNull(), b)) > 0), F.corr(a, b))


def conditional(est: tuple[str, str] = EST, ref: tuple[str, str] = REF) -> list[Column]:
    """For a group: count, mse, relative power, NMSE (null if empty, -inf at no error)."""
    e, r = F.sum(err_power(est, ref)), F.sum(power(*ref))
    return [F.count(F.lit(1)).alias("count"), (e / F.count(F.lit(1))).alias("mse"), F.when(r > 0, e / r).alias("relative_power"), F.when(r > 0, ratio_db(e, F.when(r > 0, r).otherwise(1.0))).alias("nmse_db")]


def by_position(df: DataFrame, bins: int) -> DataFrame:
    """Error metrics by place in the frame, 0 to 1, in even bins with the last one closed; needs len."""
    at = F.when(F.col("len") > 1, F.col("pos") / (F.col("len") - 1)).otherwise(0.0)
    return df.withColumn("bin", F.least(F.floor(at * bins), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(*conditional())


def boundary_split(df: DataFrame, warmup: int) -> DataFrame:
    """Error energy near frame starts and inside, and each part's share."""
    inside = F.col("pos") >= warmup
    e = err_power()
    return df.agg(F.count_if(~inside).alias("boundary"), F.count_if(inside).alias("interior"), F.sum(F.when(~inside, e)).alias("boundary_energy"), F.sum(F.when(inside, e)).alias("interior_energy"), (F.sum(F.when(~inside, e)) / F.sum(e)).alias("boundary_share"))


def component_scores(est: tuple[str, str] = EST, ref: tuple[str, str] = REF) -> list[Column]:
    """MSE and R2 of I and Q apart."""
    out = []
    for part, (e, r) in {"i": (est[0], ref[0]), "q": (est[1], ref[1])}.items():
        se = F.sum((F.col(e) - F.col(r)) * (F.col(e) - F.col(r)))
        out += [(se / F.count(F.lit(1))).alias(f"mse_{part}"), (1 - se / (F.var_pop(r) * F.count(F.lit(1)))).alias(f"r2_{part}")]
    return out


def mean_abs_gain(x: tuple[str, str] = REF, y: tuple[str, str] = EST) -> Column:
    return (F.avg(F.abs(F.col(y[0]))) + F.avg(F.abs(F.col(y[1])))) / (F.avg(F.abs(F.col(x[0]))) + F.avg(F.abs(F.col(x[1]))))


def amplitude_regions(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Error metrics at or above and below each threshold."""
    t = F.explode(F.array(*[F.lit(float(v)) for v in thresholds]))
    return df.withColumn("threshold", t).withColumn("above", F.sqrt(power("i", "q")) >= F.col("threshold")).groupBy("threshold", "above").agg(*conditional())


def binned_summary(df: DataFrame, x: str, y: str, edges: list[float], least: int = 8) -> DataFrame:
    """Exact median, p10 and p90 of y by bin of x, bins with at least ``least`` rows; selected, not gathered."""
    binned = df.withColumn("bin", bin_index(F.col(x), edges)).filter("bin is not null")
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
    got = counts.join(exact_quantiles(binned, y, [0.1, 0.5, 0.9], ["bin"]).drop("count"), "bin", "left")
    return got.select("bin", "count", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90"))


def frozen_reference(train: DataFrame, bins: int) -> DataFrame:
    """Train-only quantities that other splits reuse: amplitude quantiles, mean power, maximum, uniform edges."""
    r = F.sqrt(power("i", "q"))
    got = train.agg(F.avg(power("i", "q")).alias("mean_power"), F.max(r).alias("maximum")).crossJoin(F.broadcast(exact_quantiles(train, r, [0.9, 0.95, 0.99])))
    return got.select(F.col("q")[0].alias("q90"), F.col("q")[1].alias("q95"), F.col("q")[2].alias("q99"), "mean_power", "maximum", F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda k: k * F.col("maximum") / bins).alias("edges"))


def additive_counters(df: DataFrame, by: list[str], sums: list[str], maxima: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def timing_summary(df: DataFrame, ns: str = "elapsed_ns", samples: str = "samples") -> DataFrame:
    v = F.col(ns) / F.col(samples)
    ends = df.agg(F.min(v).alias("fastest"), F.max(v).alias("slowest"), (F.max(v) - F.min(v)).alias("spread"))
    return ends.crossJoin(F.broadcast(exact_quantiles(df, v, [0.5]))).select(F.col("q")[0].alias("median"), "fastest", "slowest", "spread")


def rotated(df: DataFrame, floor: float = 0.0) -> DataFrame:
    radial, tangential, ok = rotate_to_input(F.col("yi") - F.col("i"), F.col("yq") - F.col("q"), F.col("i"), F.col("q"), floor)
    return df.withColumn("radial", radial).withColumn("tangential", tangential).withColumn("rotated", ok)
