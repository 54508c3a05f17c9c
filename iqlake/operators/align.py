"""Delay search and alignment of paired records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iqlake.operators.metrics import ls_gain

#: Samples of a block of the delay search.
SAMPLES = 1 << 15


def delay_scores(x: DataFrame, y: DataFrame, most: int, least_overlap: int | None = None, count: int | None = None) -> DataFrame:
    """(d, overlap, score) for d from -most to most: correlation power over the pairs x[n], y[n + d], in 0..1.

    The record is cut into blocks of n; a block holds its x and, with a halo of ``most`` samples, its y, so a sample is moved
    once (y near a block's end twice or more, if blocks are shorter than the halo) and not 2 most + 1 times. A block gives the
    moments of all delays, which are summed. A delay whose overlap is below ``least_overlap`` (half the record by default) or
    has no energy scores null. n is unique in x and in y; values that are null count as no sample.
    """
    if least_overlap is None:
        n = count if count is not None else x.count()
        least_overlap = max(2, n // 2)
    size = max(SAMPLES, 2 * most)
    a = x.filter("i is not null and q is not null").select(F.expr(f"n div {size} - if(n % {size} < 0, 1, 0)").alias("block"), F.lit(0).alias("side"), "n", F.col("i").alias("re"), F.col("q").alias("im"))
    reach = F.explode(F.sequence(F.floor((F.col("n") - most) / size), F.floor((F.col("n") + most) / size)))
    b = y.filter("yi is not null and yq is not null").select(reach.alias("block"), F.lit(1).alias("side"), "n", F.col("yi").alias("re"), F.col("yq").alias("im"))

    def moments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = key[0] * size
        one, two = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        xs, here = np.zeros(size, complex), np.zeros(size)
        ys, there = np.zeros(size + 2 * most, complex), np.zeros(size + 2 * most)
        at = (one["n"] - start).to_numpy()
        xs[at], here[at] = one["re"].to_numpy() + 1j * one["im"].to_numpy(), 1.0
        at = (two["n"] - start + most).to_numpy()
        ys[at], there[at] = two["re"].to_numpy() + 1j * two["im"].to_numpy(), 1.0
        px, py = np.abs(xs) ** 2, np.abs(ys) ** 2
        rows = []
        for d in range(-most, most + 1):
            cut = slice(d + most, d + most + size)
            c = np.vdot(xs, ys[cut])
            rows.append((d, int(here @ there[cut]), c.real, c.imag, px @ there[cut], here @ py[cut]))
        return pd.DataFrame(rows, columns=["d", "overlap", "re", "im", "ex", "ey"])

    parts = a.unionByName(b).groupBy("block").applyInPandas(moments, "d int, overlap long, re double, im double, ex double, ey double")
    g = parts.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("overlap", "re", "im", "ex", "ey")]).filter("overlap > 0")
    ok = (F.col("overlap") >= least_overlap) & (F.col("ex") > 0) & (F.col("ey") > 0)
    return g.select("d", "overlap", F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.expr("(re*re + im*im) / (ex*ey)")))).alias("score"))


def integer_delay(scores: DataFrame) -> DataFrame:
    """The best delay; near-ties go to the smallest abs(d), then the smaller d. An error if no delay scored."""
    # One row a delay, 2 most + 1 of them.
    all_ = scores.agg(F.max("score").alias("best"), F.collect_list(F.struct(F.abs("d").alias("far"), "d", "score")).alias("all"))
    near = F.filter("all", lambda x: F.abs(x["score"] - F.col("best")) <= 1e-15 + 1e-13 * F.abs("best"))
    pick = F.when(F.col("best").isNull(), F.raise_error(F.lit("no delay has a score")).cast(scores.schema["d"].dataType)).otherwise(F.array_min(near)["d"])
    return all_.select(pick.alias("d"), F.array_min(near)["score"].alias("score"))


def fractional_diagnostic(scores: DataFrame) -> DataFrame:
    """First plain maximum and the vertex of the parabola through it and its neighbours; null at an edge, if not concave or beyond 1/2."""
    w = Window.orderBy("d")
    s = scores.withColumn("low", F.lag("score").over(w)).withColumn("high", F.lead("score").over(w))
    top = s.filter("score is not null").orderBy(F.desc("score"), "d").limit(1)
    bend = F.expr("low - 2*score + high")
    shift = F.when(bend < 0, 0.5 * F.expr("low - high") / bend)
    return top.select("d", "score", F.when(F.abs(shift) <= 0.5, shift).alias("offset"), (F.col("d") + F.when(F.abs(shift) <= 0.5, shift)).alias("fractional_delay"))


def overlap(x: DataFrame, y: DataFrame, d: int) -> DataFrame:
    """Pairs x[n] with y[n + d]."""
    return x.select("n", "i", "q").join(y.select((F.col("n") - d).alias("n"), "yi", "yq"), "n")


def align_and_gain(x: DataFrame, y: DataFrame, d: int | None = None, most: int | None = None) -> DataFrame:
    """Overlap at a given delay or at the best one up to ``most`` (exactly one of them), and its least-squares gain; y is not corrected."""
    if (d is None) == (most is None):
        raise ValueError("give a delay or a search range")
    if d is None:
        d = integer_delay(delay_scores(x, y, most)).first()["d"]
    re, im = ls_gain()
    return overlap(x, y, d).agg(F.lit(d).alias("d"), F.count(F.lit(1)).alias("overlap"), re.alias("gain_re"), im.alias("gain_im"))
