"""Literal fixtures and recovery tests of operators, models, streams and files."""

import cmath
import re
import math
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from places import SF
from iqlake.functions import scalar as S
from iqlake.operators import align, blocks, features, frames, metrics, models, selection, solve, spectral, windows
from iqlake.plans import cost, fits, govern, release, residual, search, select
from iqlake.sources import io, matlab, views
from iqlake.streaming import kernels

RNG = np.random.default_rng(7)


def signal(spark, x, y=None, nperseg=10**6):
    y = np.zeros(len(x)) if y is None else y
    rows = [(k // nperseg, k, k % nperseg, float(a.real), float(a.imag), float(b.real), float(b.imag)) for k, (a, b) in enumerate(zip(np.asarray(x, complex), np.asarray(y, complex)))]
    return spark.createDataFrame(rows, "frame long, n long, pos long, i double, q double, yi double, yq double")


def noise(n):
    return RNG.normal(size=n) + 1j * RNG.normal(size=n)


def test_gain_and_delay(spark):
    x = noise(96)
    g = 2.3 * cmath.exp(0.37j)
    r = signal(spark, x, g * x).agg(*[c.alias(k) for k, c in zip("ab", metrics.ls_gain())]).first()
    assert abs(complex(r.a, r.b) - g) < 1e-12
    for d in (5, -4):
        y = np.zeros(96, complex)
        if d > 0:
            y[d:] = g * x[:-d]
        else:
            y[:d] = g * x[-d:]
        df = signal(spark, x, y)
        scores = align.delay_scores(df, df, 10)
        assert align.integer_delay(scores).first().d == d
        assert align.fractional_diagnostic(scores).first().d == d
        r = align.align_and_gain(df, df, most=10).first()
        assert r.d == d and abs(complex(r.gain_re, r.gain_im) - g) < 1e-12
    with pytest.raises(ValueError):
        align.align_and_gain(df, df)


def test_delay_ties(spark):
    scores = spark.createDataFrame([(-2, 9, 0.5), (-1, 9, 0.9), (1, 9, 0.9), (3, 9, None)], "d int, overlap long, score double")
    assert align.integer_delay(scores).first().d == -1
    assert align.fractional_diagnostic(scores).first().d == -1


def test_two_bins(spark):
    turn = np.array([0.31, -0.45, 0.07])
    x = np.linspace(0.03, 0.87, 15)
    bins = np.searchsorted([0.25, 0.6], x, "right")
    y = 1.7 * x * np.exp(1j * turn[bins])
    r = metrics.characteristics(signal(spark, x, y), [0.0, 0.25, 0.6, 0.9]).orderBy("bin").collect()
    assert [q["count"] for q in r] == np.bincount(bins).tolist()
    assert np.allclose([(q.gain, q.phase, q.concentration) for q in r], [(1.7, t, 1) for t in turn])
    assert metrics.characteristics(signal(spark, [1.0, 0.0]), [0.0, 0.5, 1.0]).filter("bin = 1").first()["count"] == 1


def test_boundary_lag(spark):
    x = np.random.default_rng(3).normal(size=14)
    for lag in (2, -3):
        r = windows.safe_lag(signal(spark, x, nperseg=5), "i", lag).orderBy("n").collect()
        want = [(x[k - lag], True) if 0 <= k - lag < len(x) and (k - lag) // 5 == k // 5 else (0, False) for k in range(len(x))]
        assert [(q.lagged, q.lagged_valid) for q in r] == want


def test_slow_envelope_resets(spark):
    r = windows.slow_envelope(signal(spark, [0, 1, 1, 0], nperseg=2), 2.0, 0.5).orderBy("n").collect()
    a = math.exp(-0.5)
    assert np.allclose([r[0].state, r[2].state], [a * 0.5, a * 0.5 + 1 - a])


def test_rotation(spark):
    x = np.exp(1j * np.array([0.1, 1.0, 2.0]))
    r = metrics.rotated(signal(spark, x, x + (0.2 - 0.3j) * x)).collect()
    assert np.allclose([(q.radial, q.tangential) for q in r], [(0.2, -0.3)] * 3)


def test_rounding_vectors(spark):
    """Against whole-number arithmetic, to the ends of BIGINT."""
    rng = np.random.default_rng(11)
    top = 2**63 - 1
    v = [int(x) for x in rng.integers(-(2**62), 2**62, 60)] + [int(x) for x in rng.integers(-300, 300, 60)] + [top, top - 1, -top - 1, -top, 3 << 40, -(3 << 40), 0]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    for shift in (1, 5, 41, 62):
        got = {q.v: q.s for q in df.select("v", S.shift_even("v", shift).alias("s")).collect()}
        assert got == {x: round(Fraction(x, 2**shift)) for x in v}
        y = kernels.FixedKernel._shift(np.array(v, np.int64), shift)
        assert y.tolist() == [round(Fraction(x, 2**shift)) for x in v]
    roots = [int(x) for x in rng.integers(0, 3037000499, 80)]
    squares = [x for r in roots for x in (r * r, r * r + r, r * r + r + 1, max(0, r * r - 1))] + [top, 3037000499**2, 3037000499**2 - 1, 0, 1, 2, 2**52, 2**52 + 1]
    got = {q.v: q.s for q in spark.createDataFrame([(x,) for x in squares], "v long").select("v", S.isqrt_even("v").alias("s")).collect()}
    assert got == {x: math.isqrt(x) + (x - math.isqrt(x) ** 2 > math.isqrt(x)) for x in squares}
    f = S.FixedFormat(6, 3)
    r = spark.createDataFrame([(float(x),) for x in rng.uniform(-6, 6, 50).round(2)] + [(0.0625,), (0.1875,), (-0.0625,)], "v double").select("v", f.quantize("v").alias("c"), f.saturated("v").alias("s")).collect()
    codes = [round(Fraction(q.v) * 8) for q in r]
    assert [q.c for q in r] == [max(-32, min(31, c)) for c in codes] and [q.s for q in r] == [not -32 <= c <= 31 for c in codes]
    assert S.monotone_codes([0.0, 0.05, 0.08, 0.9, 1.3], S.FixedFormat(7, 3)) == ([0, 1, 2, 7, 10], 2, 1)
    with pytest.raises(ValueError):
        S.monotone_codes([0.0, 9.0], S.FixedFormat(7, 3))
    for peak in (0.3, 0.97, 5.2, 31.0):
        fmt = S.FixedFormat.for_full_scale(10, peak)
        assert fmt.high / 2**fmt.fraction >= peak * 1.001 and (fmt.fraction == 9 or fmt.high / 2 ** (fmt.fraction + 1) < peak * 1.001)
    with pytest.raises(ValueError):
        S.FixedFormat.for_full_scale(4, 8.0)
    with pytest.raises(Exception, match="64 bits"):
        spark.range(1).select(S.checked_product(F.lit(2**62), F.lit(4).cast("long")).alias("x")).collect()


def test_no_delay_is_an_error(spark):
    scores = spark.createDataFrame([(-1, 3, None), (0, 4, None)], "d int, overlap long, score double")
    for s in (scores, scores.filter("d > 5")):
        with pytest.raises(Exception, match="no delay"):
            align.integer_delay(s).collect()


def test_delays_over_many_blocks(spark, monkeypatch):
    """Blocks shorter than the record, gaps and missing samples: as the double loop."""
    monkeypatch.setattr(align, "SAMPLES", 16)
    x, y = noise(90), noise(90)
    df = signal(spark, x, y).filter("n % 17 <> 4").withColumn("n", F.col("n") - 40)
    xs = {k - 40: x[k] for k in range(90) if k % 17 != 4}
    ys = {k - 40: y[k] for k in range(90) if k % 17 != 4}
    for r in align.delay_scores(df, df, 12, 2).collect():
        pairs = [(xs[n], ys[n + r.d]) for n in xs if n + r.d in ys]
        c = sum(a.conjugate() * b for a, b in pairs)
        assert r.overlap == len(pairs)
        assert abs(r.score - abs(c) ** 2 / (sum(abs(a) ** 2 for a, _ in pairs) * sum(abs(b) ** 2 for _, b in pairs))) < 1e-12


def test_one_pole_is_the_recurrence():
    p = np.random.default_rng(2).random(500)
    for tau in (0.4, 9.0, 5000.0):
        a, s, want = math.exp(-1 / tau), 0.25, []
        for v in p:
            s = a * s + (1 - a) * v
            want.append(s)
        assert np.abs(windows.one_pole(p, tau, 0.25) - want).max() < 1e-12


def test_rank_over_many_tasks(spark):
    rows = [(f"r{k}", float((k * 37) % 50), k % 9 != 0) for k in range(200)]
    t = spark.createDataFrame(rows, "recipe string, score_db double, valid boolean").repartition(6)
    got = {r.recipe: r["rank"] for r in select.ranked(t, 3.0, "recipe").collect()}
    valid = [r for r in rows if r[2]]
    low = min(r[1] for r in valid)
    want = sorted(valid, key=lambda r: (r[1] > low + 3.0, r[1] if r[1] > low + 3.0 else 0.0, r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}


def test_leave_one_out_by_a_tree(spark, monkeypatch):
    """Buckets of few frames: every fit as from the rows of the other frames."""
    monkeypatch.setattr(solve, "FAN", 4)
    x, t = noise(22 * 12), noise(22 * 12)
    terms = [features.Term(0, 0, 0), features.Term(1, 0, 0)]
    got = solve.leave_one_out(features.design(signal(spark, x, t, 12), terms), 2, 1e-3).collect()
    a = np.column_stack([x, x * np.abs(x)])
    assert sorted(r.frame for r in got) == list(range(22))
    for r in got:
        keep = np.arange(len(x)) // 12 != r.frame
        n = keep.sum()
        want = np.linalg.solve(a[keep].conj().T @ a[keep] / n + 1e-3 * np.eye(2), a[keep].conj().T @ t[keep] / n)
        assert r.rows == n and np.abs(np.array(r.coef).view(complex) - want).max() < 1e-9
    with pytest.raises(Exception, match="two frames"):
        solve.leave_one_out(features.design(signal(spark, x[:9], t[:9], 12), terms), 2).collect()


def test_named_fits(spark):
    df = signal(spark, 0.6 * noise(1200), nperseg=300)
    plant = models.SplineModel([0.0, 0.6, 1.2, 3.0], [(0, 0), (1, 1)], [list(1 + 0.1 * noise(4)), list(0.1 * noise(4))])
    y = plant.predict(df).withColumn("yi", F.col("pi")).withColumn("yq", F.col("pq")).drop("pi", "pq")
    got, about = fits.fit_spline_memory(y, plant.branches, plant.knots, ridge=0.0)
    assert np.abs(np.array(got.coef) - np.array(plant.coef)).max() < 1e-8 and about.rank == 8 and about.warmup == 1 and about.mse < 1e-16
    gain = 1.8 - 0.4j
    scaled = df.select("frame", "n", "pos", "i", "q", F.expr("1.8*i + 0.4*q").alias("yi"), F.expr("1.8*q - 0.4*i").alias("yq"))
    inverse, _ = fits.fit_predistorter(scaled, gain, [(0, 0)], knots=[0.0, 1.0, 4.0], ridge=0.0)
    assert np.abs(np.array(inverse.coef) - 1).max() < 1e-8
    base = y.withColumn("pi", F.col("i")).withColumn("pq", F.col("q"))
    first = base.select("*").withColumn("yi", F.col("pi")).withColumn("yq", F.col("pq"))
    taps = models.FirCorrection([0, 2], [0.2 - 0.1j, -0.05 + 0.3j], True)
    moved = taps.correct(first, ("yi", "yq"))
    again, about = fits.fit_correction(moved, [0, 2], True, 0.0)
    assert np.abs(np.array(again.coef) - taps.coef).max() < 1e-9 and about.width == 2
    with pytest.raises(ValueError):
        fits.fit_correction(moved, [300])


def test_search(spark):
    """Every trial as refitted frame by frame from its own rows; the planted topology wins."""
    df = signal(spark, 0.7 * noise(600), nperseg=100)
    terms = features.generalized(3, 2)
    y = models.TermModel(terms, list(noise(len(terms)))).predict(df).withColumn("yi", F.col("pi") + F.expr("0.001 * sin(n)")).withColumn("yq", F.col("pq")).drop("pi", "pq").persist()
    recipes = [search.Recipe.generalized("small", ka=1, la=2), search.Recipe.generalized("right", ka=3, la=2), search.Recipe.generalized("large", ka=5, la=3)]
    ledger = {r.recipe: r for r in search.trials(search.folds(y, recipes, [1e-6], 10), recipes, "topology").collect()}
    for recipe in recipes:
        fits_ = solve.leave_one_out(features.design(y, list(recipe.terms)), len(recipe.terms), 1e-6, True)
        error = power = 0.0
        for r in fits_.collect():
            p = models.TermModel(list(recipe.terms), list(np.array(r.coef).view(complex))).predict(y.filter(F.col("frame") == r.frame))
            e, w = p.agg(F.sum(F.expr("pow(pi - yi, 2) + pow(pq - yq, 2)")), F.sum(F.expr("yi*yi + yq*yq"))).first()
            error, power = error + e, power + w
        assert abs(ledger[recipe.name].score_db - 10 * math.log10(error / power)) < 1e-6 and ledger[recipe.name].frames == 6
    got = search.search(y, recipes, 1e-6, [1e-8, 1e-6, 1e-4], 10, 3 + 9)
    assert got.recipe.name == "right" and got.ledger.count() == 3 + 3 * len({r.recipe for r in got.ledger.filter("stage = 'ridge'").collect()})
    with pytest.raises(ValueError):
        search.search(y, recipes, 1e-6, [1e-8], 10, 5)


def test_tone_and_leakage(spark):
    t = np.arange(128)
    s = spectral.power_spectrum(signal(spark, np.exp(2j * np.pi * 17 * t / 128)), 128.0, 128)
    top = s.orderBy(F.desc("power")).first()
    assert top.freq == 17 and abs(top.power - 1) < 1e-12
    x = sum(a * np.exp(2j * np.pi * f * t / 128) for f, a in ((-15, 1.0), (-5, 1.0), (5, 1.0), (15, 1.0), (-25, 0.1), (25, 0.2)))
    r = spectral.subchannel_aclr_db(spectral.power_spectrum(signal(spark, x), 128.0, 128), 128.0, 128, 40.0, 4).first()
    assert abs(r.left_db + 20) < 0.2 and abs(r.right_db - 20 * math.log10(0.2)) < 0.2
    df = signal(spark, noise(64), nperseg=32)
    a = {(q.frame, (q.k + 16) % 32): q.power for q in spectral.dft(df, 32).collect()}
    b = {(q.frame, q.k): q.power for q in spectral.welch(df, 32.0, 32).collect()}
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a])


def test_fractional_delay(spark):
    n = np.arange(512)
    tone = lambda t: sum(np.exp(2j * np.pi * f * t) for f in (0.01, -0.03, 0.07, 0.11, -0.15))
    df = signal(spark, tone(n), tone(n - 0.27))
    r = windows.align_fractionally(df, 0.27).agg(metrics.nmse_db().alias("db")).first().db
    wrong = windows.align_fractionally(df, -0.27).agg(metrics.nmse_db().alias("db")).first().db
    assert r < -100 and wrong > r + 60
    frozen = windows.freeze_fractional(0.27)
    assert frozen.guard == 32 and frozen.whole == 0 and frozen.sha256() == windows.freeze_fractional(0.27).sha256() != windows.freeze_fractional(0.28).sha256()
    assert frozen.apply(df).agg(metrics.nmse_db().alias("db")).first().db == r
    for bad in ({"count": 8}, {"count": 1}, {"beta": -1.0}, {"delay": math.inf}):
        with pytest.raises(ValueError):
            windows.freeze_fractional(**{"delay": 0.27, **bad})
    with pytest.raises(ValueError):
        windows.FrozenAlignment(0.27, 0, 8.6, windows.freeze_fractional(0.3).taps).apply(df)


def test_terms_and_costs():
    assert len(features.generalized(2, 2, 1, 1, 1, 1, 2, 1, causal=False)) == 7
    assert len(features.generalized(2, 2, 1, 1, 1, 1, 2, 1)) == 6
    assert cost.memory_polynomial([1, 3, 5, 7, 9], list(range(24))).mul == 792
    assert cost.memory_polynomial([1, 3, 5, 7, 9], list(range(24))).add == 502
    assert cost.hammerstein(32, 8).mul == 37 and cost.hammerstein(32, 8).add == 36
    with pytest.raises(ValueError):
        features.memory_polynomial([1, 1], [0])
    with pytest.raises(ValueError):
        features.strict_knots([0.0, 0.0])


def test_fits_recover(spark):
    x = noise(3000)
    terms = features.generalized(2, 2, 1, 1, 1)
    coef = noise(len(terms))
    df = signal(spark, x, nperseg=500).repartition(5)
    y = models.TermModel(terms, list(coef)).predict(df).withColumn("yi", F.col("pi")).withColumn("yq", F.col("pq")).drop("pi", "pq")
    for kw in ({}, {"scaled": True}, {"scaled": True, "rcond": 1e-12}):
        got = solve.fit(features.design(y, terms), len(terms), **kw)
        assert np.abs(got.coef - coef).max() < 1e-10 and got.rank == len(terms)
    whole = solve.leave_one_out(features.design(y, terms), len(terms)).collect()
    assert all(np.abs(np.array(f.coef).view(complex) - coef).max() < 1e-9 for f in whole) and len(whole) == 6
    knots = [0.0, 0.5, 1.0, 2.0, 4.0]
    c = list(noise(5))
    s = models.SplineModel(knots, [(0, 0)], [c])
    z = s.predict(df).withColumn("yi", F.col("pi")).withColumn("yq", F.col("pq"))
    assert np.abs(solve.fit(features.spline_design(z, knots, [(0, 0)]), 5).coef - c).max() < 1e-8


def test_ridge_is_the_augmented_solution(spark):
    x, t = noise(200), noise(200)
    terms = [features.Term(0, 0, 0), features.Term(1, 0, 0)]
    got = solve.fit(features.design(signal(spark, x, t), terms), 2, 1e-2)
    a = np.column_stack([x, x * np.abs(x)])
    want = np.linalg.solve(a.conj().T @ a / 200 + 1e-2 * np.eye(2), a.conj().T @ t / 200)
    assert np.abs(got.coef - want).max() < 1e-10


MODELS = [
    (models.TermModel(features.generalized(3, 2, 1, 1, 1), list(noise(7))), kernels.TermKernel),
    (models.SplineModel([0.0, 0.5, 1.0, 3.0], [(0, 0), (1, 2)], [list(noise(4)), list(noise(4))]), kernels.SplineKernel),
    (models.HammersteinModel(models.SplineModel([0.0, 1.0, 3.0], [(0, 0)], [list(noise(3))]), list(noise(2))), kernels.HammersteinKernel),
]


@pytest.mark.parametrize(("model", "kernel"), MODELS)
def test_chunks_equal_the_record(spark, model, kernel):
    x = noise(64)
    got = model.predict(signal(spark, x)).orderBy("n").collect()
    want = np.array([complex(r.pi, r.pq) for r in got])
    k, h, out = kernel(model), None, []
    for a, b in ((0, 7), (7, 25), (25, 26), (26, 64)):
        y, h = kernels.predict_chunk(k, x[a:b], h)
        out.append(y)
    assert np.abs(np.concatenate(out) - want).max() < 1e-10


def test_fixed_kernel_equals_columns(spark):
    m = models.TermModel([features.Term(0, 0, 0), features.Term(2, 1, 1), features.Term(1, 1, 2)], [1 + 0.1j, -0.1 + 0j, 0.2j])
    x = 0.7 * noise(200)
    got = models.predict_fixed_terms(m, signal(spark, x), models.FixedConfig()).orderBy("n").collect()
    y, _ = kernels.predict_chunk(kernels.FixedKernel(m, models.FixedConfig()), x)
    assert [(r.oi, r.oq) for r in got] == [(int(v.real), int(v.imag)) for v in y]


def test_fixed_spline_is_near_the_double_one(spark):
    s = models.SplineModel([0.0, 0.5, 1.0, 2.0], [(0, 0), (1, 1)], [[1, 0.95, 0.9, 0.8], [0.1j, 0.1, 0.05, 0]])
    df = signal(spark, 0.5 * noise(300))
    both = models.predict_fixed_spline(s, s.predict(df), models.FixedConfig())
    worst = both.agg(F.max(F.abs(F.col("oi") / 4096 - F.col("pi")) + F.abs(F.col("oq") / 4096 - F.col("pq"))).alias("w")).first().w
    assert worst < 4e-3


def test_lookahead_is_refused():
    with pytest.raises(ValueError):
        kernels.TermKernel(models.TermModel([features.Term(1, 0, -1)], [1 + 0j]))


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    model = MODELS[0][0]
    kernel = kernels.TermKernel(model)
    x = noise(300)
    df = signal(spark, x, nperseg=100).select("frame", "n", "pos", "i", "q")
    src, ck, sink = str(tmp_path / "in"), str(tmp_path / "ck"), str(tmp_path / "out")

    def run():
        q = kernels.stream(kernels.replay(spark, src, df.schema), kernel).writeStream.format("parquet").option("checkpointLocation", ck).option("path", sink).trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination()

    df.filter("n < 130").coalesce(1).write.mode("append").parquet(src)
    run()
    df.filter("n >= 130 and n < 210").coalesce(1).write.mode("append").parquet(src)
    run()
    df.filter("n >= 210").coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r.n: complex(r.pi, r.pq) for r in spark.read.parquet(sink).collect()}
    want = {r.n: complex(r.pi, r.pq) for r in model.predict(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[n] - want[n]) for n in want) < 1e-10


def test_stream_state_ends_with_its_frame(spark, tmp_path):
    """A frame that has its length leaves no state; a sample for it afterwards is an error."""
    kernel = kernels.ChainKernel(kernels.TermKernel(MODELS[0][0]), kernels.FirKernel(models.FirCorrection([0, 3], [0.1j, 0.2])))
    df = signal(spark, noise(300), nperseg=100).select("frame", "n", "pos", "i", "q")
    src, ck, sink = (str(tmp_path / x) for x in ("in", "ck", "out"))

    def run():
        q = kernels.stream(kernels.replay(spark, src, df.schema, 10), kernel, 100).writeStream.format("parquet").option("checkpointLocation", ck).option("path", sink).trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination()
        return q

    df.filter("pos < 40").write.mode("append").parquet(src)
    assert run().lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    df.filter("pos >= 40").write.mode("append").parquet(src)
    assert run().lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    got = {r.n: complex(r.pi, r.pq) for r in spark.read.parquet(sink).collect()}
    want = {r.n: complex(r.pi, r.pq) for r in kernels.batch_outputs(df, kernel).collect()}
    assert got.keys() == want.keys() and max(abs(got[n] - want[n]) for n in want) < 1e-12
    df.filter("n = 99").write.mode("append").parquet(src)
    with pytest.raises(Exception, match="expected sample 0"):
        run()


def test_batch_kernel_of_one_long_frame(spark, monkeypatch):
    """Blocks with the history as halo."""
    kernel = kernels.TermKernel(MODELS[0][0])
    df = long_frame(spark, 70_000)
    got = {r.n: complex(r.pi, r.pq) for r in kernels.batch_outputs(df, kernel).filter("n < 40 or (n > 65500 and n < 65600) or n > 69900").collect()}
    i, q = columns(df, "i", "q")
    want, _ = kernels.predict_chunk(kernel, i + 1j * q)
    assert len(got) == 40 + 99 + 99 and all(abs(v - want[n]) < 1e-12 for n, v in got.items())


def test_role_gates_and_checks(spark):
    with pytest.raises(ValueError):
        frames.checked_role("test", "model_selection")
    with pytest.raises(ValueError):
        select.checked_budget(5, 2, 2)
    df = signal(spark, noise(20), nperseg=8)
    assert frames.prefix(signal(spark, noise(16), nperseg=8), 3).count() == 6
    with pytest.raises(Exception, match="shorter"):
        frames.prefix(df, 5).count()
    with pytest.raises(Exception, match="warm-up"):
        frames.checked_warmup(df, 4).collect()
    p = views.paired(spark, SF)
    tables = residual.report(p.withColumn("pi", F.col("i")).withColumn("pq", F.col("q")), "train", "discovery", [0, 1], [1, 2], 4, 16)
    assert all(t.count() for t in tables.values())
    with pytest.raises(ValueError):
        residual.report(p, "test", "final_report", [0], [1], 4, 16)


def test_protocol_and_transfer(spark):
    p = views.paired(spark, SF)
    protocol = govern.freeze_protocol(p, 512, 3, 4, 16)
    assert protocol.delay == 0 and len(protocol.edges) == 5 and protocol.sha256() == govern.freeze_protocol(p, 512, 3, 4, 16).sha256()
    terms = [features.Term(0, 0, 0), features.Term(2, 0, 0), features.Term(0, 1, 1)]
    refit = lambda d: models.TermModel(terms, list(solve.fit(features.design(d, terms), 3).coef))
    out = govern.transfer(models.TermModel(terms[:1], [1 + 0j]), p, p, refit, [64], 2)
    assert out["refit_64"].first().db < -200 < out["zero_shot"].first().db


def test_direction(spark):
    """The cascade score and the inverse diagnostic are different things."""
    x = 0.6 * noise(400)
    pa = models.TermModel([features.Term(0, 0, 0), features.Term(2, 0, 0)], [1 + 0j, -0.1 + 0j])
    df = pa.predict(signal(spark, x)).withColumn("yi", F.col("pi")).withColumn("yq", F.col("pq")).drop("pi", "pq")
    same = models.TermModel([features.Term(0, 0, 0)], [1 + 0j])
    c = models.cascade(df, same, pa).agg(F.max(F.abs(F.col("pi") - F.col("yi"))).alias("d")).first().d
    i = models.inverse_diagnostic(df, same, 1 + 0j).agg(F.max(F.abs(F.col("pi") - F.col("yi"))).alias("d")).first().d
    assert c < 1e-12 and i < 1e-12


def test_files(spark, tmp_path):
    d = str(tmp_path)
    x = noise(40)
    df = signal(spark, x, 2 * x)
    for name, cols in (("train_input", ("i", "q")), ("train_output", ("yi", "yq"))):
        io.write_iq_csv(df.select("n", F.col(cols[0]).alias("i"), F.col(cols[1]).alias("q")), f"{d}/{name}.csv")
    got = io.load_pair(spark, d, "train").orderBy("n").collect()
    assert [complex(r.i, r.q) for r in got] == list(x) and [complex(r.yi, r.yq) for r in got] == list(2 * x)
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    (tmp_path / "nan.csv").write_text("I,Q\n1,NaN\n")
    (tmp_path / "spec.json").write_text('{"nperseg": 8}')
    for bad in ("bad", "nan"):
        with pytest.raises(ValueError):
            io.load_iq_csv(spark, f"{d}/{bad}.csv")
    assert io.load_spec(spark, d) == {"nperseg": 8} and io.load_spec(spark, f"{d}/none") == {}
    assert io.prepare(df, f"{d}/prep", 2, 10, 15)["counts"] == {"train": 8, "val": 5, "test": 25}
    io.save_models(spark, [{"model_id": "m", "model_type": "gmp_pa", "coef": [(1.0, 0.5)]}], f"{d}/models")
    assert io.load_model(spark, f"{d}/models", "m", "gmp_pa")["coef"] == [{"re": 1.0, "im": 0.5}]
    with pytest.raises(ValueError):
        io.load_model(spark, f"{d}/models", "m", "gmp_dpd")
    io.publish({"t": df}, {"tables": ["t"], "z": 1 + 2j, "bad": float("nan")}, f"{d}/bundle")
    manifest, tables = io.read_bundle(spark, f"{d}/bundle")
    assert manifest["z"] == {"real": 1.0, "imag": 2.0} and manifest["bad"] is None and tables["t"].count() == 40
    with pytest.raises(Exception, match="exist"):
        io.publish({"t": df}, {"tables": []}, f"{d}/bundle")


def long_frame(spark, n, parts=6):
    """One frame of n samples, made by many tasks."""
    u = lambda k: (F.xxhash64(F.col("id"), F.lit(k)) % 1000) / 1000.0
    return spark.range(0, n, 1, parts).select(F.lit(0).cast("long").alias("frame"), F.col("id").alias("n"), F.col("id").alias("pos"), u(1).alias("i"), u(2).alias("q"), u(3).alias("yi"), u(4).alias("yq"))


def columns(df, *names):
    rows = sorted(df.select("n", *names).collect())
    return [np.array([r[k + 1] for r in rows]) for k in range(len(names))]


def test_slow_envelope_of_one_long_frame(spark, monkeypatch):
    """Blocks and stretches of blocks, from a record without pos, too, and long decays over many blocks."""
    monkeypatch.setattr(blocks, "FAN", 7)
    df = long_frame(spark, 5000)
    i, q = columns(df, "i", "q")
    for tau in (3.0, 4000.0):
        want, s = [], 0.7
        for p in i * i + q * q:
            s = math.exp(-1 / tau) * s + (1 - math.exp(-1 / tau)) * p
            want.append(s)
        for rows in (df, df.drop("pos").withColumn("n", F.col("n") * 3)):
            got, = columns(windows.slow_envelopes(rows, {"s": tau}, 0.7, size=100), "s")
            assert np.abs(got - want).max() < 1e-12
    with pytest.raises(Exception, match="without gaps"):
        windows.slow_envelopes(df.filter("n <> 2500"), {"s": 3.0}, 0.7, size=100).collect()


def test_a_million_samples_in_one_frame(spark):
    """No task holds the frame: the largest has a block's samples."""
    df = long_frame(spark, 1_000_000)
    out = windows.slow_envelope(df, 1e5, 0.0)
    i, q = (np.array(x) for x in zip(*[(r.i, r.q) for r in df.orderBy("n").select("i", "q").toLocalIterator()]))
    want = windows.one_pole(i * i + q * q, 1e5, 0.0)
    for n, s in out.filter("n % 99991 = 17 or n = 999999").select("n", "state").collect():
        assert abs(s - want[n]) < 1e-11
    held = blocks.in_blocks(df, ["n"]).select(F.size("v0").alias("c")).collect()
    assert len(held) == 16 and max(r.c for r in held) == blocks.SIZE


def test_welch_of_one_long_frame(spark, monkeypatch):
    monkeypatch.setattr(spectral, "SIZE", 100)
    df = long_frame(spark, 3001)
    i, q = columns(df, "i", "q")
    x = i + 1j * q
    for nperseg, overlap, detrend in ((64, 48, True), (256, 100, False), (50, 0, True)):
        hop = nperseg - overlap
        parts = np.array([x[s : s + nperseg] for s in range(0, len(x) - nperseg + 1, hop)])
        parts = parts - parts.mean(1, keepdims=True) if detrend else parts
        w = spectral.hann(nperseg)
        want = np.fft.fftshift((np.abs(np.fft.fft(parts * w, axis=1)) ** 2).mean(0)) / w.sum() ** 2
        got = {r.k: r.power for r in spectral.welch(df, 32.0, nperseg, overlap, detrend=detrend).collect()}
        assert np.abs(np.array([got[k] for k in range(nperseg)]) - want).max() < 1e-12
    plan = spectral.welch(df, 32.0, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan.split("Aggregate [frame")[-1]


def test_factors_of_one_long_frame(spark, monkeypatch):
    """Blocks with halos, merged in two steps, give the factor of the whole frame; two factors in one pass."""
    monkeypatch.setattr(solve, "SIZE", 90)
    monkeypatch.setattr(solve, "STACK", 3)
    terms = [features.Term(0, 0, 0), features.Term(2, 1, 3), features.Term(1, 7, 0), features.Term(3, 0, -2)]
    df = long_frame(spark, 1100).union(long_frame(spark, 60).withColumn("frame", F.lit(1).cast("long")))
    for by_frame in (True, False):
        got = solve.term_factors(df, terms, by_frame, 0, late=13 if by_frame else None).collect()
        grams = {}
        for frame, n in ((0, 1100), (1, 60)):
            i, q, yi, yq = columns(df.filter(F.col("frame") == frame), "i", "q", "yi", "yq")
            x = i + 1j * q
            at = lambda v, d: np.array([v[k - d] if 0 <= k - d < n else 0 for k in range(n)])  # noqa: B023, E731
            a = np.column_stack([at(x, t.signal) * at(np.abs(x), t.envelope) ** t.exponent if t.exponent else at(x, t.signal) for t in terms] + [yi + 1j * yq])
            grams[frame] = a.conj().T @ a, a[13:].conj().T @ a[13:]
        gram = lambda r: (lambda m: m.conj().T @ m)(solve._read(r, 5))
        if by_frame:
            assert sorted((r.group, r.rows, r.scored) for r in got) == [(0, 1100, 1087), (1, 60, 47)]
            assert all(np.allclose(gram(r.r), grams[r.group][0]) and np.allclose(gram(r.steady), grams[r.group][1]) for r in got)
        else:
            assert np.allclose(sum(gram(r.r) for r in got), grams[0][0] + grams[1][0]) and sum(r.rows for r in got) == 1160


def test_exact_quantiles(spark):
    """Narrowed brackets give what sorting gives: ties, outliers of all sizes, groups of unlike size, nulls, one value."""
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=3000), "b": np.r_[np.full(2000, 5.0), rng.exponential(size=900) * 10.0 ** rng.integers(-30, 30, 900)], "c": np.array([7.0]), "d": rng.integers(0, 4, 1500).astype(float)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    p = [0.0, 0.1, 0.37, 0.5, 0.9, 0.999, 1.0]
    for most in (1 << 16, 50):
        got = {r.g: r for r in selection.exact_quantiles(df, "x", p, ["g"], most).collect()}
        assert set(got) == set("abcd")
        for k, v in data.items():
            assert got[k]["count"] == len(v) and np.allclose(got[k].q, np.quantile(v, p), rtol=1e-12, atol=0)
    whole = selection.exact_quantiles(df, F.col("x") * 2, [0.25], most=50).first()
    assert whole.q[0] == pytest.approx(2 * np.quantile(np.concatenate(list(data.values())), 0.25), rel=1e-12)
    none = selection.exact_quantiles(df.filter("g = 'e'"), "x", [0.5]).collect()
    assert [(r["count"], r.q) for r in none] == [(0, [None])]


def test_hammerstein_reads_once(spark):
    """The alternating fit of a long frame is one job over its samples, in blocks."""
    df = long_frame(spark, 3000)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("hammerstein", "fit")
    got = solve.fit_hammerstein(df, [0.0, 0.5, 1.0, 1.5], 3, 1e-6, 0.0, 1e-6, most=6, tolerance=0.0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got.objective) == 13 and all(b <= a * (1 + 1e-9) for a, b in zip(got.objective, got.objective[1:]))
    assert len(jobs.getJobIdsForGroup("hammerstein")) <= 3  # stages of one adaptive query
    i, q, yi, yq = columns(df, "i", "q", "yi", "yq")
    x = i + 1j * q
    c = np.interp(np.abs(x), [0.0, 0.5, 1.0, 1.5], got.coef) * x
    error = c + got.tail[0] * np.r_[0, c[:-1]] + got.tail[1] * np.r_[0, 0, c[:-2]] - yi - 1j * yq
    power = (np.abs(error) ** 2).mean() + 1e-6 * ((np.abs(got.coef) ** 2).sum() + (np.abs(got.tail) ** 2).sum())
    assert got.objective[-1] == pytest.approx(power, rel=1e-9)


def test_search_goes_on_from_its_ledger(spark, tmp_path, monkeypatch):
    """No trial is made twice; another record, warm-up or recipe of the same name is another trial."""
    df = long_frame(spark, 400).withColumn("frame", F.expr("n div 100")).withColumn("pos", F.expr("n % 100"))
    recipes = [search.Recipe("a", (features.Term(0, 0, 0),), 4), search.Recipe("b", (features.Term(0, 0, 0), features.Term(2, 0, 0)), 8)]
    asked, real = [], search.folds
    monkeypatch.setattr(search, "folds", lambda d, r, x, w: asked.append((sorted(q.name for q in r), list(x))) or real(d, r, x, w))
    at = str(tmp_path / "trials")
    first = search.Ledger(spark, at, df, 5)
    first.trials(recipes[:1], [1e-6], "topology")
    again = {"most": 2, "tolerance_db": 1e9}
    one = search.search(df, recipes, 1e-6, [1e-6, 1e-3], 5, 2 + 4, ledger=at, **again)
    assert asked == [(["a"], [1e-6]), (["b"], [1e-6]), (["a", "b"], [1e-3])]
    asked.clear()
    two = search.search(df, recipes, 1e-6, [1e-6, 1e-3], 5, 2 + 4, ledger=at, **again)
    plain = search.search(df, recipes, 1e-6, [1e-6, 1e-3], 5, 2 + 4, **again)
    assert asked == [(["a", "b"], [1e-6]), (["a", "b"], [1e-6, 1e-3])]  # of the plain one
    told = lambda s: sorted((r.recipe, r.ridge, r.stage, round(r.score_db, 9), r.mul) for r in s.ledger.collect())
    assert told(one) == told(two) == told(plain) and one.recipe == plain.recipe and one.ridge == plain.ridge
    assert spark.read.parquet(at).count() == 4
    asked.clear()
    other = search.Recipe("a", (features.Term(1, 0, 0),), 4)
    first.trials([other], [1e-6], "topology")
    search.Ledger(spark, at, df, 6).trials(recipes[:1], [1e-6], "topology")
    search.Ledger(spark, at, df.filter("frame < 3"), 5).trials(recipes[:1], [1e-6], "topology")
    assert len(asked) == 3


def test_content_hash_tree(spark, monkeypatch):
    """The same whatever the order and partitions; repeated rows count; a tree of several levels."""
    monkeypatch.setattr(govern, "BUCKET", 2)
    monkeypatch.setattr(govern, "DIGITS", 1)
    rows = [(k % 2, k, f"v{k % 7}") for k in range(300)] + [(0, 0, "v0"), (1, None, None)]
    df = spark.createDataFrame(rows, "g int, a int, b string")
    got = {r.g: r.sha256 for r in govern.content_hash(df, ["g"], ["a", "b"]).collect()}
    assert got == {r.g: r.sha256 for r in govern.content_hash(df.orderBy(F.desc("a")).repartition(7), ["g"], ["a", "b"]).collect()}
    less = spark.createDataFrame(rows[1:], df.schema)
    other = {r.g: r.sha256 for r in govern.content_hash(less, ["g"], ["a", "b"]).collect()}
    assert other[0] != got[0]
    assert len(govern.content_hash(df, [], ["g", "a", "b"]).collect()) == 1


@pytest.mark.parametrize("count", [5, 65, 1025])
def test_long_fir_over_blocks(spark, count):
    """Equal to the direct sum, over block borders, shifted either way, cropped or not."""
    df = long_frame(spark, 3000)
    i, q, yi = columns(df, "i", "q", "yi")
    half = count // 2
    for delay in (0.3, -3.4, 4.0):
        whole, taps = windows.fractional_taps(delay, count)
        direct = np.array([sum(t * (yi[n + whole - (k - half)] if 0 <= n + whole - (k - half) < 3000 else 0.0) for k, t in enumerate(taps)) if n % 37 == 0 or n in (2999, half) else math.nan for n in range(3000)])
        there = {r.n: r.yi for r in windows.block_fir(df, ["yi"], taps, whole, size=2100).collect()}
        assert len(there) == 3000 and all(abs(there[n] - v) < 1e-9 for n, v in enumerate(direct) if v == v)
        lo, hi = max(0, -whole) + half, 3000 - max(0, whole) - half
        cut = {r.n: (r.i, r.yi) for r in windows.block_fir(df, ["yi"], taps, whole, True, ["i"], 2100).collect()}
        assert sorted(cut) == list(range(lo, hi)) and all(cut[n][0] == i[n] and abs(cut[n][1] - there[n]) < 1e-9 for n in cut)


def test_release_rules(spark):
    """Each rule is true and false on its own figure, and null counts as false."""
    limits = {"drift": 1e-9, "stream": 1e-12, "condition_ratio": 4.0, "norm_ratio": 1.5, "peak_ratio": 1.0, "gain_db": 0.1, "common_gain_db": 0.2, "gap_db": 0.8, "edge_db": 1.2, "mul": 900.0}
    good = dict.fromkeys("changed_files changed_settings limit_drift reference_drift training_drift validation_drift stream_gap reset_gap lookahead unsolved_folds above_support missing_tables cooldown declared_cooldown".split(), 0.0)
    good |= {"recipes": 1.0, "mul": 800.0, "recounted_mul": 800.0, "warmup": 16.0, "declared_warmup": 16.0, "condition_ratio": 4.0, "norm_ratio": 1.5, "peak_ratio": 1.0}
    good |= {"score_db": -40.0, "common_db": -40.5, "validation_db": -39.5, "validation_common_db": -40.0, "reference_db": -39.0, "reference_common_db": -39.0}
    spoilt = {"recipes": 2.0, "mul": 900.0, "recounted_mul": 801.0, "warmup": 8.0, "declared_warmup": 8.0, "condition_ratio": 4.1, "norm_ratio": 1.6, "peak_ratio": 1.01, "score_db": -39.0, "common_db": -38.9, "validation_db": -38.0, "validation_common_db": -38.2, "reference_db": -40.0, "reference_common_db": -40.4}
    names = sorted(good)
    rows = [("", *[good[n] for n in names])]
    for n in names:
        rows += [(n, *[spoilt.get(m, 1.0) if m == n else good[m] for m in names]), (f"{n}?", *[None if m == n else good[m] for m in names])]
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{n} double" for n in names))
    got = {r["name"]: r for r in release.decide(df, [], limits, "name").collect()}
    assert got[""].passed and got[""].failed == []
    for n in names:
        told = {r.name for r in release.RULES if re.search(rf"\b{n}\b", r.left)}
        assert not got[n].passed and not got[f"{n}?"].passed, n
        assert set(got[n].failed) <= told and set(got[n].failed), n
        assert set(got[f"{n}?"].failed) <= told, n
    assert {x for r in got.values() for x in r.failed} == {r.name for r in release.RULES}


def test_release_evidence(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    values = "m string, name string, v double"
    frozen = make([("a", "x", 1.0), ("a", "y", -3.0), ("b", "x", 1.0), ("c", "x", None)], values)
    found = make([("a", "x", 1.0), ("a", "y", -3.4), ("a", "z", 9.0)], values)
    assert dict(release.drift(found, frozen, "m", "name", "v", "d").collect()) == {"a": pytest.approx(0.1), "b": math.inf, "c": math.inf}
    assert dict(release.changed(found, frozen, "m", "name", "v", "n").collect()) == {"a": 1, "b": 1, "c": 1}
    assert dict(release.changed(frozen, frozen, "m", "name", "v", "n").collect()) == {"a": 0, "b": 0, "c": 0}
    assert dict(release.missing(frozen, ["x", "y"], "m", "name", "n").collect()) == {"a": 0, "b": 1, "c": 1}
    out = "m string, frame long, n long, pos long, pi double, pq double"
    batch = make([("a", 0, n, n, float(n), 0.0) for n in range(6)] + [("b", 0, 0, 0, 1.0, 1.0)], out)
    late = make([("a", 0, n, n, n + (3.0 if n == 5 else 0.0), 4.0 if n == 5 else 0.0) for n in range(6)], out)
    gaps = {r.m: (r.stream_gap, r.reset_gap) for r in release.stream_gaps(late, batch, "m", 2).collect()}
    assert gaps == {"a": (5.0, 0.0), "b": (math.inf, math.inf)}
    folds = make([("a", "r", 3, 3, 2.0, 1.0, 1.0, 2.0), ("a", "r", 3, 3, 6.0, 1.5, 3.0, 2.0), ("b", "r", 3, 2, 1.0, 1.0, 1.0, 1.0), ("b", "q", 3, 3, None, 1.0, 1.0, 1.0)], "m string, recipe string, width int, rank int, condition double, norm double, held_peak double, fit_peak double")
    got = {r.m: r for r in release.folds_found(folds, "m").collect()}
    assert tuple(got["a"])[1:] == (1, 0, 3.0, 1.5, 1.5) and (got["b"].recipes, got["b"].unsolved_folds) == (2, 2)


def csv_parts(tmp_path, sizes):
    """Part files of unlike sizes, their samples numbered on."""
    at, n = tmp_path / "x.csv", 0
    at.mkdir()
    for k, size in enumerate(sizes):
        lines = [f"{n + j}.5,{-(n + j)}" for j in range(size)]
        (at / f"part-{k + 99_997:05d}-q.csv").write_text("\n".join(["I,Q", *lines]) + "\n")
        n += size
    return str(at), n


def test_csv_parts_keep_their_order(spark, tmp_path):
    """Parts of unlike sizes, cut into many splits, with part numbers of five and six digits."""
    at, n = csv_parts(tmp_path, [3, 900, 1, 5000, 40, 0, 2500])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = io.load_iq_csv(spark, at)
            assert size == before or df.rdd.getNumPartitions() > 7
            assert {(r.n, r.i, r.q) for r in df.collect()} == {(k, k + 0.5, -float(k)) for k in range(n)} and df.count() == n
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "x.csv" / "part-100009-q.csv").write_text("Q,I\n1,2\n")
    with pytest.raises(Exception, match="header"):
        io.load_iq_csv(spark, at).collect()


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_matlab_container(spark, tmp_path, deflate, order):
    """Written by the encoder, read in stretches of samples by offset, over two files."""
    x = [noise(500), noise(70)]
    for k, v in enumerate(x):
        (tmp_path / f"f{k}.mat").write_bytes(matlab.encode({"other": v[:3], "x": v, "eRef": 3 * v, "y": 2j * v}, deflate, order))
    got = sorted(io.load_blackbox_mat(spark, str(tmp_path)).collect())
    both = np.concatenate(x)
    assert [r.n for r in got] == list(range(570))
    assert np.array_equal([complex(r.i, r.q) for r in got], both) and np.array_equal([complex(r.yi, r.yq) for r in got], 2j * both) and np.array_equal([complex(r.ei, r.eq) for r in got], 3 * both)
    spark.dataSource.register(matlab.Mat5)
    parts = spark.read.format("mat5").option("variables", "x").option("stretch", "64").load(str(tmp_path / "f0.mat"))
    assert parts.rdd.getNumPartitions() == (1 if deflate else 8)
    assert np.array_equal([complex(r.x_re, r.x_im) for r in sorted(parts.collect())], x[0])


def test_matlab_small_and_real_elements(tmp_path):
    """Whole numbers stored small, in the tag, and vectors that are not complex."""
    small = struct.pack("<HH", 1, 3) + b"\x01\xff\x05\0"
    body = struct.pack("<II", 6, 8) + struct.pack("<II", 6, 0) + struct.pack("<II", 5, 8) + struct.pack("<ii", 1, 3) + struct.pack("<HH", 1, 1) + b"x\0\0\0" + small
    raw = matlab.encode({}) + struct.pack("<II", 14, len(body)) + body
    (tmp_path / "s.mat").write_bytes(raw)
    v = matlab.variables(str(tmp_path / "s.mat"), ["x"])["x"]
    assert np.concatenate(list(v.values(v.real, 0, 3))).tolist() == [1.0, -1.0, 5.0] and v.imag is None
    assert np.concatenate(list(v.values(v.imag, 1, 2))).tolist() == [0.0, 0.0]


def test_matlab_errors(spark, tmp_path):
    x = noise(50)
    cases = {"lacks": matlab.encode({"x": x, "y": x}), "length": matlab.encode({"x": x, "y": x[:9], "eRef": x}), "not a MATLAB": b"text", "finite": matlab.encode({"x": x, "y": x, "eRef": x * math.nan}), "early": matlab.encode({"x": x, "y": x, "eRef": x})[:-300]}
    for k, (what, raw) in enumerate(cases.items()):
        (tmp_path / f"{k}.mat").write_bytes(raw)
        with pytest.raises(Exception, match=what):
            io.load_blackbox_mat(spark, str(tmp_path / f"{k}.mat")).collect()


def test_unsorted_duplicate_stream_rows_are_errors():
    with pytest.raises(ValueError):
        models.TermModel([features.Term(0, 0, 0)], [])


def test_hammerstein_fit_recovers(spark):
    knots, c, h = [0.0, 0.7, 1.5, 4.0], [1 + 0j, 0.95 + 0.05j, 0.9 + 0.02j, 0.7 - 0.1j], [0.15 - 0.05j, -0.05 + 0.02j]
    df = signal(spark, noise(900), nperseg=300)
    m = models.HammersteinModel(models.SplineModel(knots, [(0, 0)], [c]), h)
    y = m.predict(df).withColumn("yi", F.col("pi")).withColumn("yq", F.col("pq")).drop("pi", "pq")
    got = solve.fit_hammerstein(y, knots, 3, most=25, tolerance=1e-6)
    assert np.abs(got.coef - c).max() < 1e-3 and np.abs(got.tail - h).max() < 1e-3
    assert all(b <= a * (1 + 1e-9) for a, b in zip(got.objective, got.objective[1:]))
