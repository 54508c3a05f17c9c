"""Hard-negative mining against a double loop."""

import math
import random
from collections import Counter

import pytest
from iqlake.llm import hard_negatives as H
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, score int, block int"


def table(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA)
    return df.repartition(3) if rows else df


def brute(rows, k=5, m=5, low=80, high=100):
    kept = [(i, y, [math.floor(256.0 * x) for x in v]) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for p, (a, y, u) in enumerate(kept):
        if a is None or a % 10:
            continue
        scored = [(-sum(s * t for s, t in zip(u, v)), late(i), i, z == y) for q, (i, z, v) in enumerate(kept) if q != p]
        scored.sort(key=lambda r: r[:2])
        for s, _, pos, _ in [r for r in scored if r[3]][:k]:
            window = [r for r in scored if not r[3] and low * -s <= 100 * -r[0] <= high * -s][:m]
            out += [(a, pos, n + 1, r[2], -s, -r[0]) for n, r in enumerate(window)]
    return Counter(out)


def rows(seed, n, width=6, same=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    out = []
    for i in range(n):
        y = rng.randrange(3)
        v = [float(x) for x in centres[y]] if i < same else [c + rng.gauss(0, 0.6) for c in centres[rng.randrange(3)]]
        out.append((i, [float(int(x * 64)) / 64 for x in v], y if i >= same else i % 3))
    return out


def mined(spark, data, **more):
    got = H.hard_negatives(table(spark, data), F.col("vec_id") % 10 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, got.collect()))


EDGES = [
    (60, None, 1), (61, [1.0] * 6, None), (70, [float("nan")] * 6, 1), (71, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 2), (72, [float("inf")] + [1.0] * 5, 0),
    (None, [1.0, 0.5, 1.0, 0.5, 1.0, 0.5], 1), (80, [], 1), (81, [0.5], 2), (90, [0.5] * 9, 0), (90, [0.5] * 9, 0), (91, [0.5] * 9, 1), (91, [0.5] * 9, 1), (100, [0.0] * 6, 2),
]


@pytest.mark.parametrize("seed", range(2))
def test_equals_double_loop(spark, seed):
    data = rows(seed, 60) + EDGES
    assert mined(spark, data) == brute(data)


def test_ties_and_one_common_vector(spark):
    """Half the rows share one vector: ties at the kth score go by id."""
    data = rows(5, 120, same=60)
    assert mined(spark, data) == brute(data)


def test_blocks_lanes_and_digits_change_nothing(spark, monkeypatch):
    data = rows(8, 150)
    want = brute(data, 3, 4, 50, 120)
    monkeypatch.setattr(H, "ANCHORS", 4)
    monkeypatch.setattr(H, "BROADCAST", 0)
    monkeypatch.setattr(H, "DIGIT", 2)
    assert mined(spark, data, positives=3, negatives=4, low=50, high=120) == want and want


def test_large_components(spark):
    """Scores beyond the whole numbers of a double are exact."""
    data = [(i, [2.0**20 + 2.0**10 * (i % 5) + x for x in range(4)], i % 2) for i in range(25)]
    assert mined(spark, data) == brute(data)


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == mined(spark, [(10, [1.0], 1)]) == Counter()
