"""Line dedup over runs against a double loop."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from iqlake.llm.common import Scratch
from iqlake.llm.line_dedup import LineRuns, drop_lines, line_dedup
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(pairs, chars=40, docs=5):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for i, t in pairs:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    least = lambda i: (i is not None, i or 0)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < chars or len(held[key(x)]) < docs or max(held[key(x)], key=least) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def judged(pairs):
    return Counter((i, n, d, hashlib.sha256(x.encode()).hexdigest()) for i, n, d, x in brute(pairs))


def corpus(seed, n=60):
    rng = random.Random(seed)
    common = ["Common line number %d, which is over forty characters É" % k for k in range(6)]
    forms = [lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: f"{x}\x0b\x0c", lambda x: x + " "]
    rows = []
    for i in range(n):
        lines = [rng.choice(forms)(rng.choice(common)) if rng.random() < 0.4 else rng.choice(["", "short", "x" * 39, "y" * 40, f"one of its own, this is document {i} line {k}"]) for k in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines)))
    return rows


EDGES = [(None, "z" * 50 + "\nq"), (None, "z" * 50), (3, "z" * 50), (3, "z" * 50), (3, "other\n" + "z" * 50), (4, "Z" * 50 + "\n"), (5, " " + "z" * 50 + "\n" + "z" * 50), (900, None), (901, ""), (902, "\n\n"), (6, "z" * 50)]


@pytest.mark.parametrize(("seed", "batches"), [(0, 1), (1, 5)])
def test_equals_double_loop(spark, docs, seed, batches):
    pairs = corpus(seed) + EDGES
    got = line_dedup(docs(pairs), batches=batches)
    assert Counter(map(tuple, got.collect())) == judged(pairs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_drop_lines_keeps_rows_and_columns(spark, docs):
    pairs = corpus(7) + EDGES
    df = docs(pairs)
    got = drop_lines(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((i, None if t is None else x) for (i, t), (_, _, _, x) in zip(pairs, brute(pairs), strict=True))
    assert {r.n_chars for r in got.collect()} == {r.n_chars for r in df.collect()}


def test_empty_tables_and_texts(spark, docs):
    assert line_dedup(docs([])).collect() == [] and drop_lines(docs([])).collect() == []
    only = [(1, None), (2, "")]
    assert Counter(map(tuple, line_dedup(docs(only)).collect())) == judged(only)


def test_very_long_text(spark, docs):
    """Many lines of one document that all go, and one very long line."""
    many = "\n".join(f"line {k} of a very long document, over forty characters" for k in range(20_000))
    pairs = [(i, many) for i in range(5)] + [(9, "w" * 300_000)]
    assert Counter(map(tuple, line_dedup(docs(pairs)).collect())) == judged(pairs)


def test_runs_compact_and_settle(spark):
    """Runs stay few, sums are right in any order of batches, and a settled key is not written again."""
    scratch = Scratch(spark, "runs")
    runs = LineRuns(spark, scratch, min_docs=2)
    found = lambda rows: spark.createDataFrame([(h.encode(), i) for h, i in rows], "h binary, id long")
    runs.add(found([("a", 9), ("a", 8), ("b", 9), ("b", 9)]))
    runs.add(found([("a", 7), ("b", 6), ("c", 5)]))
    assert [bool(x) for x in runs.levels] == [False, True]
    runs.add(found([("a", 10), ("c", 1), ("d", 1)]))
    rows = {bytes(r.h): (r.docs, r.keep) for r in runs.frequent().collect()}
    assert rows == {b"a": (3, 10), b"b": (2, 9), b"c": (2, 5)}
    assert len([x for x in runs.levels if x]) == 1
    scratch.drop()


def test_plan_is_native(spark, docs):
    """No Python worker, and runs merge without an exchange of their own."""
    scratch = Scratch(spark, "plan")
    runs = LineRuns(spark, scratch)
    for k in range(2):
        rows = docs(corpus(k)).select(F.unhex(F.md5("text")).alias("h"), F.col("doc_id").alias("id"))
        runs.add(rows)
    plan = line_dedup(docs(corpus(1)))._jdf.queryExecution().toString() + runs.frequent()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    scratch.drop()
