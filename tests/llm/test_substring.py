"""Recompression against a window-by-window brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from iqlake.llm import chunks, substring


def brute(docs, w=20):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen, out = set(), []
    for k in order:
        ws = words[k]
        gone = [False] * len(ws)
        for j in range(len(ws) - w + 1):
            key = tuple(ws[j : j + w])
            if key in seen:
                gone[j : j + w] = [True] * w
            seen.add(key)
        kept = " ".join(x for x, g in zip(ws, gone) if not g)
        out.append((docs[k][0], len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


#: Words around two that any polynomial modulo 2 ** 64 takes for one.
CONTEXT = [f"c{k}" for k in range(25)]


def corpus(seed, n=250):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "the", "the", "the"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(18, 70))] for _ in range(12)]
    docs = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 5)):
            r = rng.random()
            if r < 0.35:
                ws += rng.choice(passages)
            elif r < 0.5:
                ws += ["ha"] * rng.randint(1, 60)
            elif r < 0.6:
                ws += ["x", "y"] * rng.randint(1, 40)
            else:
                ws += [rng.choice(vocab) for _ in range(rng.randint(1, 40))]
        docs.append((i, " ".join(ws) if i % 7 else "\n ".join(ws)))
    return docs


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(chunks.make_chunks, "__defaults__", (6000,))
    monkeypatch.setattr(substring, "PER_BUCKET", 20000)


def test_against_brute_force(docs, small):
    pairs = corpus(1) + [(900, None), (901, ""), (None, "w1 " * 30), (902, "hot words " * 40), (903, "hot words " * 40), (904, "z" * 70000 + " w2" * 25)] + [(910 + k, " ".join([*CONTEXT[:10], "".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)), *CONTEXT[10:]])) for k in (0, 1)]
    got = substring.drop_repeats(docs(pairs), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute(pairs)


def test_rows_keep_columns(docs, small):
    same = " ".join(f"v{i}" for i in range(30))
    out = substring.drop_repeats(docs([(1, f"a  b\n{same}"), (2, f"{same} tail"), (3, None), (4, "x\ty"), (4, "x\ty")]))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*docs([]).columns, "n_words", "n_removed"]
    assert rows[1].text == f"a  b\n{same}" and rows[2].text == "tail" and rows[3].text is None and rows[4].text == "x\ty"
    assert rows[2].id == "x" and rows[2].rank == 3 and out.count() == 5
    assert substring.drop_repeats(docs([])).count() == 0


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        substring.drop_repeats(spark.createDataFrame([("x", "t")], "doc_id string, text string"))


def test_determined_symbols_agree():
    """Two occurrences of a window have the same symbols in their zones, wherever they stand."""
    rng = np.random.default_rng(4)
    for trial in range(300):
        w = rng.integers(0, [3, 8, 50][trial % 3], 20).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        seen = []
        for _ in range(3):
            left, right = (rng.integers(0, 3, int(rng.integers(0, 30))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            h = np.concatenate([left, w, right])
            g = substring.Grammar(h, np.array([0, len(h)]))
            lo, hi = (int(x[0]) for x in g.zones(np.array([len(left)]), 20))
            seen.append([(int(g.levels[-1][j]) - len(left), int(g.names[j])) for j in range(lo, hi)])
        assert seen[0] == seen[1] == seen[2]
