"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from iqlake.llm import chunks, jaccard
from iqlake.llm.common import Scratch
from iqlake.llm.components import components


def brute(docs, width, percent):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for k, (i, _) in enumerate(docs):
        ids = [d for (d, _), x in zip(docs, label) if x == label[k] and d is not None]
        out.append((i, len(sets[k]), min(ids) if ids and len(sets[k]) else i))
    return Counter(out)


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(vocab) for _ in range(30)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))] + (shared if rng.random() < 0.3 else [])
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            base = words if rng.random() < 0.3 else base
            docs.append(" ".join(words) if rng.random() < 0.9 else " ".join(words).upper())
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 1024), (5, 80, 8), (2, 50, 5)])
def test_against_all_pairs(docs, monkeypatch, width, percent, block):
    monkeypatch.setattr(chunks.make_chunks, "__defaults__", (9000,))
    monkeypatch.setattr(jaccard, "PER_BUCKET", 30000)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    pairs = corpus(width, 40, 14) + [(900, None), (901, ""), (902, " \n"), (903, "a b c"), (904, "A  b\tc"), (905, "a b c d"), (906, "a"), (None, "a"), (907, "long " * 20000), (908, "long " * 300), (908, "long " * 300)] + [(920 + k, "x y z " + "".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048))) for k in (0, 1)]
    rows = jaccard.jaccard_classes(docs(pairs), width, percent).collect()
    assert Counter(map(tuple, rows)) == brute(pairs, width, percent)


def test_keep_one_judges_rows(docs):
    """One row of each class, by the row's own text: repeated and null ids that hold different texts."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    d = docs([(1, a), (1, b), (2, b), (None, a), (None, b), (None, "lone words here"), (1, a), (5, None), (5, "")])
    got = Counter((r.doc_id, r.text) for r in jaccard.keep_one(d).collect())
    assert got == Counter([(1, a), (1, b), (None, "lone words here"), (5, None), (5, "")])


def test_unlike_sets_of_one_group_meet_few_blocks(spark, monkeypatch, tmp_path):
    """A chain of unlike sets, each with one n-gram of the next, makes one group; nodes go to blocks by shared n-grams only."""
    rng = np.random.default_rng(6)
    n = 20_000
    own = rng.integers(1, 2**62, (n, 12)).astype(np.uint64)
    own[1:, 0] = own[:-1, 11]
    own[1::500, 1:11] = own[::500, 1:11]  # and some that link
    sets = [np.unique(x) for x in own]
    links = {k + 1 for k in range(0, n, 500)}
    names = [k.to_bytes(16, "big") for k in range(n)]
    rows = pd.DataFrame({"k": names, "set": [x.astype("<u8").tobytes() for x in sets], "prefix": [x.view(np.int64).tolist() for x in sets]})
    nodes = spark.createDataFrame(rows, "k binary, set binary, prefix array<long>").repartition(4)
    groups = spark.createDataFrame(pd.DataFrame({"node": names, "label": [names[0]] * n}), "node binary, label binary")
    sent, real = [], jaccard._routes

    def counted(open_, percent):
        out = real(open_, percent).checkpoint()
        sent.append((out.count(), out.select("g", "block").distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "_routes", counted)
    got = jaccard._links(nodes, groups, Scratch(spark, "t"), 80).filter("a <> b").collect()
    assert {max(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in got} == links
    # Each node shares n-grams with two others, so it goes to two blocks at most, not to all the group's.
    assert sent and 0 < sent[0][0] <= 2 * n and sent[0][1] > n / 1024


def test_path_of_ascending_names(spark):
    """Rounds grow as the logarithm of a path, whatever its names."""
    scratch = Scratch(spark, "path")
    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b").union(spark.range(1000, 1300).selectExpr("1000L AS a", "id + 1 AS b"))
    labels = {r.node: r.label for r in components(edges, scratch, "p").collect()}
    assert len(labels) == 702 and len({labels[k] for k in range(401)}) == 1 and len({labels[k] for k in range(1000, 1301)}) == 1 and len(set(labels.values())) == 2
    assert sum(x.startswith("p-s") for x in scratch.saved) <= 24
    scratch.drop()


def test_empty_and_columns(docs):
    assert jaccard.jaccard_classes(docs([])).count() == 0
    d = docs([(1, "one two three four five six"), (2, "one two three four five six"), (3, None)])
    out = jaccard.keep_one(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_bound_is_an_upper_bound():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 4000, 300).astype(np.uint64)) for _ in range(40)]
    tree = jaccard.Tree(sets)
    for maps, low, high, lost in tree.levels:
        span = -(-len(sets) // len(maps)) if len(maps) > 1 else len(sets)
        span = jaccard.FAN ** [len(x[0]) for x in tree.levels].index(len(maps))
        for i in range(len(maps)):
            for j in range(len(maps)):
                most = int(np.bitwise_count(maps[i] & maps[j]).sum()) + min(lost[i], lost[j])
                for a in sets[i * span : (i + 1) * span]:
                    assert low[i] <= len(a) <= high[i]
                    for b in sets[j * span : (j + 1) * span]:
                        assert len(np.intersect1d(a, b)) <= most
