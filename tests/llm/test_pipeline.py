"""The pipeline on a small corpus: every stage against what it should leave."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from test_jaccard import brute as brute_classes
from test_substring import brute as brute_repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(4000)]
    passage = " ".join(rng.choices(vocab, k=60))
    texts = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(30, 150))
        texts.append(" ".join(words).capitalize() + ".")
        if i % 6 == 0:
            texts.append(texts[-1])
        if i % 7 == 0:
            near = list(words)
            near[3] = "changed"
            texts.append(" ".join(near).capitalize() + ".")
        if i % 5 == 0:
            texts.append(" ".join(rng.choices(vocab, k=40)).capitalize() + f" {passage} the end.")
    texts += [" ".join(w.upper() + "!!" for w in rng.choices(vocab, k=60)) for _ in range(6)]
    texts += [" ".join(w + "###" for w in rng.choices(vocab, k=60)) for _ in range(6)] + ["same words " * 40, "short", "", None]
    return list(enumerate(texts))


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in corpus()], COLUMNS)
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left[name] = {r.doc_id: r.text for r in docs.collect()} if k < 4 else docs.collect()
    texts = dict(corpus())
    good, once, apart, cut, pieces = left.values()
    assert set(good) == {i for i, t in texts.items() if t and t[-1] == "." and len(t.split()) >= 10}
    largest = defaultdict(int)
    for i in good:
        largest[good[i]] = max(largest[good[i]], i)
    assert set(once) == set(largest.values())
    assert set(apart) == {c for i, n, c in brute_classes(sorted(once.items()), 5, 80)}
    assert sum(n for _, _, n, _ in brute_repeats(sorted(apart.items()))) > 0
    assert Counter((i, n - g) for i, n, g, _ in brute_repeats(sorted(apart.items()))) == Counter((i, len(t.split())) for i, t in cut.items())
    assert {r.doc_id for r in pieces} == set(cut)


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
