"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule looks at one property of a document and votes good (1), bad (2) or abstains (0). No label is read: with the
hidden class of a document unknown, expectation-maximisation over the counts of vote patterns estimates for each class how
often each rule votes what, and how large the classes are. There are at most 3 ** len(RULES) patterns whatever the input, so
the counts and the posteriors by pattern are small enough to collect and to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.llm.common import Scratch
from iqlake.llm.textcore import Texts, mix, slices, spans_hash, tidy, window_docs, windows_hash

_TABLE = {name: np.isin(np.arange(256), list(chars.encode())) for name, chars in {"symbol": "#*$%&|<>", "end": ".!?:;)\"'", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz"}.items()}

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: Documents stay at this posterior probability of the good class or more.
KEEP_AT = 0.5
#: Pseudo-documents of each outcome.
PRIOR = 0.1


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(parts: list) -> dict[str, np.ndarray]:
    """Counts of whole texts, one value for each document."""
    t = Texts(parts)
    t.words()
    data, starts, docs = t.data, t.starts, len(t)
    out = {"n_words": np.diff(t.at)}
    solid = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~((data == 32) | ((data >= 9) & (data <= 13))), out=solid[1:])
    begins = ((data & 0xC0) != 0x80) & (np.diff(solid) > 0)
    out["word_chars"] = _per_doc(begins, starts)
    out["n_symbols"] = _per_doc(_TABLE["symbol"][data], starts)
    # Latin-1 letters are two bytes, 0xC3 and one that tells the case.
    second = np.concatenate([data[1:], [0]])
    accent = data == 0xC3
    out["n_upper"] = _per_doc(_TABLE["upper"][data] | (accent & (second >= 0x80) & (second <= 0x9E)), starts)
    out["n_lower"] = _per_doc(_TABLE["lower"][data] | (accent & (second >= 0x9F)), starts)
    ends = np.flatnonzero(data == 10)
    lines = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    with_word = solid[ends] > solid[lines] if len(ends) else np.zeros(0, bool)
    lines, ends = lines[with_word], ends[with_word]
    line_doc = np.searchsorted(starts, lines, "right") - 1
    salt = mix(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    key, first = np.unique(mix(spans_hash(data, lines, ends) ^ salt[line_doc]), return_index=True)
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[first], minlength=docs)
    last = t.b[np.searchsorted(t.b, ends, "right") - 1] - 1 if len(ends) else ends
    out["n_ended"] = np.bincount(line_doc[_TABLE["end"][data[last]]], minlength=docs)
    h = t.hashes()
    word_doc = np.repeat(np.arange(docs), out["n_words"])
    at, doc = window_docs(t.at, REPEAT_WINDOW)
    _, back, count = np.unique(mix(windows_hash(h, REPEAT_WINDOW)[at] ^ salt[doc]), return_inverse=True, return_counts=True)
    twice = at[count[back] > 1] if len(at) else at
    cover = np.bincount(twice, minlength=len(h) + 1)[: len(h) + 1] - np.bincount(twice + REPEAT_WINDOW, minlength=len(h) + 1)[: len(h) + 1]
    out["n_repeat_words"] = _per_doc(np.cumsum(cover)[:-1] > 0, t.at)
    key, first, count = np.unique(mix(h ^ salt[word_doc]), return_index=True, return_counts=True)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, word_doc[first], count)
    out["top_word"] = top
    bang = np.zeros(len(h), bool)
    long = t.b - t.a >= 2
    bang[long] = (data[t.b[long] - 1] == 33) & (data[t.b[long] - 2] == 33)
    out["n_bang"] = _per_doc(bang, t.at)
    out["n_tails"] = _per_doc(_TABLE["symbol"][data[t.b - 1]] if len(h) else bang, t.at)
    out["n_bars"] = _per_doc((t.b - t.a == 1) & (data[t.a] == 124) if len(h) else bang, t.at)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


Rule = tuple[str, Callable[[dict], np.ndarray], Callable[[dict], np.ndarray]]
#: Name, when it votes good, when it votes bad; neither: it abstains.
RULES: list[Rule] = [
    ("symbols", lambda f: 50 * f["n_symbols"] <= f["n_words"], lambda f: 5 * f["n_symbols"] > f["n_words"]),
    ("word ends", lambda f: 20 * f["n_tails"] <= f["n_words"], lambda f: 5 * f["n_tails"] > f["n_words"]),
    ("bars", lambda f: f["n_bars"] == 0, lambda f: 10 * f["n_bars"] > f["n_words"]),
    ("case", lambda f: 5 * f["n_upper"] <= f["n_lower"], lambda f: f["n_upper"] > f["n_lower"]),
    ("shouting", lambda f: 100 * f["n_bang"] <= f["n_words"], lambda f: 5 * f["n_bang"] > f["n_words"]),
    ("repeated words", lambda f: 20 * f["n_repeat_words"] <= f["n_words"], lambda f: 5 * f["n_repeat_words"] > f["n_words"]),
    ("repeated lines", lambda f: f["n_dup_lines"] == 0, lambda f: 3 * f["n_dup_lines"] > f["n_lines"]),
    ("commonest word", lambda f: 4 * f["top_word"] <= f["n_words"], lambda f: 5 * f["top_word"] > 2 * f["n_words"]),
    ("word length", lambda f: (f["word_chars"] > 3 * f["n_words"]) & (f["word_chars"] < 10 * f["n_words"]), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    ("line ends", lambda f: 10 * f["n_ended"] >= 7 * f["n_lines"], lambda f: 10 * f["n_ended"] < f["n_lines"]),
    ("length", lambda f: f["n_words"] >= 30, lambda f: f["n_words"] < MIN_WORDS),
]
#: Bytes of text judged at a time by the filter; a task needs some 60 times as many.
SLICE = 2 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of each document as a number in base 3."""
    out = np.zeros(len(f["n_words"]), np.int64)
    for k, (_, good, bad) in enumerate(RULES):
        g, b = good(f), bad(f)
        out += 3**k * np.where(b, 2, np.where(g, 1, 0))
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Posterior probability of the good class for each pattern.

    Two classes, rules independent within a class, an outcome (good, bad, abstain) for each rule. The start is the vote:
    documents without a bad vote are almost surely good, others almost surely not, so that a small bad class is not swamped
    by the good one. A tenth of a pseudo-document of each outcome keeps probabilities from 0.
    """
    if not len(patterns):
        return np.zeros(0)
    digits = (patterns[:, None] // 3 ** np.arange(len(RULES))[None, :]) % 3
    hot = np.stack([digits == v for v in range(3)], 2).astype(float)
    w = counts.astype(float)
    good = np.where((digits == 2).any(1), 0.001, 0.999)
    before = -np.inf
    for _ in range(rounds):
        size = np.array([(w * good).sum(), (w * (1 - good)).sum()]) + PRIOR
        p = np.stack([np.einsum("p,prv->rv", w * q, hot) + PRIOR for q in (good, 1 - good)])
        p /= p.sum(2, keepdims=True)
        like = np.einsum("prv,crv->pc", hot, np.log(p)) + np.log(size / size.sum())
        top = like.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(like - top).sum(1))
        good = np.exp(like[:, 0] - total)
        now = float((w * total).sum())
        if now - before < tolerance * abs(now):
            break
        before = now
    return good


def _rows(id_col: str, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in slices(batches, text_col):
            f = features(parts)
            yield pa.RecordBatch.from_pydict({"id": batch.column(batch.schema.get_field_index(id_col)), **{k: pa.array(f[k]) for k in COUNTS}, "pattern": pa.array(votes(f))})

    return run


def _posteriors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The patterns of ``rows``, ascending, and the posterior of each."""
    seen = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("pattern")
    patterns = seen["pattern"].to_numpy(np.int64)
    return patterns, fit(patterns, seen["n"].to_numpy(np.int64))


def _failed(n_words: np.ndarray | Column, n_repeat_words: np.ndarray | Column) -> np.ndarray | Column:
    """The base rule."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, pattern.

    A null or empty text has no words and fails the base rule. Null ids and repeated rows are judged like any other row; an
    empty table gives an empty result. Other columns are not read. Equal texts get equal verdicts.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "quality")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in [*COUNTS, "pattern"])
    rows = scratch.save(df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(tidy(_rows(id_col, "_text")), schema), "rows")
    patterns, good = _posteriors(rows)
    known = spark.createDataFrame(pd.DataFrame({"pattern": patterns, "posterior": good}), "pattern long, posterior double")
    failed = _failed(F.col("n_words"), F.col("n_repeat_words"))
    out = rows.join(F.broadcast(known), "pattern", "left").select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & (F.col("posterior") >= KEEP_AT)).alias("kept"), "posterior", "pattern")
    out = scratch.keep(out)
    scratch.drop()
    return out


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows that ``score`` rejects, its columns unchanged.

    A row is judged by its own text alone, so repeated and null ids change nothing; ``id_col`` is not read. The table is read
    twice, for the counts of patterns and for the verdicts, and nothing but the counts is shuffled.
    """

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in slices(batches, "_text", SLICE):
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(votes(features(parts)))})

    known, good = _posteriors(df.select(F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(tidy(patterns), "pattern long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in slices(batches, text_col, SLICE):
            f = features(parts)
            at = np.searchsorted(known, votes(f))
            yield batch.filter(pa.array(~_failed(f["n_words"], f["n_repeat_words"]) & (good[at] >= KEEP_AT)))

    return df.mapInArrow(tidy(run), df.schema)
