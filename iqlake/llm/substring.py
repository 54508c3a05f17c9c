"""Substring deduplication by recompression.

Every document is parsed like a recompression grammar: rounds name maximal runs of a symbol and then pairs of a symbol of the
left class and one of the right class. Names are fingerprints of what they stand for, hence global without a dictionary, and
whether two neighbours join depends on them alone, so equal stretches of words get equal symbols but for a few at their
edges. A last round names every three consecutive symbols. For a window of ``width`` words, the named triples that its words
alone determine occur wherever the window occurs: chunks ask which of their triples occur twice, and only windows all of
whose triples do are fingerprinted themselves. Of each such window, chunks ask where it comes first; every later one goes.
A window without a determined triple (inside long runs) is always asked about.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iqlake.llm.chunks import ask, bounds_of, chunk_parts, chunk_texts, cut, joined, make_chunks, read_answers, save_answers, total_bytes, with_answers
from iqlake.llm.common import Scratch, need
from iqlake.llm.textcore import U, Texts, mix, tidy, window_docs, windows_hash

WIDTH, ROUNDS, NAMED = 20, 2, 3
_LEFT, _RIGHT, _RUN = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
#: Bytes of text whose questions one bucket answers.
PER_BUCKET = 24 << 20
#: Parses and windows take some 27 bytes a byte of text: chunks of half the size.
SMALLER = 2


class Grammar:
    """The parse of a batch of words ``h`` whose documents begin at ``at``: boundaries of every level, and names of the top one.

    levels[0] are starts of runs, levels[k] starts of symbols after k rounds of pairs, all as word positions.
    """

    def __init__(self, h: np.ndarray, at: np.ndarray, rounds: int = ROUNDS) -> None:
        n = len(h)
        first = np.zeros(n + 1, bool)
        first[at] = True  # of a document, and the end
        new = np.ones(n, bool)
        new[1:] = (h[1:] != h[:-1]) | first[1:n]
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, n))
        names = np.where(length > 1, mix(h[starts] * _RUN + length.astype(np.uint64)), h[starts])
        self.levels = [starts]
        for r in range(rounds):
            side = mix(names ^ U(0x1234567 + r)) >> U(63)
            pair = np.zeros(len(names), bool)
            if len(names) > 1:
                pair[:-1] = (side[:-1] == 0) & (side[1:] == 1) & ~first[starts[1:]]
            right = np.concatenate([np.zeros(min(1, len(pair)), bool), pair[:-1]])
            merged = names.copy()
            left = np.flatnonzero(pair)
            merged[left] = mix(names[left] * _LEFT + mix(names[left + 1] * _RIGHT + U(r + 1)))
            names, starts = merged[~right], starts[~right]
            self.levels.append(starts)
        self.names, self.n = names, n
        #: Names of three symbols in a row in one document, at the first one; others are not valid.
        m = len(names) - NAMED + 1
        self.triples = windows_hash(names, NAMED)
        crosses = np.concatenate([[0], np.cumsum(first[starts])]) if n else np.zeros(1, int)
        self.valid = (crosses[NAMED : m + NAMED] - crosses[1 : m + 1] == 0) if m > 0 else np.zeros(0, bool)

    def zones(self, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For windows at ``starts``: the first top symbol and the one past the last that their words determine."""
        runs = np.append(self.levels[0], self.n)
        low = runs[np.searchsorted(runs, starts, "right")]
        low = runs[np.minimum(np.searchsorted(runs, low, "right"), len(runs) - 1)]
        high = runs[np.searchsorted(runs, starts + width - 1, "right") - 1]
        high = runs[np.maximum(np.searchsorted(runs, high, "left") - 1, 0)]
        for k in range(1, len(self.levels)):
            edges = np.append(self.levels[k], self.n)
            if k > 1:
                # One more symbol of the level below may join what lies outside.
                below = np.append(self.levels[k - 1], self.n)
                low = below[np.minimum(np.searchsorted(below, low, "right"), len(below) - 1)]
                high = below[np.maximum(np.searchsorted(below, high, "left") - 1, 0)]
            low = edges[np.minimum(np.searchsorted(edges, low, "left"), len(edges) - 1)]
            high = edges[np.searchsorted(edges, high, "right") - 1]
        top = np.append(self.levels[-1], self.n)
        return np.searchsorted(top, low), np.searchsorted(top, high)


def _parsed(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """Word fingerprints and bounds of documents with a window, one after another, and their parse."""
    t.words()
    h = t.hashes()
    return h, t.at, Grammar(h, t.at)


def _triples(g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct valid triple names, how often each occurs here, and for each triple of the parse its place among them (-1: not valid)."""
    where = np.flatnonzero(g.valid)
    keys, back, count = np.unique(g.triples[where], return_inverse=True, return_counts=True)
    place = np.full(len(g.triples), -1)
    place[where] = back
    return keys, count, place


def _candidates(t: Texts, width: int, answers: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that may occur elsewhere: their first words and two fingerprints each."""
    h, at, g = _parsed(t, width)
    starts, _ = window_docs(at, width)
    if not len(starts):
        return starts, h[:0], h[:0]
    keys, count, place = _triples(g)
    told = read_answers(answers)
    often = (count > 1) | (told > 0 if len(told) else np.zeros(len(keys), bool))
    once = np.zeros(len(place) + 1, np.int64)
    np.cumsum((place >= 0) & ~np.append(often, False)[place], out=once[1:])
    low, high = g.zones(starts, width)
    last = np.clip(high - NAMED + 1, low, len(place))
    low = np.minimum(low, last)
    starts = starts[once[last] == once[low]]
    a, b = windows_hash(h, width), windows_hash(h, width, 0x1D2E3F4A5B6C7)
    return starts, a[starts], b[starts]


def _firsts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, b) pairs in ascending order: the first index of each, and each index's pair."""
    order = np.lexsort((np.arange(len(a)), b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d)[:-1] > 0


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() if n != "texts" else c[i].as_buffer() for c, n in zip(columns, names, strict=True))


def mark_repeats(df: DataFrame, scratch: Scratch, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of ``df`` with the answers that ``_removed`` needs."""
    chunks = make_chunks(df, scratch, id_col, text_col, parts_of=SMALLER)
    buckets = max(1, -(-total_bytes(chunks) // PER_BUCKET))

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, texts, n_bytes in _columns(batch, "chunk", "sizes", "texts", "n_bytes"):
                _, _, g = _parsed(chunk_texts(sizes, texts, n_bytes), width)
                keys, _, _ = _triples(g)
                at = bounds_of(keys, buckets)
                full = np.flatnonzero(np.diff(at) > 0)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "keys": pa.array([cut(keys[at[b] : at[b + 1]], 6) for b in full], pa.binary())})

    def twice(_: list[int], rows: list[tuple]) -> list[np.ndarray]:
        keys = joined([r[0] for r in rows], 6)
        _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        return np.split((count[back] > 1).astype(np.uint8), np.cumsum([len(r[0]) // 6 for r in rows])[:-1])

    slim = chunks.select("chunk", "sizes", "texts", "n_bytes")
    repeated = save_answers(ask(slim.mapInArrow(tidy(triples), "bucket int, chunk long, keys binary"), buckets, twice, ["keys"]), scratch, "repeated")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, texts, n_bytes, ids, told in _columns(batch, "chunk", "sizes", "texts", "n_bytes", f"c_{id_col}", "repeated"):
                t = chunk_texts(sizes, texts, n_bytes)
                starts, a, b = _candidates(t, width, told)
                first, _ = _firsts(a, b)
                doc = np.searchsorted(t.at, starts[first], "right") - 1
                rank = np.array([-(2**63) if x is None else x for x in ids], np.int64)[doc]
                keys = a[first]
                at = bounds_of(keys, buckets)
                full = np.flatnonzero(np.diff(at) > 0)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "keys": pa.array([keys[at[x] : at[x + 1]].astype("<u8").tobytes() for x in full], pa.binary()), "more": pa.array([cut(b[first][at[x] : at[x + 1]], 8) for x in full], pa.binary()), "docs": pa.array([np.ascontiguousarray(rank[at[x] : at[x + 1]].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in full], pa.binary())})

    def first_here(chunk: list[int], rows: list[tuple]) -> list[np.ndarray]:
        sizes = [len(r[0]) // 8 for r in rows]
        keys, more = joined([r[0] for r in rows], 8), joined([r[1] for r in rows], 8)
        docs = np.concatenate([np.ascontiguousarray(np.frombuffer(r[2], np.uint8).reshape(8, -1).T).reshape(-1).view("<i8") for r in rows])
        order = np.lexsort((np.repeat(np.argsort(np.argsort(chunk)), sizes), docs, more, keys))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        out = np.zeros(len(keys), np.uint8)
        out[order[new]] = 1
        return np.split(out, np.cumsum(sizes)[:-1])

    asked = with_answers(chunks.select("chunk", "sizes", "texts", "n_bytes", f"c_{id_col}"), repeated, "repeated")
    firsts = save_answers(ask(asked.mapInArrow(tidy(windows), "bucket int, chunk long, keys binary, more binary, docs binary"), buckets, first_here, ["keys", "more", "docs"]), scratch, "firsts")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, texts, n_bytes, told, here in _columns(batch, "chunk", "sizes", "texts", "n_bytes", "repeated", "firsts"):
                t = chunk_texts(sizes, texts, n_bytes)
                starts, a, b = _candidates(t, width, told)
                first, _ = _firsts(a, b)
                again = np.ones(len(starts), bool)
                again[first[read_answers(here) > 0]] = False
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "removed": pa.array([np.packbits(_covered(starts[again], width, len(t.a))).tobytes()], pa.binary())})

    told = with_answers(with_answers(chunks.select("chunk", "sizes", "texts", "n_bytes"), repeated, "repeated"), firsts, "firsts")
    marks = scratch.save_by(told.mapInArrow(tidy(removed), "chunk long, removed binary"), "marks", "chunk")
    scratch.drop("repeated")
    scratch.drop("firsts")
    return chunks.join(marks.hint("shuffle_hash"), "chunk")


def drop_repeats(df: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``df`` with its columns, and n_words, n_removed; the text is the words that stay, joined by a space.

    Ids must be whole numbers (a TypeError otherwise). A word goes when a window of ``width`` consecutive words that covers it has also started earlier: in a smaller id (null is
    smallest), in the same document further left, or, for rows with the same id, in the one that comes first in the input.
    Windows are judged on the input. A text from which nothing goes is left as it is, white space included; a null text stays
    null. Words are never split or folded. With ``digest`` the text column is replaced by kept_sha256, of the words that stay
    joined by a space. Other columns pass through, whatever their names, unless called n_words or n_removed (those are replaced).
    """
    need(df, **{id_col: T.IntegralType})
    scratch = Scratch(df.sparkSession, "substring")
    df = df.drop("n_words", "n_removed")
    marked = mark_repeats(df, scratch, width, id_col, text_col)
    others = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            lists = {c: batch.column(batch.schema.get_field_index(f"c_{c}")) for c in others}
            for i, (sizes, texts, n_bytes, gone) in enumerate(_columns(batch, "sizes", "texts", "n_bytes", "removed")):
                parts = chunk_parts(sizes, texts, n_bytes)
                t = Texts(parts)
                t.words()
                null = np.frombuffer(sizes, "<i8") < 0
                off = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(t.a)).astype(bool)
                n_words = np.diff(t.at)
                total = np.concatenate([[0], np.cumsum(off)])
                n_removed = total[t.at[1:]] - total[t.at[:-1]]
                # Kept words and one space after each, by a mask over the bytes.
                kept = ~off
                size = np.where(kept, t.b - t.a + 1, 0)
                end = np.concatenate([[0], np.cumsum(size)])
                take = np.repeat(t.a - end[:-1], size) + np.arange(end[-1])
                flat = np.where(take == np.repeat(t.b, size), np.uint8(32), t.data[np.minimum(take, max(len(t.data) - 1, 0))]) if end[-1] else np.zeros(0, np.uint8)
                raw = flat.tobytes()
                spans = [raw[end[x] : max(end[y] - 1, end[x])] for x, y in zip(t.at[:-1].tolist(), t.at[1:].tolist(), strict=True)]
                out = {c: v[i].values for c, v in lists.items()}
                if digest:
                    out["kept_sha256"] = pa.array([hashlib.sha256(s).hexdigest() for s in spans])
                else:
                    out[text_col] = pa.array([None if z else (s if r else bytes(p)).decode("utf-8", "replace") for s, r, p, z in zip(spans, n_removed.tolist(), parts, null.tolist(), strict=True)], pa.string())
                out["n_words"], out["n_removed"] = pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "kept_sha256 string" if digest else f"`{text_col}` string", "n_words long", "n_removed long"])
    out = marked.mapInArrow(tidy(run), schema)
    if digest:
        out = scratch.keep(out)
        scratch.drop()
        return out
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "n_words", "n_removed")
