"""Token ids of documents by a public word tokenizer, encoded once per distinct word.

The tokenizer's normaliser (NFC, white space to a space, lower case) and its pre-tokenizer never look across white space,
so a text's ids are the concatenation of its words' ids. A chunk of text is split into words by vectorised fingerprints;
only words that the worker has not met are handed to the tokenizer, and known ones are compared byte for byte. A text that holds one of the tokenizer's special strings
is encoded as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from iqlake.llm.textcore import Texts, distinct, ragged, slices, spans_differ

#: Words kept by a worker, some 100 bytes each; beyond it the memory starts anew, which costs time only.
KEEP_WORDS = 1_000_000
#: Words that the tokenizer gets at a time: it holds a string for each token.
AT_ONCE = 1 << 15


class WordEncoder:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id, added = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark = added.content
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # ascending
        self.lo, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        #: Where each known word's bytes are.
        self.a, self.b = np.empty(0, np.int64), np.empty(0, np.int64)
        self.text, self.n_text = np.empty(1 << 20, np.uint8), 0
        #: All ids met; the first is that of the close.
        self.ids, self.n_ids = np.zeros(1 << 20, np.uint32), 1

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Stores the ids of ``words``: where they begin, and how many. One text, a special token between words, is much cheaper than many texts."""
        if len(words) > AT_ONCE:
            got = [self._ids(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)]
            return np.concatenate([lo for lo, _ in got]), np.concatenate([size for _, size in got])
        flat = np.asarray(self.tokenizer.encode_batch_fast([self.mark.join(w.decode("utf-8", "replace") for w in words)], add_special_tokens=False)[0].ids, np.uint32)
        is_mark = flat == self.mark_id
        cuts = np.concatenate([[-1], np.flatnonzero(is_mark), [len(flat)]])
        if len(cuts) != len(words) + 1:
            raise ValueError("a word holds a special token")
        size = np.diff(cuts) - 1
        got = flat[~is_mark]
        if self.n_ids + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids) + len(got), np.uint32)])
        self.ids[self.n_ids : self.n_ids + len(got)] = got
        lo = self.n_ids + np.cumsum(size) - size
        self.n_ids += len(got)
        return lo, size

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        lo, size = self._ids(words)
        end = self.n_text + np.cumsum([len(w) for w in words])
        if end[-1] > len(self.text):
            self.text = np.concatenate([self.text[: self.n_text], np.empty(2 * int(end[-1]) - self.n_text, np.uint8)])
        self.text[self.n_text : end[-1]] = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[self.n_text], end[:-1]])
        self.n_text = int(end[-1])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.lo, self.size, self.a, self.b = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.lo, lo), (self.size, size), (self.a, begin), (self.b, end)))

    def encode(self, parts: list, close: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by ``close``, and where each text begins (and the end)."""
        if len(self.keys) > KEEP_WORDS:
            self._clear()
        raw = None
        whole: list[int] = []
        t = Texts(parts)
        if any(s in t.raw for s in self.special):
            raw = parts
            whole = [i for i in range(len(parts)) if any(s in t.raw[t.starts[i] : t.starts[i + 1]] for s in self.special)]
            t = Texts([b"" if i in set(whole) else p for i, p in enumerate(parts)])
        t.words()
        keys, where, back = distinct(t.data, t.a, t.b)
        a, b = t.a[where], t.b[where]
        # Words of one fingerprint that are not the same come last; they are never learnt.
        twin = np.arange(len(keys)) >= len(np.unique(keys))
        slot = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(~twin & (self.keys[np.minimum(slot, len(self.keys) - 1)] != keys)) if len(self.keys) else np.flatnonzero(~twin)
        if len(new):
            self._learn([t.raw[x:y] for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)], keys[new])
            slot = np.searchsorted(self.keys, keys)
        lo, size = self.lo[slot], self.size[slot]
        # A known fingerprint is taken at its word only if the bytes are those that were learnt.
        odd = np.flatnonzero(twin | spans_differ(t.data, a, b, self.text[: self.n_text], self.a[slot], self.b[slot]))
        if len(odd):
            lo[odd], size[odd] = self._ids([t.raw[x:y] for x, y in zip(a[odd].tolist(), b[odd].tolist(), strict=True)])
        word_lo, word_n = lo[back], size[back]
        n_words = np.diff(t.at)
        if close is not None:
            # One more "word" after each document.
            self.ids[0] = close
            word_lo = np.insert(word_lo, t.at[1:], 0)
            word_n = np.insert(word_n, t.at[1:], 1)
            n_words = n_words + 1
        total = np.concatenate([[0], np.cumsum(word_n)])
        flat = self.ids[ragged(word_lo, word_n)]
        starts = total[np.concatenate([[0], np.cumsum(n_words)])]
        if whole:
            pieces = [flat[starts[i] : starts[i + 1]] for i in range(len(parts))]
            for i in whole:
                ids = self.tokenizer.encode(bytes(raw[i]).decode("utf-8", "replace"), add_special_tokens=False).ids
                pieces[i] = np.asarray(ids + ([] if close is None else [close]), np.uint32)
            flat, starts = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return flat, starts


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder: the tasks that a worker runs one after another share the words that it has met."""
    return WordEncoder(path)


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(path: str, most: int, id_col: str, text_col: str, with_ids: bool = False):  # noqa: ANN201
    """For ``mapInArrow``: the pieces of each document, at most ``most`` ids each, with their ids as bytes if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch, parts in slices(batches, text_col):
            flat, starts = encoder.encode(parts)
            flat = flat.astype("<u4")
            raw = memoryview(flat.tobytes())
            n = -(-np.diff(starts) // most)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
            start = piece * most
            length = np.minimum(most, np.diff(starts)[doc] - start)
            lo = starts[:-1][doc] + start
            spans = [raw[4 * a : 4 * (a + k)] for a, k in zip(lo.tolist(), length.tolist(), strict=True)]
            out = {"id": batch.column(batch.schema.get_field_index(id_col)).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(s) for s in spans], pa.int64())}
            if with_ids:
                out["ids"] = pa.array([bytes(s) for s in spans], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run
