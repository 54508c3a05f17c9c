"""Vectorised text kernels over UTF-8 buffers: word bounds and 64-bit fingerprints without one Python object per word.

A batch is the concatenation of its documents, each closed by a newline, with ``starts`` of documents in bytes. Words are
maximal runs of bytes other than 0x20 and 0x09-0x0D, which never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: An odd base congruent to 3 modulo 8, for windows of words.
_BASE = int(_rng.integers(1, 2**60)) * 8 + 3
_M = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words handled at a time by windows_hash.
BLOCK = 1 << 20
#: Spans of more bytes are hashed one by one with BLAKE2b.
LONG_SPAN = 512
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [_M], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    if n > 1:
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


_POW, _IPOW = _powers(_BASE, BLOCK + 1), _powers(_INV, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number, zeros past its end."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))


def spans_hash(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprints of data[a:b]; equal bytes give equal values.

    Eight bytes at a time go through a finaliser that is one to one, so spans of one length up to eight bytes never collide
    and longer ones have no structure that could make them; those over ``LONG_SPAN`` go through BLAKE2b.
    """
    n = (b - a).astype(np.int64)
    out = mix(n.astype(np.uint64) + U(0x9E3779B97F4A7C15))
    left, at, now = n, a.astype(np.int64), np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    if len(now):
        word = eights(data)
        left, at = left[now], at[now]
        while len(now):
            out[now] = mix((out[now] ^ (word[at] & _HEAD[np.minimum(left, 8)])) * U(0xD6E8FEB86659FD93) + U(0xA5A3564E2D8F1C37))
            more = left > 8
            now, left, at = now[more], left[more] - 8, at[more] + 8
    for k in np.flatnonzero(n > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[a[k] : b[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def spans_differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, other: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Where data[a:b] is not other[c:d], given that their fingerprints are equal.

    Byte for byte, but that spans of one length up to eight bytes are equal if their fingerprints are.
    """
    out = (b - a) != (d - c)
    now = np.flatnonzero(~out & (b - a > 8))
    if len(now):
        one, two = eights(data), eights(other)
        left, x, y = (b - a)[now].astype(np.int64), a[now].astype(np.int64), c[now].astype(np.int64)
        while len(now):
            bad = ((one[x] ^ two[y]) & _HEAD[np.minimum(left, 8)]) != 0
            out[now[bad]] = True
            more = (left > 8) & ~bad
            now, left, x, y = now[more], left[more] - 8, x[more] + 8, y[more] + 8
    return out


def distinct(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different spans by ascending fingerprint: their fingerprints, one place each, and for each span its number among them.

    Spans are compared byte for byte, so two texts of one fingerprint stay apart (the later ones come at the end).
    """
    code, seen = pd.factorize(spans_hash(data, a, b))
    # Codes count up as they are first met.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
    order = np.argsort(seen)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    keys, first, back = seen[order], first[order], rank[code]
    bad = np.flatnonzero(spans_differ(data, a, b, data, a[first][back], b[first][back]))
    if len(bad):
        extra: dict[bytes, int] = {}
        for k in bad.tolist():
            back[k] = extra.setdefault(data[a[k] : b[k]].tobytes(), len(first) + len(extra))
        of = np.unique(back[bad], return_index=True)[1]
        keys, first = np.concatenate([keys, spans_hash(data, a[bad[of]], b[bad[of]])]), np.concatenate([first, bad[of]])
    return keys, first, back


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``."""
    flag = np.empty(len(data) + 2, bool)
    flag[0] = flag[-1] = True
    flag[1:-1] = _SPACE[data]
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    return edge[::2], edge[1::2]


class Texts:
    """Some documents as one buffer."""

    def __init__(self, parts: list[bytes | memoryview]) -> None:
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.raw = b"\n".join(parts) + b"\n" if parts else b""
        self.data = np.frombuffer(self.raw, np.uint8)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def words(self) -> None:
        """Sets a, b (bounds of words) and at (the first word of each document, and the end)."""
        self.a, self.b = word_bounds(self.data)
        self.at = np.searchsorted(self.a, self.starts)

    def lower_ascii(self) -> None:
        d = self.data
        self.data = np.where((d >= 65) & (d <= 90), d + np.uint8(32), d)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.a, self.b)


def windows_hash(h: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """Fingerprints of every ``width`` consecutive values of ``h``, order included; another ``base`` gives independent ones."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = (_BASE if not base else base * 8 + 3) & _M
    pw, ip = (_POW, _IPOW) if not base and len(h) <= BLOCK else (_powers(odd, len(h)), _powers(pow(odd, -1, 1 << 64), len(h)))
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * pw[: len(h)], out=acc[1:])
    return mix((acc[width:] - acc[:n]) * ip[:n])


def window_docs(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents whose words begin at ``at``: the starts of windows that lie in one document, and their documents."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(n)])[:-1], n)
    return first + np.arange(len(doc)), doc


def ragged(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices lo[0] .. lo[0] + size[0] - 1, lo[1] .., one after another."""
    end = np.cumsum(size)
    return np.repeat(lo - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def blob(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each value of a string or binary column; null gives none."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return []
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    bad = np.zeros(len(column), bool) if column.null_count == 0 else np.asarray(column.is_null())
    return [view[0:0] if bad[i] else view[off[i] : off[i + 1]] for i in range(len(column))]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[memoryview]]]:
    """Batches cut to about ``most`` bytes of text; a longer text comes alone."""
    for batch in batches:
        parts = blob(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= most):
                size += len(parts[j])
                j += 1
            yield batch.slice(i, j - i), parts[i:j]
            i = j


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow``; when a task ends, the memory that it has freed goes back to the system.

    A worker lives on after its task, and allocators would keep what the task needed at its height.
    """

    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no such call
        ctypes.CDLL(None).malloc_trim(0)
