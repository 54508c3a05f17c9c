"""Exact dedup, sharding and packing on small fixtures against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from iqlake.llm import exact_dedup, packing, sharding, textcore, tokens
from iqlake.llm.common import dense_ranks

PATH = public_tokenizers.path("word_bpe_49k.json")
#: This word and its complement are equal under any polynomial modulo 2 ** 64.
THUE = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
ODD = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (5, "A b"), (5, "A b"), (None, "a b"), (None, None), (6, " a b"), (7, "é\x1c x"), (8, "word " * 9000), (9, "hot"), (10, "hot"), (11, "<|endoftext|> x"), (12, "It's é 2024 Oİ"), (13, THUE + " " + THUE.translate({97: 98, 98: 97}))]


def test_exact_dedup(docs):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs(ODD + [(100 + i, "copy") for i in range(300)]), heavy=2, counters=16).collect()]
    pairs = ODD + [(100 + i, "copy") for i in range(300)]
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    want = []
    for i, t in pairs:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drop_copies_keeps_columns(docs):
    d = docs(ODD)
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([3, 4, 5, 5, 6, 7, 8, 10, 11, 12, 13])


def test_drop_copies_judges_rows(docs):
    """Repeated and null ids that hold different texts."""
    d = docs([(1, "a"), (1, "b"), (2, "b"), (None, "b"), (None, "c"), (3, "hot"), (2, "hot"), (2, "a")])
    assert Counter((r.doc_id, r.text) for r in exact_dedup.drop_copies(d, heavy=1).collect()) == Counter([(2, "b"), (None, "c"), (3, "hot"), (2, "a")])


@pytest.mark.parametrize("op", [lambda d: exact_dedup.exact_dedup(d), lambda d: sharding.shard(d, 4), lambda d: packing.pack(d, PATH)])
def test_empty(docs, op):
    assert op(docs([])).count() == 0


def ring_walk(pairs, shards):
    """Rows one by one in the planned order: each goes clockwise to the first shard with room."""
    points = sharding.ring(shards)
    owners = [s for _, s in points]
    total = sum(n for _, n in pairs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    where = defaultdict(Counter)
    waiting = dict(pairs)
    for step in range(len(points)):
        for arc in sorted(waiting):
            s = owners[(arc + step) % len(points)]
            while waiting[arc] and room[s]:
                waiting[arc] -= 1
                room[s] -= 1
                where[arc][s] += 1
    return where, room


def test_ring_plan_is_the_walk():
    counts = {0: 50, 3: 1, 7: 200, 11: 4}
    points = sharding.ring(5)
    got = defaultdict(Counter)
    for arc, low, high, s, _ in sharding.plan(points, counts, 5):
        got[arc][s] += high - low
    want, room = ring_walk(list(counts.items()), 5)
    assert got == want and not any(room)


def test_shard_rows(docs):
    pairs = [(i, f"text {i % 50}") for i in range(300)] + [(1000 + i, "hot") for i in range(150)] + [(5000, None), (5000, None), (None, "x")]
    rows = sharding.shard(docs(pairs), 7).collect()
    per = Counter(r.shard for r in rows)
    assert len(rows) == len(pairs) and set(per) == set(range(7)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs), key=str)


def test_equal_texts_stay_together(docs):
    """A text is split only at a shard's bound, or by its own number."""
    pairs = [(i, f"text {i % 60}") for i in range(900)] + [(5000, "long " * 100_000), (5001, "long " * 100_000)]
    rows = sharding.shard(docs(pairs), 7).select("shard", "text_crc32").collect()
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert sum(len(x) - 1 for x in where.values()) <= 2 * 7


def test_ranks_keep_values_together(spark):
    """Also where one value has more rows than a sub-bucket holds."""
    rows = [(k % 2, k % 14, k) for k in range(700)] + [(0, 2, 1000 + k) for k in range(400)]
    df = spark.createDataFrame(rows, "key int, h long, id long").repartition(4).checkpoint()
    got = dense_ranks(df, ["key"], ["h", "id"], 50, together="h").collect()
    for key in (0, 1):
        of = sorted((r["rank"], r.h) for r in got if r.key == key)
        assert [r for r, _ in of] == list(range(len(of)))
        assert sum(a[1] != b[1] for a, b in zip(of, of[1:])) == 6


def test_ring_moves_little():
    """One more shard: of keys spread evenly, only those that it takes move."""

    def owner(n):
        ends = sharding.ring(n)
        return [next((s for c, s in ends if c >= k), ends[0][1]) for k in range(0, 1 << 64, 1 << 54)]

    a, b = owner(10), owner(11)
    moved = [(x, y) for x, y in zip(a, b) if x != y]
    assert all(y == 10 for _, y in moved) and len(moved) < 0.15 * len(a)


def test_rows_move_little(docs):
    """Rows that a new shard does not take move only where bounds overflow."""
    pairs = [(i, f"text number {i}") for i in range(4000)]
    a, b = ({r.doc_id: r.shard for r in sharding.shard(docs(pairs), n).collect()} for n in (10, 11))
    moved = [(a[k], b[k]) for k in a if a[k] != b[k]]
    assert sum(y == 10 for _, y in moved) <= 4000 / 11 + 1
    assert sum(y != 10 for _, y in moved) < 0.08 * 4000


def test_packing_is_lossless_and_tight(docs):
    rng = np.random.default_rng(3)
    pairs = ODD + [(100 + i, " ".join(["tok"] * int(rng.integers(0, 90)))) for i in range(400)] + [(1000 + i, "same words here") for i in range(200)]
    most = 64
    rows = packing.pack(docs(pairs), PATH, most, with_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    lengths = []
    for i, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), most):
            part = np.asarray(ids[p : p + most], "<u4").tobytes()
            want[(i, p // most, p, len(part) // 4, zlib.crc32(part))] += 1
            lengths.append(len(part) // 4)
    distinct = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in rows]
    assert Counter(x[:5] for x in distinct) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    bins = defaultdict(list)
    for x in distinct:
        bins[x[5]].append((x[6], x[3]))
    for spans in bins.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= most
    assert len(bins) == brute_best_fit(lengths, most)


def brute_best_fit(lengths, most):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(most - n)
    return len(rooms)


def test_words_of_one_fingerprint(monkeypatch):
    """Ids do not depend on fingerprints of words over eight bytes, however often they collide."""
    real = textcore.spans_hash

    def colliding(data, a, b):
        out = real(data, a, b)
        return np.where(b - a > 8, out % np.uint64(7), out)

    monkeypatch.setattr(textcore, "spans_hash", colliding)
    encoder = tokens.WordEncoder(PATH)
    tok = Tokenizer.from_file(PATH)
    words = [f"{x}{y}" for x in ("international", "misunderstand", "straightforward") for y in ("", "s", "ing", "ation", "ly", "ed")]
    for texts in ([" ".join([*words, "one", "two", *words[::-1]]), "four five"], ["internationals one seven eight straightforwardly", ""]):
        flat, at = encoder.encode([t.encode() for t in texts])
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_short_spans_have_fingerprints_of_their_own():
    """The finaliser is one to one: spans of one length up to eight bytes have different fingerprints."""
    rng = np.random.default_rng(5)
    for n in range(1, 9):
        spans = np.unique(rng.integers(0, 256, (20_000, n), np.uint8), axis=0)
        data = spans.reshape(-1)
        a = np.arange(len(spans)) * n
        assert len(np.unique(textcore.spans_hash(data, a, a + n))) == len(spans)
