"""The relational lattice against the SentencePiece library and, for Viterbi, against all paths."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from iqlake.llm import chunks, pieces

def thue_morse(n):
    """A word and its complement: equal under any polynomial modulo 2 ** 64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PATH = public_tokenizers.path("piece_bpe_32k.model")


def corpus():
    rng = random.Random(2)
    words = ["Hello", "world", "the", "thnding", "eauouon", "ciónée", "日本語", "zzzz", "a", "1999", "naïve,", "x" * 70, "ab" * 60, "é", "😀", "unbelievably", "ha▁ha", "\x00", "__", "<s>", "<0x41>"]
    texts = ["", " ", "  a  b ", "\n", "a\nb\t c", "▁x", "tail   ", "z" * 3000, "word " * 5000, " ".join(thue_morse(1024)), "".join(rng.choice("abehinorst") for _ in range(10_000)), "ab" * 5000, " " * 700 + "x"] + ["".join(w + rng.choice([" ", "  ", "\n", " \n ", "\t", ""]) for w in rng.choices(words, k=rng.randint(1, 40))) for _ in range(150)]
    return list(enumerate(texts)) + [(900, None), (None, "null id"), (3, "\n")]


def test_against_the_library(docs, monkeypatch):
    monkeypatch.setattr(chunks.make_chunks, "__defaults__", (5000,))
    monkeypatch.setattr(pieces, "PER_BUCKET", 20000)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pairs = corpus()
    out = pieces.encode(docs(pairs), PATH)
    back = pieces.decode(out, PATH)
    got = sorted(((r.doc_id, tuple(r.ids), r.n_pieces, r.lossless, r.decoded) for r in back.collect()), key=str)
    want = sorted(((i, tuple(e := sp.encode(t or "")), len(e), "▁" not in (t or ""), (t or "").replace("▁", " ")) for i, t in pairs), key=str)
    assert got == want
    crc = sorted(((r.doc_id, r.ids_crc32) for r in pieces.encode(docs(pairs), PATH, digest=True).collect()), key=str)
    assert crc == sorted(((i, zlib.crc32(np.asarray(e, "<u4").tobytes())) for i, e, *_ in want), key=str)
    assert pieces.encode(docs([]), PATH).count() == 0


def spelled(part, model, plain):
    return [plain[part]] if part in plain else [model.unknown]


def best_path(unit, model):
    """Every segmentation, one by one."""
    plain, worst = model.plain(), min(model.scores) - 10
    done = [(0.0, [])] if not unit else []
    for k in range(1, len(unit) + 1):
        head = unit[:k]
        if head in plain or k == 1:
            s, rest = best_path(unit[k:], model)
            done.append((s + (model.scores[plain[head]] if head in plain else worst), spelled(head, model, plain) + rest))
    return max(done, key=lambda x: x[0])


def table_path(unit, model):
    """The best path by a table of boundaries, for units with too many segmentations."""
    plain, worst = model.plain(), min(model.scores) - 10
    best = [(0.0, [])] + [(-math.inf, [])] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(max(0, j - 8), j):
            head = unit[i:j]
            if (head in plain or j == i + 1) and best[i][0] + (s := model.scores[plain[head]] if head in plain else worst) > best[j][0]:
                best[j] = (best[i][0] + s, best[i][1] + spelled(head, model, plain))
    return best[-1][1]


def test_viterbi(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("▁abc", k=rng.randint(1, 4))).lstrip() for _ in range(40)} | {"a", "b"})
    model = pieces.Model(["<unk>", *names], [0.0, *[-rng.random() * 9 for _ in names]], [2, *[1] * len(names)], False)
    units = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(60)})
    long = ["".join(rng.choices("abcd", k=n)) for n in (90, 700)]
    df = spark.createDataFrame([(u,) for u in units + long], "unit string")
    got = {r.unit: list(r.ids) for r in pieces.lattice_ids(df, model).collect()}
    assert all(got[u] == best_path(u, model)[1] for u in units)
    assert all(got[u] == table_path(u, model) for u in long)


def test_merges_out_of_order_are_refused():
    model = pieces.Model(["a", "b", "c", "ab", "abc"], [0.0, 0.0, 0.0, -9.0, -3.0], [1] * 5, True)
    with pytest.raises(ValueError):
        pieces.spines(model)


def test_units_cover_the_text():
    alphabet = pieces.Alphabet(pieces.Model([" a", "▁b", "▁▁▁x"], [0.0] * 3, [1] * 3, True))
    u = pieces.Units([b"a b\nc", b"", b"  x"], alphabet)
    assert [u.t.raw[a:b] for a, b in zip(u.a, u.b)] == [b" a", b" b", b"\n", b"c", b"   x"] and u.at.tolist() == [0, 4, 4, 5]


def test_no_shuffle_between_explode_and_fold(spark):
    units = spark.createDataFrame([("▁a",)], "unit string").repartition(3, "unit")
    plan = pieces.lattice_ids(units, pieces.Model.load(PATH))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
