"""Conversation repair against a plain search over (cost, letters), and damage against zlib."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from iqlake.llm import repair as R
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, absent boolean, block int, d string, uid string, conv string"
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    df = spark.createDataFrame([(*r, *([False] if len(r) == 4 else []), 1, "x", "y", "z") for r in rows], SCHEMA)
    return df.repartition(3) if rows else df


def cheapest(rows):
    """Least (cost, letters, lines) for the rows (role, text, fault): all edits at each place, insertions first."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    role_of = {"u": "user", "a": "assistant"}

    def insert(nodes):
        for _ in range(3):
            for state, (c, a, t) in list(nodes.items()):
                to = follow[state]
                new = (c + 5, a + "I", [*t, f"{role_of[to]}:"])
                nodes[to] = min(nodes.get(to, new), new, key=lambda x: x[:2])
        return nodes

    nodes = insert({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def put(state, *new):
            after[state] = min(after.get(state, new), new, key=lambda x: x[:2])

        for state, (c, a, t) in nodes.items():
            put(state, c + 2, a + "D", t)
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                to = follow[state]
                put(to, c + 1 + extra, a + "R", [*t, f"{role_of[to]}:{text}"])
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    put(role[0], c + extra, a + "K", [*t, f"{role}:{text}"])
        nodes = insert(after)
    return min((nodes[s] for s in ("", "a") if s in nodes), key=lambda x: x[:2])


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *absent in rows:
        convs[conv] += [] if absent and absent[0] else [(turn, role if role is not None else " ", text if text is not None else " ")]
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in turns:
            bare = text.rstrip(SPACE)
            marked.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        cost, letters, lines = cheapest(marked)
        known = [t for t, _, _ in turns if t is not None]
        kinds = Counter(f for _, _, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def repaired(spark, rows, parts=None):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts or before)
    try:
        got = R.repair(table(spark, rows), absent_col="absent")
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return Counter(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def talk(rng, conv, n, start=0):
    texts = ["Yes.", "no", " \t", "", "Why?\n", "Right!  ", "é.", "x" * 30, "z.\x0b", "a\nb."]
    roles = ["user", "assistant", "user", "assistant", "system", "s", "tool", "", "Assistant"]
    return [(conv, start + k, rng.choice(roles[:4] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"turn {k} of {conv}{rng.choice('.!?,')}") for k in range(n) if rng.random() > 0.05]


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randint(1, 9))]
    assert repaired(spark, rows) == brute(rows)


def test_long_conversations_span_partitions(spark):
    """Conversations over many partitions, and one of more rows than a block holds."""
    rng = random.Random(4)
    rows = [r for conv, n in ((1, 3), (2, 700), (3, 2), (4, 5000), (5, 1), (6, 400)) for r in talk(rng, conv, n)]
    want = brute(rows)
    assert repaired(spark, rows) == want
    assert repaired(spark, rows, parts="23") == want


def test_nulls_repeats_and_absent_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, "user", "Hm."), (7, None, "user", "One."), (7, None, "user", "One."), (7, 3, "assistant", "Two."),
        (8, 1, "user", "gone.", True), (9, 1, "user", "x" * 200_000 + "."), (9, 1, "assistant", "y" * 200_000 + "!"), (10, 5, "assistant", "A."), (11, 2, "system", "S."), (12, -4, "user", "Q?"), (12, 9, "assistant", "A."),
    ]
    rows += [(13, 4, "user", "Same.")] * 50
    assert repaired(spark, rows) == brute(rows)


def test_empty(spark):
    assert repaired(spark, []) == Counter()


def test_damage(spark):
    rows = [(c, t if t != 6 else None, "assistant" if t % 2 else "user", f"Say. {c}! {t}?" if t != 5 else None) for c in range(20) for t in range(8)]
    want = []
    for c, t, role, text in rows:
        text = " " if text is None else text
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        new = (c, t, "user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text, kind == 0)
        want += [new] * (1 + (kind == 3))
    got = R.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(map(tuple, got.select("conv_id", "turn", "role", "text", F.col("absent")).collect())) == Counter(want)
