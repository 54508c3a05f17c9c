"""Conversation structure repair on a bidirectional tight-arc DAG.

A node is a place between rows and a state of the roles so far: nothing, system, user, assistant. Arcs keep, rerole or delete the
next row, or insert a row at the place; each has a cost. An arc is tight if the least cost forward to its tail, its cost and the
least cost backward from its head are the least cost in all; the tight arcs are all optimal repairs. From the first node on,
the least letter that leaves the frontier by a tight arc is taken, and the frontier becomes the heads of all such arcs.

Rows are range-partitioned and sorted by conversation and turn, so that a long conversation lies in several partitions, and
packed in blocks of bounded size. A block that holds a whole conversation is solved where it is. For the others a block's
least costs from state to state make a 4 x 4 matrix; scans of these matrices over a conversation's blocks give the costs at the
blocks' ends in both directions, then each block tells in which state it leaves for each in which it may be entered, and a second
scan tells in which it is. Only a conversation's SHA-256 goes through its blocks in order in one task, a block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iqlake.llm.common import Scratch, hottest, need, split_join

#: Rows and bytes of text of a block; they change cost only.
ROWS, BYTES = 4096, 4 << 20
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60
#: States: nothing yet, after system, after user, after assistant. Which state a role leads to from each, None where it may not follow.
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_NEXT, _ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
_ENDS = (0, 3)
_RULED = {"delete": 2, "rerole": 1, "insert": 5, "cut": 5}


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """(letter, state, cost) of the arcs over a row, from each state."""
    out = []
    for state in range(4):
        arcs = [("D", state, _RULED["delete"])]
        if fault in (FINE, TRUNCATED):
            extra = _RULED["cut"] if fault == TRUNCATED else 0
            kept = _KEEP.get(initial, (None,) * 4)[state]
            arcs += [("K", kept, extra)] if kept is not None else []
            arcs.append(("R", _NEXT[state], _RULED["rerole"] + extra))
        out.append(arcs)
    return out


_OVER = {(c, f): _arcs(c, f) for c in "sua-" for f in range(4)}


def _over(role: str, fault: int) -> list[list[tuple[str, int, int]]]:
    return _OVER[role[:1] if role[:1] in _KEEP else "-", fault]


def _inserted(cost: list[int], back: bool = False) -> list[int]:
    """Least costs at one place when rows may be inserted there; more than two never help."""
    for _ in range(2):
        moves = [(y, x) if back else (x, y) for x, y in enumerate(_NEXT)]
        new = list(cost)
        for x, y in moves:
            new[y] = min(new[y], cost[x] + _RULED["insert"])
        cost = new
    return cost


START = _inserted([0, _FAR, _FAR, _FAR])
END = _inserted([0 if s in _ENDS else _FAR for s in range(4)], back=True)


def _forward(rows: list, cost: list[int]) -> list[list[int]]:
    """Least costs to each node, places first to last; ``rows`` are (role, fault)."""
    out = [cost]
    for role, fault in rows:
        new = [_FAR] * 4
        for state, arcs in enumerate(_over(role, fault)):
            for _, to, w in arcs:
                new[to] = min(new[to], cost[state] + w)
        cost = _inserted(new)
        out.append(cost)
    return out


def _backward(rows: list, cost: list[int]) -> list[list[int]]:
    """Least costs from each node on."""
    out = [cost]
    for role, fault in reversed(rows):
        cost = _inserted([min(cost[to] + w for _, to, w in arcs) for arcs in _over(role, fault)], back=True)
        out.append(cost)
    return out[::-1]


def matrix(rows: list) -> list[int]:
    """Least costs from each state at the first place to each at the last, insertions at both included."""
    return [x for s in range(4) for x in _forward(rows, _inserted([0 if s == k else _FAR for k in range(4)]))[-1]]


def walk(rows: list, texts: list[str], ahead: list[list[int]], behind: list[list[int]], state: int, last: bool) -> tuple[str, list[str], int]:
    """Letters, repaired rows and final state of the least optimal repair that enters in ``state``."""
    total = min(a + b for a, b in zip(ahead[0], behind[0], strict=True))
    place, frontier, letters, out = 0, {state}, [], []
    while place < len(rows) or last:
        tight: dict[str, set[int]] = {}
        for x in frontier:
            moves = [("I", _NEXT[x], _RULED["insert"], place)] + ([(a, y, w, place + 1) for a, y, w in _over(*rows[place])[x]] if place < len(rows) else [])
            for letter, y, w, to in moves:
                if ahead[place][x] + w + behind[to][y] == total:
                    tight.setdefault(letter, set()).add(y)
        if not tight:
            break
        letter = min(tight)
        frontier = tight[letter]
        state = min(frontier)
        letters.append(letter)
        if letter == "K":
            out.append(f"{rows[place][0]}:{texts[place]}")
        elif letter == "R":
            out.append(f"{_ROLE[state]}:{texts[place]}")
        elif letter == "I":
            out.append(f"{_ROLE[state]}:")
        place += letter != "I"
    return "".join(letters), out, state


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


BLOCK = "block long, alone boolean, roles array<string>, faults array<int>, texts array<string>, matrix array<long>, counts array<long>, turns array<long>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, conv, turn, role, text, absent, fault) as blocks; the first and last conversation of a partition may go on elsewhere."""
    schema = None
    held: list[dict] = []  # the blocks of the conversation at hand
    now: list = []
    done: list[dict] = []
    size = number = seen = 0
    conv: object = None

    def close() -> dict:
        turns = [t for _, t, _, _, absent, _ in now if t is not None and not absent]
        rows = [(r, f, x) for _, _, r, x, absent, f in now if not absent]
        roles, faults = [r for r, _, _ in rows], [f for _, f, _ in rows]
        pairs = [a[:1] + b[:1] for a, b in zip(roles, roles[1:])]
        counts = [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), sum(p not in ("su", "ua", "au") for p in pairs)]
        return {"conv": conv, "block": (part << 32) + number, "alone": True, "roles": roles, "faults": faults, "texts": [x for _, _, x in rows], "matrix": [], "counts": counts, "turns": [min(turns), max(turns), len(set(turns)), turns[0], turns[-1]] if turns else []}

    def settle(edge: bool) -> None:
        nonlocal held
        if edge or len(held) > 1:
            for b in held:
                b["alone"], b["matrix"] = False, matrix(list(zip(b["roles"], b["faults"], strict=True)))
        done.extend(held)
        held = []

    part = 0
    for batch in batches:
        schema = schema or pa.schema([("conv", batch.schema.field("conv").type), ("block", pa.int64()), ("alone", pa.bool_()), ("roles", pa.list_(pa.string())), ("faults", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), ("matrix", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64()))])
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            part = row[0]
            if now and (row[1] != conv or len(now) >= ROWS or size >= BYTES):
                held.append(close())
                now, size, number = [], 0, number + 1
                if row[1] != conv:
                    settle(edge=seen == 0)
                    seen += 1
            conv = row[1]
            now.append(row[1:])
            size += len(row[4])
        if sum(len(b["roles"]) for b in done) >= ROWS:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now:
        held.append(close())
        settle(edge=True)
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def _result(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv", kind), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, each solved at once."""
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            rows = list(zip(b["roles"], b["faults"], strict=True))
            ahead, behind = _forward(rows, START), _backward(rows, END)
            letters, lines, _ = walk(rows, b["texts"], ahead, behind, 0, True)
            turns = b["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            out.append({"conv": b["conv"], "gaps": gaps, **dict(zip(COUNTS, b["counts"], strict=True)), "cost": behind[0][0], "audit": letters, "repaired_sha256": _sha(lines)})
        yield pa.RecordBatch.from_pylist(out, _result(batch.schema.field("conv").type))


def _scan(table: pa.Table) -> pa.Table:
    """Costs at the ends of one conversation's blocks, and its counts in its first block."""
    blocks = sorted(table.to_pylist(), key=lambda b: b["block"])
    ahead, behind = [START], [END]
    step = lambda m, x, y: m[4 * x + y]
    for b in blocks:
        ahead.append([min(ahead[-1][x] + step(b["matrix"], x, y) for x in range(4)) for y in range(4)])
    for b in reversed(blocks):
        behind.append([min(behind[-1][y] + step(b["matrix"], x, y) for y in range(4)) for x in range(4)])
    behind.reverse()
    sums = [sum(b["counts"][k] for b in blocks) for k in range(len(COUNTS))]
    full = [b for b in blocks if b["ends"]]
    sums[3] += sum(x["ends"][1][:1] + y["ends"][0][:1] not in ("su", "ua", "au") for x, y in zip(full, full[1:]))
    timed = [b["turns"] for b in blocks if b["turns"]]
    gaps = 0
    if timed:
        distinct = sum(t[2] for t in timed) - sum(x[4] == y[3] for x, y in zip(timed, timed[1:]))
        gaps = max(t[1] for t in timed) - min(t[0] for t in timed) + 1 - distinct
    n = len(blocks)
    cols = {"block": [b["block"] for b in blocks], "conv": [b["conv"] for b in blocks], "ahead": ahead[:n], "behind": behind[1:], "last": [k == n - 1 for k in range(n)], "totals": [[gaps, *sums, behind[0][0]]] * n}
    return pa.table(cols, pa.schema([("block", pa.int64()), ("conv", table.schema.field("conv").type), ("ahead", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("last", pa.bool_()), ("totals", pa.list_(pa.int64()))]))


def _solved(b: dict) -> tuple[list, list, list]:
    rows = list(zip(b["roles"], b["faults"], strict=True))
    return rows, _forward(rows, b["ahead"]), _backward(rows, b["behind"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which a block is left, for each in which an optimal repair may enter it."""
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            rows, ahead, behind = _solved(b)
            total = min(x + y for x, y in zip(ahead[0], behind[0], strict=True))
            on = [s for s in range(4) if ahead[0][s] + behind[0][s] == total]
            out.append({"block": b["block"], "exits": [walk(rows, b["texts"], ahead, behind, s, b["last"])[2] if s in on else -1 for s in range(4)]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("exits", pa.list_(pa.int64()))]))


def _entries(table: pa.Table) -> pa.Table:
    blocks = sorted(table.select(["block", "exits"]).to_pylist(), key=lambda b: b["block"])
    state, out = 0, []
    for b in blocks:
        out.append(state)
        state = b["exits"][state]
    return pa.table({"block": [b["block"] for b in blocks], "entry": out}, pa.schema([("block", pa.int64()), ("entry", pa.int64())]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            rows, ahead, behind = _solved(b)
            letters, lines, _ = walk(rows, b["texts"], ahead, behind, b["entry"], b["last"])
            out.append({"conv": b["conv"], "block": b["block"], "letters": letters, "lines": lines, "totals": b["totals"]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", batch.schema.field("conv").type), ("block", pa.int64()), ("letters", pa.string()), ("lines", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation and block as results; texts are hashed as they pass."""
    now: dict | None = None
    digest, first = hashlib.sha256(), True
    letters: list[str] = []
    schema = None

    def end() -> pa.RecordBatch:
        gaps, *counts, cost = now["totals"]
        row = {"conv": now["conv"], "gaps": gaps, **dict(zip(COUNTS, counts, strict=True)), "cost": cost, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        schema = schema or _result(batch.schema.field("conv").type)
        for b in batch.to_pylist():
            if now is not None and now["conv"] != b["conv"]:
                yield end()
                digest, first, letters = hashlib.sha256(), True, []
            now = b
            letters.append(b["letters"])
            for line in b["lines"]:
                digest.update(f"{'' if first else chr(10)}{line}".encode())
                first = False
    if now is not None:
        yield end()


def fault(text: Column, repeated: Column) -> Column:
    """The first fault of a row: blank, duplicate, truncated, or none."""
    bare = F.rtrim(text, F.lit(_SPACE))
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    return F.when(bare == "", F.lit(BLANK)).when(repeated, F.lit(DUPLICATE)).when(cut, F.lit(TRUNCATED)).otherwise(F.lit(FINE))


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """One row for each conversation of ``df``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first; ties by role, the text's first 64 code points, a digest of both; equal rows are adjacent. Null
    texts and roles are one space. A row's first fault counts: blank (only ASCII white space), duplicate (the conversation
    has an earlier row of this role and text), truncated (the last other character is not one of ``.!?``). ``gaps`` is last turn - first turn
    + 1 - distinct turns without nulls, ``illegal`` counts neighbours whose roles' initials are not su, ua or au. ``audit`` has the
    letters of the cheapest edits that make the initials ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1, Delete 2 (the
    only one for blank and duplicate rows), Insert an empty user or assistant row 5; a truncated row that stays adds 5; of equal costs
    the least string. ``repaired_sha256`` is that of the repaired rows, ``role:text`` joined by newlines.
    Rows where the boolean ``absent_col`` holds only make their conversation be listed: without other rows it has zeros, an empty
    audit and the hash of the empty string. Rows with a null id are one conversation; repeated rows are rows of their own. An
    empty table gives an empty result. Other columns are not read.
    """
    need(df, **{turn_col: T.IntegralType, role_col: T.StringType, text_col: T.StringType})
    spark = df.sparkSession
    scratch = Scratch(spark, "repair")
    kind = df.schema[conv_col].dataType.simpleString()
    absent = F.coalesce(F.col(f"`{absent_col}`"), F.lit(False)) if absent_col else F.lit(False)
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"), absent.alias("absent"), F.monotonically_increasing_id().alias("uid"))
    name = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("null")), F.length("role").cast("string"), "role", "text", F.col("absent").cast("string"))
    rows = scratch.save(rows.withColumn("d", F.unhex(F.md5(name.cast("binary")))), "rows")
    # Equal rows of one conversation: all but the first are duplicates. Only keys that repeat are joined, frequent ones by broadcast.
    repeats = rows.groupBy("d").agg(F.min(F.struct("turn", "uid")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    repeats = scratch.save(repeats.select("d", F.col("f.uid").alias("first"), "c"), "repeats")
    rows = split_join(rows, repeats.select("d", "first"), "d", "left", hot=hottest(repeats, "d", "c"))
    rows = rows.withColumn("fault", fault(F.col("text"), F.coalesce(F.col("first") != F.col("uid"), F.lit(False)))).withColumn("head", F.substring("text", 1, 64))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "d", "uid"]
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(number, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("part"), "conv", "turn", "role", "text", "absent", "fault")
    blocks = scratch.save(dealt.mapInArrow(_blocks, f"conv {kind}, {BLOCK}"), "blocks")
    scratch.only("blocks")

    result = f"conv {kind}, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string, repaired_sha256 string"
    whole = blocks.filter("alone").mapInArrow(_alone, result)
    several = blocks.filter("not alone")
    ends = F.when(F.size("roles") > 0, F.array(F.element_at("roles", 1), F.element_at("roles", -1)))
    light = several.select("conv", "block", "matrix", "counts", "turns", ends.alias("ends"))
    costs = light.groupBy("conv").applyInArrow(_scan, f"block long, conv {kind}, ahead array<long>, behind array<long>, last boolean, totals array<long>")
    costs = scratch.save(costs, "costs")
    heavy = several.select("block", "roles", "faults", "texts").join(costs, "block")
    exits = scratch.save(heavy.mapInArrow(_exits, "block long, exits array<long>"), "exits")
    entries = exits.join(costs.select("block", "conv"), "block").groupBy("conv").applyInArrow(_entries, "block long, entry long")
    entries = scratch.save(entries, "entries")
    pieces = heavy.join(entries, "block").mapInArrow(_pieces, f"conv {kind}, block long, letters string, lines array<string>, totals array<long>")
    spanning = pieces.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_joined, result)
    out = scratch.keep(whole.unionByName(spanning).withColumnRenamed("conv", conv_col))
    scratch.drop()
    return out


def damage(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text; nulls count as one space) with rows damaged by the CRC-32 of conv_id:turn modulo 20.

    0 makes a row absent, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("absent"), F.explode(times).alias("copy")).drop("copy")
