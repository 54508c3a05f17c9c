"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` points of the ring, each point the arc that ends in it. A row goes to the arc that holds the
hash of its text, so that equal texts lie together, and belongs to the arc's shard; where that shard is full, the rows past
its bound continue clockwise to the next shard with room. The bounds add up to the number of rows and differ by at most one,
so every shard ends at its bound: balance is guaranteed. A shard that joins takes its share; besides, rows between old shards
move only where bounds force an overflow, which many virtual nodes keep small.

The walk is planned on the counts of the arcs (shards x vnodes numbers, whatever the input). Rows then find their shard and
slot by their rank within the arc, dealt over sub-buckets so that no arc lands in one task. Equal texts have consecutive ranks,
so only a text at the very bound of a shard, or with more rows than the shard has room for, is split.
"""

from __future__ import annotations

import bisect
import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iqlake.llm.common import Scratch, dense_ranks

#: Cells of the table that finds arcs; points in a cell are searched one by one, so their number limits nothing.
CELLS, VNODES = 1 << 16, 256


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) of each virtual node, ascending 64-bit points; a shard's points depend on its number only."""
    points: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
            if points.setdefault(at, s) != s:
                raise ValueError("two shards share a point")
    return sorted(points.items())


def _arcs(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """(cell, next, inside): the first arc that ends after the cell, and the points in it (the low 48 bits, arc)."""
    ends = [p for p, _ in points]
    inside: list[list[tuple[int, int]]] = [[] for _ in range(CELLS)]
    for arc, p in enumerate(ends):
        inside[p >> 48].append((p & ((1 << 48) - 1), arc))
    # Past the last point the ring closes.
    after = [bisect.bisect_left(ends, (c + 1) << 48) % len(ends) for c in range(CELLS)]
    return spark.createDataFrame(pd.DataFrame({"cell": range(CELLS), "next": after, "inside": inside}), "cell int, next int, inside array<struct<low: long, arc: int>>")


def plan(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, low, high, shard, first slot): rows of ``arc`` with low <= rank < high take these slots in order.

    Round 0 fills shards from their own arcs, in ring order; what overflows moves on to the next arc's shard, round by round.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out = [0] * shards, []
    waiting = [(arc, 0, counts.get(arc, 0)) for arc in range(len(points)) if counts.get(arc, 0)]
    for step in range(len(points)):
        left = []
        for arc, low, high in waiting:
            s = points[(arc + step) % len(points)][1]
            take = min(high - low, room[s] - used[s])
            if take:
                out.append((arc, low, low + take, s, used[s]))
                used[s] += take
            if low + take < high:
                left.append((arc, low + take, high))
        waiting = left
        if not waiting:
            break
    # A shard whose points were all shared has no arc of its own: it takes what is left.
    for arc, low, high in waiting:
        for s in range(shards):
            take = min(high - low, room[s] - used[s])
            if take:
                out.append((arc, low, low + take, s, used[s]))
                used[s] += take
                low += take
    return out


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, vnodes: int = VNODES) -> DataFrame:
    """One row for each row of ``df``: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text and ``overhead``; a null text counts as none. The law is ``rows``: the shards' row
    counts differ by at most one, slots are gapless from 0, grown_shard is null. Equal texts stay together except where a
    full shard splits them; texts of any length count by their hash. Null ids and repeated rows are rows like any other. Other
    columns are not read.
    """
    spark = df.sparkSession
    points = ring(shards, vnodes)
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # A key belongs to the first point at or after its hash.
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 48).cast("int")).join(F.broadcast(_arcs(spark, points)), "cell")
    low = F.col("h").bitwiseAND(F.lit((1 << 48) - 1))
    rows = rows.withColumn("arc", F.coalesce(F.get(F.filter("inside", lambda p: p["low"] >= low), F.lit(0))["arc"], F.col("next"))).drop("cell", "next", "inside")
    rows = scratch.save(rows, "rows")
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans = plan(points, counts, shards)
    steps = spark.createDataFrame(pd.DataFrame(spans, columns=["arc", "low", "high", "shard", "base"]), "arc int, low long, high long, shard int, base long")
    per_arc = steps.groupBy("arc").agg(F.collect_list(F.struct("low", "high", "shard", "base")).alias("steps"))
    placed = dense_ranks(rows, ["arc"], ["h", "id"], together="h").join(F.broadcast(per_arc), "arc")
    step = F.filter("steps", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    placed = placed.withColumn("s", step)
    out = placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("s.shard").alias("shard"), (F.col("s.base") + F.col("rank") - F.col("s.low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out = scratch.keep(out)
    scratch.drop()
    return out
