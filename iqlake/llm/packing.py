"""Best-fit packing planned on the histogram of lengths.

Only the counts of lengths 1 to ``most`` reach the driver, so the plan is as small for a trillion documents as for ten.
Best-fit decreasing runs over counts: bins of one content are one class, a length's items go to the class with the least
room that still holds them, many at a time. The plan is a list of segments; a piece takes the slot of its rank within its
length, found by a join on that rank.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.llm.common import Scratch, dense_ranks
from iqlake.llm.textcore import tidy
from iqlake.llm.tokens import PIECES, pieces_of

MOST = 2048


def plan(counts: dict[int, int], most: int = MOST) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, low, high, first sequence, per sequence, first offset).

    Items of ``length`` with low <= rank < high fill consecutive sequences, ``per sequence`` in each, from ``first offset``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (first, number)
    rooms: list[int] = []
    out, fresh = [], 0

    def put(left: int, first: int, number: int) -> None:
        if left and number:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, number))

    for length in sorted((k for k, c in counts.items() if c), reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                first, number = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(i)
            else:
                left, first, number = most, fresh, -(-(end - rank) // (most // length))
                fresh += number
            each = left // length
            full = min(number, (end - rank) // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, most - left))
                rank += full * each
                put(left - each * length, first, full)
            if full < number and rank < end:
                some = min(each, end - rank)
                out.append((length, rank, rank + some, first + full, each, most - left))
                rank += some
                put(left - some * length, first + full, 1)
                full += 1
            put(left, first + full, number - full)
    return out


def token_pieces(df: DataFrame, tokenizer: str, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces (id, piece, start, length, ids_crc32, and ids if wanted) of each row: its ids and a closing 0, cut only if longer than ``most``."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = PIECES.replace("id long", f"id {kind}", 1) + (", ids binary" if with_ids else "")
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(tidy(pieces_of(tokenizer, most, id_col, "_text", with_ids)), schema)


def pack(df: DataFrame, tokenizer: str, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids as little-endian uint32 if wanted).

    A null or empty text is the single id 0. Offsets are gapless from 0 in every sequence. Null ids and repeated rows are
    packed like any other row; an empty table packs to nothing. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(token_pieces(df, tokenizer, most, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = pd.DataFrame(plan(counts, most), columns=["length", "low", "high", "first", "each", "base"])
    steps = spark.createDataFrame(steps, "length long, low long, high long, first long, each long, base long")
    by_length = steps.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "each", "base"))).alias("steps"))
    placed = dense_ranks(pieces, ["length"], ["id", "piece"]).join(F.broadcast(by_length), "length")
    step = F.filter("steps", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    placed = placed.withColumn("s", step).withColumn("k", F.col("rank") - F.col("s.low"))
    out = placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("s.first") + F.expr("k div s.each")).alias("sequence_id"), (F.col("s.base") + F.expr("k % s.each") * F.col("length")).alias("offset"), *(["ids"] if with_ids else []))
    out = scratch.keep(out)
    scratch.drop()
    return out
