"""Token ids as packed binary matrices.

Each task tokenises its own documents and packs them block by block, by best-fit decreasing: a segment tree over capacities
finds the open sequence with the least room that still holds a piece. No shuffle: a sequence's number is made of the
partition, the block and its place in it. Documents longer than a sequence are cut into pieces that join up to the whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.llm.textcore import slices

WIDTH, PAD = 2048, 0


class Rooms:
    """A segment tree over capacities 0..most: how many open sequences have each, and the least one of at least so much."""

    def __init__(self, most: int) -> None:
        self.n = 1 << most.bit_length()
        self.count = [0] * (2 * self.n)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.n
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and gives (room, sequence) of the least room of at least ``least``."""
        i = least + self.n
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.n
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces of each sequence; ties go by index."""
    rooms, out = Rooms(most), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        got = rooms.take(n)
        if got is None:
            got = (most, len(out))
            out.append([])
        out[got[1]].append(k)
        if got[0] > n:
            rooms.add(got[0] - n, got[1])
    return out


def packed_matrix(df: DataFrame, ranks_path: str, end_id: int = 50256, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """One row for each sequence of ``width`` ids.

    Columns: block (of about ``block_bytes`` of text), row (in the block's matrix), n_tokens, ids (little-endian uint32,
    padded to ``width``), cu_seqlens (bounds of the segments, from 0 to n_tokens), positions (little-endian uint32, from 0 in
    each segment, 0 in the padding), doc_ids, pieces, starts (of each segment: its document, which piece of it, and where in
    its ids it begins). A document's ids are its tokens and ``end_id``; null and empty texts are ``end_id`` alone. Null ids and
    repeated rows are packed like others. Write the result with any Spark sink; ``ids`` of a block by row are its matrix.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken
        from pyspark import TaskContext

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        block = TaskContext.get().partitionId() << 32
        for batch, parts in slices(batches, "_text", block_bytes):
            own = batch.column(0).to_pylist()
            flat: list[np.ndarray] = []
            doc, piece, start = [], [], []
            for k, p in enumerate(parts):
                ids = np.asarray(encoding.encode_ordinary(bytes(p).decode("utf-8", "replace")) + [end_id], "<u4")
                for j, at in enumerate(range(0, len(ids), width)):
                    flat.append(ids[at : at + width])
                    doc.append(own[k])
                    piece.append(j)
                    start.append(at)
            lengths = np.fromiter(map(len, flat), np.int64, len(flat))
            rows: dict[str, list] = {c: [] for c in ("block", "row", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "pieces", "starts")}
            for r, members in enumerate(best_fit(lengths, width)):
                cu = np.concatenate([[0], np.cumsum(lengths[members])])
                ids = np.full(width, PAD, "<u4")
                ids[: cu[-1]] = np.concatenate([flat[k] for k in members])
                positions = np.zeros(width, "<u4")
                positions[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
                for c, v in zip(rows, (block, r, int(cu[-1]), ids.tobytes(), cu.tolist(), positions.tobytes(), [doc[k] for k in members], [piece[k] for k in members], [start[k] for k in members]), strict=True):
                    rows[c].append(v)
                if len(rows["row"]) == 256:
                    yield pa.RecordBatch.from_pydict(rows, schema=out_type(batch.schema.field(0).type))
                    rows = {c: [] for c in rows}
            if rows["row"]:
                yield pa.RecordBatch.from_pydict(rows, schema=out_type(batch.schema.field(0).type))
            block += 1

    def out_type(of_id: pa.DataType) -> pa.Schema:
        return pa.schema({"block": pa.int64(), "row": pa.int32(), "n_tokens": pa.int32(), "ids": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), "positions": pa.binary(), "doc_ids": pa.list_(of_id), "pieces": pa.list_(pa.int32()), "starts": pa.list_(pa.int64())})

    schema = f"block long, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{kind}>, pieces array<int>, starts array<long>"
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def write_matrices(df: DataFrame, path: str) -> None:
    """Writes packed sequences as Parquet, rows of a block together and in order."""
    df.write.option("compression", "zstd").parquet(path)


def unpack(row: dict) -> list[tuple[object, int, int, int]]:
    """(doc_id, piece, start, crc32 of its ids) of the segments of a packed row, read from its binary columns."""
    ids, cu = np.frombuffer(row["ids"], "<u4"), row["cu_seqlens"]
    return [(d, p, s, zlib.crc32(ids[a:b].tobytes())) for d, p, s, a, b in zip(row["doc_ids"], row["pieces"], row["starts"], cu[:-1], cu[1:], strict=True)]
