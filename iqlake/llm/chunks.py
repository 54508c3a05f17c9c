"""Documents in chunks, and questions that chunks ask each other.

A chunk is one row with some megabytes of text, compressed, in a written table, so its number and content never change. The
table is bucketed by the chunk's number, and so are the answers that chunks get, so texts are never shuffled. To learn something global about its keys (does this symbol occur in another chunk? does this window come first here?) a chunk
deals its distinct keys over buckets, one packed binary row for each bucket; a bucket compares what all chunks sent and
answers with one value for each key, in the order asked. However frequent a key is, a chunk sends it once, so no bucket
grows with a hot key, and nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.llm.common import Scratch
from iqlake.llm.textcore import Texts, blob, tidy

CHUNK, ROWS = 4 << 20, 1 << 15


def make_chunks(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, most: int = CHUNK, *, parts_of: int = 1) -> DataFrame:
    """Table (chunk, n_bytes, n, sizes, texts, and each other column as an array), rows of a chunk in order of id, nulls first.

    A null text is empty, with size -1. A chunk has one of ``parts_of`` parts of ``most`` bytes, for work that takes much memory a byte.
    """
    most //= parts_of
    others = [f for f in df.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        codec = pa.Codec("zstd", 3)
        held: list[tuple[pa.RecordBatch, list]] = []
        size = rows = 0

        def emit() -> pa.RecordBatch:
            nonlocal number, size, rows
            whole = pa.concat_tables([pa.Table.from_batches([b]) for b, _ in held]).combine_chunks()
            parts = [p for _, ps in held for p in ps]
            order = pc.sort_indices(whole, sort_keys=[(id_col, "ascending")], null_placement="at_start").to_numpy()
            bad = np.asarray(whole.column(text_col).is_null())[order]
            sizes = np.fromiter((len(parts[i]) for i in order), np.int64, len(order))
            text = b"".join([parts[i] for i in order])
            out = {"chunk": pa.array([number]), "n_bytes": pa.array([len(text)], pa.int64()), "n": pa.array([len(order)], pa.int64()), "sizes": pa.array([np.where(bad, -1, sizes).astype("<i8").tobytes()]), "texts": pa.array([codec.compress(text, asbytes=True)], pa.binary())}
            for f in others:
                values = whole.column(f.name).combine_chunks().take(pa.array(order))
                values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
                out[f"c_{f.name}"] = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), values)
            number, size, rows = number + 1, 0, 0
            held.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            parts = blob(batch.column(batch.schema.get_field_index(text_col)))
            i = 0
            while i < len(parts):
                j = i
                while j < len(parts) and rows < ROWS and (rows == 0 or size + len(parts[j]) <= most):
                    size += len(parts[j])
                    rows += 1
                    j += 1
                if j > i:
                    held.append((batch.slice(i, j - i), parts[i:j]))
                if j < len(parts):
                    yield emit()
                i = j
        if held:
            yield emit()

    schema = "chunk long, n_bytes long, n long, sizes binary, texts binary" + "".join(f", `c_{f.name}` array<{f.dataType.simpleString()}>" for f in others)
    return scratch.save_by(df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), schema), "chunks", "chunk")


def chunk_parts(sizes: bytes, texts: bytes, n_bytes: int) -> list[memoryview]:
    sizes_ = np.maximum(np.frombuffer(sizes, "<i8"), 0)
    raw = memoryview(pa.Codec("zstd").decompress(texts, n_bytes, asbytes=True)) if n_bytes else memoryview(b"")
    ends = np.cumsum(sizes_)
    return [raw[a:b] for a, b in zip((ends - sizes_).tolist(), ends.tolist(), strict=True)]


def chunk_texts(sizes: bytes, texts: bytes, n_bytes: int) -> Texts:
    return Texts(chunk_parts(sizes, texts, n_bytes))


def chunk_rows(marked: DataFrame, like: DataFrame, text_col: str, gone: str) -> DataFrame:
    """The rows of chunks, with the columns of ``like``, without those whose places are in the array column ``gone`` (null: none)."""

    names = like.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = lambda batch, name: batch.column(batch.schema.get_field_index(name))
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = column(batch, "sizes")[i].as_py()
                parts = chunk_parts(sizes, column(batch, "texts")[i].as_buffer(), column(batch, "n_bytes")[i].as_py())
                stays = np.ones(len(parts), bool)
                stays[column(batch, gone)[i].as_py() or []] = False
                null = np.frombuffer(sizes, "<i8") < 0
                out = {}
                for name in names:
                    if name == text_col:
                        out[name] = pa.array([None if z else bytes(p).decode("utf-8", "replace") for p, z, s in zip(parts, null.tolist(), stays.tolist(), strict=True) if s], pa.string())
                    else:
                        out[name] = column(batch, f"c_{name}")[i].values.filter(pa.array(stays))
                yield pa.RecordBatch.from_pydict(out)

    kinds = ["string" if f.name == text_col else f.dataType.simpleString() for f in like.schema.fields]
    return marked.mapInArrow(tidy(run), ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def bounds_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in ascending ``keys`` (and the end); a bucket is a range of keys."""
    edge = ((np.arange(1, buckets, dtype=object) << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]]).astype(np.int64)


def by_bucket(asked: DataFrame, buckets: int, fields: list[str], answer: Callable[[int, list[int], list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``answer`` makes of each bucket's chunks and ``fields``, given ``asked`` (bucket, chunk, and the binary fields)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunks, rows = None, [], []
        for batch in batches:
            for b, c, *data in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if bucket is not None and b != bucket:
                    yield from answer(bucket, chunks, rows)
                    chunks, rows = [], []
                bucket = b
                chunks.append(c)
                rows.append(tuple(data))
        if rows:
            yield from answer(bucket, chunks, rows)

    # Buckets grow in number with the text; partitions are as many as the session shuffles into, each with a range of buckets.
    parts = min(buckets, 4 * int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = asked.select("bucket", "chunk", *fields).repartitionById(parts, F.expr(f"cast(bucket * {parts}L div {buckets} as int)")).sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(tidy(run), schema)


def ask(asked: DataFrame, buckets: int, answer: Callable[[list[int], list[tuple]], list[np.ndarray]], fields: list[str]) -> DataFrame:
    """Answers (chunk, answers) to ``asked`` (bucket, chunk, and the binary ``fields``), an array of structs (bucket, bits) for each chunk.

    ``answer`` gets the chunks and fields of one bucket and gives an array of small integers for each chunk.
    """

    def reply(bucket: int, chunks: list[int], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        bits = [np.asarray(b, np.uint8).tobytes() for b in answer(chunks, rows)]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return collected(by_bucket(asked, buckets, fields, reply, "chunk long, bucket int, bits binary"))


def collected(answers: DataFrame) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def save_answers(answers: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.save_by(answers, name, "chunk")


def with_answers(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """``chunks`` with their answers in column ``name``; null where a chunk asked nothing. Both are bucketed by chunk: no shuffle."""
    return chunks.join(answers.withColumnRenamed("answers", name).hint("shuffle_hash"), "chunk", "left")


def read_answers(answers: list[dict] | None) -> np.ndarray:
    """All answers to a chunk, in the order of its ascending keys."""
    if not answers:
        return np.zeros(0, np.uint8)
    return np.frombuffer(b"".join(x["bits"] for x in sorted(answers, key=lambda x: x["bucket"])), np.uint8)


def cut(keys: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each key; with the bucket they tell keys apart but for a rare, harmless coincidence."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def joined(parts: list[bytes], n: int) -> np.ndarray:
    """Keys of ``cut`` parts, one after another."""
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, n)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :n] = raw
    return out.reshape(-1).view("<u8")
