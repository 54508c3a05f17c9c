"""Hard-negative mining by distributed radix selection.

Rows are packed in blocks, anchors in blocks of bounded size; a join of blocks on (anchor block, lane) lets each task score
blocks against blocks by one matrix product, whole numbers throughout. First, the best positives of each anchor: a task's few
best, then the best of these. Each (anchor, positive) then has a window of scores, counted from its upper end. Tasks send
histograms of the windows' scores, 256 buckets of equal width, only as far as a task's own rows don't yet fill the selection;
their sums locate the bucket with the kth score, which is refined by the next digit until it is one score. A last
pass gathers only rows above that score and, of those at it, the smallest ids a task has.

Scores are recomputed in each pass instead of being written: a pass costs one matrix product, and nothing of the size of
anchors x rows is ever moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iqlake.llm.common import Scratch, need

#: Rows and, about, anchors of a block, bits of a digit, bytes of packed anchors that may be broadcast; they change cost only.
ROWS, ANCHORS, DIGIT, BROADCAST = 4096, 1024, 8, 32 << 20
BLOCK = "n long, uid binary, id binary, label binary, kind string, width long, vectors binary"
_NONE = np.iinfo(np.int64).max
_EXACT = float(1 << 53)


def _vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number vectors, shorter ones filled up with zeros, and which rows have only finite components."""
    column = column.cast(pa.large_list(pa.float64()))
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    flat, n = flat[at[0] : at[-1]], np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    fine = np.bincount(row[~np.isfinite(flat)], minlength=len(n)) == 0  # a null component is NaN here
    out = np.zeros((len(n), int(n.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], n)] = np.floor(scale * flat)
    out = out[fine]
    if out.size and np.abs(out).max() >= 2.0**62:
        raise OverflowError("a component is too large for whole numbers")
    return out.astype(np.int64), fine


def _pack(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                v, fine = _vectors(part.column(3), scale)
                if not len(v):
                    continue
                top = int(np.abs(v).max(initial=0))
                kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
                one = [part.column(c).fill_null(_NONE).to_numpy(zero_copy_only=False)[fine].astype("<i8").tobytes() for c in range(3)]
                yield pa.RecordBatch.from_pylist([{"n": len(v), "uid": one[0], "id": one[1], "label": one[2], "kind": kind, "width": v.shape[1], "vectors": v.astype(kind).tobytes()}], schema=_schema())

    return run


def _schema() -> pa.Schema:
    b = pa.binary()
    return pa.schema([("n", pa.int64()), ("uid", b), ("id", b), ("label", b), ("kind", pa.string()), ("width", pa.int64()), ("vectors", b)])


def _unpack(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    uid, at, label = (np.frombuffer(r[c], "<i8") for c in ("uid", "id", "label"))
    return uid, at, label, np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], r["width"])


def _split_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, one by one."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for r in batch.to_pylist():
            uid, at, label, v = _unpack(r)
            cols = [uid, at, label, [r["kind"]] * len(uid), [x.tobytes() for x in v]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uid", "id", "label", "kind", "vector"])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact; in double precision only where no sum can leave its whole numbers."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * w
    if most < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = a.astype(object) @ b.astype(object).T
    if max(abs(int(whole.max())), abs(int(whole.min()))) >= 1 << 62:
        raise OverflowError("a score is too large for whole numbers")
    return whole.astype(np.int64)


def _anchors(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    uid, label = (np.array(r[c], np.int64) for c in ("a_uid", "a_label"))
    vectors = [np.frombuffer(x, k) for x, k in zip(r["a_vector"], r["a_kind"], strict=True)]
    out = np.zeros((len(uid), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return uid, label, out


def _first(group: np.ndarray, k: np.ndarray | int, *order: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each group in ``order``."""
    by = np.lexsort([*order[::-1], group])
    g = group[by]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return by[rank < (k if np.isscalar(k) else k[by])]


def _positives(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each pair of blocks, the first ``k`` rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                uid, at, label, v = _unpack(r)
                a_uid, a_label, a = _anchors(r)
                s = _scores(a, v)
                fits = (label == a_label[:, None]) & (uid != a_uid[:, None])
                held = np.where(fits, s, np.iinfo(np.int64).min)
                if held.shape[1] > k:
                    fits &= held >= np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None]
                i, j = np.nonzero(fits)
                by = _first(i, k, -s[i, j], at[j])
                i, j = i[by], j[by]
                yield pa.RecordBatch.from_arrays([pa.array(a_uid[i]), pa.array(at[j]), pa.array(s[i, j])], names=["uid", "id", "score"])

    return run


def _in_windows(r: dict) -> tuple[np.ndarray, ...] | None:
    """(window, place below its upper end, row id, score) of all rows of other labels in the windows of a pair of blocks."""
    _, at, label, v = _unpack(r)
    a_uid, a_label, a = _anchors(r)
    w_at = {u: k for k, u in enumerate(a_uid.tolist())}
    row = np.array([w_at[u] for u in r["w_uid"]], np.int64)
    if not len(row):
        return None
    low, high = np.array(r["w_low"], np.int64), np.array(r["w_high"], np.int64)
    least, most = np.full(len(a), _NONE), np.full(len(a), -_NONE)
    np.minimum.at(least, row, low)
    np.maximum.at(most, row, high)
    s = _scores(a, v)
    i, j = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (label != a_label[:, None]))
    score = s[i, j]
    # Each anchor's windows are consecutive; a row in the anchor's whole range is compared with each of them.
    by = np.argsort(row, kind="stable")
    first, count = np.searchsorted(row[by], np.arange(len(a))), np.bincount(row, minlength=len(a))
    n = count[i]
    pick = np.repeat(np.arange(len(i)), n)
    w = by[np.repeat(first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    keep = (score[pick] >= low[w]) & (score[pick] <= high[w])
    pick, w = pick[keep], w[keep]
    return w, high[w] - score[pick], at[j[pick]], score[pick]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, bucket, rows) of the undecided interval of each window; none beyond the bucket that fills the selection here."""
    for batch in batches:
        for r in batch.to_pylist():
            got = _in_windows(r)
            if got is None:
                continue
            w, below, _, _ = got
            start, stop, shift = (np.array(r[f"w_{c}"], np.int64) for c in ("start", "stop", "shift"))
            inside = (below >= start[w]) & (below < stop[w])
            w, below = w[inside], below[inside]
            name, rows = np.unique((w << 10) | ((below - start[w]) >> shift[w]), return_counts=True)
            w, bucket = name >> 10, name & 1023
            first = np.searchsorted(w, w)
            before = np.cumsum(rows) - rows
            keep = before - before[first] < np.array(r["w_need"], np.int64)[w]
            uid, p = np.array(r["w_uid"], np.int64), np.array(r["w_p"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(uid[w[keep]]), pa.array(p[w[keep]]), pa.array(bucket[keep]), pa.array(rows[keep])], names=["uid", "p", "bucket", "rows"])


def _gather(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows above the kth score, and the first at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = _in_windows(r)
                if got is None:
                    continue
                w, below, at, score = got
                keep = below < np.array(r["w_stop"], np.int64)[w]
                w, at, score = w[keep], at[keep], score[keep]
                by = _first(w, k, -score, at)
                w, at, score = w[by], at[by], score[by]
                uid, p = np.array(r["w_uid"], np.int64), np.array(r["w_p"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(uid[w]), pa.array(p[w]), pa.array(at), pa.array(score)], names=["uid", "p", "id", "score"])

    return run


class _Blocks:
    """Blocks of rows and of anchors, and their pairs."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, scratch: Scratch) -> None:
        self.rows = rows
        size = anchors.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("vector") + 64).alias("bytes")).first()
        self.n = -(-size["n"] // ANCHORS)
        # Lanes spread a block of anchors over tasks where it is shuffled; a broadcast needs none.
        self.small = (size["bytes"] or 0) <= BROADCAST
        self.lanes = 1 if self.small else max(1, rows.count() // 64)
        placed = anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(max(1, self.n))))
        one = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"a_{c}") for c in ("uid", "label", "kind", "vector")])))
        blocks = placed.groupBy("block").agg(one.alias("x"))
        self.anchors = scratch.save(blocks.select("block", *[F.col("x")[f"a_{c}"].alias(f"a_{c}") for c in ("uid", "label", "kind", "vector")]), "blocks")

    def pairs(self, windows: DataFrame | None = None) -> DataFrame:
        """Each block of rows with each block of anchors, and the anchors' windows."""
        side = self.anchors
        if windows is not None:
            one = F.collect_list(F.struct(*[F.col(c).alias(f"w_{c}") for c in windows.columns]))
            grouped = windows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(max(1, self.n)))).groupBy("block").agg(one.alias("x"))
            side = side.join(grouped.select("block", *[F.col("x")[f"w_{c}"].alias(f"w_{c}") for c in windows.columns]), "block")
        side = side.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(self.lanes - 1))))
        rows = self.rows.withColumn("lane", F.pmod(F.xxhash64("uid"), F.lit(self.lanes)).cast("int"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n - 1).cast("long"))))
        return rows.join(F.broadcast(side) if self.small else side, ["block", "lane"])


def _refine(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows narrowed to the bucket that holds the score still looked for; a window with fewer rows than needed is left whole."""
    over = Window.partitionBy("uid", "p").orderBy("bucket")  # 256 buckets at most
    sums = counts.groupBy("uid", "p", "bucket").agg(F.sum("rows").alias("rows"))
    sums = sums.withColumn("before", F.sum("rows").over(over) - F.col("rows"))
    found = windows.join(sums, ["uid", "p"]).filter("before < need and before + rows >= need")
    start = F.expr("start + shiftleft(bucket, int(shift))")
    stop = F.least(F.col("stop"), start + F.expr("shiftleft(1L, int(shift))"))
    there = found.select("uid", "p", start.alias("s"), stop.alias("e"), (F.col("need") - F.col("before")).alias("left"))
    out = windows.join(there, ["uid", "p"], "left")
    open_ = F.col("s").isNotNull()
    pick = lambda new, old: F.when(open_, F.col(new)).otherwise(F.col(old)).alias(old)
    return out.select("uid", "p", "positive_id", "low", "high", pick("s", "start"), pick("e", "stop"), F.when(open_, F.greatest(F.col("shift") - DIGIT, F.lit(0))).otherwise(F.lit(-1)).cast("long").alias("shift"), pick("left", "need"))


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``df`` where ``anchor`` holds.

    Rows with a null label or vector, or a component that is null or not finite, take no part. A component x becomes
    floor(scale * x); a row's score is its inner product with the anchor over the components that both have, a whole number (one
    that needs more than 62 bits is an error). Higher scores come first, ties by smaller id, null ids last. An anchor's
    positives are its first ``positives`` other rows of its label; for each, ``rank`` numbers the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Rows are told apart by their place,
    not their id: rows that repeat an id are rows of their own, and an anchor listed twice is two anchors, each the other's
    positive. An anchor without positives, and a window without negatives, gives no row. An empty table, or one without anchors,
    gives an empty result. Other columns of ``df`` are read only by ``anchor``.
    """
    need(df, **{id_col: T.IntegralType, label_col: T.IntegralType, vector_col: T.ArrayType})
    spark = df.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("_a"))
    rows = scratch.save(rows.filter("label is not null and vector is not null"), "rows")
    parts = {name: rows.filter(F.col("_a")) if name == "anchors" else rows for name in ("all", "anchors")}
    packed = {name: scratch.save(part.select("uid", "id", "label", "vector").mapInArrow(_pack(scale), BLOCK), name) for name, part in parts.items()}
    scratch.drop("rows")
    anchors = packed["anchors"].mapInArrow(_split_anchors, "uid long, id long, label long, kind string, vector binary")
    anchors = scratch.save(anchors, "split")
    blocks = _Blocks(packed["all"], anchors, scratch)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not blocks.n:
        scratch.drop()
        return spark.createDataFrame([], result)

    best = blocks.pairs().mapInArrow(_positives(positives), "uid long, id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "id")
    best = best.withColumn("p", F.row_number().over(order).cast("long")).filter(F.col("p") <= positives)
    # The least and the largest whole score with low * score <= 100 * x <= high * score.
    at_least = -F.floor(-(F.col("score").cast("decimal(38,0)") * low) / 100)
    at_most = F.floor((F.col("score").cast("decimal(38,0)") * high) / 100)
    windows = best.select("uid", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), at_least.cast("long").alias("low"), at_most.cast("long").alias("high")).filter("low <= high")
    windows = scratch.save(windows, "found")
    scored = windows.select("uid", "p", "positive_score")
    bits = F.greatest(F.lit(0), F.length(F.bin(F.col("high") - F.col("low"))) - DIGIT)
    windows = windows.select("uid", "p", "positive_id", "low", "high", F.lit(0).cast("long").alias("start"), (F.col("high") - F.col("low") + 1).alias("stop"), bits.cast("long").alias("shift"), F.lit(negatives).cast("long").alias("need"))
    widest = windows.agg(F.max(bits)).first()[0]
    kernel = ("uid", "p", "low", "high", "start", "stop", "shift", "need")
    for k in range(0 if widest is None else 1 + -(-widest // DIGIT)):
        undecided = windows.filter("shift >= 0 and stop - start > 1")
        counts = blocks.pairs(undecided.select(*kernel)).mapInArrow(_histograms, "uid long, p long, bucket long, rows long")
        after = scratch.save(_refine(undecided, counts).unionByName(windows.filter("shift < 0 or stop - start <= 1")), f"windows{k}")
        windows = after
    picked = blocks.pairs(windows.select(*kernel)).mapInArrow(_gather(negatives), "uid long, p long, id long, score long")
    order = Window.partitionBy("uid", "p").orderBy(F.desc("score"), "id")
    picked = picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = anchors.select("uid", F.col("id").alias("a"))
    known = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    out = picked.join(windows.select("uid", "p", "positive_id"), ["uid", "p"]).join(scored, ["uid", "p"]).join(names, "uid")
    out = out.select(known("a").alias("anchor_id"), known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = scratch.keep(out)
    scratch.drop()
    return out
