"""Frames of any length in blocks of bounded size, with a halo where a kernel looks beyond its block.

A frame is never gathered whole: block b of a frame owns the samples pos in [b size, (b + 1) size) and may hold ``before`` samples ahead of
them and ``after`` behind. So a record that is one single frame is the work of as many tasks as it has blocks. ``pos`` counts
a frame's samples from 0 without gaps, which is checked in every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples that a block owns, and blocks that one step of a scan takes.
SIZE, FAN = 1 << 16, 4096


def placed(df: DataFrame, keys: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """``df`` with ``pos``, the place in its frame by order of n, if it lacks it: places within stretches of n, plus the stretches' counts before."""
    keys = keys or ["frame"]
    if "pos" in df.columns:
        return df
    df = df.withColumn("_stretch", F.floor(F.col("n") / size))
    over = Window.partitionBy(*keys).orderBy("_stretch")  # a row a stretch
    counts = df.groupBy(*keys, "_stretch").agg(F.count(F.lit(1)).alias("_c")).select(*keys, "_stretch", (F.sum("_c").over(over) - F.col("_c")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy("n")) - 1
    return df.withColumn("_k", within).join(counts, [*keys, "_stretch"]).withColumn("pos", (F.col("_before") + F.col("_k")).cast("long")).drop("_before", "_k", "_stretch")


def in_blocks(df: DataFrame, cols: list[str], before: int = 0, after: int = 0, size: int = SIZE, keys: list[str] | None = None) -> DataFrame:
    """(keys, block, skip, arrays of ``cols``) of ``df`` (keys, pos, cols); ``skip`` samples ahead of the block's own come from the halo.

    Every sample moves once, those in a halo once more.
    """
    keys = keys or ["frame"]
    rows = df.select(*keys, F.struct("pos", *cols).alias("s"), "pos")
    if before or after:
        low, high = F.greatest(F.lit(0).cast("long"), F.expr(f"(pos - {after}) div {size}")), F.expr(f"(pos + {before}) div {size}")
        rows = rows.withColumn("block", F.explode(F.sequence(low, high)))
    else:
        rows = rows.withColumn("block", F.expr(f"pos div {size}"))
    rows = rows.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("s")).alias("s"))
    first, last = F.element_at("s", 1)["pos"], F.element_at("s", -1)["pos"]
    own, held = F.col("block") * size, F.greatest(F.lit(0).cast("long"), F.col("block") * size - before)
    whole = (first == held) & (last - first + 1 == F.size("s"))
    told = F.raise_error(F.lit("pos must count a frame's samples from 0 without gaps")).cast("long")
    # A block beyond a frame's end may have got a halo, but nothing of its own.
    rows = rows.filter(last >= own).select(*keys, "block", F.when(whole, own - first).otherwise(told).alias("skip"), "s")
    return rows.select(*keys, "block", "skip", *[F.col("s")[c].alias(f"v{k}") for k, c in enumerate(cols)])


def lists(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets, and the flat values, of the list columns from number ``at`` on."""
    return batch.column(at).offsets.to_numpy().astype(np.int64), [batch.column(c).values.to_numpy(zero_copy_only=False) for c in range(at, batch.num_columns)]


#: Values of a column that a kernel gets at a time.
AT_ONCE = 1 << 18


def over_blocks(blocks: DataFrame, kernel: Callable[[np.ndarray, int, list[np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``kernel(frames, skip, matrices)`` over blocks (frame, block, skip, arrays) of one length and skip at a time: a row a block, a matrix a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame, skip = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            off, values = lists(batch, 3)
            shape = np.stack([np.diff(off), skip], 1)
            for n, s in np.unique(shape, axis=0):
                own = np.flatnonzero((shape == (n, s)).all(1))
                step = max(1, AT_ONCE // max(1, int(n)))
                for lo in range(0, len(own), step):
                    at = off[:-1][own[lo : lo + step]][:, None] + np.arange(n)[None, :]
                    out = kernel(frame[own[lo : lo + step]], int(s), [v[at] for v in values])
                    if len(next(iter(out.values()))):
                        yield pa.RecordBatch.from_pydict(out)

    return blocks.mapInArrow(run, schema)


def affine_starts(blocks: DataFrame, factors: list[float], start: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, block, start) of frames with several blocks: the states s at the start of each block, where a block of ``len`` samples maps s to a ** len s + carry.

    ``blocks`` has (keys, block, len, carry), ``carry`` an array with an entry for each a of ``factors``. Maps of FAN blocks are composed in one
    task, then those of the stretches.
    """
    keys = keys or ["frame"]
    a = np.array(factors)
    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    more = blocks.filter("block > 0").select(*keys).distinct()
    several = blocks.join(more, keys, "left_semi").withColumn("stretch", F.expr(f"block div {FAN}"))

    def compose(table: pa.Table) -> pa.Table:
        """Before each block the map from the stretch's start, and the map of the whole stretch."""
        table = table.sort_by("block")
        m, c, ms, cs = np.ones(len(a)), np.zeros(len(a)), [], []
        for n, carry in zip(table.column("len").to_pylist(), table.column("carry").to_pylist(), strict=True):
            ms.append(m.tolist())
            cs.append(c.tolist())
            step = a**n
            m, c = m * step, c * step + np.array(carry)
        doubles = pa.list_(pa.float64())
        cols = [*[table.column(k) for k in keys], table.column("stretch"), table.column("block"), pa.array(ms, doubles), pa.array(cs, doubles), pa.array([m.tolist()] * len(ms), doubles), pa.array([c.tolist()] * len(cs), doubles)]
        return pa.table(cols, names=[*keys, "stretch", "block", "m", "c", "whole_m", "whole_c"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("stretch")
        s, out = np.full(len(a), start), []
        for m, c in zip(table.column("whole_m").to_pylist(), table.column("whole_c").to_pylist(), strict=True):
            out.append(s.tolist())
            s = np.array(m) * s + np.array(c)
        return pa.table([*[table.column(k) for k in keys], table.column("stretch"), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "stretch", "s"])

    doubles = "array<double>"
    maps = several.groupBy(*keys, "stretch").applyInArrow(compose, f"{kinds}, stretch long, block long, m {doubles}, c {doubles}, whole_m {doubles}, whole_c {doubles}")
    ends = maps.filter(F.col("block") % FAN == 0).select(*keys, "stretch", "whole_m", "whole_c").groupBy(*keys).applyInArrow(chain, f"{kinds}, stretch long, s {doubles}")
    state = F.zip_with(F.zip_with("m", "s", lambda x, y: x * y), "c", lambda x, y: x + y)
    return maps.join(ends, [*keys, "stretch"]).select(*keys, "block", state.alias("start"))
