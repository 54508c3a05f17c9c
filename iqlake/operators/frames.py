"""Frames, masks, crops and checks of sample rows (frame, n, pos, ...). Windows are always partitioned by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["frame"]


def in_frame(keys: list[str] | None = None) -> Window:
    return Window.partitionBy(*(keys or FRAME))


def in_order(keys: list[str] | None = None, order: str = "n") -> Window:
    return in_frame(keys).orderBy(order)


def with_frames(df: DataFrame, nperseg: int) -> DataFrame:
    """frame = n div nperseg and pos in it; the last frame may be short."""
    if nperseg < 1:
        raise ValueError("nperseg must be positive")
    return df.withColumn("frame", F.expr(f"n div {nperseg}")).withColumn("pos", F.col("n") % nperseg)


def frame_lengths(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First sample and length of each frame."""
    return df.groupBy(*(keys or FRAME)).agg(F.min("n").alias("first_n"), F.count(F.lit(1)).alias("len"))


def tiles(df: DataFrame) -> DataFrame:
    """One row: whether the frames tile the record without gap or overlap, and how many samples they hold."""
    f = df.groupBy("frame").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("len"))
    return f.agg(F.sum("len").alias("samples"), (F.min(F.col("hi") - F.col("lo") + 1 == F.col("len")) & (F.max("hi") - F.min("lo") + 1 == F.sum("len"))).alias("tiled"))


def with_length(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.withColumn("len", F.count(F.lit(1)).over(in_frame(keys)))


def steady(warmup: int, cooldown: int = 0) -> Column:
    """Past the first ``warmup`` and before the last ``cooldown`` samples of a frame of ``len`` rows."""
    mask = F.col("pos") >= warmup
    return mask & (F.col("pos") < F.col("len") - cooldown) if cooldown else mask


def scored_lengths(df: DataFrame, warmup: int) -> DataFrame:
    """Frame lengths less ``warmup``, of every frame: 0 or less where nothing is left to score."""
    return frame_lengths(df).withColumn("scored", F.col("len") - warmup)


def checked_warmup(df: DataFrame, warmup: int) -> DataFrame:
    """Frame lengths, with an error if ``warmup`` leaves nothing of a frame."""
    f = scored_lengths(df, warmup)
    return f.withColumn("scored", F.when(F.col("scored") > 0, F.col("scored")).otherwise(F.raise_error(F.lit("warm-up consumes a frame")).cast("long")))


def prefix(df: DataFrame, samples: int) -> DataFrame:
    """The first ``samples`` of every frame; an error if a frame is shorter."""
    sized = with_length(df)
    ok = F.when(F.col("len") >= samples, True).otherwise(F.raise_error(F.lit("a frame is shorter than the prefix")).cast("boolean"))
    return sized.filter(ok & (F.col("pos") < samples)).drop("len")


def guard_crop(df: DataFrame, guard: int) -> DataFrame:
    """Without exactly ``guard`` samples at both ends of each frame."""
    return with_length(df).filter((F.col("pos") >= guard) & (F.col("pos") < F.col("len") - guard)).drop("len")


def padded(df: DataFrame, nperseg: int, cols: list[str]) -> DataFrame:
    """Each frame right-padded with zeros to ``nperseg`` rows; ``real`` marks its own rows."""
    grid = df.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nperseg - 1).cast("long"))).alias("pos"))
    own = df.select("frame", "pos", *cols, F.lit(True).alias("real"))
    return grid.join(own, ["frame", "pos"], "left").select("frame", "pos", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols], F.coalesce("real", F.lit(False)).alias("real"))


def even_sample(df: DataFrame, length: int, most: int) -> DataFrame:
    """At most ``most`` rows, at the whole parts of an even grid from 0 to length - 1."""
    if most >= length:
        return df
    last, steps = length - 1, most - 1
    picks = df.sparkSession.range(most).select(F.when(F.col("id") == steps, last).otherwise(F.floor(F.col("id") * (last / steps))).cast("long").alias("n")).distinct()
    return df.join(F.broadcast(picks), "n", "left_semi")


def check_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pairs, rows with no partner on either side, and rows of either with a double that is null or not finite."""

    def marked(df: DataFrame, name: str) -> DataFrame:
        ok = F.lit(True)
        for c, kind in df.dtypes:
            if kind in ("double", "float") and c not in keys:
                ok = ok & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
        return df.select(*keys, (~ok).cast("long").alias(name))

    both = marked(left, "_l").join(marked(right, "_r"), keys, "full")
    bad = F.sum(F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0)))
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("pairs"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.coalesce(bad, F.lit(0)).alias("not_finite"))


def support(df: DataFrame, maximum: float, by: list[str] | None = None) -> DataFrame:
    """Samples above a frozen amplitude: count and share."""
    over = F.sqrt(F.col("i") * F.col("i") + F.col("q") * F.col("q")) > maximum
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("samples"), F.count_if(over).alias("above"), F.avg(over.cast("double")).alias("share"))


def checked_role(split: str, purpose: str) -> None:
    """The held-out split is for final reports only."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split}")
    if split == "test" and purpose != "final_report":
        raise ValueError("the test split is for the final report only")


def window_starts(df: DataFrame, length: int, stride: int, per_frame: bool = True) -> DataFrame:
    """First samples of windows of ``length``; ``per_frame`` keeps them inside a frame, else they may cross."""
    if per_frame:
        f = frame_lengths(df).filter(F.col("len") >= length)
        return f.select("frame", F.explode(F.expr(f"sequence(first_n, first_n + len - {length}, {stride})")).alias("start"))
    f = df.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).filter(F.col("hi") - F.col("lo") + 1 >= length)
    return f.select(F.explode(F.expr(f"sequence(lo, hi - {length} + 1, {stride})")).alias("start"))


def crossing_windows(df: DataFrame, length: int, stride: int) -> DataFrame:
    """How many flat windows lie across a frame boundary: by arithmetic on a row a frame, no join of windows and samples.

    Windows start at the record's first sample and every ``stride`` on; frames tile the record. A window crosses if it starts
    in a frame's last ``length`` - 1 samples and ends in the record.
    """
    f = frame_lengths(df)
    bounds = F.broadcast(f.agg(F.min("first_n").alias("lo"), F.max(F.col("first_n") + F.col("len") - 1).alias("hi")))
    first, end = F.col("first_n"), F.col("first_n") + F.col("len")

    def starts(low: Column, high: Column) -> Column:
        """How many windows start in [low, high), cut to those that end in the record."""
        last = F.least(high, F.col("hi") - length + 2)
        up = lambda v: F.floor((v - F.col("lo") + stride - 1) / stride)
        return F.greatest(F.lit(0).cast("long"), up(last) - up(low))

    rows = f.crossJoin(bounds).select(starts(first, end).alias("w"), starts(F.greatest(first, end - (length - 1)), end).alias("c"))
    return rows.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("windows"), F.coalesce(F.sum("c"), F.lit(0)).alias("crossing"))
