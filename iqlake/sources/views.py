"""Signal views over the driver's tables: rows (frame, n, pos, i, q), paired records (yi, yq) and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NPERSEG = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iq_events(spark: SparkSession, sf_dir: str, nperseg: int = NPERSEG) -> DataFrame:
    """Samples of ``events`` in frames of ``nperseg``; the last one may be short."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("double")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), "user_id", (F.col("value") / 100).alias("i"), ((k - 49.5) / 50).alias("q"))
    return e.select(F.expr(f"n div {nperseg}").alias("frame"), "n", (F.col("n") % nperseg).alias("pos"), "i", "q", "user_id")


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples framed by user: many short frames of different lengths."""
    e = iq_events(spark, sf_dir)
    return e.select(F.col("user_id").alias("frame"), "n", (F.row_number().over(Window.partitionBy("user_id").orderBy("n")) - 1).cast("long").alias("pos"), "i", "q")


def plant(signal: DataFrame) -> DataFrame:
    """Adds a deterministic output with memory: y = x (1 - 0.1 abs(x)^2) + 0.2 x[n-1], no history at a frame's start."""
    w = Window.partitionBy("frame").orderBy("n")
    gain = 1 - 0.1 * (F.col("i") * F.col("i") + F.col("q") * F.col("q"))
    return signal.withColumn("yi", F.col("i") * gain + 0.2 * F.lag("i", 1, 0.0).over(w)).withColumn("yq", F.col("q") * gain + 0.2 * F.lag("q", 1, 0.0).over(w))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(iq_events(spark, sf_dir)).select("frame", "n", "pos", "i", "q", "yi", "yq")


def iq_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of 32 complex samples per vector: even places are i, odd ones q."""
    return iq_arrays(spark, sf_dir).select("frame", "label", F.posexplode(F.arrays_zip("i", "q")).alias("pos", "s")).select("frame", "label", "pos", F.col("s.i").alias("i"), F.col("s.q").alias("q"), (F.col("frame") * 32 + F.col("pos")).alias("n"))


def iq_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one row a frame with arrays i and q: what the kernels of whole frames take without a shuffle."""
    part = lambda odd: F.transform(F.sequence(F.lit(odd), F.size("embedding") - 2 + odd, F.lit(2)), lambda k: F.get("embedding", k).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", part(0).alias("i"), part(1).alias("q"))


def split_of(frame: str = "frame", period: int = 5) -> Column:
    """60/20/20 by frame number: of five frames three are train, one val, one test."""
    k = F.col(frame) % period
    return F.when(k < 3, "train").when(k == 3, "val").otherwise("test")
