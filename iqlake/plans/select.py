"""Ranking and selection over trial tables; every rule is an order and a filter, so ties are settled by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with(trials: DataFrame, value: Column, name: str) -> DataFrame:
    """``trials`` with an aggregate of all of them, one broadcast row."""
    return trials.crossJoin(F.broadcast(trials.agg(value.alias(name))))


def best(trials: DataFrame, *order: Column | str) -> DataFrame:
    """The lexicographic minimum."""
    return trials.orderBy(*order).limit(1)


def near_best(trials: DataFrame, tolerance: float, score: str = "score_db", valid: str = "valid") -> DataFrame:
    """Valid trials within ``tolerance`` dB of the best score."""
    return _with(trials.filter(valid), F.min(score), "_best").filter(F.col(score) <= F.col("_best") + tolerance).drop("_best")


def ranked(trials: DataFrame, tolerance: float, *order: Column | str, score: str = "score_db") -> DataFrame:
    """All valid trials with a rank: those near the best by ``order``, then the others by score and ``order``."""
    t = _with(trials.filter("valid"), F.min(score), "_best").withColumn("_near", F.col(score) > F.col("_best") + tolerance).drop("_best")
    return numbered(t, "rank", "_near", F.when(F.col("_near"), F.col(score)), *order).drop("_near")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows numbered from 1 in ``order``: sorted by range over all tasks, numbered in each, and shifted by the tasks before."""
    at = rows.sort(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # One row a task.
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    return at.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_k") + 1).cast("int")).drop("_p", "_k", "_before")


def retained(trials: DataFrame, most: int, window_db: float, *order: Column | str, score: str = "score_db") -> DataFrame:
    """Up to ``most`` topologies within a dB window of the best."""
    return near_best(trials, window_db, score).orderBy(*order).limit(most)


def strongest_ridge(trials: DataFrame, tie_db: float, topology: str = "recipe", score: str = "score_db") -> DataFrame:
    """Per topology, of trials within ``tie_db`` of its best the one with the strongest ridge."""
    w = Window.partitionBy(topology)
    near = trials.filter("valid").withColumn("_b", F.min(score).over(w)).filter(F.col(score) <= F.col("_b") + tie_db)
    return near.withColumn("_r", F.row_number().over(w.orderBy(F.desc("ridge"), score))).filter("_r = 1").drop("_r", "_b")


def smallest_within(trials: DataFrame, tolerance: float, size: str, score: str = "score_db") -> DataFrame:
    """The smallest of those within ``tolerance`` dB of the best."""
    return near_best(trials, tolerance, score).orderBy(size, score).limit(1)


def eligible_gain(trials: DataFrame, none: str, tolerance: float) -> DataFrame:
    """Best eligible candidate by the lesser of full and common gain, ties within ``tolerance`` to fewer multiplications; ``none`` if none is eligible."""
    t = trials.withColumn("gain", F.least("full_gain", "common_gain"))
    ok = _with(t.filter("eligible"), F.max("gain"), "_b").filter(F.col("gain") >= F.col("_b") - tolerance).orderBy("mul", F.desc("gain"), "recipe").limit(1).select("recipe", F.lit(0).alias("_o"))
    fallback = trials.sparkSession.range(1).select(F.lit(none).alias("recipe"), F.lit(1).alias("_o"))
    return ok.union(fallback).orderBy("_o").limit(1).select("recipe")


def top_rows(rows: DataFrame, value: str, count: int = 5, causal: str | None = None, tie: str = "lag") -> DataFrame:
    """Largest by absolute value, finite ones only, ties by ``tie``."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    if causal:
        ok = ok & (F.col(causal) >= 0)
    return rows.filter(ok).orderBy(F.abs(value).desc(), tie).limit(count)


def gates(trials: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A boolean column for each rule, null counting as false, and ``passed`` for all of them."""
    out = trials.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in rules.items()})
    all_ = F.lit(True)
    for k in rules:
        all_ = all_ & F.col(k)
    return out.withColumn("passed", all_)


def release_thresholds(validation_gain: Column) -> Column:
    """The least out-of-fold gain that a release needs."""
    return F.greatest(F.lit(0.10), 0.25 * validation_gain)


def with_failures(trials: DataFrame, failures: DataFrame) -> DataFrame:
    """Failed fits stay as invalid rows."""
    return trials.unionByName(failures.withColumn("valid", F.lit(False)), allowMissingColumns=True)


def deltas(results: DataFrame, variant: str, a: str, b: str, keys: list[str], values: list[str]) -> DataFrame:
    """Variant ``a`` minus variant ``b`` of each value, joined on ``keys``."""
    left = results.filter(F.col(variant) == a).select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    right = results.filter(F.col(variant) == b).select(*keys, *values)
    return left.join(right, keys).select(*keys, *[(F.col(f"_{v}") - F.col(v)).alias(f"{v}_delta") for v in values])


def checked_budget(declared: int, *stages: int) -> int:
    """The number of fits of all stages, which must be what was declared."""
    if declared != sum(stages):
        raise ValueError(f"declared {declared} fits, stages need {sum(stages)}")
    return declared
