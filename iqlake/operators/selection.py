"""Exact quantiles without gathering the values: order statistics by narrowing brackets.

Each order statistic has a bracket of values that holds it, at first least to largest. While a bracket holds more than ``MOST``
values, a mergeable sketch of the values in it gives cuts near the one looked for, and one exact count of the values before, between
and behind them says which part holds it. So a task ever gathers at most MOST values a bracket, whatever the number of rows; a value
that repeats more often than that becomes a bracket by itself, which needs no gathering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.sources import io

#: Values of a bracket that are gathered, cuts of a sketch and its accuracy; they change cost only.
MOST, CUTS, ACCURACY = 1 << 16, 500, 10_000


def _rank(p: float, side: str) -> Column:
    at = F.lit(float(p)) * (F.col("n") - 1)
    return (F.floor(at) if side == "low" else F.ceil(at)).cast("long")


def _narrowed(rows: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets after one sketch and one count."""
    inside = rows.join(F.broadcast(open_), keys).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    grid = F.percentile_approx("_v", [k / CUTS for k in range(CUTS + 1)], ACCURACY)
    drawn = inside.groupBy(*keys, "rank").agg(grid.alias("grid"))
    at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * CUTS).cast("int")
    cut = lambda k: F.element_at("grid", F.greatest(F.lit(0), F.least(F.lit(CUTS), k)) + 1)
    cuts = io.written(open_.join(drawn, [*keys, "rank"]).withColumn("a", cut(at - 2)).withColumn("b", cut(at + 3)).drop("grid"), "cuts")
    within = rows.join(F.broadcast(cuts), keys).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    v = F.col("_v")
    counts = within.groupBy(*keys, "rank").agg(F.count_if(v < F.col("a")).alias("ahead"), F.count_if(v < F.col("b")).alias("to_b"), F.count_if(v <= F.col("b")).alias("through"), F.count(F.lit(1)).alias("all"))
    k = F.col("rank") - F.col("below")
    first, second = k < F.col("ahead"), k < F.col("through")
    got = cuts.join(counts, [*keys, "rank"])
    pick = lambda x, y, z: F.when(first, x).when(second, y).otherwise(z)
    lo, hi = pick(F.col("lo"), F.col("a"), F.col("b")), pick(F.col("a"), F.col("b"), F.col("hi"))
    below = F.col("below") + pick(F.lit(0), F.col("ahead"), F.col("to_b"))
    inside = pick(F.col("ahead"), F.col("through") - F.col("ahead"), F.col("all") - F.col("to_b"))
    return got.select(*keys, "rank", lo.alias("lo"), hi.alias("hi"), below.alias("below"), inside.alias("inside"))


def exact_quantiles(df: DataFrame, value: str | Column, probabilities: list[float], by: list[str] | None = None, most: int = MOST) -> DataFrame:
    """(by, count, q): for each group the quantiles at ``probabilities``, interpolated linearly between neighbours; nulls don't count.

    Groups without values give no row, but without ``by`` there is always one row, with null quantiles if there are no values.
    """
    keys = by or ["_all"]
    v = value if isinstance(value, Column) else F.col(value)
    rows = (df if by else df.withColumn("_all", F.lit(0))).select(*keys, v.cast("double").alias("_v")).filter("_v is not null")
    sizes = io.written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")), "sizes")
    ranks = F.array_distinct(F.array(*[_rank(p, s) for p in probabilities for s in ("low", "high")]))
    brackets = sizes.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    wide = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
    while not (open_ := brackets.filter(wide)).isEmpty():
        brackets = io.written(_narrowed(rows, open_, keys).unionByName(brackets.filter(~wide)), "brackets")
    gathered = brackets.filter("lo < hi").select(*keys, "lo", "hi").distinct()
    held = rows.join(F.broadcast(gathered), keys).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    lists = held.groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("_v")).alias("s"))
    found = brackets.join(lists, [*keys, "lo", "hi"], "left")
    got = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("s", (F.col("rank") - F.col("below")).cast("int")))
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", got.alias("x")))).alias("at"))
    out = sizes.join(values, keys)
    parts = []
    for p in probabilities:
        low, high, at = _rank(p, "low"), _rank(p, "high"), F.lit(float(p)) * (F.col("n") - 1)
        a, b = F.element_at("at", low), F.element_at("at", high)
        parts.append(F.when(low == high, a).otherwise((high - at) * a + (at - low) * b))
    out = out.select(*(by or []), F.col("n").alias("count"), F.array(*parts).alias("q"))
    if by:
        return out
    empty = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("_c"))
    filled = empty.join(out, F.lit(True), "left")
    return filled.select(F.coalesce("count", "_c").alias("count"), F.coalesce("q", F.array(*[F.lit(None).cast("double")] * len(probabilities))).alias("q"))
