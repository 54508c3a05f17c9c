"""Connected components by contraction, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.llm.common import Scratch, hottest, split_join


def components(edges: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``edges``; nodes that are connected share the label, one of their own.

    Each round maps a node to the least of it and its neighbours, and rewrites the edges. Even rounds compare names, which ends
    a star around its least node at once; odd rounds compare hashes of names with the round's number, of which whatever the
    names are (a path of ascending ones, too) at most half are expected to be least, so rounds grow as the logarithm of the
    nodes. The rounds' maps are then composed, last to first. Hubs are split joins. Nothing goes to the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    now = scratch.save(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), f"{name}-e0")
    steps: list[DataFrame] = []
    while not now.isEmpty():
        r = len(steps)
        named = lambda c: F.struct((F.xxhash64(F.lit(r), c) if r % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        step = now.groupBy("u").agg(F.min(named("v")).alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least(named("u"), F.col("m"))["to"].alias("to"), "degree")
        step = scratch.save(step, f"{name}-s{r}")
        steps.append(step)
        hot = hottest(step, "u", "degree")
        maps = step.select("u", "to")
        half = split_join(now, maps, "u", hot=hot).select(F.col("to").alias("w"), F.col("v").alias("u"))
        half = scratch.save(half, f"{name}-h{r}")
        after = split_join(half, maps, "u", hot=hot).select(F.col("w").alias("u"), F.col("to").alias("v")).filter("u <> v").distinct()
        now = scratch.save(after, f"{name}-e{r + 1}")
        scratch.drop(f"{name}-e{r}")
        scratch.drop(f"{name}-h{r}")
    if not steps:
        return both.select(F.col("u").alias("node"), F.col("v").alias("label")).limit(0)
    labels = steps[-1].select(F.col("u").alias("node"), F.col("to").alias("label"))
    for r in range(len(steps) - 2, -1, -1):
        joined = split_join(steps[r].select("u", "to"), labels.select(F.col("node").alias("to"), "label"), "to", "left")
        labels = scratch.save(joined.select(F.col("u").alias("node"), F.coalesce("label", "to").alias("label")), f"{name}-l{r}")
    return labels
