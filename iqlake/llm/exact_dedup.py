"""Exact deduplication by a heavy-hitter split.

A Misra-Gries sketch (Spark's ``approx_top_k``: bounded counters, decremented together when full, merged over partitions)
names the digests (by a 64-bit hash) that may be frequent. Their exact counts and winners are then verified by an ordinary aggregate over just
these digests, and the verified winners, at most ``heavy`` rows whatever the input, are broadcast: rows of frequent
groups get their verdict map-side and are never shuffled. The remaining digests, none of them frequent, are shuffled.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.llm.common import Scratch, sha256_hex

#: Digests that the broadcast may hold, and counters of a sketch. Any digest with more than 1 / COUNTERS of the rows, or
#: somewhat less, is found; one that is missed is only shuffled with the rest, with the same result.
HEAVY, COUNTERS, FAN_IN = 512, 2048, 256


def _winners(rows: DataFrame, heavy: int, counters: int) -> DataFrame:
    """(d, keep_id, group_size) of frequent digests of ``rows`` (id, d), at most ``heavy`` of them, verified by exact counts."""
    # Sketches of partitions meet in a tree, so that no task merges those of the whole table.
    leaves = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("leaf")).agg(F.expr(f"approx_top_k_accumulate(xxhash64(d), {counters})").alias("s"))
    sketch = leaves.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {heavy})").alias("top"))
    often = sketch.select(F.explode("top").alias("t")).filter("t.count > 1").select(F.col("t.item").alias("item"))
    return _groups(rows.join(F.broadcast(often), F.xxhash64("d") == F.col("item"), "left_semi"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("d").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _verdicts(rows: DataFrame, digests: DataFrame, scratch: Scratch, heavy: int, counters: int) -> DataFrame:
    """``rows``, which have a digest d, with keep_id and group_size of their group in ``digests`` (id, d)."""
    winners = scratch.save(_winners(digests, heavy, counters), "winners")
    marked = rows.join(F.broadcast(winners), "d", "left")
    common = marked.filter("group_size is not null")
    rare = marked.filter("group_size is null").select(*rows.columns)
    # Counted map-side; what is not frequent meets its group's count in a join whose larger partitions can be split.
    groups = _groups(digests.join(F.broadcast(winners), "d", "left_anti"))
    return common.unionByName(rare.join(groups, "d"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The row with the largest id stays; a null id counts as the
    smallest. Rows that repeat both id and text are one document listed more than once: they get the same verdict, each
    counts in group_size. An empty table gives an empty result. Other columns of ``df`` are not read, so their names can't
    clash.
    """
    scratch = Scratch(df.sparkSession, "exact")
    digests = scratch.save(df.select(F.col(id_col).alias("id"), F.unhex(sha256_hex(F.col(text_col))).alias("d")), "digests")
    out = _verdicts(digests, digests, scratch, heavy, counters)
    out = scratch.keep(out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("d")).alias("text_sha256")))
    scratch.drop()
    return out


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """``df`` without the rows that lose, its columns unchanged.

    A row is judged by its own text and id: it stays if its id is the largest of the rows with its text (null is smallest),
    whatever other texts have that id. Rows that repeat both id and text stay or go together. Columns may have any names.
    """
    scratch = Scratch(df.sparkSession, "copies")
    digest = F.unhex(sha256_hex(F.col(f"`{text_col}`")))
    digests = scratch.save(df.select(F.col(f"`{id_col}`").alias("id"), digest.alias("d")), "digests")
    whole = df.select(digest.alias("d"), F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return _verdicts(whole, digests, scratch, heavy, counters).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("row.*")
