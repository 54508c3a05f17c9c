"""Whether a selected model may be released: rules as data over evidence from tables.

Evidence is one row a model, a column a finding, each worked out from tables of its own: metrics found again against those frozen,
digests of files, a stream's output against the batch, folds against each other. A rule says which figure stands in what relation to which
limit. A figure that is null, because its table has nothing on the model, fails its rules; so no rule takes the greatest of several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iqlake.plans.select import gates


@dataclass(frozen=True)
class Rule:
    """``left`` is SQL over the evidence; ``limit`` names one of the limits, or is a number."""

    name: str
    left: str
    relation: str
    limit: str | float

    def column(self, limits: dict[str, float]) -> Column:
        right = limits[self.limit] if isinstance(self.limit, str) else self.limit
        return F.expr(f"({self.left}) {self.relation} {right!r}D")

    def sql(self, limits: dict[str, float]) -> str:
        """The rule for another engine, null counting as false."""
        right = limits[self.limit] if isinstance(self.limit, str) else self.limit
        return f"coalesce(({self.left}) {self.relation} {right!r}, false)"


def none_of(name: str, figure: str) -> Rule:
    return Rule(name, figure, "=", 0.0)


def within(name: str, figure: str, limit: str) -> Rule:
    return Rule(name, figure, "<=", limit)


#: What a release needs, by the question that a rule answers.
RULES = (
    # Is the evidence that of the frozen model, on the frozen data, under the frozen limits?
    none_of("files_unchanged", "changed_files"),
    none_of("protocol_unchanged", "changed_settings"),
    within("limits_from_formula", "limit_drift", "drift"),
    none_of("one_recipe_throughout", "recipes - 1"),
    none_of("operations_recounted", "recounted_mul - mul"),
    none_of("edges_as_declared", "abs(warmup - declared_warmup) + abs(cooldown - declared_cooldown)"),
    # Do the numbers come out again?
    within("reference_found_again", "reference_drift", "drift"),
    within("training_found_again", "training_drift", "drift"),
    within("validation_found_again", "validation_drift", "drift"),
    # Does the model run as a stream, each frame from rest, without looking ahead?
    within("stream_as_batch", "stream_gap", "stream"),
    within("frames_from_rest", "reset_gap", "stream"),
    none_of("no_lookahead", "lookahead"),
    # Are the folds sound and alike, and is nothing scored beyond what was fitted?
    none_of("folds_solved", "unsolved_folds"),
    within("folds_alike_in_condition", "condition_ratio", "condition_ratio"),
    within("folds_alike_in_norm", "norm_ratio", "norm_ratio"),
    within("folds_in_support", "peak_ratio", "peak_ratio"),
    none_of("validation_in_support", "above_support"),
    # Is it better than the reference, on new data too, everywhere in a frame, and cheap enough?
    Rule("gain", "reference_db - score_db", ">=", "gain_db"),
    Rule("gain_inside", "reference_common_db - common_db", ">=", "common_gain_db"),
    within("holds_on_validation", "validation_db - score_db", "gap_db"),
    within("holds_inside", "validation_common_db - common_db", "gap_db"),
    within("edges_in_folds", "abs(score_db - common_db)", "edge_db"),
    within("edges_in_validation", "abs(validation_db - validation_common_db)", "edge_db"),
    Rule("affordable", "mul", "<", "mul"),
    none_of("diagnostics_complete", "missing_tables"),
)


def drift(found: DataFrame, frozen: DataFrame, key: str, name: str, value: str, out: str) -> DataFrame:
    """(key, out): the largest difference of a frozen value and the one found again, relative to 1 + its size; infinite where one is missing.

    A model has a name once in each table.
    """
    there = frozen.select(key, name, F.col(value).alias("_v")).join(found.select(key, name, F.col(value).alias("_w")), [key, name], "left")
    off = F.abs(F.col("_v") - F.col("_w")) / (1 + F.abs("_v"))
    return there.groupBy(key).agg(F.max(F.when(off.isNull() | F.isnan(off), float("inf")).otherwise(off)).alias(out))


def changed(found: DataFrame, frozen: DataFrame, key: str, name: str, value: str, out: str) -> DataFrame:
    """(key, out): how many frozen names have another value now, or none; nulls are equal to nulls."""
    there = frozen.select(key, name, F.col(value).alias("_v")).join(found.select(key, name, F.col(value).alias("_w"), F.lit(True).alias("_is")), [key, name], "left")
    return there.groupBy(key).agg(F.count_if(~F.coalesce("_is", F.lit(False)) | ~F.col("_v").eqNullSafe(F.col("_w"))).alias(out))


def missing(present: DataFrame, required: list[str], key: str, name: str, out: str) -> DataFrame:
    """(key, out): how many of the ``required`` names a model lacks."""
    return present.groupBy(key).agg((F.lit(len(set(required))) - F.size(F.collect_set(F.when(F.col(name).isin(required), F.col(name))))).alias(out))


def stream_gaps(streamed: DataFrame, batch: DataFrame, key: str, reach: int) -> DataFrame:
    """(key, stream_gap, reset_gap) of outputs (key, frame, n, pos, pi, pq): largest distances, over all samples and over each frame's first ``reach``.

    A sample that one side lacks is infinitely far.
    """
    a = streamed.select(key, "frame", "n", F.col("pi").alias("_si"), F.col("pq").alias("_sq"))
    both = batch.select(key, "frame", "n", "pos", "pi", "pq").join(a, [key, "frame", "n"], "full")
    off = F.sqrt((F.col("pi") - F.col("_si")) ** 2 + (F.col("pq") - F.col("_sq")) ** 2)
    off = F.when(off.isNull() | F.isnan(off), float("inf")).otherwise(off)
    first = F.coalesce(F.col("pos") < reach, F.lit(True))
    return both.withColumn("_off", off).groupBy(key).agg(F.max("_off").alias("stream_gap"), F.coalesce(F.max(F.when(first, F.col("_off"))), F.lit(0.0)).alias("reset_gap"))


def folds_found(folds: DataFrame, key: str) -> DataFrame:
    """(key, recipes, unsolved_folds, condition_ratio, norm_ratio, peak_ratio) of a row a fold (key, recipe, width, rank, condition, norm, held_peak, fit_peak)."""
    finite = F.col("condition").isNotNull() & ~F.isnan("condition") & (F.col("condition") < float("inf"))
    return folds.groupBy(key).agg(
        F.count_distinct("recipe").alias("recipes"), F.count_if(~F.coalesce(finite & (F.col("rank") == F.col("width")), F.lit(False))).alias("unsolved_folds"),
        (F.max("condition") / F.min("condition")).alias("condition_ratio"), (F.max("norm") / F.min("norm")).alias("norm_ratio"), F.max(F.col("held_peak") / F.col("fit_peak")).alias("peak_ratio"),
    )


def decide(models: DataFrame, evidence: list[DataFrame], limits: dict[str, float], key: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``models`` with the columns of ``evidence`` (each one row a key), a boolean for each rule, ``passed`` for all, and the names that ``failed``."""
    for table in evidence:
        models = models.join(table, key, "left")
    out = gates(models, {r.name: r.column(limits) for r in rules})
    return out.withColumn("failed", F.array_compact(F.array(*[F.when(~F.col(r.name), F.lit(r.name)) for r in rules])))
