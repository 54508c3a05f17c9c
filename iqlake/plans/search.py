"""Out-of-fold search over model topologies and ridges, its trial ledger and its gates.

All topologies are subsets of one dictionary, so one R factor a frame of the whole dictionary serves every trial: a subset's
factor is that of some of its columns, the fit on all other frames comes from the merged factor of the others, and the error
on the frame held out is the norm of its own factor times the solution. Rows are read once a call of ``folds``, whatever the number of
trials: the factors, and those without each frame's first samples, are written, and all that follows reads them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iqlake.operators import features
from iqlake.operators.features import Term
from iqlake.operators.solve import _factor, _read, others, solve, term_factors
from iqlake.plans import cost, select
from iqlake.plans.fits import Report, fit_terms
from iqlake.plans.govern import canonical_sha256, content_hash
from iqlake.sources import io


@dataclass(frozen=True)
class Recipe:
    """A topology: its terms, and its multiplications per sample."""

    name: str
    terms: tuple[Term, ...]
    mul: int

    @staticmethod
    def generalized(name: str, **sizes: int) -> Recipe:
        return Recipe(name, tuple(features.generalized(**sizes)), cost.generalized(**sizes).mul)


FOLDS = "recipe string, ridge double, frame long, width int, rank int, condition double, norm double, rows long, scored long, error double, power double, common_error double, common_power double"


def folds(df: DataFrame, recipes: list[Recipe], ridges: list[float], warmup: int) -> DataFrame:
    """A row for each recipe, ridge and held-out frame of (frame, n, pos, i, q, yi, yq): the fit on all others, and its error there.

    Coefficients are scaled by column RMS before the ridge acts. ``common`` errors leave out the first ``warmup`` samples.
    """
    if len({r.name for r in recipes}) != len(recipes) or not recipes or not ridges:
        raise ValueError("recipes must have names of their own")
    terms = list(dict.fromkeys(t for r in recipes for t in r.terms))
    place = {t: k for k, t in enumerate(terms)}
    width = len(terms) + 1
    trials = [(r.name, [place[t] for t in r.terms] + [width - 1]) for r in recipes]
    own = io.written(term_factors(df, terms, True, late=warmup), "factors")
    rest = others(own.select("group", "rows", "r"), width).select("group", F.col("rows").alias("fitted"), F.col("r").alias("rest"))
    both = own.join(rest, "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                whole, others_, late = _read(row["r"], width), _read(row["rest"], width), _read(row["steady"] or b"", width)
                for name, columns in trials:
                    base = _factor(others_[:, columns]) if row["fitted"] else None
                    for ridge in ridges:
                        got = solve(row["fitted"], base, ridge, scaled=True) if base is not None else None
                        c = np.append(got.coef, -1) if got else np.full(len(columns), np.nan)
                        error, common = (float((np.abs(x[:, columns] @ c) ** 2).sum()) for x in (whole, late))
                        power, common_power = (float((np.abs(x[:, -1]) ** 2).sum()) for x in (whole, late))
                        out.append((name, ridge, row["group"], len(columns) - 1, got.rank if got else 0, got.condition if got else np.inf, float(np.linalg.norm(c[:-1])), row["rows"], row["scored"] or 0, error, power, common, common_power))
            names = [x.split(" ")[0] for x in FOLDS.split(", ")]
            kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[x.split(" ")[1]]) for v, x in zip(zip(*out) if out else [[]] * len(names), FOLDS.split(", "), strict=True)], names=names)

    return both.mapInArrow(run, FOLDS)


def _db(error: str, power: str) -> Column:
    return F.when(F.sum(error) == 0, float("-inf")).otherwise(10 * F.log10(F.sum(error) / F.sum(power)))


def trials(scores: DataFrame, recipes: list[Recipe], stage: str) -> DataFrame:
    """The ledger: a row for each recipe and ridge of ``folds``; a fit without full rank or finite scores stays, but is not valid."""
    costs = scores.sparkSession.createDataFrame([(r.name, r.mul) for r in recipes], "recipe string, mul long")
    rows = scores.groupBy("recipe", "ridge").agg(
        F.count(F.lit(1)).alias("frames"), F.first("width").alias("width"), _db("error", "power").alias("score_db"), _db("common_error", "common_power").alias("common_db"),
        F.min(F.col("rank") - F.col("width")).alias("_short"), F.max("condition").alias("condition"), (F.max("condition") / F.min("condition")).alias("condition_ratio"), (F.max("norm") / F.min("norm")).alias("norm_ratio"),
    )
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) < float("inf"))
    valid = (F.col("_short") == 0) & finite("score_db") & finite("common_db") & finite("condition")
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False))).join(F.broadcast(costs), "recipe").withColumn("stage", F.lit(stage)).drop("_short")


#: What tells a sample of a record from another, for the record's hash.
RECORD = ["frame", "n", "i", "q", "yi", "yq"]


class Ledger:
    """Trials kept in a folder, so that a search that was stopped goes on where it was.

    A trial's key is the hash of its recipe's terms, its ridge, and the hash of the record and warm-up it was scored on: another
    record, or a recipe of the same name with other terms, is another trial. Trials are appended by Spark's committer, all of a call or none.
    """

    def __init__(self, spark: SparkSession, path: str, df: DataFrame, warmup: int) -> None:
        self.spark, self.path, self.df, self.warmup = spark, path, df, warmup
        hashes = content_hash(df, [], RECORD).collect()
        self.record = canonical_sha256([hashes[0]["sha256"] if hashes else "", warmup])

    @staticmethod
    def key(recipe: Recipe) -> str:
        return canonical_sha256([[t.exponent, t.signal, t.envelope] for t in recipe.terms])

    def made(self) -> DataFrame | None:
        """This record's trials, once each."""
        fs, at = io._path(self.spark, self.path)
        if not fs.exists(at):
            return None
        rows = self.spark.read.parquet(self.path)
        return rows.filter(F.col("record") == self.record).dropDuplicates(["recipe_key", "ridge"])

    def _wanted(self, recipes: list[Recipe], ridges: list[float]) -> DataFrame:
        return self.spark.createDataFrame([(self.key(r), r.name, float(x)) for r in recipes for x in dict.fromkeys(ridges)], "recipe_key string, recipe string, ridge double")

    def kept(self, recipes: list[Recipe], ridges: list[float], stage: str) -> DataFrame:
        """The trials of these recipes and ridges that are there now.

        Spark takes two scans of a folder for one, whatever files each has listed, so results from before and after an append
        must not meet in one plan.
        """
        rows = self.made().drop("recipe", "record", "stage")
        return self._wanted(recipes, ridges).join(rows, ["recipe_key", "ridge"]).drop("recipe_key").withColumn("stage", F.lit(stage))

    def trials(self, recipes: list[Recipe], ridges: list[float], stage: str) -> DataFrame:
        """``trials`` of all recipes and ridges: those that are not there yet are made and kept."""
        wanted = self._wanted(recipes, ridges)
        made = self.made()
        left = wanted if made is None else wanted.join(made, ["recipe_key", "ridge"], "left_anti")
        todo = left.select(*wanted.columns).collect()  # of a declared budget
        if todo:
            names = {r["recipe"] for r in todo}
            some = [r for r in recipes if r.name in names]
            new = trials(folds(self.df, some, sorted({r["ridge"] for r in todo}), self.warmup), some, stage)
            new = new.join(F.broadcast(self.spark.createDataFrame(todo, wanted.schema)), ["recipe", "ridge"])
            new.withColumn("record", F.lit(self.record)).write.mode("append").parquet(self.path)
        return self.kept(recipes, ridges, stage)


@dataclass(frozen=True)
class Search:
    ledger: DataFrame
    recipe: Recipe
    ridge: float
    model: object
    report: Report


def search(df: DataFrame, recipes: list[Recipe], base_ridge: float, ridges: list[float], warmup: int, budget: int, tolerance_db: float = 0.05, tie_db: float = 0.01, most: int = 3, ledger: str | None = None) -> Search:
    """Two stages: topologies at ``base_ridge``, then ``ridges`` for those kept; the winner is fitted on all frames.

    Kept are up to ``most`` topologies within ``tolerance_db`` of the best, fewer multiplications first; of a topology's ridges
    the strongest within ``tie_db`` of its best; of those the best score, ties to fewer multiplications. ``budget`` is the
    declared number of trials, which must be what the stages use at most. The ledger has the trials of both stages; with a folder
    ``ledger`` it is kept there, and only trials that it lacks are made.
    """
    select.checked_budget(budget, len(recipes), most * len(ridges))
    kept_in = Ledger(df.sparkSession, ledger, df, warmup) if ledger else None

    def stage(some: list[Recipe], levels: list[float], name: str) -> DataFrame:
        return kept_in.trials(some, levels, name) if kept_in else trials(folds(df, some, levels, warmup), some, name)

    first = stage(recipes, [base_ridge], "topology")
    kept = [r["recipe"] for r in select.retained(first, most, tolerance_db, "mul", "score_db", "recipe").collect()]
    if not kept:
        raise ValueError("no topology has a valid fit")
    left = [r for r in recipes if r.name in kept]
    second = stage(left, ridges, "ridge")
    first = kept_in.kept(recipes, [base_ridge], "topology") if kept_in else first
    ridge = select.strongest_ridge(second, tie_db)
    top = select.best(ridge.filter("valid"), "score_db", "mul", "recipe").first()
    if top is None:
        raise ValueError("no ridge has a valid fit")
    recipe = next(r for r in recipes if r.name == top["recipe"])
    model, report = fit_terms(df, list(recipe.terms), top["ridge"])
    return Search(first.unionByName(second), recipe, top["ridge"], model, report)
