"""Protocols, hashes, registries and manifests: what is frozen, and proof that it still is."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iqlake.operators.align import delay_scores, fractional_diagnostic, integer_delay
from iqlake.operators.frames import checked_role
from iqlake.operators.metrics import bundle, frozen_reference, ls_gain, mean_frame_nmse


#: Hex digits of a level of ``content_hash``, and rows that a bucket of the lowest level is meant to have.
DIGITS, BUCKET = 3, 4096


def row_hash(*cols: str) -> Column:
    """SHA-256 of the columns as text, joined by a bar; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def content_hash(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One hash per group of ``keys``, the same whatever the order or partitioning of rows, repeated rows counted.

    A tree: the rows' hashes fall by their first digits into buckets, DIGITS for each level, with as few levels as make the buckets of
    all rows about BUCKET long. A bucket's value is the SHA-256 of its sorted hashes, that of a bucket above it the
    SHA-256 of its sorted (name, value) list, up to the group's. No list is longer than 16 ** DIGITS, or a bucket.
    """
    rows, levels = df.count(), 0
    while rows > BUCKET * 16 ** (DIGITS * levels):
        levels += 1
    list_hash = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256).alias("_v")
    parts = df.withColumn("_h", row_hash(*cols)).groupBy(*keys, F.substring("_h", 1, DIGITS * levels).alias("_b")).agg(list_hash("_h"))
    for level in range(levels - 1, -1, -1):
        parts = parts.groupBy(*keys, F.substring("_b", 1, DIGITS * level).alias("_b")).agg(list_hash(F.concat("_b", "_v")))
    return parts.select(*keys, F.col("_v").alias("sha256"))


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def mismatches(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Manifest rows (name, sha256) with no equal observed row."""
    return manifest.join(observed, ["name", "sha256"], "left_anti")


def reproduced(frozen: DataFrame, again: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows of both, and whether they agree within ``tolerance``; a missing row does not."""
    a, b = frozen.select(*keys, F.col(value).alias("frozen")), again.select(*keys, F.col(value).alias("again"))
    return a.join(b, keys, "full").withColumn("same", F.coalesce(F.abs(F.col("frozen") - F.col("again")) <= tolerance, F.lit(False)))


@dataclass(frozen=True)
class Protocol:
    """Train-only quantities that every later evaluation uses as they are."""

    delay: int
    fractional: float | None
    gain: complex
    peak_ratio: float
    maximum: float
    edges: tuple[float, ...]
    warmup: int
    nperseg: int

    def sha256(self) -> str:
        return canonical_sha256([self.delay, self.fractional, self.gain.real, self.gain.imag, self.peak_ratio, self.maximum, list(self.edges), self.warmup, self.nperseg])


def freeze_protocol(train: DataFrame, nperseg: int, most: int, bins: int, warmup: int) -> Protocol:
    """Delay, gain, amplitude range and bin edges of the training pair (n, i, q, yi, yq)."""
    scores = delay_scores(train, train, most).cache()
    d = integer_delay(scores).first()["d"]
    f = fractional_diagnostic(scores).first()["fractional_delay"]
    scores.unpersist()
    re, im = ls_gain()
    r = train.agg(re.alias("re"), im.alias("im"), F.sqrt(F.max(F.expr("yi*yi + yq*yq")) / F.max(F.expr("i*i + q*q"))).alias("peak")).first()
    ref = frozen_reference(train, bins).first()
    return Protocol(int(d), f, complex(r["re"], r["im"]), r["peak"], ref["maximum"], tuple(ref["edges"]), warmup, nperseg)


def evaluate(predict, df: DataFrame, protocol: Protocol, split: str, purpose: str) -> dict[str, DataFrame]:  # noqa: ANN001
    """Pooled, common and per-frame metrics of ``predict`` (a DataFrame function that adds pi, pq) under a frozen protocol."""
    checked_role(split, purpose)
    if protocol.delay:
        raise ValueError("a delayed record must be aligned before it is framed")
    p = predict(df)
    est, ref = ("pi", "pq"), ("yi", "yq")
    return {"pooled": p.agg(*bundle(est, ref)), "common": p.agg(*bundle(est, ref, F.col("pos") >= protocol.warmup)), "frames": mean_frame_nmse(p, est, ref, protocol.nperseg)}


def transfer(source, target_train: DataFrame, target_eval: DataFrame, refit, samples: list[int], most: int) -> dict[str, object]:  # noqa: ANN001
    """Zero-shot score, delay and gain of the target, and coefficient-only refits on the first ``samples`` of each frame."""
    from iqlake.operators.align import align_and_gain
    from iqlake.operators.frames import prefix
    from iqlake.operators.metrics import nmse_db

    est, ref = ("pi", "pq"), ("yi", "yq")
    out: dict[str, object] = {"zero_shot": source.predict(target_eval).agg(nmse_db(est, ref).alias("db")), "nuisance": align_and_gain(target_train, target_train, most=most)}
    for n in samples:
        out[f"refit_{n}"] = refit(prefix(target_train, n)).predict(target_eval).agg(nmse_db(est, ref).alias("db"))
    return out


def freeze_selection(spark: SparkSession, row: dict, binding: dict, directory: str) -> dict:
    """Publishes one selected model with what it is bound to (delay, scale, protocol hash); the manifest with both hashes comes last."""
    from iqlake.sources import io

    io.save_models(spark, [row], f"{directory}/models")
    stored = io.load_model(spark, f"{directory}/models", row["model_id"], row["model_type"])
    manifest = {"model_id": row["model_id"], "model_type": row["model_type"], "binding": binding, "model_sha256": canonical_sha256(stored), "binding_sha256": canonical_sha256(binding), "tables": ["models"]}
    io.write_json(spark, manifest, f"{directory}/manifest")
    return manifest


def load_frozen(spark: SparkSession, directory: str, binding: dict) -> dict:
    """The model row of a published selection, only if model and binding are what was frozen, and the binding is the caller's."""
    from iqlake.sources import io

    manifest, _ = io.read_bundle(spark, directory)
    row = io.load_model(spark, f"{directory}/models", manifest["model_id"], manifest["model_type"])
    if canonical_sha256(row) != manifest["model_sha256"] or canonical_sha256(manifest["binding"]) != manifest["binding_sha256"]:
        raise ValueError("the selection is not what was frozen")
    if manifest["binding"] != binding:
        raise ValueError("the model is bound to another delay, scale or protocol")
    return row


def evaluate_frozen(spark: SparkSession, directory: str, binding: dict, df: DataFrame, split: str, purpose: str) -> DataFrame:
    """Pooled metrics of a frozen term model on ``df``; hashes are checked before any sample is read."""
    from iqlake.operators.features import Term
    from iqlake.operators.models import TermModel

    checked_role(split, purpose)
    row = load_frozen(spark, directory, binding)
    model = TermModel([Term(**t) for t in row["terms"]], [complex(c["re"], c["im"]) for c in row["coef"]])
    return model.predict(df).agg(*bundle(("pi", "pq"), ("yi", "yq")))
