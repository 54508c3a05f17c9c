"""Files in and out: I/Q CSV pairs, dataset specs, chronological splits, model registry, reports and sealed bundles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODEL = "model_id string, model_type string, version int, knots array<double>, branches array<struct<signal:int,envelope:int>>, terms array<struct<exponent:int,signal:int,envelope:int>>, delays array<int>, conjugate boolean, coef array<struct<re:double,im:double>>"
FIELDS = ["model_id", "model_type", "version", "knots", "branches", "terms", "delays", "conjugate", "coef"]
VERSION = 1


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def load_iq_csv(spark: SparkSession, path: str, checked: bool = True) -> DataFrame:
    """(n, i, q) of a two-column file with header I,Q in any case; empty files and values that are not finite are errors.

    n is the place in the file. Part files follow one another by their part number, then by name, whatever their sizes: each split
    counts its lines, and sums of the counts in order of file and byte offset say where it begins. Every part must have the
    header. The table of counts has a row a split, never one a sample.
    """
    head = spark.read.text(path).limit(1).collect()
    if checked and (not head or [c.strip().lower() for c in head[0][0].split(",")] != ["i", "q"]):
        raise ValueError(f"{path}: the header must be I,Q")
    raw = spark.read.schema("i double, q double").option("header", True).option("enforceSchema", not checked).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "FAILFAST").csv(path)
    # Rows of a split are neighbours in their partition, so within a split this number less the split's least is the line.
    raw = raw.select("i", "q", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_byte"), F.monotonically_increasing_id().alias("_at"))
    bad = F.count_if(~(F.abs("i") < float("inf")) | ~(F.abs("q") < float("inf")) | F.isnan("i") | F.isnan("q") | F.col("i").isNull() | F.col("q").isNull())
    splits = raw.groupBy("_file", "_byte").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_low"), bad.alias("_bad"))
    if checked:
        total = splits.agg(F.sum("_c").alias("c"), F.sum("_bad").alias("bad")).first()
        if not total["c"]:
            raise ValueError(f"{path}: no samples")
        if total["bad"]:
            raise ValueError(f"{path}: values that are not finite")
    number = F.regexp_extract(F.element_at(F.split("_file", "/"), -1), r"^part-(\d+)", 1).cast("long")
    files = splits.groupBy("_file").agg(F.sum("_c").alias("_rows"))
    by_file = Window.orderBy(number.asc_nulls_first(), "_file")  # a row a file
    files = files.select("_file", (F.sum("_rows").over(by_file) - F.col("_rows")).alias("_before"))
    by_byte = Window.partitionBy("_file").orderBy("_byte")
    within = splits.select("_file", "_byte", "_low", (F.sum("_c").over(by_byte) - F.col("_c")).alias("_inner"))
    begins = within.join(files, "_file").select("_file", "_byte", (F.col("_before") + F.col("_inner") - F.col("_low")).alias("_shift"))
    return raw.join(F.broadcast(begins), ["_file", "_byte"]).select((F.col("_at") + F.col("_shift")).alias("n"), "i", "q")


def load_pair(spark: SparkSession, directory: str, split: str) -> DataFrame:
    """(n, i, q, yi, yq) of one split's input and output files, which must be of one length."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split}")
    x, y = load_iq_csv(spark, f"{directory}/{split}_input.csv"), load_iq_csv(spark, f"{directory}/{split}_output.csv")
    if x.count() != y.count():
        raise ValueError(f"{split}: input and output differ in length")
    return x.join(y.select("n", F.col("i").alias("yi"), F.col("q").alias("yq")), "n")


def load_spec(spark: SparkSession, directory: str) -> dict:
    """The optional spec.json, {} if there is none."""
    fs, p = _path(spark, f"{directory}/spec.json")
    if not fs.exists(p):
        return {}
    value = json.loads(spark.read.text(f"{directory}/spec.json", wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError("spec.json must hold an object")
    return value


def write_iq_csv(df: DataFrame, path: str) -> None:
    """I,Q in order of n; doubles are written so that they read back the same."""
    df.orderBy("n").select(F.col("i").alias("I"), F.col("q").alias("Q")).write.mode("errorifexists").option("header", True).csv(path)


def load_waveforms(spark: SparkSession, path: str, columns: dict[str, str], nperseg: int) -> DataFrame:
    """A bundle of waveforms with exactly these columns and whole frames of ``nperseg``."""
    df = spark.read.parquet(path)
    if {f.name: f.dataType.simpleString() for f in df.schema.fields} != columns:
        raise ValueError("unexpected columns")
    if df.groupBy("frame").count().filter(F.col("count") % nperseg != 0).limit(1).count():
        raise ValueError("a frame is not whole")
    return df


def load_blackbox_mat(spark: SparkSession, path: str) -> DataFrame:
    """(n, i, q, yi, yq, ei, eq) of MATLAB 5 containers with numeric vectors x, y and eRef of one length and finite values."""
    from iqlake.sources.matlab import Mat5

    spark.dataSource.register(Mat5)
    rows = spark.read.format("mat5").option("variables", "x,y,eRef").load(path)
    parts = dict(zip(("i", "q", "yi", "yq", "ei", "eq"), ("x_re", "x_im", "y_re", "y_im", "eRef_re", "eRef_im"), strict=True))
    value = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} has values that are not finite")).cast("double"))
    return rows.select("n", *[value(c).alias(name) for name, c in parts.items()])


def chronological(df: DataFrame, train: int, val: int, test: int) -> DataFrame:
    """split by n: [train, val) train, [val, test) val, [test, end) test; rows before ``train`` are left out."""
    if not 0 <= train < val < test:
        raise ValueError("cuts must ascend")
    return df.filter(F.col("n") >= train).withColumn("split", F.when(F.col("n") < val, "train").when(F.col("n") < test, "val").otherwise("test"))


def prepare(df: DataFrame, directory: str, train: int, val: int, test: int) -> dict:
    """Writes selection splits and the sealed test apart, scaled by the training input's peak; the manifest comes last."""
    spark = df.sparkSession
    split = chronological(df, train, val, test)
    peak = split.filter("split = 'train'").agg(F.sqrt(F.max(F.expr("i*i + q*q"))).alias("p")).first()["p"]
    scaled = split.select("n", "split", *[(F.col(c) / peak).alias(c) for c in ("i", "q", "yi", "yq")])
    scaled.filter("split <> 'test'").write.mode("errorifexists").partitionBy("split").parquet(f"{directory}/selection")
    scaled.filter("split = 'test'").write.mode("errorifexists").parquet(f"{directory}/sealed_test")
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    manifest = {"peak": peak, "cuts": [train, val, test], "counts": counts}
    write_json(spark, manifest, f"{directory}/manifest")
    return manifest


def json_ready(value: object) -> object:
    """Complex numbers as {real, imag}, arrays as lists, numbers that are not finite as null."""
    if isinstance(value, complex):
        return {"real": value.real, "imag": value.imag}
    if hasattr(value, "tolist"):
        return json_ready(value.tolist())
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One JSON document by Spark's committer: there whole or not at all, and never over another."""
    spark.createDataFrame([(json.dumps(json_ready(value), sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def save_models(spark: SparkSession, rows: list[dict], path: str) -> None:
    spark.createDataFrame([tuple({"version": VERSION, **r}.get(f) for f in FIELDS) for r in rows], MODEL).coalesce(1).write.mode("append").parquet(path)


def load_model(spark: SparkSession, path: str, model_id: str, model_type: str) -> dict:
    """A model row of the expected type and version: a forward model is never loaded as a predistorter."""
    got = spark.read.schema(MODEL).parquet(path).filter(F.col("model_id") == model_id).collect()
    if len(got) != 1:
        raise ValueError(f"{len(got)} models {model_id}")
    row = got[0].asDict(recursive=True)
    if row["model_type"] != model_type or row["version"] != VERSION:
        raise ValueError(f"{model_id} is {row['model_type']} version {row['version']}")
    return row


def publish(frames: dict[str, DataFrame], manifest: dict, directory: str) -> None:
    """A bundle of tables, never over an existing one, its manifest last: without a manifest it isn't published."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{directory}/{name}")
    write_json(spark, manifest, f"{directory}/manifest")


def read_bundle(spark: SparkSession, directory: str) -> tuple[dict, dict[str, DataFrame]]:
    fs, p = _path(spark, f"{directory}/manifest/_SUCCESS")
    if not fs.exists(p):
        raise ValueError("the bundle is not published")
    manifest = json.loads(spark.read.text(f"{directory}/manifest").first()[0])
    return manifest, {name: spark.read.parquet(f"{directory}/{name}") for name in manifest["tables"]}


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir`` or, where that is unset (a local run), in the warehouse.

    It is removed when the program ends.
    """
    import atexit
    import contextlib
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    at = f"{root}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                fs, p = _path(spark, at)
                fs.delete(p, True)

    atexit.register(drop)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a workspace and read back: what several jobs read is computed once."""
    at = workspace(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
