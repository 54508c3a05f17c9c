"""Shared plumbing of the training-data operators: scratch tables, two-level ranks, digests."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that separate words: space and U+0009 to U+000D, nothing else.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where it is unset (a local run), one in the warehouse."""
    jsc = spark.sparkContext._jsc.sc()
    at = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if at is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.sparkContext.setCheckpointDir(at)
    return at or jsc.getCheckpointDir().get()


#: How tables are written. They need their shuffle files no more; without the first these stay until the driver happens to
#: collect garbage. Rows go to Python in batches of 4 MB: a task holds Spark's own 64 MB several times, in the JVM and in Python.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


class Scratch:
    """Written tables that cut lineage within one operator call.

    Tables are compressed Parquet in the shared folder, so a lost executor costs a reread and never a recomputation of
    everything before. ``keep`` gives a result that outlives the scratch: a reliable checkpoint. Spark removes it once no plan
    refers to it where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true (set it when the session is built; the
    default is false); elsewhere it stays in the checkpoint folder like any other checkpoint.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.root = f"{scratch_root(spark)}/{self.name}"
        self.tables: list[str] = []
        self.saved: set[str] = set()
        atexit.register(self._last)

    def _last(self) -> None:
        """What a lazy result still needed goes when the program ends."""
        with contextlib.suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                self.drop()

    def save(self, df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
        """Writes ``df``, planned under ``conf``, and reads it back."""
        path = f"{self.root}/{name}"
        self.saved.add(name)
        with self.planned(WRITING | (conf or {})):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_by(self, df: DataFrame, name: str, key: str, sort: bool = False) -> DataFrame:
        """Writes ``df`` bucketed by ``key``, so that joins on it with other such tables need no shuffle, and reads it back.

        With ``sort`` each bucket is sorted by ``key``, and merge joins of such tables need no sort.

        There are as many buckets as the session has shuffle partitions, which a cluster sizes for its data.
        """
        number, table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"{self.name}_{name}"
        with self.planned(WRITING | ({"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"} if sort else {})):
            made = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(min(number, 100_000), key)
            (made.sortBy(key) if sort else made).saveAsTable(table)
        self.tables.append(table)
        self.saved.add(name)
        return self.spark.table(table)

    @contextlib.contextmanager
    def planned(self, conf: dict[str, str]) -> Iterator[None]:
        """What is planned inside is planned under ``conf``."""
        before = {k: self.spark.conf.get(k) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def keep(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)

    def only(self, *names: str) -> None:
        """Drops all tables but these."""
        for name in sorted(self.saved - set(names)):
            self.drop(name)

    def drop(self, name: str = "") -> None:
        for t in [t for t in self.tables if not name or t == f"{self.name}_{name}"]:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self.tables.remove(t)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.saved.discard(name)
        if not name:
            atexit.unregister(self._last)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spread_hash(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def dense_ranks(df: DataFrame, key: list[str], order: list[str], rows_per_bucket: int = 16384, rank: str = "rank", together: str | None = None) -> DataFrame:
    """Adds a gapless 0-based rank within ``key`` without gathering a key in one task.

    A key with many rows is dealt over sub-buckets by a hash of ``order``; rows are ranked inside a sub-bucket and shifted by
    the sizes of the sub-buckets before it. ``order`` should tell rows apart; equal rows get distinct ranks in any order.
    With ``together`` (a column that decides ``key``) its equal values get consecutive ranks: sub-buckets are ranges of its
    hash, and a value with more rows than a sub-bucket holds has sub-buckets of its own. Needs a ``df`` that reads the same
    twice (a written table).
    """
    total = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_total")).select(*key, F.greatest(F.lit(1), F.ceil(F.col("_total") / rows_per_bucket)).cast("long").alias("_n"))
    mixed = F.xxhash64(*[F.col(c) for c in order], F.lit(7))
    bucket = ["_b", "_v", "_w"]
    if together is None:
        dealt = _same(df, total, key).withColumns({"_b": F.pmod(mixed, F.col("_n")), "_v": F.lit(0).cast("long"), "_w": F.lit(0).cast("long")})
        first = []
    else:
        value = F.xxhash64(F.col(together), F.lit(9))
        many = df.groupBy(together).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > rows_per_bucket).withColumn("_p", F.ceil(F.col("_c") / rows_per_bucket).cast("long"))
        dealt = _same(split_join(df, many.select(together, "_p"), together, "left", hottest(many, together, "_c")), total, key)
        own = F.col("_p").isNotNull()
        dealt = dealt.withColumns({"_b": F.shiftright(F.shiftrightunsigned(value, 33) * F.col("_n"), 31), "_v": F.when(own, value), "_w": F.when(own, F.pmod(mixed, F.col("_p")))}).drop("_p")
        dealt = dealt.fillna(0, ["_v", "_w"])
        first = [value]
    counts = dealt.groupBy(*key, *bucket).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(*key, *bucket, (F.sum("_c").over(Window.partitionBy(*key).orderBy(*bucket)) - F.col("_c")).alias("_before"))
    within = Window.partitionBy(*key, *bucket).orderBy(*first, F.xxhash64(*[F.col(c) for c in order]), *[F.col(c) for c in order])
    ranked = dealt.withColumn("_r", F.row_number().over(within) - 1)
    return _same(ranked, before, [*key, *bucket]).withColumn(rank, (F.col("_r") + F.col("_before")).cast("long")).drop("_r", "_before", "_n", *bucket)


def _same(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on null-safe equality of ``key``, keeping the left side's key columns."""
    named = right.select(*[F.col(c).alias(f"_k_{c}") if c in key else F.col(c) for c in right.columns])
    cond = None
    for c in key:
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        cond = one if cond is None else cond & one
    return left.join(named, cond).drop(*[f"_k_{c}" for c in key])


#: Keys that a split join may broadcast, and rows that make a key worth it.
HOT_KEYS, HOT_ROWS = 512, 64


def hottest(rows: DataFrame, key: str, count: str) -> DataFrame:
    """At most HOT_KEYS keys, those with the largest ``count``."""
    return rows.filter(F.col(count) >= HOT_ROWS).orderBy(F.desc(count), key).limit(HOT_KEYS).select(key)


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has each ``key`` once, without gathering a frequent key's rows in one task.

    The rows of ``right`` for the most frequent keys of ``left`` (at most HOT_KEYS, whatever the input) are broadcast; the
    others are shuffled, and none of them has more than 1 / HOT_KEYS of the rows. Needs a ``left`` that reads the same twice.
    """
    if hot is None:
        hot = hottest(left.groupBy(key).agg(F.count(F.lit(1)).alias("_c")), key, "_c")
    names = hot.collect()  # HOT_KEYS at most
    if not names:
        return left.join(right, key, how)
    hot = left.sparkSession.createDataFrame(names, hot.schema)
    known = right.join(F.broadcast(hot), key, "left_semi").withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(known), key, "left")
    common = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").select(*left.columns).join(right, key, how)
    return common.unionByName(rest)


def need(df: DataFrame, **kinds: type | tuple) -> None:
    for name, kind in kinds.items():
        got = df.schema[name].dataType
        if not isinstance(got, kind):
            raise TypeError(f"column {name} is {got.simpleString()}")


LONG = T.LongType()
