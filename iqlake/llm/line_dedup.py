"""Line deduplication over levelled sorted runs of line hashes.

A run is a written table of (h, docs, keep): the hash of a line's key, in how many documents of its batches it was found, the
largest id of these. Runs are bucketed and sorted by h, so that runs and batches merge without moving a run. Documents come
in batches, the largest ids first. A batch's keys are counted (partial sums before every shuffle), merge-anti-joined with the
runs, which removes the keys that a run has already settled (found in enough documents, the largest of them no smaller), and
the others are added as the batch's own run of level 0. Two runs of a level are compacted into one of the next, so that there
are as many runs as the logarithm of the batches. At the end all are compacted, and their sums tell the frequent keys; the lines that hold one are found
by a join in which the most frequent keys are broadcast, and only places of lines to drop meet the texts.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iqlake.llm.common import Scratch, hottest, need, sha256_hex, split_join

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of one table; they change cost only.
BATCHES = 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """``line`` without ASCII white space at both ends, A-Z lower-cased, nothing else changed."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """The runs of all batches so far, in the shared folder. All rows of one id must come in one batch."""

    def __init__(self, spark: SparkSession, scratch: Scratch, min_docs: int = MIN_DOCS) -> None:
        self.spark, self.scratch, self.min_docs = spark, scratch, min_docs
        #: The name of each level's run, or "".
        self.levels: list[str] = []
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"run{self.made}"
        self.scratch.save_by(rows, name, "h", sort=True)
        return name

    def _read(self, name: str, mark: str = "") -> DataFrame:
        run = self.spark.table(f"{self.scratch.name}_{name}")
        return run.select(*[F.col(c).alias(f"{c}{mark}") for c in run.columns])

    def _merge(self, one: str, other: str) -> str:
        """Both runs are bucketed and sorted by h, so that they merge in place."""
        both = self._read(one).join(self._read(other, "_").hint("merge"), F.col("h") == F.col("h_"), "full")
        sums = F.coalesce("docs", F.lit(0)) + F.coalesce("docs_", F.lit(0))
        merged = self._write(both.select(F.coalesce("h", "h_").alias("h"), sums.alias("docs"), F.greatest("keep", "keep_").alias("keep")))
        self.scratch.drop(one)
        self.scratch.drop(other)
        return merged

    def add(self, found: DataFrame) -> None:
        """Adds a batch ``found`` (h, id); an id may repeat, and counts once for each key."""
        # The first shuffle is by key and document, so that no key is large in it; then a task sends one row for each key.
        own = found.groupBy("h", "id").agg(F.lit(1).alias("_")).groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keep"))
        for name in filter(None, reversed(self.levels)):
            settled = self._read(name, "_").filter(F.col("docs_") >= self.min_docs).hint("merge")
            no_larger = F.col("keep").isNull() | (F.col("keep") <= F.col("keep_"))
            own = own.join(settled, (F.col("h") == F.col("h_")) & no_larger, "left_anti")
        run, level = self._write(own), 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._merge(self.levels[level], run), ""
            level += 1
        self.levels[level : level + 1] = [run]

    def frequent(self) -> DataFrame:
        """(h, docs, keep) of the keys found in at least ``min_docs`` documents, after a batch; compacts all runs into one."""
        first, *others = filter(None, self.levels)
        for name in others:
            first = self._merge(name, first)
        self.levels = [""] * (len(self.levels) - 1) + [first]
        return self._read(first).filter(F.col("docs") >= self.min_docs)


def _cuts(rows: DataFrame, batches: int) -> list[int]:
    """At most ``batches`` - 1 ids, ascending, between which about equally many rows lie."""
    if batches < 2:
        return []
    got = rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000).alias("at")).first()["at"]
    return sorted(set(got or []))


def _kept(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, more: dict[str, Column]) -> DataFrame:
    """(lines, gone) of every row with the columns ``more``: the text's lines and the ascending places of those that go, or null."""
    need(df, **{id_col: T.IntegralType, text_col: T.StringType})
    row_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    mark = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    keyed = F.transform(_lines(text), lambda x, p: F.struct(line_key(x).alias("k"), p.alias("p")))
    keyed = F.transform(F.filter(keyed, lambda x: F.char_length(x["k"]) >= min_chars), lambda x: F.struct(F.unhex(F.md5(x["k"].cast("binary"))).alias("h"), x["p"].alias("p")))
    digests = scratch.save(df.select(row_id.alias("id"), mark.alias("mark"), keyed.alias("keyed")).filter("size(keyed) > 0"), "digests")
    runs = LineRuns(df.sparkSession, scratch, min_docs)
    cuts = _cuts(digests, batches)
    for k in range(len(cuts), -1, -1):
        here = F.lit(True) if k == len(cuts) else F.col("id") < cuts[k]
        if k:
            here = here & (F.col("id") >= cuts[k - 1])
        elif cuts:
            here = here | F.col("id").isNull()
        runs.add(digests.filter(here).select("id", F.explode(F.array_distinct(F.col("keyed")["h"])).alias("h")))
    frequent = scratch.save(runs.frequent(), "frequent")
    scratch.only("digests", "frequent")
    lines = digests.select("id", "mark", F.explode("keyed").alias("x")).select("id", "mark", "x.h", "x.p")
    met = split_join(lines, frequent.select("h", "keep"), "h", hot=hottest(frequent, "h", "docs")).filter(~F.col("id").eqNullSafe(F.col("keep")))
    gone = scratch.save(met.groupBy("id", "mark").agg(F.sort_array(F.collect_set("p")).alias("gone")), "gone")
    scratch.only("gone")
    # Lines are cut below the join: above it, their array would be cut again for each place.
    whole = df.select(row_id.alias("_id"), mark.alias("_mark"), _lines(text).alias("lines"), *[c.alias(n) for n, c in more.items()])
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_mark") == F.col("mark"))
    return whole.join(gone.withColumnRenamed("id", "_of"), same, "left").select("lines", "gone", *more)


def _joined() -> Column:
    """The lines that stay, joined by newlines. The set difference is by hash, so it is linear in the lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(places, lambda p: F.col("lines")[p]), "\n"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row for each row of ``df``: id, n_lines (before dropping), n_dropped, kept_sha256 of the lines that stay.

    Lines are what lies between newlines; a null or empty text is one empty line. A line's key is ``line_key``. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the largest id
    that holds them. A document is an id: rows that repeat an id are one document, and keep or lose a line together; rows with
    a null id are one document with the smallest id. A text whose lines all go becomes empty. An empty table gives an empty
    result. Other columns are not read, so their names can't clash. Keys are compared by 128 bits.
    """
    scratch = Scratch(df.sparkSession, "lines")
    out = _kept(df, scratch, id_col, text_col, min_chars, min_docs, batches, {"id": F.col(f"`{id_col}`")})
    n_gone = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    out = scratch.keep(out.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), n_gone.cast("long").alias("n_dropped"), sha256_hex(_joined()).alias("kept_sha256")))
    scratch.drop()
    return out


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``df`` with the lines that ``line_dedup`` drops gone from its texts, its columns and rows otherwise unchanged; a null text stays null."""
    scratch = Scratch(df.sparkSession, "lines")
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    out = _kept(df, scratch, id_col, text_col, min_chars, min_docs, batches, {"row": row})
    text = F.when(F.col("row")[text_col].isNull(), F.lit(None).cast("string")).otherwise(_joined())
    return out.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
