"""What a worker holds: batches of bounded bytes, memory given back after a task, words kept from task to task."""

import pyarrow as pa
from pyspark.sql import functions as F

from iqlake.llm import textcore
from iqlake.llm.common import Scratch
from iqlake.llm.textcore import tidy


def sizes():
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    return run


def test_written_tables_take_small_batches(spark):
    """20 MB of rows in one partition reach Python in batches of about 4 MB."""
    scratch = Scratch(spark, "batches")
    rows = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = scratch.save(rows.mapInArrow(sizes(), "n long, bytes long"), "sizes").agg(F.sum("n"), F.max("bytes")).first()
    scratch.drop()
    assert got[0] == 2000 and got[1] < 5 << 20


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    said = []
    monkeypatch.setattr(textcore, "give_back", lambda: said.append("back"))
    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    for b in tidy(sizes())(iter(batches)):
        said.append(b.column(0)[0].as_py())
    assert said == [1, 1, 1, "back"]
    textcore.give_back()
