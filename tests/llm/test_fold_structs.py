"""Structs are slow to make in lambdas, so the test of an edge makes none, and short units skip the blocks of the fold."""

import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from iqlake.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_an_edge_is_tested_without_structs(spark):
    got = str(pieces._follows(F.col("prev"), F.col("e"), F.col("near"), F.col("facts"), 9))
    assert "struct" not in got


def test_units_about_as_long_as_a_block(spark):
    rng = random.Random(7)
    units = sorted({"▁" + "".join(rng.choices("aehinorst", k=n)) for n in [*range(1, 60), 254, 255, 256, 257] for _ in range(4)})
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(u,) for u in units], "unit string").repartition(2, "unit")
    got = {r.unit: list(r.ids) for r in pieces.lattice_ids(df, pieces.Model.load(PATH)).collect()}
    assert got == {u: sp.encode(u[1:]) for u in units}
