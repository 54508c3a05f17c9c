"""Lambdas share no subexpressions, so what an edge's test reads often is looked up once."""

from pyspark.sql import functions as F

from iqlake.llm import pieces


def test_the_edge_before_is_looked_up_once(spark):
    edge = F.get(F.col("tail_of_states"), 3)
    got = pieces._follows(edge, F.col("e"), F.col("near"), F.col("facts"), 9)
    assert str(got).count("tail_of_states") == 1
