"""Models applied to one frame, and what was saved and read again."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rankweave.operators import scenario

SMALL = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the generated tables are not here")


@given
def test_slot_probabilities_are_shares_of_the_contest(spark):
    df = __spark_entry__.queries()["slot_probabilities"](spark, SMALL)
    sums = df.groupBy("contest_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("share", "p_place1", "p_place2", "p_place3")], F.sum(F.col("p_style_o") + F.col("p_style_f")).alias("styles")).collect()
    assert sums
    for r in sums:
        assert r["n"] == 6 and all(abs(r[c] - 1) < 1e-9 for c in ("share", "p_place1", "p_place2", "p_place3")) and abs(r["styles"] - 6) < 1e-9


@given
def test_saved_pair_scores_the_last_days_only(spark):
    df = __spark_entry__.queries()["saved_pair_scores"](spark, SMALL)
    sums = df.groupBy("contest_id").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.sum("predicted_rank").alias("ranks")).collect()
    assert sums and all(r["n"] == 6 and abs(r["share"] - 1) < 1e-9 and r["ranks"] == 21 for r in sums)


def test_outcome_scenarios(spark):
    rows = [(1, "x", "won", "inside"), (2, "in", "placed", "inside"), (2, "in", "lost", "inside"), (2, "x", "placed", "inside"), (3, "x", "lost", "inside"), (4, "x", "lost", "outside"), (6, "x", "lost", "inside"), (None, None, "absent", "outside"), (None, None, "absent", "inside")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, winner int, style string, favourite string, shape string")
    found = [r[0] for r in df.orderBy("i").select(scenario.outcome_scenario("in")).collect()]
    assert found == ["S0", "S1", "S2", "S2", "S3", "S4", "S5", "S5", "S6"]
