"""Shares of output tables summed in one aggregation."""

import pytest

from pyspark.sql import functions as F
from voltgrain.operators import activity as ac


def test_weights_in_one_aggregation(spark):
    rows = spark.createDataFrame([(1, 0, "rise", 0.5, 0.25, 3.0), (1, 0, "fall", 0.5, 0.25, 4.0), (1, 1, "rise", 0.2, 0.75, 5.0), (1, 1, "fall", 0.2, 0.75, 1.0), (2, 0, "rise", 0.0, 0.5, 7.0), (2, 0, "fall", 0.0, 0.5, 7.0)],
                                 "id int, ord int, rf string, from_activity double, duty double, e double").withColumn("pg_pin", F.lit("VDD"))
    share = ac.output_weights(rows.filter("rf = 'rise'"), ["id"]).select("id", "ord", "weight")
    want = {r.id: r.x for r in rows.join(share, ["id", "ord"]).groupBy("id").agg(F.sum(F.col("weight") * F.col("e")).alias("x")).collect()}
    got = {r.id: r.value for r in ac.weighted_output(rows, ["id"], F.col("rf") == "rise", F.col("e")).collect()}
    assert got == pytest.approx(want) and got[2] == 0.0
