"""A row that stands for n windows is, to every model and metric, as n rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import evaluation


def test_weighted_logistic(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 2)), i % 3 > 0, [n for n in ("a", "b", "c") if rng.integers(0, 2)], int(rng.integers(0, 6)), int(rng.integers(1, 9))) for i in range(60)]
    one = spark.createDataFrame(rows, "i int, label int, train boolean, held array<string>, n int, weight int")
    many = one.withColumn("weight", F.explode(F.array_repeat(F.lit(1), F.col("weight")))).drop("weight")
    a = {r.i: r.score for r in evaluation.logistic_on_names(one, ["a", "b", "c"], number="n").collect()}
    b = {r.i: r.score for r in evaluation.logistic_on_names(many, ["a", "b", "c"], number="n").collect()}
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-5) for i in a)
    dense = lambda df: df.withColumn("features", F.array("n", F.size("held")))
    a = {r.i: r.score for r in evaluation.logistic(dense(one).where("train"), dense(one).where("not train"), balanced=True).collect()}
    b = {r.i: r.score for r in evaluation.logistic(dense(many).where("train"), dense(many).where("not train"), balanced=True).collect()}
    assert all(a[i] == pytest.approx(b[i], abs=1e-5) for i in a)
