"""Dealing within strata in blocks, areas by ranges, weighted models, and tallied orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import assays, evaluation, models


@pytest.mark.parametrize("most", [3, 40, 1_000])
def test_dealt(spark, most):
    """Strata of 1 to 200 rows, draws with ties; as by sorting each stratum twice, however it is cut into blocks."""
    rng = np.random.default_rng(5)
    rows = [(s, s * 1000 + i, float(rng.random()), int(rng.integers(0, 60)) << 26, int(rng.integers(0, 1 << 32))) for s, n in enumerate((1, 2, 7, 40, 41, 200)) for i in range(n)]
    tokens = spark.createDataFrame(rows, "s long, w long, value double, taken long, given long").repartition(5)
    got = {(r.s, r.w): r.dealt for r in assays.dealt(tokens, most).collect()}
    want = {}
    for s in range(6):
        own = [r for r in rows if r[0] == s]
        for to, source in zip(sorted(own, key=lambda r: (r[3], r[1])), sorted(own, key=lambda r: (r[4], r[1])), strict=True):
            want[s, to[1]] = source[2]
    assert got == want


def test_ranged_auroc(spark):
    """Ties over several batches, weights, and a model of one class."""
    rng = np.random.default_rng(6)
    rows = [(m, int(rng.integers(0, 2)) if m < 2 else 1, float(rng.integers(0, 9)), int(rng.integers(1, 5))) for _ in range(400) for m in range(3)]
    scored = spark.createDataFrame(rows, "model int, label int, score double, n int").repartition(6)
    want = {r.model: r.auroc for r in evaluation.auroc(scored, "model", weight="n").collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.model: r.auroc for r in evaluation.ranged_auroc(scored, "n").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[2] is None and want[2] is None and all(got[m] == pytest.approx(want[m], abs=1e-12) for m in (0, 1))


def test_weighted_models(spark):
    """A row that stands for n is as n rows."""
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 2)), bool(rng.integers(0, 3)), rng.integers(0, 3, 2).tolist(), int(rng.integers(1, 6))) for _ in range(60)]
    one = spark.createDataFrame(rows, "label int, train boolean, x array<int>, weight int")

    def design(batch):
        yield 0, np.array(models.column(batch, "x").to_pylist(), float), np.arange(batch.num_rows)

    many = one.withColumn("weight", F.explode(F.array_repeat(F.lit(1), F.col("weight"))))
    a, b = models.fitted(one, design)[0], models.fitted(many, design)[0]
    assert a["beta"] == pytest.approx(b["beta"], abs=1e-8) and a["scale"] == pytest.approx(b["scale"])


def test_orders_are_tallied(spark):
    """A hundred times the windows with the same items have no more rows than the items have orders."""
    few = [["x", "y", "x"], ["y", "x"], ["x", "z", "y"], [], ["q", "x"]]
    words = {0: ["x", "y", "z"], 1: ["y", "x"]}
    rows = [(f"{i}", i % 2, few[i % 5], [i % 3 > 0, i % 4 > 0]) for i in range(1000)]
    windows = spark.createDataFrame(rows, "window_id string, label int, items array<string>, train array<boolean>")
    got = assays.order_rows(windows, words, (0.0, 0.5)).collect()
    plain = {bytes(r.order) for r in got if r.kind == 0 and r.split == 0 and not r.planted}
    assert len(plain) == 5 and sum(r.weight for r in got if r.kind == 0 and r.split == 1 and r.planted_not) == 1000  # [], x, xy, yx, xzy; q is no word
    assert all({3, 4} <= set(np.frombuffer(r.order, np.uint16).tolist()) for r in got if r.planted and r.split == 0)
    assert len(got) < 500
