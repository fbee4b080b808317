"""Sparse models, invariants, outages and checks on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_assays import area, fit
from tracelode.operators import evaluation, outages, samplers
from tracelode.sources import formats

HOUR = 3_600_000_000


def test_logistic_on_names(spark):
    """Scores of sparse, uncentred features are those of a plain fit without class weights."""
    rng = np.random.default_rng(2)
    names = [f"p{j}" for j in range(6)]
    x = rng.random((200, 6)) < 0.4
    n = rng.integers(0, 5, 200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.4 * n - 1)))).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), i % 3 > 0, [names[j] for j in range(6) if x[i, j]] + ["unknown"], int(n[i])) for i in range(200)], "i int, label int, train boolean, held array<string>, n int")
    train = np.arange(200) % 3 > 0
    got = {r.i: r.score for r in evaluation.logistic_on_names(rows, names, number="n").collect()}
    dense = np.column_stack([n, x]).astype(float)
    scaled = dense / dense[train].std(0, ddof=1)
    z, t = np.hstack([scaled, np.ones((200, 1))]), y[train]
    beta, ridge = np.zeros(8), np.append(np.ones(7), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z[train] @ beta))
        beta = beta - np.linalg.solve(z[train].T @ (z[train] * (p * (1 - p))[:, None]) + np.diag(ridge), z[train].T @ (p - t) + ridge * beta)
    want = 1 / (1 + np.exp(-z[~train] @ beta))
    assert [got[i] for i in np.flatnonzero(~train)] == pytest.approx(want.tolist(), abs=2e-4)
    assert area(y[~train].tolist(), [got[i] for i in np.flatnonzero(~train)]) == pytest.approx(area(y[~train].tolist(), want.tolist()), abs=0.01)
    assert callable(fit)


def test_demanded(spark):
    good = spark.createDataFrame([("last5", 3, True)], "horizon string, survivors long, clear boolean")
    samplers.demanded(good)
    for bad in ((0, True), (3, False), (0, None)):
        rows = spark.createDataFrame([("last5", 3, True), ("24h", *bad)], "horizon string, survivors long, clear boolean")
        if bad[0] == 0 or bad[1] is False:
            with pytest.raises(ValueError, match="24h"):
                samplers.demanded(rows)


def test_mined_horizons_demand_a_signal(spark):
    """Failures with an item of their own pass; labels without any signal are refused."""
    clear = [(f"{i}", i < 30, ["bad", "x"] if i < 30 else ["x"]) for i in range(90)]
    shape = "window_id string, is_failure boolean, item_set array<string>"
    rows = spark.createDataFrame(clear, shape).withColumn("horizon", F.lit("last5"))
    assert samplers.mined_horizons(rows, ["last5"], demand=True).first().survivors > 0
    dull = spark.createDataFrame([(f"{i}", i < 30, ["x"]) for i in range(90)], shape).withColumn("horizon", F.lit("last5"))
    with pytest.raises(ValueError, match="last5"):
        samplers.mined_horizons(dull, ["last5"], demand=True)


def test_sequence_invariants(spark):
    """Order that only failures have holds in a long horizon; in a short one it is a planted order."""
    rows = [(f"{i}", i < 20, ["a", "b", "c"] if i < 20 else ["c", "b", "a"], h) for i in range(60) for h in ("long", "short")]
    w = spark.createDataFrame(rows, "window_id string, is_failure boolean, items array<string>, horizon string").withColumn("item_set", F.array_sort("items"))
    got = {r.horizon: r.holds for r in samplers.sequence_invariants(w, ["short"]).collect()}
    assert got == {"long": True, "short": False}
    with pytest.raises(ValueError, match="short"):
        samplers.held_up(samplers.sequence_invariants(w, ["short"]))
    samplers.held_up(samplers.sequence_invariants(w.where("horizon = 'long'"), []))


def test_outage_windows_guard(spark):
    """An outage in the wake of another, and one without events before it, have no window."""
    rows = [(1, 10, "view", "a"), (1, 11, "view", "a"), (1, 12, "view", "b"), (1, 20, "error", "e"), (1, 30, "view", "c"), (1, 31, "error", "e"), (1, 100, "error", "e")]
    s = spark.createDataFrame([(e, t * HOUR, i, k, x) for i, (e, t, k, x) in enumerate(rows)], "entity_id int, us long, ordinal long, event_type string, item string")
    got = sorted((r.horizon, r.anchor // HOUR, r.n_events, r.chain) for r in outages.outage_windows(s, "error").collect())
    assert got == [("24h", 20, 3, ["a", "b"]), ("72h", 20, 3, ["a", "b"])]


def test_join_rate_and_strangers(spark):
    failures = spark.createDataFrame([(1, "x", 0), (1, "x", 0), (2, "y", 0), (3, None, 7)], "m int, c string, t int")
    records = spark.createDataFrame([(1, "x"), (1, "x"), (9, "y")], "m int, c string")
    assert tuple(formats.join_rate(failures, records, ["m", "c"], F.col("t") == 7).first()) == (4, 2, 0.5, 1)
    assert tuple(formats.join_rate(failures.limit(0), records, ["m", "c"]).first()) == (0, 0, None, 0)
    events = spark.createDataFrame([("task_failure",), ("odd",), (None,), ("odd",)], "event_type string")
    assert {(r.event_type, r.n) for r in formats.strangers(events, "tasks").collect()} == {("odd", 2), (None, 1)}
