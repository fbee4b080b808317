"""Closed miners against the filter over all patterns, finished in tasks and by steps over the cluster."""

import random

import pytest

from tracelode.functions.columns import item_set
from tracelode.operators import closed, mining

SHAPE = "window_id string, is_failure boolean, items array<string>"


def windows(spark, lists, controls=()):
    rows = [(f"f{i}", True, x) for i, x in enumerate(lists)] + [(f"c{i}", False, x) for i, x in enumerate(controls)]
    return spark.createDataFrame(rows, SHAPE).withColumn("item_set", item_set("items"))


def plain(df, name):
    return sorted((tuple(r[name]), r.n_failure) for r in df.collect())


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(7)
    lists = [[rng.choice("abcde") for _ in range(rng.randrange(7))] for _ in range(60)]
    return lists + [list("abcab")] * 6 + [list("edcba")] * 5 + [[], []]


@pytest.mark.parametrize("small", [1_000_000, 60, 0])
def test_sequences(spark, drawn, small):
    w = windows(spark, drawn, [list("abc")] * 9)
    want = plain(mining.closed(mining.sequences(w, 0.08), "sequence", ordered=True), "sequence")
    assert plain(closed.sequences(w, 0.08, small), "sequence") == want


@pytest.mark.parametrize("small", [1_000_000, 60, 0])
def test_itemsets(spark, drawn, small):
    w = windows(spark, drawn, [list("abc")] * 9)
    want = plain(mining.closed(mining.itemsets(w, 0.04), "itemset"), "itemset")
    assert plain(closed.itemsets(w, 0.04, small), "itemset") == want


def test_long_windows(spark):
    """Windows of a hundred different items have 2 ** 100 patterns and four closed ones."""
    items = [f"i{i:03}" for i in range(100)]
    w = windows(spark, [items] * 3 + [items[:60]] * 2 + [items[40:]])
    assert plain(closed.sequences(w, 0.1), "sequence") == sorted([(tuple(items), 3), (tuple(items[:60]), 5), (tuple(items[40:60]), 6), (tuple(items[40:]), 4)])
    assert plain(closed.itemsets(w, 0.1), "itemset") == sorted([(tuple(items), 3), (tuple(items[:60]), 5), (tuple(items[40:60]), 6), (tuple(items[40:]), 4)])


def test_nothing(spark):
    assert closed.sequences(windows(spark, [[], []], [["a"]])).collect() == []
    assert closed.itemsets(windows(spark, [], [["a"]])).collect() == []
