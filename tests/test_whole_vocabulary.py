"""Precedence of all words, exact quantiles without one task that holds all values, and patterns of tallied rows."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import features, mining, ordered
from tracelode.plans import complements

SF = "/root/testdata/sf0.001"


def test_precedence_of_any_two(spark):
    """25 words: pairs beyond the twentieth word count too, by first places; strangers don't."""
    words = [f"w{i}" for i in range(25)]
    rows = [(0, ["w24", "w3", "w24", "w20", "q"]), (1, ["w22", "w23", "w22"]), (2, []), (3, ["q"]), (4, ["w5", "w5"])]
    got = {r.window_id: r.held for r in features.precedence(spark.createDataFrame(rows, "window_id int, items array<string>"), words).collect()}
    want = {w: [f"{i}<{j}" for i, j in combinations(range(25), 2) if words[i] in own and words[j] in own and own.index(words[i]) < own.index(words[j])] for w, own in rows}
    assert {w: sorted(x) for w, x in got.items()} == {w: sorted(x) for w, x in want.items()} and got[0] == ["3<20"] and got[1] == ["22<23"]


def test_models_have_pairs_of_all_words(spark, monkeypatch):
    seen, plain, words = [], features.precedence, features.vocabulary
    few = spark.createDataFrame([(1, 0.5, 1, "x"), (0, 0.5, 1, "x")], "label int, score double, weight int, feature_set string")
    monkeypatch.setattr(complements, "pattern_scores", lambda *_: few)
    monkeypatch.setattr(complements, "judged_by_model", lambda *_, **__: few)
    monkeypatch.setattr(features, "vocabulary", lambda w: [*words(w), *[f"rare{i}" for i in range(30)]])
    monkeypatch.setattr(features, "precedence", lambda w, own: seen.append(len(own)) or plain(w, own))
    complements.lr_head_to_head(spark, SF)
    assert seen and seen[0] > 30


@pytest.mark.parametrize("bins", [4, 1 << 16])
def test_quantiles_are_exact(spark, monkeypatch, bins):
    """As percentile, over ties, far values, nulls and no values, in few bins of many passes."""
    monkeypatch.setattr(ordered, "BINS", bins)
    rng = np.random.default_rng(9)
    shares = [0.0, 0.25, 0.5, 0.7, 0.75, 1.0]
    for own in ([*rng.integers(0, 50, 200).tolist(), 1 << 51, -(1 << 50)], [3], [5, 5, 6], [1_704_067_200_000_000 + int(x) for x in rng.integers(0, 1 << 41, 300)]):
        df = spark.createDataFrame([(x,) for x in [*own, None]], "v long")
        assert ordered.quantiles(df, "v", shares) == df.agg(F.percentile("v", shares)).first()[0]
    assert ordered.quantiles(spark.createDataFrame([], "v long"), "v", shares) == [None] * 6


@pytest.mark.parametrize("small", [0, 6, 1_000_000])
def test_patterns_of_tallied_rows(spark, monkeypatch, small):
    """All patterns by brute force, in steps over the cluster, in tasks, and in both; equal rows are one before."""
    monkeypatch.setattr(mining, "SMALL", small)
    rng = np.random.default_rng(10)
    items = [[str(x) for x in rng.choice(list("abc"), rng.integers(0, 6))] for _ in range(40)] * 3
    df = spark.createDataFrame([(i, i % 4 > 0, x, sorted(set(x))) for i, x in enumerate(items)], "window_id int, is_failure boolean, items array<string>, item_set array<string>")
    for column, miner, name in (("items", mining.sequences, "sequence"), ("item_set", mining.itemsets, "itemset")):
        own = [r[column] for r in df.where("is_failure").collect()]
        counts: dict = {}
        for x in own:
            for p in {tuple(x[i] for i in at) for n in range(1, len(x) + 1) for at in combinations(range(len(x)), n)}:
                counts[p] = counts.get(p, 0) + 1
        n = sum(map(bool, own)) if column == "items" else len(own)
        want = {p: c for p, c in counts.items() if c >= 0.15 * n}
        assert {tuple(r[name]): r.n_failure for r in miner(df, 0.15).collect()} == want
        held = mining.held_in(df, column, [list(p) for p in want], "held").collect()
        assert all(sorted(r.held) == sorted("|".join(p) for p in want if p in {tuple(r[column][i] for i in at) for n in range(1, len(r[column]) + 1) for at in combinations(range(len(r[column])), n)}) for r in held)
