"""Precedence features of all pairs of the 20 most frequent items, over 8 splits."""

from pyspark.sql import functions as F

from tracelode.operators import features
from tracelode.plans import catalogue as Q

SF = "/root/testdata/sf0.001"


def test_all_pairs(spark):
    n = min(20, len(Q.words_of(Q.last_windows(spark, SF))))
    assert n > 6 and {len(r.features) for r in Q.queries()["feature_precedence"](spark, SF).collect()} == {n * (n - 1) // 2}


def test_models_see_all_pairs(spark, monkeypatch):
    seen, plain = [], features.precedence
    monkeypatch.setattr(features, "precedence", lambda w, words: seen.append(len(words)) or plain(w, words))
    Q.queries()["lr_head_to_head"](spark, SF)
    n = min(20, len(Q.words_of(Q.last_windows(spark, SF))))
    assert seen == [n]


def test_eight_splits(spark, monkeypatch):
    monkeypatch.setattr(Q.evaluation, "logistic", lambda train, test, **_: test.withColumn("score", F.aggregate("features", F.lit(0), lambda s, x: s + x)))
    assert [r.split for r in Q.queries()["order_value_assay"](spark, SF).select("split").orderBy("split").collect()] == list(range(8))
