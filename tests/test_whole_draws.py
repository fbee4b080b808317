"""Registered queries draw as often as the reference."""

import pytest

from tracelode.plans import catalogue as Q

SF = "/root/testdata/sf0.001"


def test_bootstrap_draws(spark):
    assert Q.queries()["bootstrap_ci"](spark, SF).first().draws == 200


def test_top_sequences(spark):
    assert Q.queries()["count_preserving"](spark, SF).count() == 30


@pytest.mark.parametrize("name, column, steps, few", [("min_p", "p_adjusted", 500, 10), ("within_entity_perm", "p_within", 2001, 21)])
def test_steps_of_p(spark, name, column, steps, few):
    p = [r[column] for r in Q.queries()[name](spark, SF).collect()]
    assert all(abs(x * steps - round(x * steps)) < 0.002 for x in p) and any(abs(x * few - round(x * few)) > 1e-3 for x in p)
