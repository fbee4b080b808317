"""Draws over arrays are those of md5, and permutations within entities made of them are those of a plain loop."""

from hashlib import md5

import numpy as np
import pytest

from tracelode.functions import draws as D
from tracelode.operators import stats


@pytest.mark.parametrize("lanes", [5, 65_536])
def test_draws_are_md5(monkeypatch, lanes):
    """Texts of 0 to 70 bytes, more prefixes than suffixes and fewer, none of either."""
    monkeypatch.setattr(D, "LANES", lanes)
    rng = np.random.default_rng(11)
    texts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (*range(0, 60), 70, 3, 3, 3)]
    for some, ends in ((texts, texts[:3]), (texts[:2], texts[:9] * 3), (texts, []), ([], texts)):
        want = [[int(md5(p + s).hexdigest()[:8], 16) for s in ends] for p in some]
        assert D.draws(some, ends).tolist() == want


def test_tied_draws_fall_by_window(spark, monkeypatch):
    """Draws of three values only: of tied windows, those with the smaller names fail; as by sorting each draw."""
    monkeypatch.setattr(stats, "drawn", tied := lambda ps, ss: np.array([[md5(p + s).digest()[0] % 3 for s in ss] for p in ps], np.uint32))
    rows = [(f"{i % 5}/{i:03}", i % 5, i % 3 == 0, ["abc"[i % 3]]) for i in range(60)]
    w = spark.createDataFrame(rows, "window_id string, entity_id int, is_failure boolean, item_set array<string>")
    hits = w.selectExpr("window_id", "entity_id", "is_failure", "item_set as itemset")
    got = {r.itemset[0]: r.p_within for r in stats.within_entity_p(hits, w, "itemset", 20).collect()}
    counts = {x: [0] * 20 for x in "abc"}
    for e in range(5):
        own = sorted(r for r in rows if r[1] == e)
        d = tied([r[0].encode() for r in own], [f"|{b}".encode() for b in range(1, 21)])
        for b in range(20):
            for i in sorted(range(len(own)), key=lambda i: (d[i, b], i))[: sum(r[2] for r in own)]:
                counts[own[i][3][0]][b] += 1
    real = {x: sum(r[2] and r[3] == [x] for r in rows) for x in "abc"}
    assert got == {x: (1 + sum(n >= real[x] for n in counts[x])) / 21 for x in "abc"}
