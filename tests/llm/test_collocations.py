"""Phrases against plain loops, with small parts and a bitmap so small that hashes meet."""

import random
import re
from collections import Counter

import pytest

from tracelode.llm import collocations
from tracelode.llm.collocations import mined

SHAPE = "lang string, text string, phrase string, f long, w1 string, n int"


def brute(rows, least, top, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, lower = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    covered = set()
    for (lang, *w), a in candidates.items():
        for k in range(2, len(w)):
            covered |= {s for i in range(len(w) - k + 1) if 100 * a >= cover * f[s := (lang, *w[i : i + k])]}
    out = []
    for lang in n:
        rows_ = []
        for (x, *w), a in candidates.items():
            if x == lang and (x, *w) not in covered:
                score, k = min((2000000 * a // (f[(x, *w[:k])] + f[(x, *w[k:])]), k) for k in range(1, len(w)))
                rows_.append((-score, -a, " ".join(w).encode(), " ".join(w), f[(x, *w[:k])], f[(x, *w[k:])]))
        out += [(lang, i + 1, p, -a, left, right, n[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def got(spark, rows, **options):
    return sorted(map(tuple, mined(spark.createDataFrame([(*r, "clash", 1, "x", 2) for r in rows], SHAPE), **options).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = ["the", "The", "of", "a", "état", "ÉTAT", "中", "new", "york", "city", "hall", "|", "x\xa0y", "b-c"]
    fixed = ["new york city hall", "New York City", "of the", "a a a a a", "état of 中"]
    marks = [" ", " ", "  ", "\t", ", ", ".\n", "! ", "\r\n", " ; "]
    rows = []
    for _ in range(200):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "fr", None, "und", ""]), "".join(p + rng.choice(marks) for p in parts)))
    return [*rows, ("en", None), (None, ""), ("fr", " .\n"), ("en", "the of " * 40_000), ("de", "once only")] + [("en", "exact copy of this very text")] * 30


@pytest.mark.parametrize(("flush", "kept", "bits"), [(1 << 19, 1 << 18, 1 << 26), (50, 5, 1 << 15)])
def test_brute_force(spark, rows, monkeypatch, flush, kept, bits):
    """BITS reaches the workers with the function that reads it; small parts are met in the next test."""
    for name, value in (("FLUSH", flush), ("KEPT", kept), ("BITS", bits)):
        monkeypatch.setattr(collocations, name, value)
    assert got(spark, rows, least=12, top=40) == brute(rows, 12, 40)
    assert got(spark, rows, least=30, top=5) == brute(rows, 30, 5)


def test_parts_and_meeting_hashes(monkeypatch):
    """In one process: windows of small parts and a nearly full bitmap count as those of one part and an exact one."""
    import numpy as np
    import pyarrow as pa

    texts = ["a b c d e. f", "b c d e", "", "a\tb"]
    batch = pa.record_batch({"lang": ["en"] * 4, "text": texts})
    total = Counter()
    monkeypatch.setattr(collocations, "FLUSH", 3)
    monkeypatch.setattr(collocations, "SLICE", 4)
    for lexicon, codes in collocations.sequences(iter([batch])):
        for b in collocations.tallied(lexicon, collocations.leads(codes)):
            for r in b.to_pylist():
                total[tuple(r[w] for w in collocations.NAMES)] += r["n"]
    assert total == {("a", "b", "c", "d"): 1, ("b", "c", "d", "e"): 2, ("c", "d", "e", None): 2, ("d", "e", None, None): 2, ("e", None, None, None): 2, ("f", None, None, None): 1, ("a", "b", None, None): 1, ("b", None, None, None): 1}
    assert np.array_equal(collocations.leads(np.array([0, 0, 0, 0])), [[]] * 4)


def test_empty(spark):
    assert mined(spark.createDataFrame([], SHAPE)).collect() == []
    assert got(spark, [(None, None), ("en", "a b c")]) == []
