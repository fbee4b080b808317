import random
import re

import numpy as np
import pytest

from tracelode.llm import jaccard_join as J


def sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, n, percent):
    own = [sets(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    places = {}
    for i, s in enumerate(own):
        for g in s:
            places.setdefault(g, []).append(i)
    tried = set()
    for same in places.values():
        for x, i in enumerate(same):
            for j in same[:x]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    if 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(own[i]), least[find(i)] if own[i] else d) for i, (d, _) in enumerate(rows))


def made(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "The"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 8, 60, 200]))] for _ in range(n)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for b in base:
        for _ in range(rnd.choice([1, 1, 2, 9])):
            c = [rnd.choice(vocabulary) if rnd.random() < rnd.choice([0, 0.01, 0.03]) else w for w in b]
            rows.append(" ".join(c + (passage if rnd.random() < 0.4 else [])))
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)]


CASES = [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "ONE"), (5005, "one two three"), (5006, "one\ttwo  three"), (5007, "x " * 30000), (5008, "X " * 200), (5009, "a\x1cb c d e"), (5003, "another text here of five")]


@pytest.mark.parametrize(("seed", "n", "percent", "chunk", "slices"), [(1, 4, 85, 2048, 4_000_000), (2, 4, 85, 6, 3000), (3, 5, 80, 3, 4_000_000), (4, 2, 50, 2048, 2000)])
def test_components_against_brute_force(spark, monkeypatch, seed, n, percent, chunk, slices):
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "TILE", 512 if chunk > 100 else 3)
    monkeypatch.setattr(J, "REPS", 64 if chunk > 100 else 2)
    monkeypatch.setattr(J, "SLICE", slices)
    rows = made(seed, 60) + CASES
    rows.append(rows[0])
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, node int, row string")
    got = sorted(tuple(r) for r in J.linked(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, n, percent)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in J.linked(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, 4, 85)


def test_one_of_each_keeps_columns(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "other words are in this text", "z"), (2, "other words are in this text", "z"), (4, None, None), (5, None, None)]
    out = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, node string"))
    assert out.columns == ["doc_id", "text", "node"]
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == [rows[1], rows[2], rows[4], rows[5]]
    assert J.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forest_and_labels_against_brute_force():
    rnd = np.random.default_rng(5)
    base = J.mixed(np.arange(400, dtype=np.uint64))
    sets = sorted((np.unique(np.concatenate([base[k * 100 : k * 100 + 90], rnd.choice(base, int(rnd.integers(0, 25)))])) for k in rnd.integers(0, 4, 40)), key=len)
    links = J.forest(np.arange(40), sets, 80)
    want, got = np.arange(40), np.arange(40)
    pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    J.joined(want, *np.array(pairs).T)
    J.joined(got, *np.array(links).T)
    assert (want == got).all() and len(links) == 40 - len(set(want.tolist())) and set(links) <= {(max(p), min(p)) for p in pairs} | {(min(p), max(p)) for p in pairs}


def test_bound_is_above_the_overlap():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rnd.integers(0, 300, rnd.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        a, b = (np.unique(J.mixed(x)) for x in (a, b))
        assert J.Points([J.point(a).tobytes(), J.point(b).tobytes()]).bounds(np.array([0]), np.array([1]))[0] >= len(np.intersect1d(a, b))


def test_near_copies_that_share_an_id_or_have_none(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(7, text, 1, "a"), (7, text + " end", 2, "b"), (None, "x " + text[8:], 3, "c"), (8, "another text of six words here", 4, "d"), (None, "no partner for this one text", 5, "e"), (None, "no partner for this one text at", 6, "f")]
    out = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __row int, __doc string"))
    kept = sorted(map(tuple, out.collect()), key=lambda r: r[2])
    assert len(kept) in (4, 5) and len([r for r in kept if r[0] == 7 or r[2] == 3]) == 1 and rows[3] in kept
    assert all(r in rows for r in kept)


def test_a_large_group_of_near_copies_is_compared_in_proportion_to_its_size(spark, monkeypatch):
    """Rows that tiles hold, for groups of unlike sets that are all near copies of one text."""
    monkeypatch.setattr(J, "CHUNK", 64)
    monkeypatch.setattr(J, "TILE", 64)
    monkeypatch.setattr(J, "REPS", 8)
    plain, held = J.links_of, []
    monkeypatch.setattr(J, "links_of", lambda tiled, sets, percent: held.append(tiled.count()) or plain(tiled, sets, percent))
    base = [f"w{i}" for i in range(120)]
    for m in (400, 800):
        docs = spark.createDataFrame([(i, " ".join(base[: i % 60] + [f"own{i}"] + base[i % 60 + 1 :])) for i in range(m)], "doc_id long, text string")
        assert {r.component_id for r in J.linked(docs, 4, 85).collect()} == {0}
    assert len(held) <= 4 and sum(held[len(held) // 2 :]) <= 2.6 * sum(held[: len(held) // 2])
