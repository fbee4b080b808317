"""The manifest against plain loops; the exchange with many small blocks."""

import zlib
from hashlib import sha256

import pytest

from tracelode.llm.manifest import folded, manifest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `group` long, rank string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    """The root, and per leaf the list of (left, right) siblings."""
    paths, places, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = at - at % 3
            paths[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
            places[i] = at // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def wanted(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = leaf_of(doc_id, source, lang, n, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = leaf_of(doc_id, source, lang, n, text and text.replace("\n", "")) if hit else leaf
        groups.setdefault(source, []).append(((doc_id is not None, doc_id or 0), leaf, other, doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, leaf, other, doc_id), path in zip(sorted(groups[s], key=lambda x: x[:2]), trees[s][1], strict=True):
            path = path + top
            end = folded(other, path)
            out.append((doc_id, leaf, trees[s][0], root, h(*[x for p in path for x in p]), end, end == root))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SHAPE)
    return sorted(map(tuple, manifest(docs, **options).collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_brute_force(spark, levels):
    """Hot source of a third and more, sources of one row, a null and an empty one, incomplete groups at each round."""
    rows = [(i * 7 % 1001, f"text {i}\nline\n" if i % 3 else f"plain {i}", "en" if i % 5 else None, ["hot", "hot", f"s{i % 13}", "é", None, ""][i % 6 if i % 2 else 0], i) for i in range(260)]
    rows += [(5000, "lone", "en", "only", 4), (5001, None, None, "z" * 30, None), (5001, None, None, "z" * 30, None), (None, "no id\n", "de", "hot", 6), (5002, "", "de", "hot", 0), (5003, "long\n" * 50_000, "de", "hot", 250_000)]
    assert got(spark, rows, levels=levels) == wanted(rows)


@pytest.mark.parametrize("n", [1, 4, 7, 10, 19])
def test_every_last_group(spark, n):
    rows = [(i, f"t{i}\n", "en", "a", 3) for i in range(n)]
    assert got(spark, rows, levels=1) == wanted(rows)


def test_empty(spark):
    assert manifest(spark.createDataFrame([], SHAPE)).collect() == []


def test_tampering_shows(spark):
    rows = [(i, f"a{i}\nb", "en", "s", 4) for i in range(30)]
    for doc_id, *_, verified in got(spark, rows):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 2 == 1)
