import re

import numpy as np

from tracelode.llm import line_dedup as L

DOCS = [
    (5, "alpha beta gamma delta\nkept one two three four\nshort line"),
    (2, "alpha beta gamma delta\nown words here are these\nshort line"),
    (7, "User 17 logged in from 10.0.0.1 today\nalpha beta gamma delta"),
    (8, "User 23 logged in from 10.0.0.9 today\n\nsomething entirely else is said"),
    (9, None), (10, ""), (11, "\n"), (12, "alpha beta gamma delta"),
    (13, "one two three four five six seven eight"), (14, "one two three four five six seven nine"), (15, "one two other words that aren't alike at"),
    (16, "again and again\nagain and again\n" + "w " * 9000), (None, "no id at all here"), (17, "no id at all here"),
]


def masked_by_hand(line):
    """Wildcards for tokens with a digit; a line of such tokens alone stays as it is."""
    tokens = line.split()
    masked = tuple("*" if re.search("[0-9]", t) else t for t in tokens)
    return masked if set(masked) != {"*"} else ("alone", *tokens)


def brute(docs, depth=2, least=3, similarity=0.75):
    """Leaf by leaf in plain Python; returns the kept text per row."""
    lines = {}
    for doc, text in docs:
        doc = L.no_id() if doc is None else doc
        for line in (text or "").split("\n"):
            masked = masked_by_hand(line)
            if len(line.split()) >= least:
                lines.setdefault(masked, set()).add(doc)
    leaves = {}
    for masked, ids in lines.items():
        leaves.setdefault(masked if masked[:1] == ("alone",) else (len(masked), tuple([t for t in masked if t != "*"][:depth])), []).append((min(ids), masked))
    first = {}
    for rows in leaves.values():
        templates = []
        for _, masked in sorted(rows, key=lambda r: (r[0], L.hashlib.blake2b(" ".join("\0" if t == "*" else t for t in r[1]).encode(), digest_size=16).digest())):
            shares = [sum(a == b for a, b in zip(t, masked, strict=True)) for t, _ in templates]
            best = templates[shares.index(max(shares))] if shares else ([], [])
            if shares and max(shares) >= similarity * len(masked) and any(a == b != "*" for a, b in zip(best[0], masked, strict=True)):
                t, members = best
                t[:] = [a if a == b else "*" for a, b in zip(t, masked, strict=True)]
                members.append(masked)
            else:
                templates.append((list(masked), [masked]))
        for _, members in templates:
            ids = set().union(*(lines[m] for m in members))
            if len(ids) > 1:
                first |= dict.fromkeys(members, min(ids))
    out = []
    for doc, text in docs:
        me = L.no_id() if doc is None else doc
        if text is None:
            out.append((doc, None))
            continue
        rest = [x for x in text.split("\n") if first.get(masked_by_hand(x), me) == me]
        out.append((doc, "\n".join(rest)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, hash string, line int")


def key(r):
    return (r[0] is not None, r[0] or 0, r[1] or "")


def test_small_cases(spark):
    got = {r.doc_id: r.text for r in L.report(frame(spark, DOCS)).collect()}
    assert got[2] == DOCS[1][1] and got[5] == "kept one two three four\nshort line" and got[12] == ""
    assert got[7] == "User 17 logged in from 10.0.0.1 today" and got[8] == "\nsomething entirely else is said"
    assert got[14] == "" and got[15] == DOCS[10][1] and got[16] == DOCS[11][1] and got[9] is None
    assert got[None] == "no id at all here" and got[17] == ""


def test_against_brute_force(spark):
    rows = [*DOCS, DOCS[0], (5, "alpha beta gamma delta\nanother text of five here")]
    got = sorted([(r.doc_id, r.text) for r in L.report(frame(spark, rows)).collect()], key=key)
    assert got == sorted(brute(rows), key=key)


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted([(r.doc_id, r.text) for r in L.report(docs).collect()], key=key) == sorted(brute(rows), key=key)


def test_columns_stay_and_emptied_documents_go(spark):
    out = L.deduplicated(frame(spark, DOCS))
    assert out.columns == ["doc_id", "text", "hash", "line"]
    assert {r.doc_id for r in out.collect()} == {5, 2, 7, 8, 9, 10, 11, 13, 15, 16, None}
    assert L.deduplicated(frame(spark, [])).count() == 0


def test_index_finds_what_comparing_with_all_templates_finds(monkeypatch):
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 30, (40, 12)).astype(np.uint16)
    lines = [np.where(rnd.random(12) < 0.15, rnd.integers(0, 30, 12), base[k]).astype(np.uint16) for k in rnd.integers(0, 40, 800)]
    found = []
    for few in (10**9, 0, 5):
        monkeypatch.setattr(L, "FEW", few)
        leaf = L.Leaf(12, 0.75)
        for i, t in enumerate(lines):
            leaf.add(i.to_bytes(16, "big"), i, i, 1, t)
        found.append((list(leaf.owner), leaf.templates[: len(leaf.low)].tolist(), list(leaf.recurring())))
    assert found[0] == found[1] == found[2] and len(leaf.low) < 800


def test_work_in_a_leaf_of_unlike_lines_grows_with_their_number(monkeypatch):
    compared = []
    plain = np.count_nonzero
    monkeypatch.setattr(L.np, "count_nonzero", lambda x, axis=None: compared.append(len(x)) or plain(x, axis=axis))
    sums = []
    for n in (1000, 2000):
        rnd, leaf = np.random.default_rng(3), L.Leaf(12, 0.75)
        compared.clear()
        for i in range(n):
            leaf.add(i.to_bytes(16, "big"), i, i, 1, rnd.integers(1, 60000, 12).astype(np.uint16))
        sums.append(sum(compared))
    assert sums[1] <= 2.3 * sums[0]


def test_dates_lead_to_no_common_leaf():
    masker = L.Masker(2, 1)
    a, b, c = (masker.leaf(masker.masked(x, False))[0] for x in ("2024-01-01 disk is full", "2024-01-02 user has left", "2025-01-02 disk is empty"))
    assert a != b and a == c


def test_clashing_names(spark):
    rows = [(1, "alpha beta gamma delta", "k", 7), (2, "alpha beta gamma delta\nown words are here", "l", 8)]
    out = L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, __key string, __drop long"))
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "own words are here", "l", 8)]


def test_lines_of_numbers(spark):
    """Numbers alone are no template: only equal lines recur. A template that would lose its last constant isn't one."""
    rows = [(1, "42\n12 34 56\np53 2024-01-02 BRCA1 q7\n7\nx 1 2 3 4 5 6 7"), (2, "1999\n9 8 7\na1 b2 c3 d4\n7\n1 x 2 3 4 5 6 7"), (3, "42\ntotal 5"), (4, "total 9")]
    got = {r.doc_id: r.text for r in L.report(frame(spark, rows), least=1).collect()}
    assert got == {1: rows[0][1], 2: "1999\n9 8 7\na1 b2 c3 d4\n1 x 2 3 4 5 6 7", 3: "total 5", 4: ""}
    assert sorted(brute(rows, least=1)) == sorted(got.items())


def test_hot_lines(spark):
    """One line of all documents is dealt to several tasks."""
    rows = [(i, f"the same line\nown{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}") for i in range(1000)]
    got = {r.doc_id: r.text for r in L.report(frame(spark, rows), least=1).collect()}
    assert got[0] == rows[0][1] and all(got[i] == rows[i][1].split("\n")[1] for i in range(1, 1000))
