"""The license scan against plain loops, and its spans on edited notices."""

import random
import re

import pytest

from tracelode.llm.licenses import BASE, NOTICES, WORDS, scanned

SHAPE = "doc_id long, text string, label string, template long, hash string, a int, __row long"


def words_of(text):
    return re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base_of(text):
    words, found = words_of(text), []
    for label, phrase in BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", 1, "x", 2, 3) for i, t in enumerate(texts)], SHAPE)
    return {r["doc_id"]: r for r in scanned(docs).collect()}


MIT = next(t for x, t in NOTICES if x == "mit")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    pool = "cc by CC-BY all rights reserved Reserved. general Public LICENSE gnu é 中文 word \x00   the version 3 2 0".split(" ")
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", " \n", "cc", "by", "cc by", "ALL RIGHTS\nRESERVED", "cc by " * 3000, "x " * 200_000 + "all rights reserved", "all rights reserved", "all rights reserved"]
    return texts


def test_base(spark, texts):
    got = scan(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_notices(spark):
    """Whole, shouted, with words inserted and left out; half a notice, a scattered one and near misses don't count."""
    m = MIT.split()
    edited = m[:9] + ["very", "own"] + m[9:17] + m[18:]
    texts = [
        f"intro {MIT} end", MIT.upper().replace(" ", ", "), " ".join(edited), " ".join(m[: len(m) // 3]), " filler filler filler filler filler filler ".join(m),
        "Licensed under the Apache License, Version 2.0.", "licensed under the GNU General Public License, version 3.", "GNU general public license, version 2", "Licensed under CC BY-NC 4.0.", "licensed by the apache license version 1 1",
        " ".join(x for pair in zip(m[::3], m[1::3], m[2::3], strict=False) for x in [*pair, *["pad"] * 9]), f"{MIT} . {MIT}",
    ]
    got = scan(spark, texts)
    assert [got[i]["labels"] for i in range(len(texts))] == ["mit", "mit", "mit", "", "", "apache-2.0", "gpl,gpl-3.0", "gpl,gpl-2.0", "cc-by,cc-by-nc", "", "", "mit"]
    assert got[0]["score"] == 1 and 0.6 <= got[2]["score"] < 1 and got[3]["score"] == 0


def test_same_id_and_empty(spark):
    docs = spark.createDataFrame([(7, "cc by"), (7, "nothing"), (None, "all rights reserved"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_words"], r["labels"]) for r in scanned(docs).collect()) == [(0, 0, ""), (0, 3, "reserved"), (7, 1, ""), (7, 2, "cc-by")]
    assert scanned(docs.limit(0)).collect() == []


def test_no_python(spark):
    docs = spark.createDataFrame([(7, "cc by")], "doc_id long, text string")
    plan = scanned(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
