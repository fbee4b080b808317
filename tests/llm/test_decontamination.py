import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.llm import decontamination as d


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, names = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(item))
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


words = st.lists(st.sampled_from(["a", "b", "A", "é", "c1"]), max_size=14).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(words, max_size=5), words, st.integers(1, 4))
def test_automaton_against_brute_force(items, text, window):
    rows = [(str(i), d.words_of(t)) for i, t in enumerate(items)]
    found, names = d.SuffixAutomaton([r for r in rows if r[1]], window).hits(d.words_of(text))
    want = brute(text, list(enumerate(items)), window)
    assert (sum(b - a for a, b in found), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()) == want[1:4]


ITEMS = [(0, "One two three four five six seven eight nine ten eleven"), (1, "short Item"), (2, None), (3, ""), (10, "Été à l'école 42"), (1, "short item")]
DOCS = [None, "", "x one TWO three four five-six seven eight nine ten y", "a short item, a SHORT  ITEM!", "two three four five six seven eight nine ten eleven short", "été à l école 42 " * 40 + "w " * 3000, "short", "short itemx"]


def test_query_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*DOCS, DOCS[2]])], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(a, b, "x") for a, b in ITEMS], "item_id long, text string, doc_id string")
    for shard_chars in (10**6, 20):
        d.SHARD_CHARS = shard_chars
        d.build.__defaults__ = (shard_chars,)
        got = {r.doc_id: tuple(r)[1:] for r in d.contamination(docs, items, 10).collect()}
        assert got == {i: brute(t, ITEMS, 10) for i, t in enumerate([*DOCS, DOCS[2]])}
    d.build.__defaults__ = (4_000_000,)
    assert d.contamination(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in d.contamination(docs, items.limit(0)).collect())


def test_cleaning_leaves_no_window_and_other_columns(spark):
    many = " ".join(f"own{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{many} One two three four five six seven eight nine ten. {many}", "en"), (2, ITEMS[0][1], "en"), (3, None, None), (4, many, "de"), (5, f"{many} short short item item {many}", "x")], "doc_id long, text string, lang string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in d.cleaned(docs, items).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3].text is None and got[4].text == many and got[1].lang == "en"
    assert got[1].text == f"{many} . {many}"
    assert all(brute(r.text, ITEMS, 10)[4] is False for r in got.values()) and "short" not in got[5].text


def test_memory_of_an_automaton(tmp_path):
    """A tenth of a shard takes under 20 MB while it is built and loaded, and never two are held."""
    import pickle
    import random
    import tracemalloc

    rng = random.Random(1)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    items = [(f"i{i}", d.words_of(" ".join(rng.choice(vocabulary) for _ in range(60)))) for i in range(1000)]
    assert sum(len(w) + 1 for _, words in items for w in words) > 400_000
    tracemalloc.start()
    automaton = d.SuffixAutomaton(items, 10)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    for name in "ab":
        (tmp_path / name).write_bytes(pickle.dumps(automaton))
    del automaton
    before, peaks = tracemalloc.get_traced_memory()[0], []
    for name in "aba":
        tracemalloc.reset_peak()
        assert d.load(f"file://{tmp_path}/{name}").hits(items[7][1]) == ([(0, 60)], {"i7"})
        peaks.append(tracemalloc.get_traced_memory()[1] - before)
        assert len(d.LOADED) == 1
    tracemalloc.stop()
    assert max(peaks) < 20e6 and peaks[2] < 1.2 * peaks[0]
