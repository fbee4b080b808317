from tracelode.llm import language as L

DATA = "/root/testdata/sf0.01"


def test_accuracy_on_pages(spark):
    docs, pages = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "pages"))
    out = L.judged(pages, L.learned(docs))
    rows = out.join(docs.selectExpr("doc_id", "lang as known"), "doc_id").collect()
    assert len(rows) == pages.count() and sum(r.lang == r.known for r in rows) >= 0.98 * len(rows)
    assert all(0 < r.probability <= 1 for r in rows)


def test_evidence_outvotes_a_short_text(spark):
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the and with this house", "en"), ("der die das und mit haus", "de")] * 20)], "doc_id long, text string, lang string")
    page = "<html lang='{}'><script>the the the</script><body>{}</body></html>"
    rows = [(i, f"http://a.example.{'de' if i % 2 else 'com'}/x/{i}", page.format("de" if i % 2 else "en", "und mit der die das haus" if i % 2 else "with this and the house")) for i in range(60)]
    rows += [(100, "https://a.example.de/y?z=1", page.format("de", "")), (101, "http://A.example.com:80/7.html", page.format("EN", "")), (102, None, None), (103, "", "a < b > c"), (103, "", "a < b > c")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, lang string")
    out = L.judged(pages, L.learned(docs)).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and got[100].lang == "de" and got[101].lang == "en" and got[101].doc_id == 7 and got[100].doc_id is None
    assert got[102].host == "" and got[1].doc_id == 1 and all(got[i].lang == ("de" if i % 2 else "en") for i in range(60))


def test_fusion_against_brute_force(spark):
    """Counts and products once more, in plain Python, from what the texts alone say."""
    import math
    from collections import Counter

    docs, pages = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "pages"))
    model = L.learned(docs)
    raw = {r.page_id: r for r in pages.collect()}
    got = {r.page_id: r for r in L.judged(pages, model).collect()}
    logs = {p: model.likelihoods([L.visible(r.html)])[0] for p, r in raw.items()}
    langs = model.languages
    said = {p: int(x.argmax()) for p, x in logs.items()}
    domain = {p: ".".join(got[p].host.split(".")[-2:]) for p in raw}
    n = Counter()
    for p, k in said.items():
        n.update([("all", k), ("host", got[p].host, k), ("domain", domain[p], k), ("declared", got[p].declared, k), ("suffix", got[p].suffix, k)])
    for p in raw:
        score = []
        for k in range(len(langs)):
            own = said[p] == k
            above = (n["all", k] - own + 1) / (len(raw) - 1 + len(langs))
            for level, name in (("domain", domain[p]), ("host", got[p].host)):
                votes = sum(n[level, name, j] for j in range(len(langs))) - 1
                above = (n[level, name, k] - own + L.LEAN * above) / (votes + L.LEAN)
            rest = [(n[kind, name, k] - own + 0.5) / (n["all", k] - own + 2) for kind, name in (("declared", got[p].declared), ("suffix", got[p].suffix))]
            score.append(logs[p][k] + sum(math.log(x) for x in (above, *rest)))
        assert langs[score.index(max(score))] == got[p].lang
        assert abs(1 / sum(math.exp(s - max(score)) for s in score) - got[p].probability) < 1e-6


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://h.example/3", "x")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    (r,) = L.judged(pages, L.learned(docs)).collect()
    assert r.lang is None and r.probability == 0 and r.doc_id == 3 and L.judged(pages.limit(0), L.learned(docs)).count() == 0
