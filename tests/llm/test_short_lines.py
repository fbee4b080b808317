"""op1 and the pipeline's stage judge every line that has a token."""

import re

import corpus_pipeline
from test_line_dedup import brute

from tracelode.llm import line_dedup as L
from tracelode.llm import queries

HAN = "这是一个很长的段落" * 30
THAI = "ข้อความนี้ไม่มีช่องว่าง"
DOCS = [
    (1, f"And ornd.\nLes.\n{HAN}\nfirst words of one\nPage 3"), (2, f"Les.\nown words are here\n{HAN}\nonly"),
    (3, "And ornd.\nOther.\n \n"), (4, "Les."), (5, f"{THAI}甲\nPage 4"), (6, f"x\n{THAI}乙"), (7, "第12章の始まり"), (8, "第7章の始まり"),
]
WANT = {
    1: DOCS[0][1], 2: "own words are here\nonly", 3: "Other.\n \n", 4: "", 5: f"{THAI}甲", 6: "x", 7: DOCS[6][1], 8: "",
}


def saved(spark, path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op1_drops_short_and_unspaced_lines(spark, tmp_path):
    got = {r.doc_id: (r.text, r.n_dropped) for r in queries.op1_template_tree(spark, saved(spark, tmp_path)).collect()}
    assert got == {i: (t, dict(DOCS)[i].count("\n") - t.count("\n") if t else 1) for i, t in WANT.items()}


def test_stage_drops_short_and_unspaced_lines(spark, tmp_path):
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.read.parquet(f"{saved(spark, tmp_path)}/documents.parquet"), "").collect()}
    assert got == {i: t for i, t in WANT.items() if t}


def test_op1_against_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert not any(L.RUN.search(t or "") for _, t in rows)
    want = brute(rows, least=1)
    assert sorted((r.doc_id, r.text) for r in queries.op1_template_tree(spark, sf).collect()) == sorted(want)
    assert any(len(x.split()) < 3 for (_, a), (_, b) in zip(rows, want, strict=True) for x in set(a.split("\n")) - set(b.split("\n")) if x)


def test_tokens():
    assert L.tokens_of("第12章 ab") == ["第", "12", "章", "ab"] and L.tokens_of("a b-c") == ["a", "b-c"]
    assert L.unspaced("ab 章") and L.unspaced("\U00020000") and not L.unspaced("é “x” я")
    assert re.sub(r"\s", "", "".join(L.tokens_of(HAN))) == HAN and L.Masker(2, 0).masked(" \t", True) is None
