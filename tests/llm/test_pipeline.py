import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from test_decontamination import brute as hit_by_brute_force  # noqa: E402
from test_jaccard_join import brute as components_by_brute_force  # noqa: E402
from test_line_dedup import brute as lines_by_brute_force  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tracelode.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r.doc_id: r for r in docs.collect()}
        assert len(now) == docs.count() and set(now) <= set(before)
        texts = [(i, r.text) for i, r in before.items()]
        if name == "quality_classifier":
            known = [i for i in before if i in labels]
            assert sum((i in now) == labels[i] for i in known) >= 0.95 * len(known)
        elif name == "line_dedup":
            want = {i: t for i, t in lines_by_brute_force(texts, least=1)}
            assert {i: r.text for i, r in now.items()} == {i: t for i, t in want.items() if t or before[i].text == t}
        elif name == "ngram_jaccard_join":
            assert set(now) == {i for i, _, c in components_by_brute_force(texts, 5, 80) if i == c}
        else:
            assert all(hit_by_brute_force(r.text, items, 10)[1] == 0 for r in now.values())
            clean = {i for i, t in texts if hit_by_brute_force(t, items, 10)[1] == 0}
            assert all(i in now and now[i].text == before[i].text for i in clean)
        assert all(now[i][c] == before[i][c] for i in now for c in columns if c != "text")
        before = now
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {i: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in before.items()}
    assert sorted((p.doc_id, p.piece, p.length) for p in corpus_pipeline.run(spark, SF).collect()) == sorted((p.doc_id, p.piece, p.length) for p in pieces)


def test_rows_of_other_shapes(spark, tmp_path):
    rows = [(1, None, "en", 1), (2, "", None, 2), (None, "a text without an id", "en", 3), (4, "x " * 40000, "en", 4), (5, "twice here", "en", 5), (5, "twice here", "en", 5)]
    for table, frame in {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, hash string, n long"),
        "labels": spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None)], "item_id long, text string"),
    }.items():
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1, 2, None, 4, 5} and quality.CUT == 0.3
