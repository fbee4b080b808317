import zlib

import numpy as np

from tracelode.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.scored(docs, Q.trained(docs, labels))
    rows = out.join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert out.count() == docs.count()
    r = rows[0]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows) and 0 <= r.score <= 1


def test_labels_that_are_held_out_are_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("quality", Q.F.when(Q.fold(Q.F.col("doc_id")) == 0, 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = Q.trained(docs, labels), Q.trained(docs, changed)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_gradients():
    rnd = np.random.default_rng(1)
    model = Q.Attention(width=5, gate=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, counts, y = rnd.normal(size=(9, Q.FEATURES)), np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, counts)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grad = model.gradients(x, counts, y)
    for k, g in grad.items():
        for _ in range(4):
            at = tuple(rnd.integers(0, n) for n in model.p[k].shape)
            old = model.p[k][at]
            model.p[k][at] = old + 1e-5
            up = loss()
            model.p[k][at] = old - 1e-5
            down = loss()
            model.p[k][at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.1), (None, "x " * 50000, 1.0), (4, "plain words of a text", 0.0), (4, "plain words of a text", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    model = Q.trained(docs, labels)
    assert model == 1.0 and [r.predicted for r in Q.scored(docs, model).collect()] == [1] * 5
    assert Q.trained(docs, labels.limit(0)) == 0.5
    assert Q.accepted(docs, model).columns == docs.columns and Q.accepted(docs, 0.0).count() == 0
    assert Q.scored(docs, Q.Attention()).where("score is null").count() == 0
    assert Q.scored(docs.limit(0), Q.Attention()).count() == 0


def test_every_passage_is_encoded():
    x, counts = Q.passages(["a" * 1500, "", "ab." * 200])
    assert counts.tolist() == [3, 1, 2] and x.shape == (6, Q.FEATURES)
    one = Q.passages(["ab." * 200])[0]
    assert np.allclose(x[4:], one)
