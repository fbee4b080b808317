"""Quality classifier by attention-based multiple-instance learning (operator 6).

A document is a bag of passages of PASSAGE bytes (the last may be shorter). Each passage is encoded from the frequencies
of pairs of neighbouring character classes and from how its words repeat; a tanh layer embeds it. Gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), weighs the embeddings within the document, and a logistic unit scores their
weighted sum. All weights are learned together from document labels by gradient descent (Adam, fixed seed).

Bounds: at most TRAIN_DOCS labelled documents are learned from, the smallest by hash of doc_id, each with all its
passages; one that would take their sum over TRAIN_PASSAGES is left out whole. Scoring encodes every passage of every
document. The model is a few thousand numbers.

Defined cases: null and empty texts are one passage without characters and get the score of such; without labels of
both kinds, the score is the share of 1 among the labels, or 0.5 if there are none; labels of a doc_id that differ
count as 1 if at least half are; of a doc_id with several texts one is learned from; rows that repeat stay; an empty
table gives no rows; a null doc_id counts as the text ''; equal texts have equal scores; other columns aren't
read by scored() and are kept by accepted().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices
from tracelode.llm.jaccard_join import word_hashes

PASSAGE = 512
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 100_000
CUT = 0.3
#: Bytes of text that are encoded at once.
SLICE = 500_000


def classes() -> np.ndarray:
    """The class of each byte: letters, digits, blanks, sentence marks, other marks, bytes of other characters."""
    out = np.full(256, 7, np.uint8)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[9, 11, 12, 13, 32]] = 3
    out[10] = 4
    out[[ord(c) for c in ".,;:?'\""]] = 5
    out[[ord(c) for c in "()-/"]] = 6
    out[128:192] = 8
    out[192:] = 9
    return out


CLASS, N = classes(), 10
FEATURES = N * N + 4


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The encoded passages of all texts, and how many each text has (one at least)."""
    raws = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    data = np.frombuffer(b"".join(raws), np.uint8)
    doc = np.repeat(np.arange(len(raws)), sizes)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = first[doc] + inside // PASSAGE
    kind = CLASS[data]
    out = np.zeros((total, FEATURES), np.float32)
    if len(data) > 1:
        same = place[1:] == place[:-1]
        pairs = np.bincount((place[1:] * (N * N) + kind[:-1].astype(np.int64) * N + kind[1:])[same], minlength=total * N * N).reshape(total, N * N)
        out[:, : N * N] = pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    words, n, begins = word_hashes(texts)
    if len(words):
        of = np.repeat(np.arange(len(texts)), n)
        where = first[of] + begins // PASSAGE  # a word is in the passage that it begins in
        held = np.maximum(np.bincount(where, minlength=total), 1)
        again = np.concatenate([[False], (words[1:] == words[:-1]) & (of[1:] == of[:-1])])
        spots = np.unique(where * 256 + (words >> np.uint64(56)).astype(np.int64)) // 256
        out[:, N * N] = np.bincount(where[again], minlength=total) / held
        out[:, N * N + 1] = np.bincount(spots, minlength=total) / np.minimum(held, 256)
        out[:, N * N + 2] = np.log1p(held) / 5
        size = np.bincount(place, minlength=total) if len(data) else np.zeros(total)
        out[:, N * N + 3] = np.log1p(size / held) / 3
    return out, counts


class Attention:
    """The model: standardised features, embedding W, gates V and U, attention w, output c."""

    def __init__(self, width: int = 24, gate: int = 12, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {
            "W": rnd.normal(0, 0.1, (FEATURES, width)), "b": np.zeros(width), "V": rnd.normal(0, 0.3, (width, gate)), "U": rnd.normal(0, 0.3, (width, gate)),
            "w": rnd.normal(0, 0.3, gate), "c": rnd.normal(0, 0.3, width), "c0": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (a * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        weight = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(h * weight[:, None], at)
        return {"h": h, "a": a, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -30, 30)))}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, counts)["score"]

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, at = self.p, self.forward(x, counts), np.cumsum(counts) - counts
        d = (f["score"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], counts, axis=0)
        weight, h, a, g = f["weight"], f["h"], f["a"], f["g"]
        da = (h * dz).sum(axis=1)
        de = weight * (da - np.repeat(np.add.reduceat(weight * da, at), counts))
        gate = de[:, None] * p["w"]
        dv, du = gate * g * (1 - a * a), gate * a * g * (1 - g)
        dh = (weight[:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (a * g).T @ de, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.005, decay: float = 1e-4, seed: int = 11) -> Attention:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        rnd, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rnd.permutation(len(bags))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                grad = self.gradients(np.concatenate([bags[j] for j in some]), np.array([len(bags[j]) for j in some]), y[some])
                step += 1
                for k, g in grad.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fold(doc_id: Column) -> Column:
    """The remainder that holds documents out where it is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def trained(docs: DataFrame, labels: DataFrame, text: str = "text") -> Attention | float:
    """The model learned from labelled documents that aren't held out; a constant where there is nothing to learn."""
    known = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias(text)).join(F.broadcast(some), "doc_id")
    one = F.struct(F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash"))
    of: dict[int, tuple[int, int]] = {}
    left = TRAIN_PASSAGES
    for r in texts_.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(one).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most TRAIN_DOCS rows of numbers
        if (n := max(1, -(-r.text.bytes // PASSAGE))) <= left:
            of[r.doc_id], left = (r.y, r.text.hash), left - n

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, text, SLICE):
            x, counts = passages(texts)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[e - c : e].tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)], pa.binary())], ["doc_id", "bag"])

    # Of a doc_id with several texts, the one with the smallest (length, hash) is learned from.
    ids = F.broadcast(docs.sparkSession.createDataFrame([(k, h) for k, (_, h) in of.items()], "doc_id long, hash long"))
    picked = texts_.join(ids, "doc_id").where(F.xxhash64(text) == F.col("hash")).select("doc_id", text)
    rows = picked.mapInArrow(bags, "doc_id long, bag binary").groupBy("doc_id").agg(F.min("bag").alias("bag")).collect() if of else []
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([of[r.doc_id][0] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return Attention().fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in rows], y)


def scored(docs: DataFrame, model: Attention | float, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. No shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores(model, texts))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias(text))
    out = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def scores(model: Attention | float, texts: list[str]) -> np.ndarray:
    return np.full(len(texts), model) if isinstance(model, float) else model.score(*passages(texts)).astype(np.float64)


def accepted(docs: DataFrame, model: Attention | float, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, text, SLICE):
            yield batch.filter(pa.array(scores(model, texts) >= CUT))

    return docs.mapInArrow(keep, docs.schema)
