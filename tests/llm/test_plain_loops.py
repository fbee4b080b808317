"""Scores, features and learned spans against plain loops and planted cases; cases that every operator has to take."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pytest

from tracelode.llm import decontamination, media, packing, quality, secrets, token_counts, token_output
from tracelode.llm.jaccard_join import word_hashes

TEXTS = ["", "a", "Plain words, and plain Words again.\n" * 40, "é" * 700, "x1 (y) z\t" * 200 + "中文 text", "\x7f\x01 odd", "again again again"]


def plain_passages(text):
    """The features of each passage, one byte and one word at a time."""
    raw, n = text.encode(), quality.PASSAGE
    out = []
    for k in range(max(1, -(-len(raw) // n))):
        part = raw[k * n : (k + 1) * n]
        row = [0.0] * quality.FEATURES
        for a, b in zip(part, part[1:], strict=False):
            row[int(quality.CLASS[a]) * quality.N + int(quality.CLASS[b])] += 1 / (len(part) - 1)
        out.append(row)
    found = [(m.start(), re.sub("[A-Z]", lambda x: x[0].lower(), m[0].decode())) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    held, again, spots = [0] * len(out), [0] * len(out), [set() for _ in out]
    for i, (at, word) in enumerate(found):
        k = at // n
        held[k] += 1
        again[k] += i > 0 and found[i - 1][1] == word
        spots[k].add(int(word_hashes([word])[0][0]) >> 56)
    if found or text:
        for k, row in enumerate(out):
            h, base = max(held[k], 1), quality.N * quality.N
            size = len(raw[k * n : (k + 1) * n])
            row[base : base + 4] = [again[k] / h, len(spots[k]) / min(h, 256), math.log1p(h) / 5, math.log1p(size / h) / 3]
    return out


def plain_score(model, rows):
    p = {k: v.astype(float) for k, v in model.p.items()}
    h = [[math.tanh(sum((r[i] - model.mean[i]) / model.scale[i] * p["W"][i][j] for i in range(len(r))) + p["b"][j]) for j in range(len(p["b"]))] for r in rows]
    e = []
    for own in h:
        gates = []
        for j in range(p["V"].shape[1]):
            v, u = sum(x * p["V"][i][j] for i, x in enumerate(own)), sum(x * p["U"][i][j] for i, x in enumerate(own))
            gates.append(math.tanh(v) / (1 + math.exp(-u)))
        e.append(math.exp(sum(g * w for g, w in zip(gates, p["w"], strict=True))))
    z = [sum(e[k] * h[k][j] for k in range(len(h))) / sum(e) for j in range(len(h[0]))]
    return 1 / (1 + math.exp(-(sum(x * c for x, c in zip(z, p["c"], strict=True)) + p["c0"][0])))


def test_quality_scores():
    rng = np.random.default_rng(1)
    model = quality.Attention()
    model.mean, model.scale = rng.normal(0, 0.1, quality.FEATURES).astype(np.float32), rng.uniform(0.5, 2, quality.FEATURES).astype(np.float32)
    x, counts = quality.passages(TEXTS)
    assert counts.tolist() == [len(plain_passages(t)) for t in TEXTS]
    assert np.allclose(x[1:], [r for t in TEXTS[1:] for r in plain_passages(t)], atol=1e-5)
    ends = np.cumsum(counts)
    want = [plain_score(model, x[b - c : b].tolist()) for c, b in zip(counts.tolist(), ends.tolist(), strict=True)]
    assert np.allclose(quality.scores(model, TEXTS), want, atol=1e-5)


def test_media_features(spark):
    """Features of texts, one with a picture inside, by plain loops over the samples."""
    gif = "GIF89a\x01\x00\x01\x00\x00\x00\x00;"
    texts = [*TEXTS, f"before {gif} after", None]
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in enumerate(texts)] + [(None, "no id", "c", "x")], "doc_id long, text string, feature string, declared string")
    got = {r.doc_id: r for r in media.media_features(docs).collect()}
    assert len(got) == len(texts) + 1 and got[None].n_bytes == 5
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        above = [b >= 128 for b in payload]
        inside = f"image/gif@{44 + 7}+{len(gif)}" if i == len(TEXTS) else ""
        crossings = sum(a != b for a, b in zip(above, above[1:], strict=False))
        assert got[i].feature == f"audio/wav;embedded={inside};mean={sum(payload) / len(payload):.4f};zero_crossings={crossings}"
    assert media.media_features(docs.limit(0)).collect() == []


def planted(seed):
    """Texts with labelled credentials to learn from, others with unlabelled ones (shorter than the patterns find), and the
    planted values."""
    rng = random.Random(seed)
    letters, hexes, upper = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 14)))
    plain = lambda: rng.choice([word(), word(), word().title(), f"{word()}-{word()}", f"{word()}_{word()}", str(rng.randrange(10**9)), f"{rng.randrange(2000, 2030)}-12-31", f"v{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(99)}", f"{word()}.{word()}", word().upper()])
    prose = lambda: " ".join(plain() for _ in range(rng.randrange(20, 60)))
    value = lambda kind, n: "".join(rng.choice(hexes if kind else upper) for _ in range(n))
    texts = [f"{prose()} token = {value(1, 40)} {prose()}" for _ in range(300)] + [f"{prose()} {value(1, 32)} {prose()} AKIA{value(0, 16)}" for _ in range(150)]
    found = []
    for k in range(200):
        secret = value(1, 20) if k % 2 else "AKIA" + value(0, 14)
        found.append(secret)
        texts.append(f"{prose()} {secret} {prose()}")
    return texts, found


def test_learned_spans(spark):
    """Precision and recall of learned spans on planted credentials without a keyword."""
    texts, wanted = planted(3)
    got = []
    for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got += [texts[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("learned")]
    hit = set(got) & set(wanted)
    recall, precision = len(hit) / len(wanted), len([x for x in got if x in hit]) / max(len(got), 1)
    print(f"recall {recall:.3f}, precision {precision:.3f} of {len(got)} spans")
    assert recall >= 0.9 and precision >= 0.9


@pytest.mark.parametrize("rows", [[], [(None, None, "x"), (None, "same", "x"), (None, "same", "x"), (3, "", "x")]])
def test_null_ids_and_empty_tables(spark, rows):
    """Null ids and repeated rows stay, an empty table gives none; columns with the results' names don't matter."""
    bpe, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "doc_id long, text string, spans string, n_tokens int, length int")
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    ids = sorted((a is not None, a or 0) for a, *_ in rows)
    for found in (secrets.scan(docs), token_counts.token_counts(docs, bpe, limit=1024), decontamination.contamination(docs, items, 10), packing.packed(docs, word, end_id=1, capacity=4096), token_output.token_records(docs, bpe, end_id=0), media.media_features(docs)):
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found.collect()) == ids
