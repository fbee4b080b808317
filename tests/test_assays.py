"""Models, assays and paired intervals against plain loops, on the windows of the smallest tables."""

import hashlib
import os
from collections import Counter
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators import assays, evaluation, models
from tracelode.plans import assays as queries
from tracelode.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def chance(*parts):
    return draw(*parts) / 4294967296


def area(label, score):
    pos, neg = [s for y, s in zip(label, score, strict=True) if y], [s for y, s in zip(label, score, strict=True) if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def fit(x, y, steps=40):
    """Scores by plain Newton steps, both classes weighed alike, a penalty of 1/2 on the standardised coefficients."""
    mean_, sd = x.mean(0), x.std(0)
    sd[sd < 1e-9] = 1
    z = np.hstack([(x - mean_) / sd, np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge, beta = np.append(np.ones(x.shape[1]), 0), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.lstsq(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (w * (p - y)) + ridge * beta, rcond=None)[0]
    return lambda t: np.round(1 / (1 + np.exp(-np.hstack([(t - mean_) / sd, np.ones((len(t), 1))]) @ beta)), 9)


def halves(entities, seed, share=0.7):
    order = sorted(entities, key=lambda e: (draw(e, seed), e))
    return set(order[: int(len(order) * share)])


def judged(x, y, train):
    return area(y[~train].tolist(), fit(x[train], y[train])(x[~train]).tolist())


@pytest.fixture(scope="module")
def windows(spark):
    return catalogue.kept_windows(spark, SF)


@pytest.fixture(scope="module")
def rows(windows):
    return sorted(windows.collect(), key=lambda r: r.window_id)


def test_order_areas(windows, rows):
    strengths, splits = (0.0, 0.4, 0.8), 2
    got = {(r.split, r.strength): (r.real, r.shuffled) for r in assays.order_areas(windows, strengths, splits).collect()}
    entities, y = {r.entity_id for r in rows}, np.array([int(r.is_failure) for r in rows])
    assert len(got) == len(strengths) * splits
    for split in range(splits):
        own = halves(entities, split)
        train = np.array([r.entity_id in own for r in rows])
        counts = Counter(x for r, t in zip(rows, train, strict=True) if t for x in r["items"])
        words = [w for w, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:20]] + ["A", "B"]
        for strength in strengths:
            for kind in (0, 1):
                x = []
                for r, label in zip(rows, y, strict=True):
                    planted, n = chance(r.window_id, split, "planted") < strength, len(r["items"])
                    items = r["items"] + ((["A", "B"] if label else ["B", "A"]) if planted else [])
                    order = range(len(items))
                    if kind:
                        keys = sorted(range(n + 2), key=lambda i: hashlib.md5(f"{r.window_id}|{i}|{split}".encode()).hexdigest())
                        order = [i for i in keys if i < len(items)]
                    items = [items[i] for i in order]
                    first = {w: items.index(w) for w in words if w in items}
                    x.append([float(a in first and b in first and first[a] < first[b]) for i, a in enumerate(words) for b in words[i + 1 :]])
                assert judged(np.array(x), y, train) == pytest.approx(got[split, strength][kind], abs=1e-6)


def test_timing_areas(spark):
    strengths, splits = (0.0, 0.8), 1
    features = queries.timed_windows(spark, SF)
    got = {r.strength: r for r in assays.timing_areas(features, assays.KINDS, strengths, splits).collect()}
    rows = sorted(features.collect(), key=lambda r: r.window_id)
    y, words = np.array([int(r.is_failure) for r in rows]), sorted({t["item"] for r in rows for t in r.tokens})
    own = halves({r.entity_id for r in rows}, 0)
    train = np.array([r.entity_id in own for r in rows])
    for k, strength in enumerate(strengths):
        held = []  # window, item, recency; strata are dealt anew
        for i, r in enumerate(rows):
            tokens = [(t["item"], -1, t["recency"]) for t in r.tokens]
            if strength and chance(r.window_id, 0, "planted") < strength:
                u = chance(r.window_id, 0, "age")
                tokens.append(("", k, np.log1p(1 + 59 * u if r.is_failure else 3600 + 32400 * u)))
            held += [(i, item, s, v, (bool(train[i]), item, s, r.n, r.quartile)) for item, s, v in tokens]
        dealt = {}
        for stratum in {h[4] for h in held}:
            group = [h for h in held if h[4] == stratum]
            by = lambda salt: lambda h: (draw(rows[h[0]].window_id, h[1], 0, salt), rows[h[0]].window_id)
            for to, source in zip(sorted(group, key=by("taken")), sorted(group, key=by("given")), strict=True):
                dealt[to[0], to[1]] = source[3]
        assert sorted(dealt.values()) == sorted(h[3] for h in held)
        names = [*words, ""]
        present, recency, other = (np.zeros((len(rows), len(names))) for _ in range(3))
        for i, item, _, v, _ in held:
            j = names.index(item)
            present[i, j], recency[i, j], other[i, j] = 1, v, dealt[i, item]
        blocks = {"presence": present, "recency": np.hstack([present, recency]), "dealt": np.hstack([present, other]), "generic": np.array([[r.n, r.span, r["last"]] for r in rows], float)}
        for kind, x in blocks.items():
            assert judged(x, y, train) == pytest.approx(got[strength][kind], abs=1e-6), kind


def test_power(spark):
    values = spark.createDataFrame([(s, v) for s, vs in ((0.0, (0.0, -0.1)), (0.1, (0.5, 0.5)), (0.2, (0.0, 0.02)), (0.4, (0.1, 0.0)), (0.8, (0.3, 0.5))) for v in vs], "strength double, v double")
    got = {r.strength: r for r in assays.power(values, F.col("v")).collect()}
    assert [got[s].detected for s in sorted(got)] == [False, True, True, True, True]
    assert {r.smallest_detected for r in got.values()} == {0.1} and got[0.0].share_above == 0 and got[0.4].most == 0.1


def test_planted_signals_are_seen(spark):
    """Both assays rise with the strength of what is planted, and not without it."""
    for name in ("order_power", "timing_power"):
        got = {r.strength: r for r in catalogue.queries()[name](spark, SF).collect()}
        means = [got[s]["mean"] for s in sorted(got)]
        assert not got[0.0].detected and got[0.8].detected and means[-1] == max(means) and got[0.8].smallest_detected is not None


def test_drawn_areas(spark):
    """Paired draws of four scores with ties over entities of unlike sizes, in many partitions."""
    rng = np.random.default_rng(3)
    rows = [(m, int(e), int(y), float(s)) for e in rng.integers(0, 12, 150) for y in [rng.integers(0, 2)] for m in "abcd" for s in [rng.integers(0, 6) / 2 + y * (m == "d")]]
    scored = spark.createDataFrame(rows, "model string, entity_id int, label int, score double").repartition(7)
    got = {(r.model, r.b): r.auroc for r in evaluation.drawn_areas(scored, 20).collect()}
    entities = sorted({r[1] for r in rows})
    for b in range(21):
        times = Counter(entities) if b == 0 else Counter(entities[draw(b, p) % len(entities)] for p in range(1, len(entities) + 1))
        for m in "abcd":
            own = [r for r in rows if r[0] == m for _ in range(times[r[1]])]
            assert area([r[2] for r in own], [r[3] for r in own]) == pytest.approx(got[m, b])
    pairs = [("d", "d", ""), ("d less a", "d", "a")]
    told = {r.name: r for r in evaluation.paired_intervals(evaluation.drawn_areas(scored, 20), pairs).collect()}
    less = [got["d", b] - got["a", b] for b in range(1, 21)]
    assert told["d less a"].value == pytest.approx(got["d", 0] - got["a", 0]) and told["d less a"].low == pytest.approx(np.percentile(less, 2.5)) and told["d"].high == pytest.approx(np.percentile([got["d", b] for b in range(1, 21)], 97.5))
    one = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 2, 1, 0.1)], "model string, entity_id int, label int, score double")
    assert {r.auroc for r in evaluation.drawn_areas(one, 3).collect()} == {None}


def test_models_of_other_rows(spark):
    """Models with rows of their own, one without two classes, a constant feature, and many partitions."""
    rng = np.random.default_rng(4)
    x = (rng.random((300, 3)) < 0.4).astype(float)
    x[:, 2] = 1
    y = (rng.random(300) < 0.2 + 0.5 * x[:, 0]).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), i % 4 != 0, x[i].tolist()) for i in range(300)], "i int, label int, train boolean, x array<double>").repartition(5)

    def design(batch):
        own, i = np.array(models.column(batch, "x").to_pylist()), models.flags(batch, "i")
        every = np.arange(batch.num_rows)
        yield 0, own, every
        yield 1, own[i < 150][:, :2], every[i < 150]
        ones = models.flags(batch, "label") == 1
        yield 2, own[ones], every[ones]

    found = models.fitted(df, design)
    assert sorted(found) == [0, 1]
    got = models.scored(df, design, found, "i").collect()
    train = np.arange(300) % 4 != 0
    for m, some, width in ((0, np.arange(300), 3), (1, np.arange(150), 2)):
        own = train[some]
        want = fit(x[some][:, :width][own], y[some][own])(x[some][:, :width][~own])
        assert [r.score for r in sorted(got, key=lambda r: r.i) if r.model == m] == pytest.approx(want.tolist(), abs=1e-7)
    assert mean(r.label for r in got if r.model == 0) == y[~train].mean()
