"""Held-out splits, models and metrics."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import md5
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.columns import draw
from tracelode.operators.ordered import quantiles, ranked, ranked_by_draw, running
from tracelode.sources.shared import written


def temporal_split(windows: DataFrame, share: float = 0.7) -> DataFrame:
    """windows with train: whether the anchor is up to the quantile of all anchors."""
    cut = quantiles(windows, "anchor", [share])[0]
    return windows.withColumn("train", F.col("anchor") <= F.lit(cut).cast("double"))


def part_of(number: Column, share: float) -> Column:
    """The whole part of a share of a number, in decimals: as doubles, 0.7 of 90,000 is under 63,000."""
    return F.floor(number * F.lit(Decimal(str(share)))).cast("long")


def entity_split(windows: DataFrame, share: float = 0.7, seed: int = 0) -> DataFrame:
    """windows with train: by entity, in the order of their draws."""
    entities = windows.select("entity_id").distinct()
    placed = ranked_by_draw(entities, ["entity_id", F.lit(seed)], ["entity_id"])
    number = entities.agg(part_of(F.count("*"), share).alias("k"))  # one row
    return windows.join(placed.crossJoin(F.broadcast(number)).select("entity_id", (F.col("place") <= F.col("k")).alias("train")), "entity_id")


def entity_splits(rows: DataFrame, seeds: int, share: float = 0.7) -> DataFrame:
    """(entity_id, seed, train) of several splits by entity at once, each in the order of its own draws.

    Places come from counts per leading bits of the draw, so that no split is sorted in one task."""
    each = rows.select("entity_id").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    placed = each.withColumn("d", draw("entity_id", "seed")).withColumn("b", F.shiftright("d", 20))
    sizes = placed.groupBy("seed", "b").agg(F.count("*").alias("n"))
    before = running(sizes, ["seed"], F.col("b"), {"before": F.col("n")}, inclusive=False).join(sizes.groupBy("seed").agg(part_of(F.sum("n"), share).alias("k")), "seed")
    inside = Window.partitionBy("seed", "b").orderBy("d", "entity_id")
    halves = placed.withColumn("i", F.row_number().over(inside)).join(before.select("seed", "b", "before", "k"), ["seed", "b"])
    return halves.select("entity_id", "seed", (F.col("before") + F.col("i") <= F.col("k")).alias("train"))


def unranked(index: int, n: int, k: int) -> list[bool]:
    """Which of n places the combination of k of them has that stands at `index` (from 0) in the order of combinations."""
    total, out = comb(n, k), []
    for left in range(n, 0, -1):
        with_ = total * k // left  # combinations that have this place
        taken = index < with_
        out.append(taken)
        index, total, k = (index, with_, k - 1) if taken else (index - with_, total - with_, k)
    return out


def balanced_partitions(rows: DataFrame, most: int = 30, seed: int = 0) -> DataFrame:
    """(entity_id, seed, discovery): all ways to take half of the entities (rounded down), or `most` different ones drawn
    by hash where there are more. A way is one number; the driver holds `most` of them, and a task writes out a way's
    places from its number."""
    entities = ranked(rows.select("entity_id").distinct(), [F.col("entity_id")])
    n = entities.count()
    ways, chosen, i = comb(n, n // 2), {}, 0
    while len(chosen) < min(most, ways):
        number = i if ways <= most else int(md5(f"{i}|{seed}".encode()).hexdigest() * (1 + ways.bit_length() // 128), 16) % ways
        chosen.setdefault(number, len(chosen))
        i += 1
    numbers = rows.sparkSession.createDataFrame([(place, str(number)) for number, place in chosen.items()], "seed int, number string")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, number in zip(batch.column("seed").to_pylist(), batch.column("number").to_pylist(), strict=True):
                yield pa.record_batch({"seed": pa.array([place] * n, pa.int32()), "place": pa.array(range(1, n + 1), pa.int64()), "discovery": unranked(int(number), n, n // 2)})

    spread = numbers.repartition(len(chosen) or 1, "seed").mapInArrow(places, "seed int, place long, discovery boolean")
    return spread.join(entities, "place").select("entity_id", "seed", "discovery")


def auroc(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """The area under the ROC curve of label (0/1) and score, ties counting half, from counts per distinct score.

    Scores are grouped before they are ordered, and the running sum is made of sums over buckets of scores."""
    w = F.col(weight) if weight else F.lit(1.0)
    steps = scored.groupBy(*by, "score").agg(F.sum(F.col("label") * w).alias("pos"), F.sum((1 - F.col("label")) * w).alias("neg"))
    below = running(steps, list(by), F.col("score"), {"below": F.col("neg")}, inclusive=False)
    return below.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auroc"))


def ranged_auroc(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """(model, auroc), as auroc by model, of scores of which most are different: they are shuffled once, by ranges of
    model and score, and a range is three numbers per model (see run_of)."""
    rows = scored.select(F.col("model").cast("int").alias("model"), "score", F.col("label").cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("n"))
    ordered = rows.repartitionByRange("model", "score").sortWithinPartitions("model", "score").withColumn("part", F.spark_partition_id())
    state = "model int, part int, pos double, neg double, area double"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, part = {}, 0
        last = [np.zeros(0)] * 4  # model, score, positives and negatives of the last score, which the next batch may go on with

        def closed(model: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
            for m in np.unique(model):
                p, n = pos[model == m], neg[model == m]
                totals[int(m)] = run_of(totals.get(int(m)), (p.sum(), n.sum(), float((p * (np.cumsum(n) - n / 2)).sum())))

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            model, score, label, n = (batch.column(c).to_numpy() for c in ("model", "score", "label", "n"))
            model, score, pos, neg = (np.concatenate(x) for x in zip(last, (model, score, label * n, (1 - label) * n), strict=True))
            first = np.flatnonzero(np.append(True, (model[1:] != model[:-1]) | (score[1:] != score[:-1])))
            model, score, pos, neg = model[first], score[first], np.add.reduceat(pos, first), np.add.reduceat(neg, first)
            closed(model[:-1], pos[:-1], neg[:-1])
            last = [x[-1:] for x in (model, score, pos, neg)]
        closed(last[0], last[2], last[3])
        for m, (p, n, a) in totals.items():
            yield pa.record_batch({"model": pa.array([m], pa.int32()), "part": pa.array([part], pa.int32()), "pos": [p], "neg": [n], "area": [a]})

    def joined(t: pa.Table) -> pa.Table:  # a row per range
        whole = None
        for r in t.sort_by("part").to_pylist():
            whole = run_of(whole, (r["pos"], r["neg"], r["area"]))
        both = whole[0] * whole[1]
        return pa.table({"model": t["model"].slice(0, 1), "auroc": pa.array([whole[2] / both if both > 0 else None], pa.float64())})

    return ordered.mapInArrow(runs, state).groupBy("model").applyInArrow(joined, "model int, auroc double")


def average_precision(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """The step sum of precision over the gains in recall, from the highest score down; ties are one step."""
    w = F.col(weight) if weight else F.lit(1)
    steps = scored.groupBy(*by, "score").agg(F.sum(F.col("label") * w).alias("pos"), F.sum(w).alias("n"))
    run = running(steps, list(by), -F.col("score"), {"hits": F.col("pos"), "seen": F.col("n")})
    return run.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("hits") / F.col("seen")), F.sum("pos")).alias("average_precision"))


def lead_time(rows: DataFrame, said: Column) -> DataFrame:
    """Hours from the last event to the anchor over true positives: count, quartiles."""
    hit = rows.where(F.col("is_failure") & said & F.col("last_us").isNotNull()).select(((F.col("anchor") - F.col("last_us")) / 3.6e9).alias("h"))
    return hit.agg(F.count("*").alias("n"), F.percentile("h", 0.25).alias("p25"), F.percentile("h", 0.5).alias("median"), F.percentile("h", 0.75).alias("p75"))


def deviations(rows: DataFrame, vector: str, weight: str) -> tuple[int, list[float], list[float]]:
    """The number of rows that these stand for, and the mean and deviation (the sample's) of each place of a vector over
    them. Spark's variance takes weights as reliabilities; only its divisor differs from that of counts."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    w = F.col(weight).cast("double")
    told = rows.agg(Summarizer.metrics("mean", "variance").summary(F.col(vector), w).alias("s"), F.sum(w).alias("n"), F.sum(w * w).alias("squares"))
    mean, variance, n, squares = told.select(vector_to_array("s.mean"), vector_to_array("s.variance"), "n", "squares").first()
    divisor = (n - squares / n) / (n - 1) if n and n > 1 else 0.0
    return int(n or 0), list(mean or []), [(v * divisor) ** 0.5 for v in variance or []]


def tallied(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows that are alike in what models read as one, with weight: how many there are."""
    return rows.groupBy(*by).agg(F.count("*").alias("weight"))


def weighted(rows: DataFrame) -> DataFrame:
    return rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1))


def logistic(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label", strength: float = 1.0, balanced: bool = False) -> DataFrame:
    """test with score: standardised logistic regression with an L2 penalty of 1 / (2 strength) on summed loss. A column
    weight tells how many rows each row stands for.

    The scaler divides by the sample's deviation; the factor that makes it the population's goes into the penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    as_vector = lambda df, c, v: df.withColumn(v, array_to_vector(F.transform(c, lambda v: v.cast("double"))))
    own = weighted(train)
    n, mean, sd = deviations(as_vector(own, features, "x"), "x", "weight")
    ones = own.agg(F.sum(F.col(label) * F.col("weight"))).first()[0] or 0
    scaled = F.zip_with(features, F.array(*[F.struct(F.lit(m).alias("m"), F.lit(1 / s if s > 0 else 0.0).alias("f")) for m, s in zip(mean, sd, strict=True)]), lambda v, g: (v - g["m"]) * g["f"])
    factor = F.when(F.col(label) == 1, n / (2.0 * max(ones, 1))).otherwise(n / (2.0 * max(n - ones, 1))) if balanced else F.lit(1.0)
    ready = as_vector(own.withColumn("z", scaled).withColumn("w", factor * F.col("weight")), "z", "z")
    model = LogisticRegression(featuresCol="z", labelCol=label, weightCol="w", regParam=1.0 / (strength * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(ready)
    return model.transform(as_vector(test.withColumn("z", scaled), "z", "z")).withColumn("score", vector_to_array("probability")[1]).drop("z", "rawPrediction", "probability")


def logistic_on_names(rows: DataFrame, names: list[str], held: str = "held", number: str | None = None, label: str = "label", strength: float = 1.0) -> DataFrame:
    """The rows that aren't train, with score: as logistic, on which of the names each row holds (sparse vectors, so
    their number isn't bounded by a row's width) and on a number. Features are scaled, not centred: that changes the
    constant alone, which has no penalty. A column weight tells how many rows each row stands for."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    blocks, stages = [number] if number else [], []
    if names:
        stages.append(CountVectorizerModel.from_vocabulary(names, inputCol=held, outputCol="__held").setBinary(True).setMinTF(0))
        blocks.append("__held")
    ready = PipelineModel([*stages, VectorAssembler(inputCols=blocks, outputCol="__x")]).transform(weighted(rows).withColumn("__w", F.col("weight").cast("double")) if "weight" in rows.columns else rows.withColumn("__w", F.lit(1.0)))
    n, _, sd = deviations(ready.where("train"), "__x", "__w")
    scaled = ElementwiseProduct(scalingVec=Vectors.dense([1 / s if s > 0 else 0.0 for s in sd]), inputCol="__x", outputCol="__z").transform(ready)
    model = LogisticRegression(featuresCol="__z", labelCol=label, weightCol="__w", regParam=1.0 / (strength * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(scaled.where("train"))
    return model.transform(scaled.where("not train")).withColumn("score", F.round(vector_to_array("probability")[1], 9)).select(*rows.columns, "score")


def boosted(train: DataFrame, test: DataFrame, features: str = "features", label: str = "label") -> tuple[DataFrame, list[float]]:
    """test with score by gradient-boosted trees, and the features' importances. A column weight tells how many rows each
    row stands for."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    as_vector = lambda df: df.withColumn("x", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    model = GBTClassifier(featuresCol="x", labelCol=label, weightCol="weight", maxIter=20, maxDepth=4, seed=3).fit(as_vector(weighted(train)))
    return model.transform(as_vector(test)).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability"), model.featureImportances.toArray().tolist()


def bootstrap(scored: DataFrame, draws: int = 200) -> DataFrame:
    """Percentile interval of AUROC over resampled entities: each draw weighs an entity by how often a hash picks it.

    As many picks as entities are made per draw; an entity's picks in all draws are one array (see drawn_areas)."""
    rows = scored.select(F.lit("").alias("model"), "entity_id", "label", F.col("score").cast("double").alias("score"))
    areas = drawn_areas(rows, draws).where("b > 0")
    return areas.agg(F.count("*").alias("draws"), F.percentile("auroc", 0.025).alias("low"), F.percentile("auroc", 0.975).alias("high"))


#: Picks of a bootstrap that one task makes.
PICKS_OF_TASK = 1_000_000


def picks(entities: DataFrame, draws: int) -> DataFrame:
    """entity_id and times: how often each of the draws picks the entity, when it picks as many as there are.

    Picks are dealt to a stated number of tasks, PICKS_OF_TASK each: entities are few bytes and would meet in one."""
    placed = written(ranked(entities.select("entity_id").distinct(), [F.col("entity_id")]), "placed")
    n = placed.count()
    parts = -(-n * draws // PICKS_OF_TASK) or 1
    drawn = placed.repartition(parts, "place").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("b", (draw("b", "place") % n + 1).alias("place"))
    spread = drawn.repartition(parts, "place")
    times = spread.groupBy("place", "b").agg(F.count("*").alias("t")).groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("b", "t"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return placed.join(times, "place").select("entity_id", dense.alias("times"))


def drawn_areas(scored: DataFrame, draws: int) -> DataFrame:
    """(model, b, auroc): the area of every model in each bootstrap draw over entities; b is 0 for the scores as they are.

    scored: model, entity_id, label, score. Scores are counted per entity and score, weighed by the entity's picks in all
    draws at once (an array), and sorted once for all draws. A run of ascending scores is a state of three numbers per
    draw: positives, negatives, and the area so far; runs of range partitions are joined in their order. Draws without
    both classes give null. All models see the same picks, so their differences are paired."""
    counted = scored.groupBy("model", "entity_id", "score").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))
    weighted = counted.join(picks(scored, draws), "entity_id", "left").select("model", "score", "pos", "neg", F.coalesce("times", F.array_repeat(F.lit(0).cast("long"), draws)).alias("times"))
    ordered = weighted.repartitionByRange("model", "score").sortWithinPartitions("model", "score").withColumn("part", F.spark_partition_id())
    state = "model string, part int, pos array<double>, neg array<double>, area array<double>"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, key, tie, part = {}, None, None, 0
        for batch in batches:
            part = batch.column("part")[0].as_py()
            times = np.column_stack([np.ones(batch.num_rows), batch.column("times").flatten().to_numpy().reshape(batch.num_rows, draws)])
            pos, neg = times * batch.column("pos").to_numpy()[:, None], times * batch.column("neg").to_numpy()[:, None]
            for i, own in enumerate(zip(batch.column("model").to_pylist(), batch.column("score").to_pylist(), strict=True)):
                if own != key:
                    if key is not None:
                        totals[key[0]] = run_of(totals.get(key[0]), tied(tie))
                    key, tie = own, [pos[i], neg[i]]
                else:
                    tie = [tie[0] + pos[i], tie[1] + neg[i]]
        if key is not None:
            totals[key[0]] = run_of(totals.get(key[0]), tied(tie))
        for model, (p, n, a) in totals.items():
            yield pa.record_batch({"model": [model], "part": pa.array([part], pa.int32()), "pos": [p.tolist()], "neg": [n.tolist()], "area": [a.tolist()]})

    def joined(t: pa.Table) -> pa.Table:  # a row per range partition
        whole = None
        for r in t.sort_by("part").to_pylist():
            whole = run_of(whole, tuple(np.array(r[k]) for k in ("pos", "neg", "area")))
        p, n, a = whole
        both = p * n
        areas = [x / y if y > 0 else None for x, y in zip(a.tolist(), both.tolist(), strict=True)]
        return pa.table({"model": pa.array([t["model"][0].as_py()] * (draws + 1), pa.string()), "b": pa.array(range(draws + 1), pa.int32()), "auroc": pa.array(areas, pa.float64())})

    return ordered.mapInArrow(runs, state).groupBy("model").applyInArrow(joined, "model string, b int, auroc double")


def tied(tie: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state of rows with one score: ties count half."""
    return tie[0], tie[1], tie[0] * tie[1] / 2


def run_of(low: tuple | None, high: tuple) -> tuple:
    """Two states of ascending runs as one."""
    return high if low is None else (low[0] + high[0], low[1] + high[1], low[2] + high[2] + low[1] * high[0])


def paired_intervals(areas: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """name, value, low, high and draws of (name, model, other) in pairs: the area of a model, less that of the other in
    the same draw where there is one ('' for none), with the percentiles 2.5 and 97.5 over draws that have both classes."""
    wanted = areas.sparkSession.createDataFrame(pairs, "name string, model string, other string")
    one = F.broadcast(wanted).join(areas, "model")
    less = areas.select(F.col("model").alias("other"), "b", F.col("auroc").alias("base"))
    both = one.join(less, ["other", "b"], "left").withColumn("v", F.when(F.col("other") == "", F.col("auroc")).otherwise(F.col("auroc") - F.col("base")))
    own = F.when(F.col("b") > 0, F.col("v"))
    return both.groupBy("name").agg(F.max(F.when(F.col("b") == 0, F.col("v"))).alias("value"), F.percentile(own, 0.025).alias("low"), F.percentile(own, 0.975).alias("high"), F.count(own).alias("draws"))
