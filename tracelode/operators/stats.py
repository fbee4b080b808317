"""Tests and their corrections, splits, odds and hazard ratios: all on pattern tables, by horizon where there is one."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelode.functions.columns import draw, erfc, hypergeometric_tail
from tracelode.functions.draws import draws as drawn
from tracelode.operators.evaluation import part_of
from tracelode.operators.ordered import ranked_by_draw, running
from tracelode.sources.shared import written


def with_p(patterns: DataFrame) -> DataFrame:
    """One-sided exact p of n_failure hits among n_failure + n_control, given all_failure and all_control windows."""
    return patterns.withColumn("p", hypergeometric_tail(F.col("n_failure"), F.col("n_control"), F.col("all_failure"), F.col("all_control")))


def with_q(patterns: DataFrame, *by: str, p: str = "p", dependent: bool = False, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q within the groups of `by`; with dependent, Benjamini-Yekutieli. Ties don't depend on order.

    Distinct p values are ranked, by running sums and minima over buckets of them; none is sorted in one task. The
    tests are written first, as they are read several times."""
    patterns, keys = written(patterns, "tested"), [*by, p]
    steps = patterns.groupBy(*keys).agg(F.count("*").alias("__n"))
    sizes = steps.groupBy(*by).agg(F.sum("__n").alias("__m"))
    steps = steps.join(sizes, list(by)) if by else steps.crossJoin(F.broadcast(sizes))  # one row
    steps = running(steps, list(by), F.col(p), {"__r": F.col("__n")}).withColumn("__raw", F.col(p) * F.col("__m") / F.col("__r"))
    steps = running(steps, list(by), -F.col(p), {}, {"__least": F.col("__raw")})
    factor = F.aggregate(F.sequence(F.lit(1), F.col("__m").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i) if dependent else F.lit(1.0)
    found = steps.select(*keys, F.least(F.lit(1.0), F.col("__least") * factor).alias(name))
    return patterns.join(found, keys)


def summary(patterns: DataFrame, *by: str, alpha: float = 0.05) -> DataFrame:
    return patterns.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("q") < alpha).alias("n_significant"), F.min("q").alias("min_q"), F.percentile("q", 0.5).alias("median_q"))


def split(windows: DataFrame, seed: int, share: float = 0.5, entity: str = "entity_id") -> DataFrame:
    """windows with discovery: whether their entity is among the share with the smallest draws. Entities are ranked, not windows."""
    entities = windows.select(entity).distinct()
    placed = ranked_by_draw(entities, [entity, F.lit(seed)], [entity])
    number = entities.agg(part_of(F.count("*"), share).alias("k"))  # one row
    return windows.join(placed.crossJoin(F.broadcast(number)).select(entity, (F.col("place") <= F.col("k")).alias("discovery")), entity)


def odds(case_in: Column, case_all: Column, control_in: Column, control_all: Column) -> dict[str, Column]:
    """Pooled odds ratio with a half added to each cell, and its 95 % interval."""
    a, b, c, d = case_in + 0.5, case_all - case_in + 0.5, control_in + 0.5, control_all - control_in + 0.5
    log, se = F.ln(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return {"odds_ratio": F.exp(log), "or_low": F.exp(log - 1.96 * se), "or_high": F.exp(log + 1.96 * se), "or_significant": log - 1.96 * se > 0}


def matched_hazard(strata: DataFrame, by: str = "pattern", steps: int = 25) -> DataFrame:
    """Conditional logistic regression with one case per stratum and one yes-or-no covariate.

    strata: by, n (members), t (members with the covariate), x (the case's). Strata without variation say nothing.
    The likelihood depends on counts of (n, t, x) only; Newton's steps run over those, inside expressions."""
    counts = strata.where("t > 0 and t < n").groupBy(by, "n", "t").agg(F.count("*").alias("k"), F.sum("x").alias("ones"))
    packed = counts.groupBy(by).agg(F.sum("ones").alias("observed"), F.sum("k").alias("strata"), F.array_sort(F.collect_list(F.struct("n", "t", "k"))).alias("cells"))

    def prob(c: Column, beta: Column) -> Column:
        return c["t"] * F.exp(beta) / (c["n"] - c["t"] + c["t"] * F.exp(beta))

    # One aggregate walks the Newton steps, so that the expression stays small.
    zero = F.lit(0.0)

    def newton(beta: Column, _: Column) -> Column:
        expected = F.aggregate("cells", zero, lambda s, c: s + c["k"] * prob(c, beta))
        information = F.aggregate("cells", zero, lambda s, c: s + c["k"] * prob(c, beta) * (1 - prob(c, beta)))
        move = F.try_divide(F.col("observed") - expected, information)
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), beta + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(move, zero)))))

    fitted = packed.withColumn("beta", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, newton))
    information = F.aggregate("cells", zero, lambda s, c: s + c["k"] * prob(c, F.col("beta")) * (1 - prob(c, F.col("beta"))))
    # Written, so that the long series of the p value is made of two columns and not of what they come from.
    out = written(fitted.withColumn("se", F.try_divide(F.lit(1.0), F.sqrt(information))).select(by, "strata", "observed", "beta", "se"), "fitted")
    z = F.abs(F.col("beta") / F.col("se"))
    return out.select(by, "strata", "observed", F.exp("beta").alias("hazard_ratio"), F.exp(F.col("beta") - 1.96 * F.col("se")).alias("hr_low"), F.exp(F.col("beta") + 1.96 * F.col("se")).alias("hr_high"), erfc(z / 1.4142135623730951).alias("p"))


def alike(hits: DataFrame, pattern: str) -> DataFrame:
    """(window_id, held): windows that hold the same patterns have the same `held`, so a draw is counted by it first."""
    return hits.groupBy("window_id").agg(F.array_sort(F.collect_list(pattern)).alias("held"))


def within_entity_p(hits: DataFrame, windows: DataFrame, pattern: str, draws: int = 2000) -> DataFrame:
    """p of a pattern's lift when labels are permuted within each entity.

    For a fixed set of hits the lift grows with the number of case hits, so only these are counted. A draw fails an
    entity's windows with the smallest hashes (made over arrays, see functions.draws); windows that hold the same patterns are one class, and a task sends one
    array of draws per class it has seen: no row is made of a window and a draw. An entity's windows meet in one task."""
    rows, held = hit_classes(hits, windows, pattern)
    parts = parts_of(rows.count() * draws, rows)
    suffixes = [f"|{b}".encode() for b in range(1, draws + 1)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        entity, own = None, []
        for batch in batches:
            for e, *row in zip(*[batch.column(c).to_pylist() for c in ("entity_id", "window_id", "is_failure", "c")], strict=True):
                if e != entity:
                    deal(own, total)
                    entity, own = e, []
                    if len(total) > MOST_CLASSES:
                        yield class_sums(total)
                        total.clear()
                own.append(row)
        deal(own, total)
        if total:
            yield class_sums(total)

    def deal(own: list, total: dict) -> None:
        n, fails = len(own), sum(y for _, y, _ in own)
        if not fails:
            return
        prefixes, step = [w.encode() for w, *_ in own], max(1, 4_000_000 // n)
        for at in range(0, draws, step):
            d = drawn(prefixes, suffixes[at : at + step])
            last = np.partition(np.ascontiguousarray(d.T), fails - 1, axis=1)[:, fails - 1]
            falls = d <= last
            for b in np.flatnonzero(falls.sum(0) > fails).tolist():  # ties by window_id
                falls[np.argsort(d[:, b], kind="stable")[fails:], b] = False
            for i, (*_, c) in enumerate(own):
                total.setdefault(c, np.zeros(draws, np.int64))[at : at + step] += falls[i]

    entities = rows.repartition(parts, "entity_id").sortWithinPartitions("entity_id", "window_id")
    null = drawn_hits(entities.mapInArrow(dealt, "c string, drawn binary"), held, pattern, draws)
    return within_p(hits, null, pattern, draws)


def leave_one_out(hits: DataFrame, windows: DataFrame, pattern: str) -> DataFrame:
    """Per pattern, in how many of the folds without one entity it has a case hit, and in how many of those a lift over 1.

    A fold's counts are the totals less the entity's own: nothing is scanned again. Entities without hits of a pattern
    differ only in how many windows they have, so their folds are judged once per pair of numbers."""
    count = [F.count_if("is_failure").alias("hf"), F.count_if(~F.col("is_failure")).alias("hc")]
    own = hits.groupBy(pattern, "entity_id").agg(*count)
    total = own.groupBy(pattern).agg(F.sum("hf").alias("thf"), F.sum("hc").alias("thc"))
    size = windows.groupBy("entity_id").agg(F.count_if("is_failure").alias("nf"), F.count_if(~F.col("is_failure")).alias("nc"))
    every = size.agg(F.sum("nf").alias("tnf"), F.sum("nc").alias("tnc"))  # one row
    held = own.join(size, "entity_id").select(pattern, "nf", "nc", "hf", "hc", F.lit(1).alias("entities"))
    # Of each pair of numbers all entities, less those with hits of their own.
    alike_ = size.groupBy("nf", "nc").agg(F.count("*").alias("entities"))
    others = total.select(pattern).join(alike_).select(pattern, "nf", "nc", F.lit(0).alias("hf"), F.lit(0).alias("hc"), "entities")
    less = held.groupBy(pattern, "nf", "nc").agg((-F.count("*")).alias("entities")).select(pattern, "nf", "nc", F.lit(0).alias("hf"), F.lit(0).alias("hc"), "entities")
    folds = held.unionByName(others).unionByName(less).join(total, pattern).crossJoin(F.broadcast(every))
    hf, hc = F.col("thf") - F.col("hf"), F.col("thc") - F.col("hc")
    nf, nc = F.col("tnf") - F.col("nf"), F.col("tnc") - F.col("nc")
    lift = F.try_divide(F.try_divide(hf, nf), F.try_divide(hf + hc, nf + nc))
    usable = (nf > 0) & (hf + hc > 0)
    number = lambda c: F.sum(F.when(c, F.col("entities")).otherwise(0))
    return folds.groupBy(pattern).agg(number(usable).alias("folds"), number(usable & (hf > 0) & (lift > 1)).alias("consistent"))


def min_p(hits: DataFrame, windows: DataFrame, pattern: str, draws: int = 500) -> DataFrame:
    """Westfall-Young: a pattern's p next to the smallest p of all patterns under permuted labels.

    A draw fails the windows with the smallest hashes. The largest of these lies close to the failures' share of all
    hashes: windows well below are counted by class (those that hold the same patterns), an array of draws for each, and
    only those near it become rows (about 8 times the root of the windows per draw), which are ranked. Where what was
    counted shows that a draw's bound isn't near, all windows become rows."""
    sizes = windows.agg(F.count_if("is_failure").alias("all_failure"), F.count_if(~F.col("is_failure")).alias("all_control"))  # one row
    rows, held = hit_classes(hits, windows, pattern)
    rows = written(rows.select("window_id", "c"), "classes")
    fails, rest = sizes.first()
    n, share = fails + rest, fails / max(fails + rest, 1)
    suffixes = [f"|{b}".encode() for b in range(1, draws + 1)]

    def counted(low: int, high: int) -> DataFrame:
        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    ids, names = some.column("window_id"), some.column("c").to_numpy(zero_copy_only=False)
                    d = drawn([w.encode() for w in ids.to_pylist()], suffixes).astype(np.int64)
                    for name in np.unique(names).tolist():
                        own = (d[names == name] < low).sum(0)
                        total[name] = total[name] + own if name in total else own
                    i, b = np.nonzero((d >= low) & (d < high))
                    if len(i):
                        yield pa.record_batch([some.column("c").take(pa.array(i)), pa.nulls(len(i), pa.binary()), pa.array(b + 1, pa.int32()), pa.array(d[i, b]), ids.take(pa.array(i))], names=["c", "drawn", "b", "d", "window_id"])
                if len(total) > MOST_CLASSES:
                    yield sums(total)
                    total = {}
            if total:
                yield sums(total)

        def sums(total: dict) -> pa.RecordBatch:
            one, k = class_sums(total), len(total)
            return pa.record_batch([*one.columns, pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], names=["c", "drawn", "b", "d", "window_id"])

        spread = rows.repartition(parts_of(n * draws, rows), "window_id")
        return written(spread.mapInArrow(dealt, "c string, drawn binary, b int, d long, window_id string"), "dealt")

    near = 8 * (share * (1 - share) / max(n, 1)) ** 0.5 + 16 / max(n, 1)
    for low, high in ((max(0, int((share - near) * 2**32)), min(2**32, int((share + near) * 2**32))), (0, 2**32)):
        dealt = counted(low, high)
        below = total_drawn(dealt.where("drawn is not null"), draws)  # a number per draw
        there = {r.b: r["count"] for r in dealt.where("b is not null").groupBy("b").count().collect()}  # a row per draw
        if all(0 <= fails - x <= there.get(b, 0) for b, x in enumerate(below, 1)):
            break
    wanted = windows.sparkSession.createDataFrame([(b, fails - x) for b, x in enumerate(below, 1)], "b int, wanted long")
    place = F.row_number().over(Window.partitionBy("b").orderBy("d", "window_id"))
    late = dealt.where("b is not null").withColumn("i", place).join(F.broadcast(wanted), "b").where("i <= wanted").groupBy("b", "c").agg(F.count("*").alias("n"))
    late = late.join(held, "c").groupBy(pattern, "b").agg(F.sum("n").alias("late"))
    early = drawn_hits(dealt.where("drawn is not null").select("c", "drawn"), held, pattern, draws).select(pattern, F.posexplode("drawn").alias("at", "early")).withColumn("b", F.col("at") + 1)
    null = early.join(late, [pattern, "b"], "left").select(pattern, "b", (F.col("early") + F.coalesce("late", F.lit(0))).alias("n_failure"))
    return smallest_p(hits, null, sizes, pattern)


def jaccard(sets: DataFrame, by: str, member: str) -> DataFrame:
    """The similarity of every two sets (by, member), through the members they share."""
    sizes = sets.groupBy(by).agg(F.count("*").alias("n"))
    pairs = sets.select(F.col(by).alias("a"), member).join(sets.select(F.col(by).alias("b"), member), member).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    every = sizes.select(F.col(by).alias("a"), F.col("n").alias("na")).join(sizes.select(F.col(by).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    joined = every.join(pairs, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return joined.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def confusion(rows: DataFrame, label: Column, said: Column, prevalence: float = 0.01) -> DataFrame:
    """Confusion counts, precision, recall, F1 (0 where undefined) and the precision at a stated prevalence."""
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", label & said), ("fp", ~label & said), ("fn", label & ~said), ("tn", ~label & ~said))])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", F.col("tp") + F.col("fp"))), zero(F.try_divide("tp", F.col("tp") + F.col("fn")))
    false_rate = zero(F.try_divide("fp", F.col("fp") + F.col("tn")))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), zero(F.try_divide(prevalence * recall, prevalence * recall + (1 - prevalence) * false_rate)).alias("ppv"))


# Permutation tests, by copies of labels and from counts.

#: Classes whose sums a task holds before it sends them, draws of windows that a task makes.
MOST_CLASSES, DRAWS_OF_TASK = 10_000, 50_000_000


def parts_of(work: int, rows: DataFrame) -> int:
    """Tasks for so many draws. They are stated, as rows are few bytes and would be put together into few tasks."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-work // DRAWS_OF_TASK))


def hit_counts(hits: DataFrame, pattern: str) -> DataFrame:
    """(pattern, n_failure, n_control) of hits: rows of windows, or of tallied ones."""
    own = (F.sum("n_f"), F.sum("n_c")) if "n_f" in hits.columns else (F.count_if("is_failure"), F.count_if(~F.col("is_failure")))
    return hits.groupBy(pattern).agg(own[0].alias("n_failure"), own[1].alias("n_control"))


def hit_classes(hits: DataFrame, windows: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """windows (window_id, entity_id, is_failure, c) and held (c, pattern): windows of one class c hold the same patterns.

    A class is a set of items where hits are those of tallied sets, so that no window's patterns are listed; else it is
    named by the sha256 of the patterns held."""
    keys = ["window_id", "entity_id", "is_failure"]
    if "n_f" in hits.columns:
        name = F.to_json("item_set").alias("c")
        return windows.select(*keys, name), hits.select(name, pattern)
    own = alike(hits, pattern).withColumn("c", F.sha2(F.to_json("held"), 256))
    return windows.select(*keys).join(own.select("window_id", "c"), "window_id", "left").fillna("", ["c"]), own.select("c", F.explode("held").alias(pattern)).distinct()


def class_sums(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(total), pa.string()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["c", "drawn"])


def dealt_counts(groups: DataFrame, draws: int, parts: int) -> DataFrame:
    """(c, drawn): of each class, how many of its windows fail in each draw, summed over the groups of a task.

    groups: key, classes (structs of c and n) and wanted (failures per draw, an array; one number stands for all draws).
    A draw deals a group's failures among its classes without replacement: the counts are hypergeometric, seeded by the
    md5 of the key. No window is looked at, and a group's work grows with its classes and draws only."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, classes, wanted in zip(*[batch.column(c).to_pylist() for c in ("key", "classes", "wanted")], strict=True):
                rng = np.random.Generator(np.random.PCG64(int(md5(key.encode()).hexdigest(), 16)))
                sizes = np.array([c["n"] for c in classes], np.int64)
                if len(wanted) == 1 and sizes.sum() <= 1000:
                    each = rng.multivariate_hypergeometric(sizes, wanted[0], draws, method="count").T
                else:
                    each = one_by_one(rng, sizes, np.broadcast_to(np.array(wanted, np.int64), draws))
                for c, own in zip(classes, each, strict=True):
                    total[c["c"]] = total[c["c"]] + own if c["c"] in total else own
            if len(total) > MOST_CLASSES:
                yield class_sums(total)
                total = {}
        if total:
            yield class_sums(total)

    def one_by_one(rng: np.random.Generator, sizes: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
        rest = int(sizes.sum())
        for n in sizes.tolist():
            own = rng.hypergeometric(n, rest - n, left) if rest else np.zeros(draws, np.int64)
            rest, left = rest - n, left - own
            yield own

    return groups.repartition(parts, "key").mapInArrow(dealt, "c string, drawn binary")


def drawn_sums(each: DataFrame, by: str) -> DataFrame:
    """(by, drawn): sums of each (by, drawn), as one array of all draws, still in bytes."""
    kind = each.schema[by].dataType

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[object, np.ndarray]] = {}
        for batch in batches:
            for p, own in zip(batch.column(by).to_pylist(), batch.column("drawn").to_pylist(), strict=True):
                own = np.frombuffer(own, "<i8")
                total[str(p)] = (p, total[str(p)][1] + own if str(p) in total else own)
        for p, own in total.values():
            yield pa.record_batch([pa.array([p], to_arrow_type(kind)), pa.array([own.tobytes()], pa.binary())], names=[by, "drawn"])

    return each.select(by, "drawn").repartition(by).mapInArrow(summed, f"{by} {kind.simpleString()}, drawn binary")


def total_drawn(dealt: DataFrame, draws: int) -> list[int]:
    """Per draw the sum over all classes: one array on the driver."""
    one = drawn_sums(drawn_sums(dealt.select("c", "drawn"), "c").select(F.lit(0).alias("all"), "drawn"), "all").first()
    return np.frombuffer(one.drawn, "<i8").tolist() if one else [0] * draws


def drawn_hits(dealt: DataFrame, held: DataFrame, pattern: str, draws: int) -> DataFrame:
    """(pattern, drawn): sums of the classes that hold the pattern, as one array of all draws."""
    found = drawn_sums(drawn_sums(dealt, "c").join(held, "c"), pattern)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(pattern), pa.array([np.frombuffer(x, "<i8").tolist() for x in batch.column("drawn").to_pylist()], pa.list_(pa.int64()))], names=[pattern, "drawn"])

    return found.mapInArrow(opened, f"{pattern} {found.schema[pattern].dataType.simpleString()}, drawn array<long>")


def within_p(hits: DataFrame, null: DataFrame, pattern: str, draws: int) -> DataFrame:
    real = hit_counts(hits, pattern).select(pattern, F.col("n_failure").alias("case_hits"))
    drawn = F.coalesce("drawn", F.array_repeat(F.lit(0).cast("long"), draws))
    return real.join(null, pattern, "left").select(pattern, "case_hits", ((1 + F.size(F.filter(drawn, lambda x: x >= F.col("case_hits")))) / (draws + 1)).alias("p_within"))


def within_entity_counts(hits: DataFrame, windows: DataFrame, pattern: str, draws: int = 2000) -> DataFrame:
    """As within_entity_p, from counts: each entity deals its failures among its classes of windows that hold the same
    patterns. Rows are classes of entities, whatever the number of windows and draws."""
    rows, held = hit_classes(hits, windows, pattern)
    classes = rows.groupBy("entity_id", "c").agg(F.count("*").alias("n"), F.count_if("is_failure").alias("f"))
    groups = classes.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("classes"), F.sum("f").alias("f"))
    groups = written(groups.where("f > 0").select(F.col("entity_id").cast("string").alias("key"), "classes", F.array("f").alias("wanted")), "entity-classes")
    dealt = dealt_counts(groups, draws, parts_of(20 * groups.count() * draws, groups))
    return within_p(hits, drawn_hits(dealt, held, pattern, draws), pattern, draws)


def smallest_p(hits: DataFrame, null: DataFrame, sizes: DataFrame, pattern: str) -> DataFrame:
    """pattern, p and p_adjusted from null (pattern, b, n_failure): the smallest p of each draw."""
    real = hit_counts(hits, pattern)
    own = real.select(pattern, (F.col("n_failure") + F.col("n_control")).alias("hits"))
    both = null.join(own, pattern).select("b", "n_failure", (F.col("hits") - F.col("n_failure")).alias("n_control"))
    tail = with_p(both.select("n_failure", "n_control").distinct().crossJoin(F.broadcast(sizes))).select("n_failure", "n_control", "p")  # once per pair of counts
    least = both.join(tail, ["n_failure", "n_control"]).groupBy("b").agg(F.min("p").alias("least"))  # a row per draw
    tested = with_p(real.crossJoin(F.broadcast(sizes)))
    return tested.crossJoin(F.broadcast(least)).groupBy(pattern, "p").agg(F.avg((F.col("least") <= F.col("p") + 1e-12).cast("double")).alias("p_adjusted"))


#: Groups that a whole table's classes are dealt to.
DEALT = 64


def min_p_counts(hits: DataFrame, windows: DataFrame, pattern: str, draws: int = 500) -> DataFrame:
    """As min_p, from counts: all failures are dealt among DEALT groups of classes first (one small row), then each group
    deals its share among its classes in a task of its own."""
    sizes = windows.agg(F.count_if("is_failure").alias("all_failure"), F.count_if(~F.col("is_failure")).alias("all_control"))  # one row
    rows, held = hit_classes(hits, windows, pattern)
    classes = rows.groupBy("c").agg(F.count("*").alias("n")).withColumn("g", F.pmod(F.xxhash64("c"), F.lit(DEALT)).cast("int"))
    groups = written(classes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("classes"), F.sum("n").alias("n")), "class-groups")
    number = sizes.first()[0] or 0
    totals = [(r.g, r.n) for r in groups.select("g", "n").orderBy("g").collect()]  # DEALT rows
    rng, rest, left, shares = np.random.Generator(np.random.PCG64(11)), sum(n for _, n in totals), np.full(draws, number), []
    for g, n in totals:
        own = rng.hypergeometric(n, rest - n, left)
        shares.append((g, own.tolist()))
        rest, left = rest - n, left - own
    wanted = windows.sparkSession.createDataFrame(shares, "g int, wanted array<long>")
    dealt = dealt_counts(groups.join(F.broadcast(wanted), "g").select(F.col("g").cast("string").alias("key"), "classes", "wanted"), draws, DEALT)
    null = drawn_hits(dealt, held, pattern, draws).select(pattern, F.posexplode("drawn").alias("b", "n_failure"))
    return smallest_p(hits, null, sizes, pattern)
