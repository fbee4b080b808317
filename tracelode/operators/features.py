"""Feature blocks of windows, descriptors of histograms and counters, and the injections that calibrate them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.columns import draw, holds_all, holds_in_order


#: Items that a vocabulary may have: it becomes columns.
MOST_WORDS = 100_000


def vocabulary(windows: DataFrame, top: int | None = None) -> list[str]:
    """The items of the training windows, most frequent first, ties by name. Items are a closed vocabulary: a stream
    with more than MOST_WORDS of them is refused, not cut."""
    counts = windows.select(F.explode("items").alias("item")).groupBy("item").count().orderBy(F.desc("count"), "item")
    words = [r.item for r in counts.limit(top or MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} items: state how many of them become features")
    return words


def presence(windows: DataFrame, words: list[str]) -> DataFrame:
    return windows.withColumn("features", F.transform(F.array(*map(F.lit, words)), lambda w: F.array_contains("items", w).cast("int")))


def multiset(windows: DataFrame, words: list[str]) -> DataFrame:
    return windows.withColumn("features", F.transform(F.array(*map(F.lit, words)), lambda w: F.size(F.filter("items", lambda x: x == w))))


def bigrams(windows: DataFrame, pairs: list[str]) -> DataFrame:
    """Whether each of the adjacent pairs (a>b) occurs. A window's own pairs are made once, as the argument of a lambda,
    not again for each pair that is looked for."""
    tests = F.array(*map(F.lit, pairs))
    return windows.withColumn("features", F.transform(F.array(pairs_of()), lambda own: F.transform(tests, lambda p: F.array_contains(own, p).cast("int")))[0])


def top_bigrams(train: DataFrame, top: int = 200) -> list[str]:
    """The adjacent pairs that most training windows hold, ties by name."""
    return [r.pair for r in adjacent_pairs(train).orderBy(F.desc("n"), "pair").limit(top).collect()]


def pairs_of() -> Column:
    """The different adjacent pairs of items."""
    return F.array_distinct(F.zip_with(F.slice("items", 1, F.greatest(F.size("items") - 1, F.lit(0))), F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), lambda a, b: F.concat_ws(">", a, b)))


def adjacent_pairs(windows: DataFrame) -> DataFrame:
    """(pair, n) of windows that hold two items side by side."""
    return windows.select(F.explode(pairs_of()).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def precedence(windows: DataFrame, words: list[str]) -> DataFrame:
    """held: of each two words, those that both occur with the first one's first place before the other's, as i<j of
    their places in the vocabulary. A window has as many as its different items have pairs, whatever the vocabulary."""
    known = F.array(*map(F.lit, words)).cast("array<string>")
    codes = F.filter(F.transform(F.array_distinct("items"), lambda x: F.array_position(known, x) - 1), lambda c: c >= 0)
    pairs = lambda own: F.flatten(F.transform(own, lambda a, k: F.transform(F.filter(own, lambda b, j: (j > k) & (b > a)), lambda b: F.concat_ws("<", a.cast("string"), b.cast("string")))))
    return windows.withColumn("held", F.transform(F.array(codes), pairs)[0])


def precedence_row(windows: DataFrame, words: list[str]) -> DataFrame:
    """Precedence as a row of all pairs of the words."""
    names = F.array(*[F.lit(f"{i}<{j}") for i in range(len(words)) for j in range(i + 1, len(words))]).cast("array<string>")
    return precedence(windows, words).withColumn("features", F.transform(names, lambda p: F.array_contains("held", p).cast("int"))).drop("held")


def held_sets(windows: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """Whether each window holds each of the itemsets."""
    tests = F.array(*[F.array(*map(F.lit, p)) for p in patterns])
    return windows.withColumn("features", F.transform(tests, lambda p: holds_all(F.col("item_set"), p).cast("int")))


def held_sequences(windows: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """Whether each window holds each of the sequences in order."""
    tests = F.array(*[F.array(*map(F.lit, p)) for p in patterns])
    return windows.withColumn("features", F.transform(tests, lambda p: holds_in_order(F.col("items"), p).cast("int")))


def held_names(windows: DataFrame, hits: DataFrame, pattern: str) -> DataFrame:
    """windows with held: the names of the patterns that each holds, joined from their hits, however many there are."""
    named = hits.groupBy("window_id").agg(F.collect_list(F.array_join(pattern, "|")).alias("held"))
    return windows.join(named, "window_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))


def pattern_counts(windows: DataFrame, hits: DataFrame, pattern: str) -> DataFrame:
    """How many patterns each window holds; windows without one have 0."""
    return windows.join(hits.groupBy("window_id").agg(F.count(pattern).alias("n_held")), "window_id", "left").withColumn("n_held", F.coalesce("n_held", F.lit(0)))


def recency_null(per_item: DataFrame, seed: int) -> DataFrame:
    """per_item (window_id, item, stratum, recency): recencies dealt anew among the windows of an item and stratum."""
    group = Window.partitionBy("item", "stratum")
    own = per_item.withColumn("place", F.row_number().over(group.orderBy("window_id")))
    other = per_item.select("item", "stratum", F.col("recency").alias("dealt"), F.row_number().over(group.orderBy(draw("window_id", "item", F.lit(seed)), "window_id")).alias("place"))
    return own.join(other, ["item", "stratum", "place"]).drop("place")


def injected(windows: DataFrame, share: float, seed: int, first: str = "A", then: str = "B") -> DataFrame:
    """Two more items in every window: first-then in a share of the failures, in drawn order elsewhere."""
    chance = draw("window_id", F.lit(seed)) / 4294967296.0
    coin = draw("window_id", F.lit(seed), F.lit("coin")) % 2 == 0
    forward = F.when(F.col("is_failure") & (chance < share), F.lit(True)).otherwise(coin)
    return windows.withColumn("items", F.concat(F.when(forward, F.array(F.lit(first), F.lit(then))).otherwise(F.array(F.lit(then), F.lit(first))), F.col("items")))


def normalised(bins: Column) -> Column:
    total = F.aggregate(bins, F.lit(0.0), lambda s, x: s + x)
    return F.transform(bins, lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))


def wasserstein(p: Column, q: Column) -> Column:
    """The distance of two histograms over the same ordered bins: the sum of differences of their running sums."""
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("sum"))
    pairs = F.arrays_zip(normalised(p).alias("p"), normalised(q).alias("q"))
    return F.aggregate(pairs, start, lambda s, x: F.struct((s["gap"] + x["p"] - x["q"]).alias("gap"), (s["sum"] + F.abs(s["gap"] + x["p"] - x["q"])).alias("sum")), lambda s: s["sum"])


def centroid(bins: Column) -> Column:
    weighted = F.aggregate(F.transform(normalised(bins), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return weighted


def entropy(bins: Column) -> Column:
    return F.aggregate(normalised(bins), F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def tail_mass(bins: Column, share: float = 0.25) -> Column:
    """The mass in the last share of the bins."""
    from_bin = F.floor(F.size(bins) * (1 - share))
    return F.aggregate(F.filter(normalised(bins), lambda x, i: i >= from_bin), F.lit(0.0), lambda s, x: s + x)


def own_baseline(rows: DataFrame, bins: int, share: float = 0.3) -> DataFrame:
    """rows (entity_id, place, h: histograms of `bins` bins): how each entity's later histograms differ from its own
    baseline, which is the sum of its first share of rows: distance (last, largest, slope), shifts of centroid and tail
    (last, slope) and of entropy (last). Histograms without mass are left out, entities without baseline or later rows too.

    The tail is the upper half of the bins; slopes are per histogram kept."""
    order = Window.partitionBy("entity_id").orderBy("place")
    placed = rows.withColumns({"__i": F.row_number().over(order), "__n": F.count("*").over(Window.partitionBy("entity_id"))})
    early = F.col("__i") <= F.ceil(F.col("__n") * share)
    base = placed.where(early).groupBy("entity_id").agg(F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(bins)]).alias("h0"))
    mass = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    later = placed.where(~early & (mass(F.col("h")) > 0)).join(base.where(mass(F.col("h0")) > 0), "entity_id").withColumn("__k", F.row_number().over(order))
    upper = lambda h: F.aggregate(F.filter(normalised(h), lambda _, i: i >= bins // 2), F.lit(0.0), lambda s, x: s + x)
    h, h0 = F.col("h"), F.col("h0")
    told = later.select("entity_id", "__k", wasserstein(h, h0).alias("distance"), (centroid(h) - centroid(h0)).alias("centroid"), (entropy(h) - entropy(h0)).alias("entropy"), (upper(h) - upper(h0)).alias("tail"))
    last, slope = lambda c: F.max_by(c, "__k").alias(f"{c}_last"), lambda c: F.coalesce(F.regr_slope(F.col(c), F.col("__k")), F.lit(0.0)).alias(f"{c}_slope")
    return told.groupBy("entity_id").agg(last("distance"), F.max("distance").alias("distance_max"), slope("distance"), last("centroid"), slope("centroid"), last("entropy"), last("tail"), slope("tail"))


def counter_features(readouts: DataFrame, value: str, share: float = 0.3) -> DataFrame:
    """Per entity, in time order: last value, mean step, mean step over the first share (baseline), their difference, slope."""
    order = Window.partitionBy("entity_id").orderBy("us", "ordinal")
    steps = readouts.withColumns({"step": F.col(value) - F.lag(value).over(order), "place": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("entity_id"))})
    base = F.avg(F.when(F.col("place") <= F.ceil(F.col("n") * share), F.col("step")))
    return steps.groupBy("entity_id").agg(F.max_by(value, "place").alias("last_value"), F.avg("step").alias("rate"), (F.avg("step") - base).alias("rate_delta"), F.regr_slope(F.col(value), F.col("place")).alias("slope"))


def residuals(rows: DataFrame, y: str, xs: list[str], by: str) -> DataFrame:
    """rows with what is left of y after least squares on xs (and a constant) per group, by normal equations.

    The sums of products are one aggregate with partial sums; each group solves a system of len(xs) + 1 unknowns. The
    solutions, a row per group, go to the rows, which are never gathered by group: few groups may have all rows."""
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    products = [F.sum(a * b).alias(f"a{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)] + [F.sum(a * F.col(y)).alias(f"b{i}") for i, a in enumerate(terms)]
    sums = rows.groupBy(by).agg(*products)
    k = len(terms)

    @F.pandas_udf("array<double>")
    def solve(rows_: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.array(r[: k * k]).reshape(k, k), np.array(r[k * k :]), rcond=None)[0].tolist() for r in rows_])

    fitted = sums.select(by, solve(F.array(*[c for c in sums.columns if c != by])).alias("w"))
    predicted = sum((F.col("w")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
    return rows.join(F.broadcast(fitted), by).withColumn("residual", F.col(y) - predicted).drop("w")


def surprises(readouts: DataFrame, values: list[str], share: float = 0.9, places: int = 9) -> DataFrame:
    """Per entity and channel, the readouts whose absolute step is above the entity's own quantile of that channel.

    Steps and quantiles are rounded to `places`: equal steps of decimals differ in the last bit as doubles, and an
    interpolation between them may give either."""
    long = readouts.unpivot(["entity_id", "us", "ordinal"], values, "channel", "v")
    order = Window.partitionBy("entity_id", "channel").orderBy("us", "ordinal")
    steps = long.withColumn("step", F.round(F.abs(F.col("v") - F.lag("v").over(order)), places)).where("step is not null")
    limit = steps.groupBy("entity_id", "channel").agg(F.round(F.percentile("step", share), places).alias("q"))
    return steps.join(limit, ["entity_id", "channel"]).where("step > q").select("entity_id", "us", "ordinal", "channel", "step")


def trend_transitions(rows: DataFrame, width: int = 6, delta: float = 0.5) -> DataFrame:
    """rows (entity_id, hour, channel, v, scale; observed only): changes of direction against the latest observation at
    least `width` hours earlier. The previous direction is the last that was computed, 0 before any."""
    order = Window.partitionBy("entity_id", "channel").orderBy("hour")
    past = F.max_by("v", "hour").over(order.rangeBetween(Window.unboundedPreceding, -width))
    change = (F.col("v") - F.col("past")) / F.col("scale")
    told = rows.withColumn("past", past).withColumn("way", F.when(F.col("past").isNotNull(), F.when(change > delta, 1).when(change < -delta, -1).otherwise(0)))
    before = F.coalesce(F.last("way", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumn("before", before).where("way is not null and way <> 0 and way <> before").select("entity_id", "hour", "channel", F.when(F.col("way") > 0, "rising").otherwise("falling").alias("event_subtype"))


def band_entries(rows: DataFrame, abnormal: Column, severe: Column) -> DataFrame:
    """Observations whose severity band is not normal and differs from that of the observation before."""
    order = Window.partitionBy("entity_id", "channel").orderBy("hour")
    told = rows.withColumn("band", F.when(severe, "severe").when(abnormal, "high").otherwise("normal"))
    return told.withColumn("before", F.lag("band").over(order)).where("band <> 'normal' and (before is null or before <> band)").drop("before")


def iqr_scale(rows: DataFrame, entities: int = 400) -> DataFrame:
    """Per channel, the interquartile range over the first entities, or 1 where that is 0."""
    first = rows.select("entity_id").distinct().orderBy("entity_id").limit(entities)
    iqr = F.percentile("v", 0.75) - F.percentile("v", 0.25)
    return rows.join(first, "entity_id", "left_semi").groupBy("channel").agg(F.when(iqr > 0, iqr).otherwise(1.0).alias("scale"))
