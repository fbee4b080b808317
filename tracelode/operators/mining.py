"""Frequent itemsets and ordered sequences of failure windows, their scores and their null ceilings.

windows: window_id, is_failure (boolean), items (in order), item_set, and horizon where stated."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tracelode.functions.columns import draw, holds_all, holds_in_order
from tracelode.operators.ordered import ranked_by_draw
from tracelode.sources.shared import written

#: Patterns up to this many are broadcast to the windows; more are matched by their items (see containment).
BROADCAST_PATTERNS = 20_000


#: Items of a prefix's rows up to which it is finished in one task.
SMALL = 1_000_000


def itemsets(windows: DataFrame, min_support: float = 0.05) -> DataFrame:
    """(itemset, n_failure): sets in at least min_support of all failure windows, empty ones counted. A set is a
    subsequence of a sorted set."""
    failures = windows.where("is_failure").select(F.array_sort("item_set").alias("items"))
    return grown(failures, needed(failures.count(), min_support)).select(F.col("pattern").alias("itemset"), F.col("n").alias("n_failure"))


def sequences(windows: DataFrame, min_support: float = 0.05) -> DataFrame:
    """(sequence, n_failure): gapped subsequences in at least min_support of the failure windows that aren't empty.
    Patterns may be as long as the longest window."""
    failures = windows.where("is_failure").where(F.size("items") > 0).select("items")
    return grown(failures, needed(failures.count(), min_support)).select(F.col("pattern").alias("sequence"), F.col("n").alias("n_failure"))


def needed(number: int, share: float) -> int:
    """The least whole number that is this share of all, in decimals."""
    return max(1, ceil(Decimal(str(share)) * number))


def grown(rows: DataFrame, least: int) -> DataFrame:
    """(pattern, n): the gapped subsequences of at least `least` of the rows (items).

    Equal rows are one, with their number, and so are equal rests behind a prefix: work and memory grow with the
    different rows. A step puts each frequent prefix before every item of its rests; only counts per prefix are gathered.
    A prefix whose rests have at most SMALL items together is finished in one task."""
    schema = "pattern array<string>, n long"
    state = rows.where(F.size("items") > 0).groupBy("items").agg(F.count("*").alias("n")).withColumn("prefix", F.array().cast("array<string>"))
    out = None
    while True:
        longer = state.select("prefix", "items", "n", F.explode(F.array_distinct("items")).alias("x"))
        rest = F.expr("slice(items, cast(array_position(items, x) as int) + 1, size(items))")
        longer = longer.select(F.concat("prefix", F.array("x")).alias("prefix"), rest.alias("items"), "n").groupBy("prefix", "items").agg(F.sum("n").alias("n"))
        longer = written(longer, "prefixes")
        kept = written(longer.groupBy("prefix").agg(F.sum("n").alias("all"), F.sum(F.size("items")).alias("work")).where(F.col("all") >= least), "patterns")
        some = longer.where(F.size("items") > 0).join(F.broadcast(kept.select("prefix", (F.col("work") <= SMALL).alias("small"))), "prefix")
        finished = some.where("small").groupBy("prefix").applyInArrow(lambda t: finish(t, least), schema)
        one = kept.select(F.col("prefix").alias("pattern"), F.col("all").alias("n")).unionByName(finished)
        out = one if out is None else out.unionByName(one)
        if kept.where(F.col("work") > SMALL).isEmpty():
            return written(out, "grown")
        state = some.where(~F.col("small"))


def finish(table: pa.Table, least: int) -> pa.Table:
    """All patterns that begin with the prefix of these rests and are longer."""
    found: list[tuple[list[str], int]] = []

    def walk(prefix: list[str], rests: list[tuple[list[str], int, int]]) -> None:
        counts: Counter[str] = Counter()
        for items, at, n in rests:
            for x in set(items[at:]):
                counts[x] += n
        for x, n in sorted(counts.items()):
            if n >= least:
                found.append(([*prefix, x], n))
                walk(found[-1][0], [(items, items.index(x, at) + 1, n) for items, at, n in rests if x in items[at:]])

    walk(table["prefix"][0].as_py(), [(items, 0, n) for items, n in zip(table["items"].to_pylist(), table["n"].to_pylist(), strict=True)])
    return pa.table({"pattern": pa.array([p for p, _ in found], pa.list_(pa.string())), "n": pa.array([n for _, n in found], pa.int64())})


def held_in(rows: DataFrame, seq: str, patterns: list[list[str]], name: str) -> DataFrame:
    """rows with the names (items joined by bars) of the patterns that each one's seq holds in order. Patterns are a tree
    by their items, of which a row visits only what it holds: no pattern is tried in vain."""
    tree: dict = {}
    for p in patterns:
        at = tree
        for x in p:
            at = at.setdefault(x, {})
        at[None] = "|".join(p)  # no item is null

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(at: dict, items: list[str], start: int) -> None:
            for x in dict.fromkeys(items[start:]):
                if (below := at.get(x)) is not None:
                    if None in below:
                        own.append(below[None])
                    walk(below, items, items.index(x, start) + 1)

        for batch in batches:
            out = []
            for items in batch.column(seq).to_pylist():
                own: list[str] = []
                walk(tree, items, 0)
                out.append(own)
            yield batch.append_column(name, pa.array(out, pa.list_(pa.string())))

    return rows.mapInArrow(held, StructType([*rows.schema.fields, StructField(name, ArrayType(StringType()))]))


def set_hits(windows: DataFrame, patterns: DataFrame, pattern: str = "itemset") -> DataFrame:
    """(window's columns, pattern) of every itemset that a window holds.

    Few patterns are broadcast and tested in place. Many are matched through their items: a pattern is held where as
    many of its items occur as it has."""
    few = patterns.select(pattern).limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    if few:
        return windows.join(F.broadcast(patterns.select(pattern)), holds_all(F.col("item_set"), F.col(pattern)))
    named = patterns.select(pattern, F.size(pattern).alias("size"), F.explode(pattern).alias("item"))
    occurring = windows.select("window_id", F.explode("item_set").alias("item"))
    counted = occurring.join(named, "item").groupBy("window_id", pattern, "size").count().where("count = size").select("window_id", pattern)
    return windows.join(counted, "window_id")


def sequence_hits(windows: DataFrame, patterns: DataFrame, pattern: str = "sequence") -> DataFrame:
    """(window's columns, pattern) of every sequence that a window holds in order. Beyond BROADCAST_PATTERNS, only
    windows that hold the pattern's rarest-to-match first item are tested."""
    few = patterns.select(pattern).limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    if few:
        return windows.join(F.broadcast(patterns.select(pattern)), holds_in_order(F.col("items"), F.col(pattern)))
    starts = windows.withColumn("head", F.explode("item_set"))
    return starts.join(patterns.select(pattern, F.col(pattern)[0].alias("head")), "head").where(holds_in_order(F.col("items"), F.col(pattern))).drop("head")


def class_sizes(windows: DataFrame) -> DataFrame:
    return windows.agg(F.count_if("is_failure").alias("all_failure"), F.count_if(~F.col("is_failure")).alias("all_control"))


def tallied(windows: DataFrame, seq: str) -> DataFrame:
    """Windows with equal sets (or sequences) as one row, which stands for n_f failures and n_c controls."""
    groups = windows.groupBy(seq).agg(F.count_if("is_failure").alias("n_f"), F.count_if(~F.col("is_failure")).alias("n_c"))
    return groups.withColumn("window_id", F.col(seq))


def set_scores(windows: DataFrame, patterns: DataFrame, pattern: str = "itemset") -> DataFrame:
    """Scores of itemsets; each different set of items is tested once, however many windows have it."""
    return scored(set_hits(tallied(windows, "item_set"), patterns, pattern), windows, pattern)


def sequence_scores(windows: DataFrame, patterns: DataFrame, pattern: str = "sequence") -> DataFrame:
    """Scores of sequences; each different sequence of items is tested once."""
    return scored(sequence_hits(tallied(windows, "items").withColumn("item_set", F.array_distinct("items")), patterns, pattern), windows, pattern)


def scored(hits: DataFrame, windows: DataFrame, pattern: str) -> DataFrame:
    """Hits, supports, lift, P(failure | pattern), relative risk and base rate of each pattern. Patterns without hits have no row.
    hits: rows of windows, or of tallied ones."""
    own = (F.sum("n_f"), F.sum("n_c")) if "n_f" in hits.columns else (F.count_if("is_failure"), F.count_if(~F.col("is_failure")))
    counts = hits.groupBy(pattern).agg(own[0].alias("n_failure"), own[1].alias("n_control"))
    return with_scores(counts.crossJoin(F.broadcast(class_sizes(windows))))  # one row


def with_scores(counts: DataFrame) -> DataFrame:
    hit, everyone = F.col("n_failure") + F.col("n_control"), F.col("all_failure") + F.col("all_control")
    rest = F.try_divide(F.col("all_failure") - F.col("n_failure"), everyone - hit)
    return counts.select(
        "*", F.try_divide("n_failure", "all_failure").alias("support_failure"), F.try_divide("n_control", "all_control").alias("support_control"),
        F.try_divide(F.col("n_failure") / F.col("all_failure"), hit / everyone).alias("lift_failure"), F.try_divide("n_failure", hit).alias("p_fail_given_pattern"),
        F.try_divide(F.try_divide("n_failure", hit), rest).alias("relative_risk"), (F.col("all_failure") / everyone).alias("base_rate_failure"),
    )


def relabelled(windows: DataFrame, seed: int, within: str | None = None) -> DataFrame:
    """The same windows with as many failures (per group of `within`) dealt out by hash."""
    number = windows.groupBy(*([within] if within else [])).agg(F.count_if("is_failure").alias("n_f"))
    if within:
        order = Window.partitionBy(within).orderBy(draw("window_id", F.lit(seed)), "window_id")
        joined = windows.withColumn("place", F.row_number().over(order)).join(number, within)
    else:
        joined = ranked_by_draw(windows, ["window_id", F.lit(seed)], ["window_id"]).crossJoin(F.broadcast(number))  # one row
    return joined.withColumn("is_failure", F.col("place") <= F.col("n_f")).drop("place", "n_f")


def shuffled(windows: DataFrame, seed: int) -> DataFrame:
    """The same windows with each one's items in an order drawn by hash: sets and counts stay."""
    drawn = F.transform(F.array_sort("items"), lambda x, i: F.struct(F.md5(F.concat_ws("|", F.col("window_id").cast("string"), i.cast("string"), F.lit(str(seed)))).alias("k"), x.alias("x")))
    return windows.withColumn("items", F.transform(F.array_sort(drawn), lambda s: s["x"]))


def ceiling(patterns: DataFrame, null: DataFrame, name: str) -> DataFrame:
    """patterns with the largest lift of the null's patterns, and whether theirs is above it (unknown isn't)."""
    top = null.agg(F.max("lift_failure").alias(name))
    return patterns.crossJoin(F.broadcast(top)).withColumn("survives", F.coalesce(F.col("lift_failure") > F.col(name), F.col(name).isNull()))


def mined_itemsets(windows: DataFrame, min_support: float = 0.05, seed: int = 7) -> DataFrame:
    """Itemsets with scores and the permutation ceiling; survivors have a lift above all of randomly labelled windows."""
    real = set_scores(windows, itemsets(windows, min_support))
    random = written(relabelled(windows, seed), "relabelled")
    null = set_scores(random, itemsets(random, min_support))
    return ceiling(real, null, "permuted_ceiling").withColumn("itemset_size", F.size("itemset"))


def mined_sequences(windows: DataFrame, min_support: float = 0.05, seed: int = 7) -> DataFrame:
    """Sequences with scores, those of their sets, the gain of order, and the ceiling of shuffled windows."""
    found = sequences(windows, min_support)
    real = written(sequence_scores(windows, found).withColumn("itemset", F.array_sort(F.array_distinct("sequence"))), "sequences")
    sets = set_scores(windows, real.select("itemset").distinct()).select("itemset", F.col("lift_failure").alias("itemset_lift_failure"))
    mixed = written(shuffled(windows, seed), "shuffled")
    null = sequence_scores(mixed, sequences(mixed, min_support))
    gained = real.join(sets, "itemset", "left").withColumn("order_gain", F.col("lift_failure") - F.col("itemset_lift_failure"))
    return ceiling(gained, null, "shuffled_ceiling").withColumn("sequence_length", F.size("sequence"))


def closed(patterns: DataFrame, pattern: str, count: str = "n_failure", ordered: bool = False) -> DataFrame:
    """Patterns of which no longer pattern that holds them has the same count. They meet by count and by their first
    item, never all with all."""
    longer = patterns.select(F.col(pattern).alias("longer"), F.col(count).alias("same"), F.explode(F.array_distinct(pattern)).alias("head"))
    holds = holds_in_order(F.col("longer"), F.col(pattern)) if ordered else holds_all(F.col("longer"), F.col(pattern))
    return patterns.join(longer, (F.col(count) == F.col("same")) & (F.col(pattern)[0] == F.col("head")) & (F.size("longer") > F.size(pattern)) & holds, "left_anti")


def collapsed(stream: DataFrame) -> DataFrame:
    """Events without those of the same item as the one just before, per entity."""
    order = Window.partitionBy("entity_id").orderBy("us", "ordinal")
    return stream.withColumn("before", F.lag("item").over(order)).where("before is null or before <> item").drop("before")


def chains_of_three(windows: DataFrame) -> DataFrame:
    """Contiguous chains of three different items after merging repeats: occurrences among failures, windows among controls."""
    merged = F.filter("items", lambda x, i: (i == 0) | (x != F.element_at("items", F.greatest(i, F.lit(1)))))
    rows = windows.select("window_id", "is_failure", merged.alias("m")).where(F.size("m") >= 3)
    triples = rows.select("window_id", "is_failure", F.explode(F.transform(F.sequence(F.lit(1), F.size("m") - 2), lambda i: F.slice("m", i, 3))).alias("chain")).where(F.size(F.array_distinct("chain")) == 3)
    return triples.groupBy("chain").agg(F.count_if("is_failure").alias("case_occurrences"), F.count_distinct(F.when(~F.col("is_failure"), F.col("window_id"))).alias("control_windows"))


def chains(windows: DataFrame, longest: int = 4, shortest: int = 3) -> DataFrame:
    """Ordered chains of different items with gaps: (chain, n_failure, n_control) by windows.

    Windows with the same items are one row, which stands for all of them. Chains grow by one place at a time within
    their row: each step joins a chain with the later places of its own row only, and repeats are dropped at once."""
    rows = written(tallied(windows, "items"), "tallied").withColumn("row", F.col("items"))
    first = F.transform(F.col("items"), lambda x, i: F.struct(i.alias("at"), x.alias("item")))
    spots = rows.select("row", F.explode(first).alias("s")).groupBy("row", F.col("s.item").alias("item")).agg(F.collect_list("s.at").alias("places"))
    grown = spots.select("row", F.array("item").alias("chain"), F.array_min("places").alias("at"))
    out = None
    for size in range(2, longest + 1):
        later = spots.select("row", F.col("item").alias("next"), "places")
        grown = grown.join(later, "row").where(~F.array_contains("chain", F.col("next")))
        grown = grown.withColumn("next_at", F.array_min(F.filter("places", lambda p: p > F.col("at")))).where("next_at is not null")
        grown = grown.select("row", F.concat("chain", F.array("next")).alias("chain"), F.col("next_at").alias("at"))
        if size >= shortest:
            out = grown if out is None else out.unionByName(grown)
    return out.join(rows.select("row", "n_f", "n_c"), "row").groupBy("chain").agg(F.sum("n_f").alias("n_failure"), F.sum("n_c").alias("n_control"))


def dominance(patterns: DataFrame, top: int = 200, slack: float = 0.05) -> DataFrame:
    """Of the top sequences of several items by lift, whether a proper subsequence reaches their lift less slack."""
    best = patterns.where(F.size("sequence") > 1).orderBy(F.desc("lift_failure"), "sequence").limit(top)
    parts = patterns.select(F.col("sequence").alias("part"), F.col("lift_failure").alias("part_lift"), F.col("sequence")[0].alias("head"))
    heads = best.select("sequence", F.explode(F.array_distinct("sequence")).alias("head"))
    held = heads.join(parts, "head").where((F.size("part") < F.size("sequence")) & holds_in_order(F.col("sequence"), F.col("part")))
    most = held.groupBy("sequence").agg(F.max("part_lift").alias("best_part_lift"))
    pairs = best.select("sequence", "lift_failure").join(most, "sequence", "left")
    return pairs.withColumn("dominated", F.coalesce(F.col("best_part_lift") >= F.col("lift_failure") - slack, F.lit(False)))


def order_effect(windows: DataFrame, patterns: DataFrame, shuffles: int = 5, top: int = 50) -> DataFrame:
    """Lift of the top sequences less their mean lift over shuffled windows, which keep every window's items. Each
    different shuffled sequence of a copy is tested once, however many windows have it."""
    best = patterns.where(F.size("sequence") > 1).orderBy(F.desc("lift_failure"), "sequence").limit(top).select("sequence", F.col("lift_failure").alias("real_lift"))
    copies = windows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
    drawn = F.transform(F.array_sort("items"), lambda x, i: F.struct(F.md5(F.concat_ws("|", F.col("window_id").cast("string"), i.cast("string"), F.col("copy").cast("string"))).alias("k"), x.alias("x")))
    mixed = copies.withColumn("items", F.transform(F.array_sort(drawn), lambda s: s["x"]))
    alike = mixed.groupBy("copy", "items").agg(F.count_if("is_failure").alias("n_f"), F.count_if(~F.col("is_failure")).alias("n_c"))
    hits = alike.join(F.broadcast(best), holds_in_order(F.col("items"), F.col("sequence")))
    counts = hits.groupBy("copy", "sequence").agg(F.sum("n_f").alias("n_failure"), F.sum("n_c").alias("n_control"))
    lifts = with_scores(counts.crossJoin(F.broadcast(class_sizes(windows)))).groupBy("sequence").agg((F.sum("lift_failure") / shuffles).alias("shuffled_lift"))
    return best.join(lifts, "sequence", "left").select("sequence", "real_lift", F.coalesce("shuffled_lift", F.lit(0.0)).alias("shuffled_lift"), F.nullif(F.col("real_lift") - F.coalesce("shuffled_lift", F.lit(0.0)), F.lit(0.0)).alias("order_effect")).fillna(0.0, ["order_effect"])


def precursors(stream: DataFrame, kind: str, horizon: int, least: int = 5, factor: float = 3.0, items: Column | None = None) -> DataFrame:
    """Items with at least `least` firings whose share followed by a failure within (t, t + horizon] is factor times that of all firings."""
    code = F.col("item") if items is None else items
    order = Window.partitionBy("entity_id").orderBy("us").rangeBetween(1, horizon)
    marked = stream.withColumn("hit", F.coalesce(F.max((F.col("event_type") == kind).cast("int")).over(order), F.lit(0)))
    fired = marked.where(F.col("event_type") != kind).select(code.alias("item"), "hit")
    base = fired.agg(F.avg("hit").alias("base"))
    return fired.groupBy("item").agg(F.count("*").alias("firings"), F.sum("hit").alias("hits")).crossJoin(F.broadcast(base)).where((F.col("firings") >= least) & (F.col("hits") / F.col("firings") >= factor * F.col("base")))
