"""Samplers that build windows of several horizons at once, and the studies made of them.

All horizons of one anchor are cut from the longest of them, so that a stream is looked through once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.columns import item_set
from tracelode.operators import evaluation, mining, stats, windows
from tracelode.sources.shared import written

HOUR = windows.HOUR


def all_horizons(stream: DataFrame, history: DataFrame, kind: str, hours: tuple[int, ...] = (1, 6, 24), lasts: tuple[int, ...] = (5, 10), seeds: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """Windows of every horizon for every failure, with controls of the same entity: three per failure, drawn anew for
    each horizon. A time horizon's controls keep its length from failures, a count horizon's the longest one's.

    seeds: times (us) of planted failures, which are left out; if their number isn't the expected one, this raises."""
    if seeds is not None:
        if expected is not None and (n := seeds.select("us").distinct().count()) != expected:
            raise ValueError(f"{n} seed times, {expected} expected")
        stream = windows.without_seeds(stream, kind, seeds)
    failures = windows.failure_anchors(stream, kind)
    horizons = [(f"{h}h", h) for h in hours] + [(f"last{k}", k) for k in lasts]
    controls = windows.controls_by_salt(stream, failures, {name: (n if name.endswith("h") else max(hours)) * HOUR for name, n in horizons})
    out = None
    for name, n in horizons:
        timed = name.endswith("h")
        anchors = failures.unionByName(controls.where(F.col("salt") == name).drop("salt"))
        rows = windows.time_windows(history, anchors, n) if timed else windows.count_windows(history, anchors, n)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("target_type", F.when(F.col("is_failure"), kind))


def cut_to(rows: DataFrame, lasts: tuple[int, ...]) -> DataFrame:
    """A row per horizon of rows with items (those of the longest horizon, in time order)."""
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, lasts))))
    items = F.slice("items", F.greatest(F.size("items") - F.col("k") + 1, F.lit(1)), F.col("k"))
    return each.withColumns({"horizon": F.concat(F.lit("last"), "k"), "items": items, "item_set": item_set(items), "n_events": F.size(items).cast("long")}).drop("k")


def episode_windows(stream: DataFrame, kind: str, gap: int = HOUR, clean: int = HOUR, lasts: tuple[int, ...] = (5, 10, 20), per_episode: int = 3, tries: int = 40) -> DataFrame:
    """Windows before the first alert of each episode, and before controls of the same entity that keep the margin from
    every alert. Alerts are no history; anchors without history are left out; all horizons share their anchors."""
    alerts = windows.failure_anchors(stream, kind)
    first = windows.episodes(stream, kind, gap).select("entity_id", "anchor", F.lit(True).alias("is_failure"))
    controls = windows.control_anchors(stream, first, clean, per_episode, tries, around=alerts)
    rows = windows.count_windows(stream.where(F.col("event_type") != kind), first.unionByName(controls), max(lasts))
    return cut_to(rows.where("n_events > 0").select("entity_id", "anchor", "is_failure", "items"), lasts)


def repair_windows(stream: DataFrame, kind: str, lasts: tuple[int, ...] = (5, 10, 20), least: int = 5, after: int = HOUR, target: str = "repair") -> DataFrame:
    """Windows of whole entities: before the first failure, and an hour after the last event of those that never fail.
    Both need `least` events of history; failures are no history."""
    rows = windows.first_failure_windows(stream, kind, max(lasts), least, after=after, least_failing=least)
    return cut_to(rows.select("entity_id", "anchor", "is_failure", "items"), lasts).withColumn("target_type", F.when(F.col("is_failure"), target))


def riskset_windows(stream: DataFrame, subjects: DataFrame, k: int = 20, controls: int = 3) -> DataFrame:
    """Windows of the last k events before the time of each case, for the case and its controls, who share it. Controls
    without history are dropped, not replaced."""
    members = windows.risk_sets(subjects, controls)
    anchors = members.select("entity_id", F.col("length_at").alias("anchor"), (F.col("is_case") == 1).alias("is_failure"), "match_id")
    rows = windows.count_windows(stream, anchors, k).where("is_failure or n_events > 0")
    return rows.withColumn("window_id", F.concat_ws("/", F.col("match_id").cast("string"), F.col("entity_id").cast("string")))


def mined_horizons(rows: DataFrame, horizons: list[str], min_support: float = 0.05, seed: int = 7, demand: bool = False) -> DataFrame:
    """Per horizon with failures: windows, itemsets, the largest real and permuted lift, and how many patterns survive.
    demand: raise where a horizon has no signal (see demanded)."""
    out = None
    for h in horizons:
        own = written(rows.where(F.col("horizon") == h).select("window_id", "is_failure", "item_set"), "horizon")
        if own.where("is_failure and size(item_set) > 0").isEmpty():
            continue
        found = mining.mined_itemsets(own, min_support, seed)
        row = found.agg(F.count("*").alias("n_patterns"), F.max("lift_failure").alias("top_lift"), F.max("permuted_ceiling").alias("permuted_top"), F.count_if("survives").alias("survivors"))
        row = row.select(F.lit(h).alias("horizon"), "*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no horizon has failures with events")
    out = out.withColumn("clear", F.col("top_lift") >= 1.5 * F.col("permuted_top"))
    if demand:
        out = written(out, "mined-horizons")
        demanded(out)
    return out


def demanded(stats_: DataFrame) -> None:
    """Raises where a mined horizon has no survivors, or a top lift under 1.5 times the permuted one."""
    bad = [r.horizon for r in stats_.where("survivors = 0 or not clear").select("horizon").collect()]  # a row per horizon
    if bad:
        raise ValueError(f"no signal above the permuted windows: {', '.join(sorted(bad))}")


def sequence_invariants(rows: DataFrame, short: list[str], min_support: float = 0.05, seed: int = 7, slack: float = 0.05) -> DataFrame:
    """Per horizon, mean of the ten highest lifts in real and in shuffled windows, and whether that is as it has to be: in
    short horizons the two differ by less than `slack` of the shuffled one, in the others the real one is higher."""
    out = None
    for h in [r.horizon for r in rows.select("horizon").distinct().orderBy("horizon").collect()]:  # some horizons
        own = written(rows.where(F.col("horizon") == h).select("window_id", "is_failure", "items", "item_set"), "horizon")
        one = shuffle_contrast(own, min_support, seed).select(F.lit(h).alias("horizon"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no horizon has windows")
    return out.withColumn("holds", F.coalesce(F.when(F.col("horizon").isin(short), F.abs("gain") < slack).otherwise(F.col("real") > F.col("shuffled")), F.lit(False)))


def held_up(invariants: DataFrame) -> None:
    """Raises where an invariant of sequences doesn't hold."""
    if bad := [r.horizon for r in invariants.where("not holds").select("horizon").collect()]:
        raise ValueError(f"order is lost or planted: {', '.join(sorted(bad))}")


def shuffle_contrast(rows: DataFrame, min_support: float = 0.05, seed: int = 7, top: int = 10) -> DataFrame:
    """Mean of the highest lifts of sequences in real and in shuffled windows, and by how much the real ones are higher."""
    mixed = written(mining.shuffled(rows, seed), "shuffled")
    out = None
    for name, own in (("real", rows), ("shuffled", mixed)):
        best = mining.sequence_scores(own, mining.sequences(own, min_support)).orderBy(F.desc("lift_failure"), "sequence").limit(top)
        one = best.agg(F.avg("lift_failure").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.withColumn("gain", F.try_divide(F.col("real") - F.col("shuffled"), F.col("shuffled")))


def matched_split(rows: DataFrame, min_support: float = 0.05, top: int = 200, seed: int = 11) -> DataFrame:
    """Hazard ratios of the patterns with most case hits in one half of the match sets, tested on the other half, with q.

    rows: windows with match_id. A pattern's likelihood depends on counts of (n, t, x) over match sets only: these are
    grouped sums, so many patterns are many rows and nothing else."""
    halves = written(stats.split(rows, seed, entity="match_id"), "halves")
    found = halves.where("discovery")
    best = mining.set_hits(mining.tallied(found, "item_set"), mining.itemsets(found, min_support)).groupBy("itemset").agg(F.sum("n_f").alias("hits"))
    best = best.orderBy(F.desc("hits"), "itemset").limit(top).select("itemset")
    other = halves.where(~F.col("discovery"))
    sizes = other.groupBy("match_id").agg(F.count("*").alias("n"))
    held = mining.set_hits(other, best).groupBy("itemset", "match_id").agg(F.count("*").alias("t"), F.max(F.col("is_failure").cast("int")).alias("x"))
    strata = held.join(sizes, "match_id").withColumn("pattern", F.array_join("itemset", "|"))
    tested = written(stats.matched_hazard(strata), "hazards").where("p is not null")
    return stats.with_q(stats.with_q(tested), dependent=True, name="q_by")


def split_tests(rows: DataFrame, seeds: int = 20, min_support: float = 0.05, halves: DataFrame | None = None) -> DataFrame:
    """(seed, itemset, n_failure, n_control, p, q) of the patterns that are frequent in the discovery half of each split
    by entity, tested on the other half with Benjamini-Yekutieli.

    One mining serves all splits: what is frequent in a half is frequent enough in all windows. Windows are counted by
    (seed, half, set of items) before any pattern is looked at. halves: entity_id, seed, discovery in place of drawn ones."""
    halves = halves if halves is not None else evaluation.entity_splits(rows, seeds, 0.5).withColumnRenamed("train", "discovery")
    counts = rows.groupBy("entity_id", "item_set").agg(F.count_if("is_failure").alias("f"), F.count_if(~F.col("is_failure")).alias("c")).join(halves, "entity_id")
    counts = written(counts.groupBy("seed", "discovery", "item_set").agg(F.sum("f").alias("f"), F.sum("c").alias("c")), "halves")
    size = written(counts.groupBy("seed", "discovery").agg(F.sum("f").alias("all_failure"), F.sum("c").alias("all_control")), "sizes")
    least = size.where("discovery").agg(F.min("all_failure")).first()[0] or 0
    every = rows.agg(F.count_if("is_failure")).first()[0] or 1
    found = mining.itemsets(rows, min_support * least / every) if least else mining.itemsets(rows, min_support)
    held = mining.set_hits(counts.select("item_set").distinct().withColumn("window_id", F.col("item_set")), found).select("item_set", "itemset")
    hits = counts.join(held, "item_set").groupBy("seed", "discovery", "itemset").agg(F.sum("f").alias("n_failure"), F.sum("c").alias("n_control")).join(size, ["seed", "discovery"])
    frequent = hits.where(F.col("discovery") & (F.col("n_failure") >= F.ceil(F.lit(min_support) * F.col("all_failure"))) & (F.col("n_failure") > 0)).select("seed", "itemset")
    tested = stats.with_p(hits.where(~F.col("discovery")).join(frequent, ["seed", "itemset"]))
    return stats.with_q(tested, "seed", dependent=True)


def stability(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per split, how many patterns were tested and how many are significant."""
    return tests.groupBy("seed").agg(F.count("*").alias("n_tested"), F.count_if(F.col("q") < alpha).alias("n_significant"), F.avg((F.col("q") < alpha).cast("double")).alias("significant_share"))


def selection(tests: DataFrame, seeds: int = 20, alpha: float = 0.05) -> DataFrame:
    """Per pattern, in how many of the splits it was tested and the share of all in which it is significant."""
    return tests.groupBy("itemset").agg(F.count("*").alias("n_tested"), (F.count_if(F.col("q") < alpha) / seeds).alias("selection_frequency"))


def partition_summary(tests: DataFrame, partitions: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Over the partitions (seed) in which a pattern was tested: how many there are, median and quartiles of the share of
    significant patterns, and the mean Jaccard similarity of every two partitions' significant sets (1 for two empty ones).

    Two sets meet through the patterns that both have; a pattern is in as many sets as there are partitions at most."""
    shares = tests.groupBy("seed").agg(F.avg((F.col("q") < alpha).cast("double")).alias("share"), F.count_if(F.col("q") < alpha).alias("size"))
    shares = written(shares.join(partitions.select("seed").distinct(), "seed", "left_semi"), "partition-shares")
    found = tests.where(F.col("q") < alpha).select("seed", "itemset")
    both = found.join(found.withColumnRenamed("seed", "other"), "itemset").where("seed < other").groupBy("seed", "other").agg(F.count("*").alias("shared"))
    pairs = shares.select("seed", "size").join(shares.select(F.col("seed").alias("other"), F.col("size").alias("other_size")), F.col("seed") < F.col("other"))  # of some partitions
    union = F.col("size") + F.col("other_size") - F.coalesce("shared", F.lit(0))
    alike = pairs.join(both, ["seed", "other"], "left").agg(F.avg(F.when(union == 0, 1.0).otherwise(F.coalesce("shared", F.lit(0)) / union)).alias("mean_jaccard"))
    quartiles = shares.agg(F.count("*").alias("n_splits"), F.percentile("share", [0.25, 0.5, 0.75]).alias("p"))
    return quartiles.select("n_splits", F.col("p")[1].alias("median"), F.col("p")[0].alias("p25"), F.col("p")[2].alias("p75")).crossJoin(alike)  # one row each
