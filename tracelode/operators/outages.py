"""What lies before outages: guarded windows, chains with their spans, and one outage worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.columns import thinned
from tracelode.operators.windows import HOUR, failure_anchors, time_slice, without_prior_failure

KEYS = ["entity_id", "anchor", "is_failure"]


def outage_windows(stream: DataFrame, kind: str, hours: tuple[int, ...] = (24, 72)) -> DataFrame:
    """Per horizon and outage without an earlier one within the horizon: n_events, and the items with immediate repeats
    merged. Windows without events are dropped; outages are no history."""
    outages, history = failure_anchors(stream, kind), stream.where(F.col("event_type") != kind).select("entity_id", "us", "ordinal", "item")
    out = None
    for h in hours:
        found = time_slice(history, without_prior_failure(outages, outages, h * HOUR), h * HOUR)
        rows = found.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "ordinal", "item"))), lambda e: e["item"]).alias("items"))
        merged = F.filter("items", lambda x, i: (i == 0) | (x != F.element_at("items", F.greatest(i, F.lit(1)))))
        one = rows.select(F.lit(f"{h}h").alias("horizon"), *KEYS, F.size("items").cast("long").alias("n_events"), merged.alias("chain"))
        out = one if out is None else out.unionByName(one)
    return out


def timed_chains(history: DataFrame, anchors: DataFrame, span: int) -> DataFrame:
    """Chains of three different items side by side (immediate repeats merged) in the `span` before anchors: occurrences
    among outages, windows among controls, and the median minutes from the first to the third among outages."""
    found = time_slice(history.select("entity_id", "us", "ordinal", "item"), anchors.select(*KEYS), span)
    order = Window.partitionBy(*KEYS).orderBy("us", "ordinal")
    kept = found.withColumn("before", F.lag("item").over(order)).where("before is null or before <> item").drop("before")
    runs = kept.withColumns({"second": F.lead("item").over(order), "third": F.lead("item", 2).over(order), "end": F.lead("us", 2).over(order)})
    triples = runs.where("third is not null and item <> second and second <> third and item <> third")
    minutes = (F.col("end") - F.col("us")) / 6e7
    controls = F.count_distinct(F.when(~F.col("is_failure"), F.struct("entity_id", "anchor")))
    return triples.groupBy(F.array("item", "second", "third").alias("chain")).agg(F.count_if("is_failure").alias("case_occurrences"), controls.alias("control_windows"), F.percentile(F.when(F.col("is_failure"), minutes), 0.5).alias("median_span_min"))


def illustrated(stream: DataFrame, kind: str, warning: Column, hours: int = 12, gap: int = HOUR // 15, near: int = HOUR // 30, most: int = 10) -> DataFrame:
    """The outage with the best-spread precursors, minute by minute: entity_id, anchor, hours_before, n and items.

    Of the events from `hours` to two minutes before an outage, those of the same item within `gap` of the last one kept
    are dropped. An outage with two warnings, three different items and at most `most` events scores warnings
    + 0.3 * items + 0.2 * hours spanned; the best one is shown, ties by entity and time."""
    kinds = stream.select("item", warning.alias("warning")).distinct()
    pre = time_slice(stream.where(F.col("event_type") != kind), failure_anchors(stream, kind), hours * HOUR).where(F.col("us") < F.col("anchor") - near)
    kept = thinned(pre, ["entity_id", "anchor", "item"], gap).join(kinds, "item")
    n, different, span = F.count_if("warning"), F.count_distinct("item"), (F.max("us") - F.min("us")) / 3.6e9
    scores = kept.groupBy("entity_id", "anchor").agg(n.alias("warnings"), different.alias("different"), F.count("*").alias("events"), F.round(n + 0.3 * different + 0.2 * span, 9).alias("score"))
    best = scores.where((F.col("warnings") >= 2) & (F.col("different") >= 3) & (F.col("events") <= most)).orderBy(F.desc("score"), "entity_id", "anchor").limit(1)
    minute = F.floor(F.col("us") / 60_000_000) * 60_000_000
    shown = kept.join(F.broadcast(best.select("entity_id", "anchor", "score")), ["entity_id", "anchor"])
    return shown.groupBy("entity_id", "anchor", "score", minute.alias("minute")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("item")).alias("items")).withColumn("hours_before", (F.col("anchor") - F.col("minute")) / 3.6e9).drop("minute")
