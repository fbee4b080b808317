"""Queries of the assays: what order and timing add, how strong a signal must be, and intervals of models' differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracelode.operators import assays, evaluation, features, mining, models, stats, windows
from tracelode.plans import sql as S
from tracelode.plans.catalogue import CLEAN, DAY, SCORE, WINDOW_ROWS, history, kept_windows, query, r6, stream, tallied_hits, window_rows
from tracelode.sources import tables as T
from tracelode.sources.shared import written


@query("order_power")
def order_power(spark, d):
    """AUROC that order adds, by the share of windows with a planted order, and the smallest share that is detected."""
    areas = written(assays.order_areas(kept_windows(spark, d)), "order-areas")
    return r6(assays.power(areas, F.col("real") - F.col("shuffled")), "mean", "least", "most", "share_above")


@query("order_value_assay")
def order_value_assay(spark, d):
    """What order adds: AUROC of precedence features on real windows less that on shuffled ones, over splits by entity."""
    areas = assays.order_areas(kept_windows(spark, d), strengths=(0.0,)).drop("strength")
    return r6(areas.withColumn("order_value", F.col("real") - F.col("shuffled")), "real", "shuffled", "order_value")


def timed_windows(spark, d, k: int = 5):
    s = stream(spark, d)
    anchors = windows.anchors_of(s, T.FAILURE, CLEAN)
    found = windows.last_k(history(spark, d).select("entity_id", "us", "ordinal", "item"), anchors, k)
    return assays.recency_features(found, anchors).withColumn("window_id", F.concat_ws("/", F.col("entity_id").cast("string"), F.col("anchor").cast("string"), F.col("is_failure").cast("int").cast("string")))


@query("recency_features", f"""with {S.windows(5)}, tok as (select entity_id, anchor, is_failure, item, count(*) as n, min(us) as first, max(us) as us from found group by 1, 2, 3, 4),
  per as (select entity_id, anchor, is_failure, sum(n) as n, ln(1 + (anchor - min(first)) / 1e6) as span, ln(1 + (anchor - max(us)) / 1e6) as last, anchor - max(us) as gap, string_agg(item || '=' || round(ln(1 + (anchor - us) / 1e6), 4)::decimal(9,4)::varchar, '|' order by item) as tokens from tok group by 1, 2, 3),
  whole as (select a.entity_id, a.anchor, a.is_failure, coalesce(n, 0) as n, coalesce(span, 0) as span, coalesce(last, 0) as last, coalesce(gap, 0) as gap, coalesce(tokens, '') as tokens from anchors a left join per using (entity_id, anchor, is_failure))
  select entity_id, anchor, is_failure, n::bigint as n, round(span, 6) as span, round(last, 6) as last, (select count(*) from unnest((select quantile_cont(gap, [0.25, 0.5, 0.75]) from whole)) u(b) where b < gap)::int as quartile, tokens from whole""")  # fmt: skip
def recency_features(spark, d):
    shown = F.array_join(F.transform("tokens", lambda t: F.concat(t["item"], F.lit("="), F.round(t["recency"], 4).cast("decimal(9,4)").cast("string"))), "|")
    return r6(timed_windows(spark, d).select("entity_id", "anchor", "is_failure", "n", "span", "last", "quartile", shown.alias("tokens")), "span", "last")


@query("recency_dealt", f"""with {S.windows(5)}, tok as (select entity_id || '/' || anchor || '/' || cast(is_failure as int) as window_id, anchor, item, max(us) as us, sum(count(*)) over (partition by entity_id, anchor, is_failure) as n, anchor - max(max(us)) over (partition by entity_id, anchor, is_failure) as gap from found group by entity_id, anchor, is_failure, item),
  gaps as (select coalesce(max(a.anchor - f.us) filter (where back = 1), 0) as gap from anchors a left join found f using (entity_id, anchor, is_failure) group by entity_id, a.anchor, is_failure), bounds as (select quantile_cont(gap, [0.25, 0.5, 0.75]) as b from gaps),
  strata as (select window_id, item, n, len(list_filter(b, lambda x: x < gap)) as quartile, (anchor - us) / 1e6 as age from tok, bounds),
  taken as (select *, row_number() over (partition by item, n, quartile order by {S.draw('window_id', 'item', "'taken'")}, window_id) as place from strata), given as (select item, n, quartile, age as dealt, row_number() over (partition by item, n, quartile order by {S.draw('window_id', 'item', "'given'")}, window_id) as place from strata)
  select window_id, item, n::bigint as n, quartile::int as quartile, round(ln(1 + age), 6) as recency, round(ln(1 + dealt), 6) as dealt from taken join given using (item, n, quartile, place)""")  # fmt: skip
def recency_dealt(spark, d):
    """Recencies dealt anew among the windows that have the item, as many events and a last gap of the same quartile."""
    return r6(assays.dealt_recency(timed_windows(spark, d)), "recency", "dealt")


@query("recency_assay")
def recency_assay(spark, d):
    """What the items' recency adds to their presence, against recencies dealt anew, over eight splits by entity."""
    return r6(assays.recency_summary(written(assays.timing_areas(timed_windows(spark, d)), "timing-areas")), "mean", "least", "most", "share_above")


@query("timing_power")
def timing_power(spark, d):
    """AUROC that timing adds in windows of five events, by the share of windows with a planted item that is recent in
    failures and old in controls, and the smallest share that is detected."""
    rows = timed_windows(spark, d).where("n = 5")
    areas = written(assays.timing_areas(rows, ("recency", "dealt"), assays.STRENGTHS), "timing-areas")
    return r6(assays.power(areas, F.col("recency") - F.col("dealt")), "mean", "least", "most", "share_above")


#: Rules in place of models: their differences can be stated in SQL.
RULES = {"events": "n_events", "different": "size(item_set)", "purchases": "size(filter(items, x -> x like 'purchase%'))", "first": "coalesce(cast(get(items, 0) like 'view%' as int), 0)"}
RULES_SQL = {"events": "n_events", "different": "len(item_set)", "purchases": "len(list_filter(items, lambda x: x like 'purchase%'))", "first": "coalesce(cast(items[1] like 'view%' as int), 0)"}
PAIRS = [*[(m, m, "") for m in RULES], ("different less events", "different", "events"), ("purchases less different", "purchases", "different"), ("first less purchases", "first", "purchases")]


@query("paired_intervals", f"""{SCORE}, rules as ({" union all ".join(f"select '{m}' as model, entity_id, cast(is_failure as int) as label, {r}::double as score from win" for m, r in RULES_SQL.items())}),
  ent as (select entity_id, row_number() over (order by entity_id) as place, count(*) over () as n from (select distinct entity_id from win)),
  picks as (select b, {S.draw('b', 'place')} % n + 1 as place, count(*) as times from (select place, n, unnest(range(1, 201)) as b from ent) group by 1, 2 union all select 0, place, 1 from ent),
  steps as (select model, b, score, sum(label * times) as pos, sum((1 - label) * times) as neg from rules join ent using (entity_id) join picks using (place) group by 1, 2, 3),
  below as (select *, coalesce(sum(neg) over (partition by model, b order by score rows between unbounded preceding and 1 preceding), 0) as low from steps),
  areas as (select model, b, sum(pos * (low + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as a from below group by 1, 2),
  v as (select name, x.b, x.a - case when other = '' then 0 else y.a end as v from (values {", ".join(map(str, PAIRS))}) p(name, model, other) join areas x using (model) left join areas y on y.model = p.other and y.b = x.b)
  select name, round(max(v) filter (where b = 0), 6) as value, round(quantile_cont(v, 0.025) filter (where b > 0), 6) as low, round(quantile_cont(v, 0.975) filter (where b > 0), 6) as high, count(v) filter (where b > 0) as draws from v group by name""")  # fmt: skip
def paired_intervals(spark, d):
    """Areas of four rules, and differences in the same draws of entities, with their intervals over 200 draws."""
    w = kept_windows(spark, d)
    rules = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(r).cast("double").alias("score")) for m, r in RULES.items()])
    scored = w.select("entity_id", F.col("is_failure").cast("int").alias("label"), F.explode(rules).alias("x")).select("entity_id", "label", "x.*")
    return r6(evaluation.paired_intervals(evaluation.drawn_areas(scored, 200), PAIRS), "value", "low", "high")


BLOCKS = ["event_count", "presence", "multiset", "bigram"]


def block_design(words: list[str], pairs: list[str]) -> models.Design:
    """The number of events, which items and how many of each, and which of the adjacent pairs a window has: one model each."""
    index, pair_index = {w: j for j, w in enumerate(words)}, {p: j for j, p in enumerate(pairs)}

    def design(batch):
        at = np.arange(batch.num_rows)
        items = models.column(batch, "items").to_pylist()
        counts, follows = np.zeros((len(items), len(words))), np.zeros((len(items), len(pairs)))
        for i, own in enumerate(items):
            for x in own:
                if x in index:
                    counts[i, index[x]] += 1
            for a, b in zip(own, own[1:], strict=False):
                if (j := pair_index.get(f"{a}>{b}")) is not None:
                    follows[i, j] = 1
        for model, x in enumerate([np.array([[len(own)] for own in items], float), counts > 0, counts, follows]):
            if x.shape[1]:
                yield model, x, at

    return design


@query("decomposition_ci")
def decomposition_ci(spark, d):
    """AUROC of logistic regressions on the number of events, the items, their counts and the 200 most frequent adjacent
    pairs, and what each adds to the one before, with intervals over 200 draws of the entities held out."""
    w = evaluation.entity_split(kept_windows(spark, d)).withColumn("label", F.col("is_failure").cast("int"))
    w = written(w.select("entity_id", "label", "train", "items"), "split")
    train = w.where("train")
    design = block_design(features.vocabulary(train), features.top_bigrams(train))
    scored = models.scored(w, design, models.fitted(w, design), "entity_id")
    named = written(scored.withColumn("model", F.element_at(F.array(*map(F.lit, BLOCKS)), F.col("model") + 1)), "block-scores")
    pairs = [*[(b, b, "") for b in BLOCKS], *[(f"{b} less {a}", b, a) for a, b in zip(BLOCKS, BLOCKS[1:], strict=False)]]
    return r6(evaluation.paired_intervals(evaluation.drawn_areas(named, 200), pairs), "value", "low", "high")


# Hot entities, landmarks, and permutations from counts.

HOT = S.EV.replace("select user_id as entity_id", "select case when user_id % 10 < 9 then 0 else user_id end as entity_id")


@query("win_last10_hot", f"with {HOT}, anchors as (select distinct entity_id, us as anchor, true as is_failure from ev where event_type = 'error'), {S.HIST}, {S.last_k(10)} {WINDOW_ROWS}")
def win_last10_hot(spark, d):
    """Windows of a stream of which one entity has nine tenths, cut into ranges of 500 events."""
    s = stream(spark, d).withColumn("entity_id", F.when(F.col("entity_id") % 10 < 9, 0).otherwise(F.col("entity_id")))
    return window_rows(windows.count_windows(s.where(F.col("event_type") != T.FAILURE), windows.failure_anchors(s, T.FAILURE), 10, most=500))


LANDMARKS = f"""{S.EV}, spans as (select entity_id, min(us) as first, max(us) as last, min(us) filter (where event_type = 'error') as failed from ev group by 1),
  marks as (select entity_id, failed, last, unnest(range((first // {DAY} + 1) * {DAY}, least(last, coalesce(failed, last)) + 1, {DAY})) as anchor from spans), anchors as (select entity_id, anchor, coalesce(failed < anchor + {DAY}, false) as is_failure from marks), {S.HIST}, {S.last_k(20)}"""


@query("landmark_windows", f"with {LANDMARKS} select entity_id, anchor, cast(is_failure as int) as is_failure, cast(n_events as bigint) as n_events, array_to_string(items, '|') as items from win")
def landmark_windows(spark, d):
    """Each day every entity that is seen and hasn't failed yet: its last 20 events, and whether it fails within a day."""
    return landmarked(spark, d).select("entity_id", "anchor", F.col("is_failure").cast("int").alias("is_failure"), "n_events", F.array_join("items", "|").alias("items"))


def landmarked(spark, d):
    return windows.landmark_windows(stream(spark, d), T.FAILURE, 20, DAY, DAY)


@query("landmark_split", f"""with {LANDMARKS}, e as (select entity_id, row_number() over (order by {S.draw('entity_id', '0')}, entity_id) <= floor(0.5 * count(*) over ()) as train from (select distinct entity_id from win)),
  scored as (select train, cast(is_failure as int) as label, n_events as score from win join e using (entity_id)), steps as (select train, score, sum(label) as pos, sum(1 - label) as neg from scored group by 1, 2),
  below as (select *, coalesce(sum(neg) over (partition by train order by score rows between unbounded preceding and 1 preceding), 0) as low from steps)
  select train, sum(pos + neg)::bigint as windows, sum(pos)::bigint as failures, round(sum(pos * (low + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) as auroc from below group by 1""")  # fmt: skip
def landmark_split(spark, d):
    """Landmark windows in two halves of the entities: sizes, failures, and the AUROC of the number of events."""
    rows = evaluation.entity_split(landmarked(spark, d), 0.5).select("train", F.col("is_failure").cast("int").alias("label"), F.col("n_events").cast("double").alias("score"))
    rows = written(rows, "landmark-split")
    sizes = rows.groupBy("train").agg(F.count("*").alias("windows"), F.sum("label").alias("failures"))
    return r6(sizes.join(evaluation.auroc(rows, "train"), "train"), "auroc")


@query("landmark_auroc")
def landmark_auroc(spark, d):
    """AUROC on the entities held out of models of landmark windows: numbers of events and of different items, counts of
    items, and which of the itemsets in 0.05 of the training failures are held."""
    w = evaluation.entity_split(landmarked(spark, d), 0.5).withColumn("label", F.col("is_failure").cast("int"))
    w = written(w.select(F.monotonically_increasing_id().alias("window_id"), "entity_id", "is_failure", "label", "train", "items", "item_set"), "landmarks")
    train = w.where("train")
    found = [tuple(r.itemset) for r in mining.itemsets(train).orderBy(F.desc("n_failure"), "itemset").limit(features.MOST_WORDS + 1).collect()]
    if len(found) > features.MOST_WORDS:
        raise ValueError(f"over {features.MOST_WORDS} itemsets: state a higher support")
    words = features.vocabulary(train)
    design = landmark_design(words, found)
    scored = written(models.scored(w, design, models.fitted(w, design)), "landmark-scores")
    names = F.array(*map(F.lit, ("counts", "token_counts", "patterns")))
    return r6(evaluation.auroc(scored, "model").select(F.element_at(names, F.col("model") + 1).alias("features"), "auroc"), "auroc")


def landmark_design(words: list[str], patterns: list[tuple[str, ...]]) -> models.Design:
    index, sets = {w: j for j, w in enumerate(words)}, [frozenset(p) for p in patterns]

    def design(batch):
        items = models.column(batch, "items").to_pylist()
        at, counts, held = np.arange(len(items)), np.zeros((len(items), len(words))), np.zeros((len(items), len(sets)))
        for i, own in enumerate(items):
            for x in own:
                if x in index:
                    counts[i, index[x]] += 1
            seen = set(own)
            held[i] = [p <= seen for p in sets]
        yield 0, np.array([[len(own), len(set(own))] for own in items], float).reshape(-1, 2), at
        yield 1, counts, at
        if sets:
            yield 2, held, at

    return design


@query("within_entity_counts")
def within_entity_counts(spark, d):
    """p of permutations within entities, as within_entity_perm, drawn as counts."""
    w = kept_windows(spark, d)
    return r6(stats.within_entity_counts(tallied_hits(w), w, "itemset").withColumn("itemset", F.array_join("itemset", "|")), "p_within")


@query("min_p_counts")
def min_p_counts(spark, d):
    """Adjusted p by the smallest p of all itemsets, as min_p, drawn as counts."""
    w = kept_windows(spark, d)
    return r6(stats.min_p_counts(tallied_hits(w), w, "itemset").withColumn("itemset", F.array_join("itemset", "|")), "p", "p_adjusted")
