"""Queries that complete studies: outages, alarms' burden, own baselines, covariates, head-to-heads and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import alarms, evaluation, features, mining, outages, samplers, windows
from tracelode.plans import sql as S
from tracelode.plans.catalogue import DAY, HOUR, RAISED, history, judged_by_model, kept_windows, query, r6, raised_alarms, stream
from tracelode.plans.studies import contrast_sql
from tracelode.sources import formats
from tracelode.sources import tables as T
from tracelode.sources.shared import written

FAILS = "f as (select distinct entity_id, us as anchor from ev where event_type = 'error')"


def outage_sql(h: int) -> str:
    return f"""select '{h}h' as horizon, entity_id, anchor, n_events, array_to_string(list_transform(list_filter(range(1, len(items) + 1), lambda i: i = 1 or items[i] <> items[i - 1]), lambda i: items[i]), '|') as chain
      from (select f.entity_id, anchor, count(*) as n_events, list(item order by us, ordinal) as items from f join ev e on e.entity_id = f.entity_id and event_type <> 'error' and us >= anchor - {h * HOUR} and us < anchor
        where not exists (select 1 from f b where b.entity_id = f.entity_id and b.anchor >= f.anchor - {h * HOUR} and b.anchor < f.anchor) group by 1, 2)"""


@query("outage_windows", f"with {S.EV}, {FAILS} {outage_sql(24)} union all {outage_sql(72)}")
def outage_windows(spark, d):
    rows = outages.outage_windows(stream(spark, d), T.FAILURE)
    return rows.select("horizon", "entity_id", "anchor", "n_events", F.array_join("chain", "|").alias("chain"))


@query("outage_chains", f"""with {S.EV}, {FAILS}, t as (select distinct entity_id, us from ev), drawn as (select *, row_number() over (partition by entity_id order by {S.draw('entity_id', 'us')}, us) as place from t),
  anchors as (select f.*, true as is_failure from f where not exists (select 1 from f b where b.entity_id = f.entity_id and b.anchor >= f.anchor - {DAY} and b.anchor < f.anchor)
    union all select entity_id, us, false from drawn x where place <= 40 and not exists (select 1 from f where f.entity_id = x.entity_id and f.anchor between x.us and x.us + {DAY})),
  found as (select a.*, us, ordinal, item, lag(item) over (partition by a.entity_id, anchor, is_failure order by us, ordinal) as before from anchors a join ev e on e.entity_id = a.entity_id and event_type <> 'error' and us >= anchor - {DAY} and us < anchor),
  runs as (select *, lead(item) over w as second, lead(item, 2) over w as third, lead(us, 2) over w as done from found where before is null or before <> item window w as (partition by entity_id, anchor, is_failure order by us, ordinal))
  select item || '|' || second || '|' || third as chain, count(*) filter (where is_failure) as case_occurrences, count(distinct (entity_id, anchor)) filter (where not is_failure) as control_windows, round(quantile_cont((done - us) / 6e7, 0.5) filter (where is_failure), 4) as median_span_min
  from runs where third is not null and item <> second and second <> third and item <> third group by 1""")  # fmt: skip
def outage_chains(spark, d):
    """Chains of three items in the day before outages without an earlier one, against days that no outage follows."""
    s = stream(spark, d)
    fails = windows.failure_anchors(s, T.FAILURE)
    anchors = windows.without_prior_failure(fails, fails, DAY).select("entity_id", "anchor", "is_failure").unionByName(windows.event_controls(s, fails, DAY))
    rows = outages.timed_chains(history(spark, d), anchors, DAY)
    return rows.select(F.array_join("chain", "|").alias("chain"), "case_occurrences", "control_windows", F.round("median_span_min", 4).alias("median_span_min"))


@query("outage_timeline", f"""with recursive {S.EV}, {FAILS}, pre as (select distinct f.entity_id, anchor, item, us from f join ev e on e.entity_id = f.entity_id and event_type <> 'error' and us >= anchor - {12 * HOUR} and us < anchor - {HOUR // 30}),
  k as (select entity_id, anchor, item, min(us) as us from pre group by 1, 2, 3 union all select k.entity_id, k.anchor, k.item, (select min(p.us) from pre p where p.entity_id = k.entity_id and p.anchor = k.anchor and p.item = k.item and p.us >= k.us + {HOUR // 15}) from k
    where exists (select 1 from pre p where p.entity_id = k.entity_id and p.anchor = k.anchor and p.item = k.item and p.us >= k.us + {HOUR // 15})),
  scored as (select entity_id, anchor, round(count(*) filter (where item like 'view%') + 0.3 * count(distinct item) + 0.2 * (max(us) - min(us)) / 3.6e9, 9) as score from k group by 1, 2 having count(*) filter (where item like 'view%') >= 2 and count(distinct item) >= 3 and count(*) <= 10),
  best as (select * from scored order by score desc, entity_id, anchor limit 1)
  select entity_id, anchor, round(score, 6) as score, count(*) as n, array_to_string(list_sort(list_distinct(list(item))), '|') as items, round((anchor - us // 60000000 * 60000000) / 3.6e9, 6) as hours_before from k join best using (entity_id, anchor) group by entity_id, anchor, score, us // 60000000""")  # fmt: skip
def outage_timeline(spark, d):
    rows = outages.illustrated(stream(spark, d), T.FAILURE, F.col("event_type") == "view")
    return r6(rows.withColumn("items", F.array_join("items", "|")), "score", "hours_before")


@query("join_rate", "select count(*) as failures, count(p_partkey) as matched, round(avg(case when p_partkey is not null then 1.0 else 0 end), 6) as rate, count(*) filter (where p_partkey is null and l_linenumber <> 1) as unexplained from lineitem left join (select distinct p_partkey from part where p_type = 'ECONOMY') on l_partkey = p_partkey where l_returnflag = 'R'")
def join_rate(spark, d):
    """Returned line items as failures, parts of one type as the records that explain them, first lines as planted ones."""
    failures = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("key"), "l_linenumber")
    records = T.table(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("key"))
    return r6(formats.join_rate(failures, records, ["key"], F.col("l_linenumber") == 1), "rate")


@query("alarm_burden", f"""with recursive {S.EV}, {RAISED}, outage as (select distinct entity_id, us from ev where event_type = 'error'),
  a as (select r.*, ((select min(o.us) from outage o where o.entity_id = r.entity_id and o.us > r.us and o.us <= r.us + {DAY}) - r.us) / 6e7 as lead from raised r), m as (select sum(m) as months from (select (max(us) - min(us)) / {DAY} / 30 as m from ev group by entity_id))
  select count(*) as alarms, count(*) filter (where lead is null) as false_alarms, (select count(*) from outage) as outages, round(count(*) filter (where lead is null) / (select months from m), 6) as false_per_month, round(count(*) / (select count(*) from outage), 6) as alarms_per_outage,
    {", ".join(f"round(quantile_cont(lead, 0.{p}), 6) as lead_p{p}" for p in (25, 50, 75))}, {", ".join(f"round(avg(case when lead >= {m} then 1.0 else 0 end) filter (where lead is not null), 6) as {k}" for k, m in (("lead_10min", 10), ("lead_1h", 60), ("lead_6h", 360), ("lead_24h", 1440)))} from a""")  # fmt: skip
def alarm_burden(spark, d):
    s = stream(spark, d)
    there = s.where(F.col("event_type") == T.FAILURE).select("entity_id", "us").distinct()
    rows = alarms.burden(*alarms.judged(raised_alarms(spark, d), there), s)
    return r6(rows, *[c for c in rows.columns if c not in ("alarms", "false_alarms", "outages")])


P = "list_transform({0}, lambda x: x / list_sum({0}))"


@query("own_baseline", f"""with h as (select o_custkey as entity_id, o_orderkey as place, [{", ".join(f"count(*) filter (where least(4, floor((l_quantity - 1) / 10)) = {i})::double" for i in range(5))}] as h from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
  n as (select *, row_number() over (partition by entity_id order by place) as i, count(*) over (partition by entity_id) as n from h), base as (select entity_id, [{", ".join(f"sum(h[{i + 1}])" for i in range(5))}] as h0 from n where i <= ceil(n * 0.3) group by 1),
  later as (select entity_id, row_number() over (partition by entity_id order by place) as k, {P.format('h')} as p, {P.format('h0')} as q from n join base using (entity_id) where i > ceil(n * 0.3) and list_sum(h) > 0 and list_sum(h0) > 0),
  told as (select entity_id, k, list_sum(list_transform(range(1, 6), lambda i: abs(list_sum(p[1:i]) - list_sum(q[1:i])))) as distance, list_sum(list_transform(range(1, 6), lambda i: (i - 1) * (p[i] - q[i]))) as centroid,
    list_sum(list_transform(range(1, 6), lambda i: case when q[i] > 0 then q[i] * log2(q[i]) else 0 end - case when p[i] > 0 then p[i] * log2(p[i]) else 0 end)) as entropy, p[3] + p[4] + p[5] - q[3] - q[4] - q[5] as tail from later)
  select entity_id, {", ".join(f"round(arg_max({c}, k), 6) as {c}_last" for c in ("distance", "centroid", "entropy", "tail"))}, round(max(distance), 6) as distance_max, {", ".join(f"round(case when count(*) > 1 then regr_slope({c}, k) else 0 end, 6) as {c}_slope" for c in ("distance", "centroid", "tail"))} from told group by 1""")  # fmt: skip
def own_baseline(spark, d):
    """Customers' orders as readouts of a histogram of quantities, each against the customer's own first orders."""
    lines = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("place"), F.least(F.lit(4), F.floor((F.col("l_quantity").cast("double") - 1) / 10)).alias("bin"))
    h = F.array(*[F.count_if(F.col("bin") == i).cast("double") for i in range(5)]).alias("h")
    rows = T.table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("place")).join(lines.groupBy("place").agg(h), "place")
    out = features.own_baseline(rows, 5)
    return r6(out, *[c for c in out.columns if c != "entity_id"])


CENTRED = ", ".join(f"{c} - avg({c}) over (partition by g) as {c}" for c in ("x", "z", "t", "y"))


@query("ols_residual_3", f"""with r as (select l_returnflag as g, l_orderkey, l_linenumber, l_quantity::double as x, l_discount::double as z, l_tax::double as t, l_extendedprice::double as y from lineitem), c as (select g, l_orderkey, l_linenumber, {CENTRED} from r),
  a as (select g, sum(x * z) / sum(x * x) as bz, sum(x * t) / sum(x * x) as bt, sum(x * y) / sum(x * x) as b from c group by 1), c2 as (select g, l_orderkey, l_linenumber, z - bz * x as z, t - bt * x as t, y - b * x as y from c join a using (g)),
  a2 as (select g, sum(z * t) / sum(z * z) as bt, sum(z * y) / sum(z * z) as b from c2 group by 1), c3 as (select g, l_orderkey, l_linenumber, t - bt * z as t, y - b * z as y from c2 join a2 using (g)), a3 as (select g, sum(t * y) / sum(t * t) as b from c3 group by 1)
  select g, l_orderkey, l_linenumber, round(y - b * t, 3) as residual from c3 join a3 using (g)""")  # fmt: skip
def ols_residual_3(spark, d):
    """What is left of the price after quantity, discount and tax, per return flag."""
    price = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_orderkey", "l_linenumber", *[F.col(f"l_{a}").cast("double").alias(b) for a, b in (("extendedprice", "y"), ("quantity", "x"), ("discount", "z"), ("tax", "t"))])
    return features.residuals(price, "y", ["x", "z", "t"], "g").select("g", "l_orderkey", "l_linenumber", F.round("residual", 3).alias("residual"))


@query("feature_bigrams", f"""with {S.windows(5)}, own as (select window_id, list_distinct(list_transform(range(1, cast(len(items) as bigint)), lambda i: items[i] || '>' || items[i + 1])) as pairs from win),
  top as (select pair, row_number() over (order by count(*) desc, pair) as k from (select unnest(pairs) as pair from own) group by 1 order by k limit 200) select window_id, string_agg(case when list_contains(pairs, pair) then '1' else '0' end, '' order by k) as features from own, top group by 1""")  # fmt: skip
def feature_bigrams(spark, d):
    """Which of the 200 most frequent adjacent pairs each window has."""
    w = kept_windows(spark, d)
    return features.bigrams(w, features.top_bigrams(w)).select("window_id", F.array_join("features", "").alias("features"))


def pattern_scores(held, sets, runs, name: str):
    """label, score and feature_set of the held-out windows, from all itemsets, all sequences (their names), and both with
    the count. held: windows with the names of the itemsets (sets) and sequences (runs) that each holds; a model leaves
    out those that aren't among its own."""
    out = None
    both = F.concat("sets", F.transform("runs", lambda x: F.concat(F.lit(">"), x)))
    for kind, own, words, number in (("itemsets", F.col("sets"), sets, None), ("sequences", F.col("runs"), runs, None), ("combined", both, [*sets, *[f">{x}" for x in runs]], "n_events")):
        if words or number:
            rows = held.select("window_id", "label", "train", "n_events", own.alias("held"), "weight")
            scored = evaluation.logistic_on_names(rows, words, number=number)
            one = written(scored.select("label", "score", "weight", F.lit(kind).alias("feature_set")), f"scored-{name}")
            out = one if out is None else out.unionByName(one)
    return out


def held_patterns(w, sets: list[list[str]], runs: list[list[str]]):
    """w with the names of the itemsets (sets) and sequences (runs) that each window holds."""
    rows = mining.held_in(w.withColumn("item_set", F.array_sort("item_set")), "item_set", sets, "sets")
    return written(mining.held_in(rows, "items", runs, "runs").select("window_id", "label", "train", "n_events", "weight", "sets", "runs"), "held")


def names_of(patterns: list[list[str]]) -> list[str]:
    return ["|".join(p) for p in patterns]


def cut_windows(spark, d):
    return written(evaluation.temporal_split(kept_windows(spark, d)).withColumn("label", F.col("is_failure").cast("int")), "temporal")


def alike(w):
    """Windows with the same items, class and side as one row with their number (weight): models can't tell them apart.
    Their number is bounded by the vocabulary and the windows' length."""
    rows = evaluation.tallied(w, ["items", "item_set", "n_events", "label", "train", "is_failure"])
    return written(rows.withColumn("window_id", F.monotonically_increasing_id()), "alike")


@query("lr_head_to_head")
def lr_head_to_head(spark, d):
    """AUROC and average precision of logistic regression on counts alone, presence, multisets, order (precedence of every
    two items), and on all itemsets and sequences mined from the training windows, trained up to the cut."""
    w = cut_windows(spark, d)
    train = w.where("train")
    words = features.vocabulary(train)
    w = alike(w)
    sets, runs = ([r[0] for r in p.collect()] for p in (mining.itemsets(train), mining.sequences(train)))  # patterns of a closed vocabulary of items
    scored = pattern_scores(held_patterns(w, sets, runs), names_of(sets), names_of(runs), "patterns")
    for name, rows in {"event_count": w.withColumn("features", F.array("n_events")), "presence": features.presence(w, words), "multiset": features.multiset(w, words)}.items():
        scored = scored.unionByName(judged_by_model(rows, name, feature_set=name))
    ordered = written(features.precedence(w, words).select("label", "train", "held", "weight"), "held-pairs")
    # Pairs that no training window holds would have no coefficient.
    if pairs := [r.pair for r in ordered.where("train").select(F.explode("held").alias("pair")).distinct().orderBy("pair").collect()]:
        one = evaluation.logistic_on_names(ordered, pairs).select("label", "score", "weight", F.lit("precedence").alias("feature_set"))
        scored = scored.unionByName(written(one, "scored-precedence"))
    return r6(evaluation.auroc(scored, "feature_set", weight="weight").join(evaluation.average_precision(scored, "feature_set", weight="weight"), "feature_set"), "auroc", "average_precision")


SUPPORTS = ("0.02", "0.05", "0.10", "0.15")


@query("support_head_to_head")
def support_head_to_head(spark, d):
    """The same for the mined patterns at four supports: one mining at the lowest serves all, and a window's patterns are
    looked up once."""
    w = cut_windows(spark, d)
    train = w.where("train")
    sets, runs = (p.collect() for p in (mining.itemsets(train, float(SUPPORTS[0])), mining.sequences(train, float(SUPPORTS[0]))))  # patterns of a closed vocabulary of items
    every, full = train.agg(F.count_if("is_failure"), F.count_if(F.col("is_failure") & (F.size("items") > 0))).first()
    held, out = held_patterns(alike(w), [r.itemset for r in sets], [r.sequence for r in runs]), None
    for s in SUPPORTS:
        few, some = (names_of([r[0] for r in p if r.n_failure >= mining.needed(n, float(s))]) for p, n in ((sets, every), (runs, full)))
        one = pattern_scores(held, few, some, s).withColumn("min_support", F.lit(float(s)))
        out = one if out is None else out.unionByName(one)
    by = ("min_support", "feature_set")
    return r6(evaluation.auroc(out, *by, weight="weight").join(evaluation.average_precision(out, *by, weight="weight"), [*by]), "auroc", "average_precision")


@query("sequence_invariants", f"select horizon, round(real, 6) as real, round(shuffled, 6) as shuffled, round((real - shuffled) / shuffled, 6) as gain, coalesce(case when horizon = 'last2' then abs((real - shuffled) / shuffled) < 0.05 else real > shuffled end, false) as holds from ({contrast_sql(2)} union all {contrast_sql(5)})")
def sequence_invariants(spark, d):
    """Windows of two events hardly have an order to lose, those of five have."""
    rows = kept_windows(spark, d, 2).withColumn("horizon", F.lit("last2")).unionByName(kept_windows(spark, d, 5).withColumn("horizon", F.lit("last5")))
    return r6(samplers.sequence_invariants(rows, ["last2"]), "real", "shuffled", "gain")
