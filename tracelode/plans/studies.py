"""Queries of the samplers of several horizons and of the studies made of windows, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import alarms, chains, closed, evaluation, features, mining, samplers, stats, windows
from tracelode.plans import sql as S
from tracelode.plans.catalogue import (
    BASE, CLEAN, DAY, ERFC, HOUR, LIFT, NEWTON, ORACLES, REPLAYED, SHUFFLED, YEK, bars, bh, ceiling_sql, history, kept_windows, order_stream, query, r6, relabel_sql, stream, subjects,
)
from tracelode.sources import formats
from tracelode.sources import tables as T
from tracelode.sources.shared import written

ROWS = "entity_id, anchor, cast(is_failure as int) as is_failure, cast(n_events as bigint) as n_events, array_to_string(items, '|') as items"


def rows_of(df):
    return df.select("horizon", "entity_id", "anchor", F.col("is_failure").cast("int").alias("is_failure"), F.col("n_events").cast("long").alias("n_events"), bars("items"))


def timed(hours: int) -> str:
    return f"win as (select a.entity_id, a.anchor, a.is_failure, count(f.us) as n_events, coalesce(list(f.item order by f.us, f.ordinal) filter (where f.us is not null), []) as items from anchors a left join hist f on f.entity_id = a.entity_id and f.us >= a.anchor - {hours * HOUR} and f.us < a.anchor group by 1, 2, 3)"


def horizon_sql(name: str, n: int) -> str:
    clean, win = (n * HOUR, timed(n)) if name.endswith("h") else (DAY, S.last_k(n))
    return f"select '{name}' as horizon, {ROWS} from (with {S.EV}, {S.anchors(clean, salt=name)}, {S.HIST}, {win} select * from win)"


@query("win_all_horizons", " union all ".join(horizon_sql(name, n) for name, n in (("1h", 1), ("6h", 6), ("24h", 24), ("last5", 5), ("last10", 10))))
def win_all_horizons(spark, d):
    return rows_of(samplers.all_horizons(stream(spark, d), history(spark, d), T.FAILURE))


EPISODES = f"""alerts as (select distinct entity_id, us from ev where event_type = 'error'), own as (select *, us - lag(us) over (partition by entity_id order by us) as gap from alerts),
  fails as (select entity_id, us as anchor, true as is_failure from own where gap is null or gap > {HOUR}),"""


def episode_sql(k: int) -> str:
    drawn = S.anchors(HOUR, tries=40).split("from ev where event_type = 'error'),", 1)[1].replace("from fails f where f.entity_id = p.entity_id and abs(f.anchor", "from alerts f where f.entity_id = p.entity_id and abs(f.us")
    return f"select 'last{k}' as horizon, {ROWS} from (with {S.EV}, {EPISODES} {drawn}, {S.HIST}, {S.last_k(k)} select * from win where n_events > 0)"


@query("win_episode_controls", " union all ".join(map(episode_sql, (5, 10, 20))))
def win_episode_controls(spark, d):
    return rows_of(samplers.episode_windows(stream(spark, d), T.FAILURE))


def repair_sql(k: int) -> str:
    first = ORACLES["win_first_failure_other_entity"].split("select entity_id, anchor, cast(is_failure")[0]
    first = first.replace("select distinct entity_id, anchor, true as is_failure from lab join first using (entity_id) where us < anchor)", "select entity_id, anchor, true as is_failure from lab join first using (entity_id) where us < anchor group by 1, 2 having count(*) >= 5)")
    first = first.replace("max(us) + 1000000 as anchor", f"max(us) + {HOUR} as anchor").replace("having count(*) >= 3", "having count(*) >= 5").replace("back <= 3", f"back <= {k}")
    return f"select 'last{k}' as horizon, {ROWS} from ({first} select * from win)"


@query("win_repair", " union all ".join(map(repair_sql, (5, 10, 20))))
def win_repair(spark, d):
    return rows_of(samplers.repair_windows(order_stream(spark, d), "fail"))


#: Match sets of customers; an order's place in time is the end of its key, so that lengths and times are of one size.
RISK = f"""members as ({ORACLES["win_riskset"]}), placed as (select o_custkey as entity_id, o_orderkey % 10000 as us, o_orderkey as ordinal, o_orderpriority as item from orders),
  lately as (select m.match_id, m.entity_id, m.is_case, s.item, s.us, s.ordinal, row_number() over (partition by m.match_id, m.entity_id, m.is_case order by s.us desc, s.ordinal desc) as back from members m join placed s on s.entity_id = m.entity_id and s.us < m.length_at),
  win as (select m.match_id, m.entity_id, m.match_id || '/' || m.entity_id as window_id, m.is_case = 1 as is_failure, count(s.us) as n_events, coalesce(list(s.item order by s.us, s.ordinal) filter (where s.us is not null), []) as items,
    coalesce(list_sort(list_distinct(list(s.item) filter (where s.us is not null))), []) as item_set from members m left join (select * from lately where back <= 20) s using (match_id, entity_id, is_case) group by 1, 2, 3, 4 having m.is_case = 1 or count(s.us) > 0)""".replace("group by 1, 2, 3, 4 having m.is_case = 1 or", "group by m.match_id, m.entity_id, m.is_case having m.is_case = 1 or")


def risk_windows(spark, d):
    o = T.table(spark, d, "orders")
    steps = o.select(F.col("o_custkey").alias("entity_id"), (F.col("o_orderkey") % 10000).alias("us"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("item"), F.lit("order").alias("event_type"), F.col("o_orderpriority").alias("event_subtype"))
    rows = samplers.riskset_windows(steps, subjects(spark, d))
    return written(rows.select("match_id", "entity_id", "window_id", "is_failure", "n_events", "items", "item_set"), "riskset")


@query("riskset_windows", f"with {RISK} select match_id, entity_id, cast(is_failure as int) as is_failure, n_events, array_to_string(items, '|') as items from win")
def riskset_windows(spark, d):
    return risk_windows(spark, d).select("match_id", "entity_id", F.col("is_failure").cast("int").alias("is_failure"), "n_events", bars("items"))


CLOSED = "closed as (select * from frequent f where not exists (select 1 from frequent g where g.n_failure = f.n_failure and len(g.itemset) > len(f.itemset) and list_has_all(g.itemset, f.itemset)))"


@query("riskset_signatures", f"""with {RISK}, {S.ITEMSETS}, {CLOSED}, tested as (select *, {S.tail()} as p from closed), {bh()}, both_ as (select *, least(1.0, {YEK} * min(p * m / k) over (order by p range between current row and unbounded following)) as q_by from q)
  select array_to_string(itemset, '|') as itemset, n_failure, n_control, round((n_failure + 0.5) * (all_control - n_control + 0.5) / ((all_failure - n_failure + 0.5) * (n_control + 0.5)), 6) as odds_ratio, round(p, 6) as p, round(q, 6) as q, round(q_by, 6) as q_by from both_""")  # fmt: skip
def riskset_signatures(spark, d):
    """Signatures of match sets: closed itemsets with odds ratios, exact p, and both corrections."""
    w = risk_windows(spark, d)
    found = written(mining.closed(mining.itemsets(w), "itemset").select("itemset"), "closed")
    rows = stats.with_q(stats.with_q(stats.with_p(mining.set_scores(w, found))), dependent=True, name="q_by")
    odds = stats.odds(F.col("n_failure"), F.col("all_failure"), F.col("n_control"), F.col("all_control"))["odds_ratio"]
    return r6(rows.select(bars("itemset"), "n_failure", "n_control", odds.alias("odds_ratio"), "p", "q", "q_by"), "odds_ratio", "p", "q", "q_by")


MATCHED = f"""with recursive {RISK}, halves as (select match_id, row_number() over (order by {S.draw('match_id', '11')}, match_id) <= floor(0.5 * count(*) over ()) as discovery from (select distinct match_id from win)),
  {S.ITEMSETS.replace('from win', 'from (select * from win join halves using (match_id) where discovery)')}, best as (select itemset from frequent order by n_failure desc, itemset limit 200), other as (select * from win join halves using (match_id) where not discovery),
  total as (select match_id, count(*) as n from other group by 1), strata as (select array_to_string(itemset, '|') as pattern, match_id, n, count(*) as t, max(cast(is_failure as int)) as x from best join other on list_has_all(item_set, itemset) join total using (match_id) group by 1, 2, 3), {NEWTON}"""


@query("matched_hazard_split", f"""{MATCHED}
  select pattern, cast(strata as bigint) as strata, cast(observed as bigint) as observed, round(exp(beta), 5) as hazard_ratio from fitted join seen using (pattern) where se is not null""")  # fmt: skip
def matched_hazard_split(spark, d):
    return samplers.matched_split(risk_windows(spark, d)).select("pattern", "strata", "observed", F.round("hazard_ratio", 5).alias("hazard_ratio"))


@query("matched_hazard_fdr", f"""{MATCHED}, tested as (select pattern, beta, se, {ERFC.format('(abs(beta / se) / 1.4142135623730951)')} as p from fitted where se is not null), {bh()}, both_ as (select *, least(1.0, {YEK} * min(p * m / k) over (order by p range between current row and unbounded following)) as q_by from q)
  select pattern, round(exp(beta), 4) as hazard_ratio, round(exp(beta - 1.96 * se), 4) as hr_low, round(exp(beta + 1.96 * se), 4) as hr_high, round(p, 4) as p, round(q, 4) as q, round(q_by, 4) as q_by from both_""")  # fmt: skip
def matched_hazard_fdr(spark, d):
    """The same with intervals, p and both corrections."""
    rows = samplers.matched_split(risk_windows(spark, d))
    return rows.select("pattern", *[F.round(c, 4).alias(c) for c in ("hazard_ratio", "hr_low", "hr_high", "p", "q", "q_by")])


def mined_sql(k: int) -> str:
    return f"""select 'last{k}' as horizon, count(*) as n_patterns, round(max({LIFT}), 6) as top_lift, round(any_value(top), 6) as permuted_top, count(*) filter (where {LIFT} > top) as survivors, max({LIFT}) >= 1.5 * any_value(top) as clear
      from (with {S.windows(k)}, {relabel_sql(7)}, random as (select * replace (drawn as is_failure) from dealt), top as (select * from {ceiling_sql(S.ITEMSETS, 'random')}), {S.ITEMSETS} select * from frequent, top)"""


@query("mine_all_horizons", " union all ".join(map(mined_sql, (5, 10))))
def mine_all_horizons(spark, d):
    rows = kept_windows(spark, d, 5).withColumn("horizon", F.lit("last5")).unionByName(kept_windows(spark, d, 10).withColumn("horizon", F.lit("last10")))
    return r6(samplers.mined_horizons(rows, ["last5", "last10"]), "top_lift", "permuted_top")


def contrast_sql(k: int) -> str:
    """Mean of the ten highest lifts of sequences, real and shuffled."""
    top = lambda win: f"(select avg(lift) from (select {LIFT} as lift from (with {S.SEQUENCES.replace('from win', f'from {win}')} select * from frequent) order by lift desc limit 10))"
    return f"select 'last{k}' as horizon, * from (with {S.windows(k)}, {SHUFFLED} select {top('win')} as real, {top('mixed')} as shuffled)"


@query("shuffle_contrast", f"select round(real, 6) as real, round(shuffled, 6) as shuffled, round((real - shuffled) / shuffled, 6) as gain from ({contrast_sql(5)})")
def shuffle_contrast(spark, d):
    return r6(samplers.shuffle_contrast(kept_windows(spark, d)), "real", "shuffled", "gain")


SPLITS = f"""{BASE.replace('with ', '', 1)}, ents as (select entity_id, unnest(range(0, 20)) as seed from (select distinct entity_id from win)),
  halves as (select entity_id, seed, row_number() over (partition by seed order by {S.draw('entity_id', 'seed')}, entity_id) <= floor(0.5 * count(*) over (partition by seed)) as discovery from ents),
  counts as (select seed, discovery, item_set, count(*) filter (where is_failure) as f, count(*) filter (where not is_failure) as c from win join halves using (entity_id) group by 1, 2, 3),
  size as (select seed, discovery, sum(f)::bigint as all_failure, sum(c)::bigint as all_control from counts group by 1, 2), held as (select s.item_set, c.itemset from (select distinct item_set from win) s join (select distinct itemset from counted where n_failure > 0) c on list_has_all(s.item_set, c.itemset)),
  hits as (select seed, discovery, itemset, sum(f)::bigint as n_failure, sum(c)::bigint as n_control from counts join held using (item_set) group by 1, 2, 3), often as (select seed, itemset from hits join size using (seed, discovery) where discovery and n_failure > 0 and n_failure >= ceil(0.05 * all_failure)),
  tested as (select h.*, all_failure, all_control, {S.tail()} as p from hits h join often using (seed, itemset) join size using (seed, discovery) where not discovery), {bh(by='seed', factor=YEK)}"""


@query("split_stability", f"with {SPLITS} select seed, count(*) as n_tested, count(*) filter (where q < 0.05) as n_significant, round(avg(case when q < 0.05 then 1.0 else 0 end), 6) as significant_share from q group by 1")
def split_stability(spark, d):
    return r6(samplers.stability(samplers.split_tests(kept_windows(spark, d))), "significant_share")


@query("selection_frequency", f"with {SPLITS} select array_to_string(itemset, '|') as itemset, count(*) as n_tested, round(count(*) filter (where q < 0.05) / 20, 6) as selection_frequency from q group by 1")
def selection_frequency(spark, d):
    return r6(samplers.selection(samplers.split_tests(kept_windows(spark, d))).withColumn("itemset", F.array_join("itemset", "|")), "selection_frequency")


#: Six groups of entities in place of six machines: all twenty ways to take three of them.
MACHINES = SPLITS.replace(
    f"ents as (select entity_id, unnest(range(0, 20)) as seed from (select distinct entity_id from win)),\n  halves as (select entity_id, seed, row_number() over (partition by seed order by {S.draw('entity_id', 'seed')}, entity_id) <= floor(0.5 * count(*) over (partition by seed)) as discovery from ents)",
    "ways as (select m, row_number() over (order by m desc) - 1 as seed from range(0, 64) t(m) where bit_count(m) = 3), halves as (select entity_id, seed, (m >> (5 - entity_id % 6)) & 1 = 1 as discovery from (select distinct entity_id from win), ways)",
)


@query("partition_stability", f"""with {MACHINES}, per as (select seed, avg(case when q < 0.05 then 1.0 else 0 end) as share, count(*) filter (where q < 0.05) as size from q group by 1), sig as (select seed, itemset from q where q < 0.05),
  shared as (select a.seed, b.seed as other, count(*) as shared from sig a join sig b on a.itemset = b.itemset and a.seed < b.seed group by 1, 2),
  pairs as (select case when a.size + b.size = 0 then 1.0 else coalesce(shared, 0) / (a.size + b.size - coalesce(shared, 0)) end as j from per a join per b on a.seed < b.seed left join shared s on s.seed = a.seed and s.other = b.seed)
  select (select count(*) from per) as n_splits, round((select quantile_cont(share, 0.5) from per), 6) as median, round((select quantile_cont(share, 0.25) from per), 6) as p25, round((select quantile_cont(share, 0.75) from per), 6) as p75, round((select avg(j) from pairs), 6) as mean_jaccard""")  # fmt: skip
def partition_stability(spark, d):
    """Significant shares and sets over all balanced partitions of six groups of entities."""
    rows = kept_windows(spark, d).withColumn("entity_id", F.col("entity_id") % 6)
    halves = written(evaluation.balanced_partitions(rows), "partitions")
    return r6(samplers.partition_summary(samplers.split_tests(rows, halves=halves), halves), "median", "p25", "p75", "mean_jaccard")


@query("closed_sequences_grown", ORACLES["closed_sequences"])
def closed_sequences_grown(spark, d):
    return closed.sequences(kept_windows(spark, d)).select(bars("sequence"), "n_failure")


@query("closed_itemsets_last20", f"with {S.windows(20)}, {S.ITEMSETS.replace('0.05', '0.02')}, {CLOSED} select array_to_string(itemset, '|') as itemset, n_failure from closed")
def closed_itemsets_last20(spark, d):
    return closed.itemsets(kept_windows(spark, d, 20), 0.02).select(bars("itemset"), "n_failure")


@query("closed_compression", f"select 'sequences' as kind, (select count(*) from ({ORACLES['ps_sequences']})) as n_all, (select count(*) from ({ORACLES['closed_sequences']})) as n_closed union all select 'itemsets', (select count(*) from ({ORACLES['fp_itemsets']})), (select count(*) from ({ORACLES['closed_itemsets']}))")
def closed_compression(spark, d):
    """How many frequent patterns there are, and how many of them are closed."""
    w, out = kept_windows(spark, d), None
    for kind, every, some in (("sequences", mining.sequences(w), closed.sequences(w)), ("itemsets", mining.itemsets(w), closed.itemsets(w))):
        one = every.agg(F.count("*").alias("n_all")).crossJoin(some.agg(F.count("*").alias("n_closed"))).select(F.lit(kind).alias("kind"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("transfer_metrics", f"""with recursive {S.EV.replace('ev as (', 'whole as (', 1)}, farm as (select * from whole where entity_id % 2 = 0), ev as (select * from whole where entity_id % 2 = 1),
  marked as (select item, case when exists (select 1 from farm f where f.entity_id = e.entity_id and f.event_type = 'error' and f.us > e.us and f.us <= e.us + {DAY}) then 1 else 0 end as hit from farm e where event_type <> 'error'),
  codes as (select item from marked group by item having sum(hit) / count(*) >= (select avg(hit) from marked)), fired as (select distinct entity_id, us from ev where item in (select item from codes)),
  raised as (select entity_id, min(us) as us from fired group by 1 union all select r.entity_id, (select min(f.us) from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY}) from raised r where exists (select 1 from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY})), {REPLAYED}""")  # fmt: skip
def transfer_metrics(spark, d):
    """Codes learned on one half of the entities, replayed on the other: precision, recall and lead."""
    s = stream(spark, d)
    codes, there = mining.precursors(s.where("entity_id % 2 = 0"), T.FAILURE, DAY, least=1, factor=1.0), s.where("entity_id % 2 = 1")
    outages = there.where(F.col("event_type") == T.FAILURE).select("entity_id", "us").distinct()
    return r6(alarms.metrics(*alarms.judged(alarms.raised(there, codes, DAY), outages)), "median_lead_min", "precision", "recall")


CHAIN_HALVES = f"halves as (select entity_id, row_number() over (order by {S.draw('entity_id', '11')}, entity_id) <= floor(0.5 * count(*) over ()) as discovery from (select distinct entity_id from short))"


@query("degradation_chains", f"""with {S.windows(5)}, placed as (select *, lag(item) over (partition by entity_id, anchor, is_failure order by us, ordinal) as before from found),
  short as (select entity_id, anchor, is_failure, list(item order by us, ordinal) as items, list(us order by us, ordinal) as times from placed where before is null or before <> item group by 1, 2, 3), {CHAIN_HALVES},
  w as (select row_number() over () as id, * from short join halves using (entity_id)), masks as (select *, unnest(range(1, cast(1 << len(items) as bigint))) as mask from w),
  laid as (select *, list_filter(range(1, len(items) + 1), lambda i: (mask >> (i - 1)) & 1 = 1) as spot from masks), named as (select *, list_transform(spot, lambda i: items[i]) as chain from laid where len(spot) between 3 and 4),
  held as (select id, anchor, is_failure, discovery, chain, any_value(times) as times, min(spot) as spot from named where len(list_distinct(chain)) = len(chain) group by 1, 2, 3, 4, 5),
  sizes as (select discovery, count(*) filter (where is_failure) as all_failure, count(*) filter (where not is_failure) as all_control from w group by 1),
  picked as (select chain from held join sizes using (discovery) where discovery group by chain, all_failure, all_control having count(*) filter (where is_failure) > 0 and count(*) filter (where is_failure) >= 5e-3 * all_failure and count(*) filter (where not is_failure) <= 5e-2 * all_control),
  per as (select chain, chain[len(chain)] as last_item, count(*) filter (where is_failure) as n_failure, count(*) filter (where not is_failure) as n_control, quantile_cont((times[spot[len(spot)]] - times[spot[1]]) / 6e7, 0.5) filter (where is_failure) as span, quantile_cont((anchor - times[spot[len(spot)]]) / 6e7, 0.5) filter (where is_failure) as lead_ from held join picked using (chain) where not discovery group by 1, 2),
  alone as (select id, anchor, is_failure, item, max(us) as us from (select id, anchor, is_failure, unnest(items) as item, unnest(times) as us from w where not discovery) group by 1, 2, 3, 4),
  ends as (select item as last_item, count(*) filter (where not is_failure) as last_controls, quantile_cont((anchor - us) / 6e7, 0.5) filter (where is_failure) as last_lead from alone group by 1),
  tested as (select *, {S.tail()} as p from per join ends using (last_item), (select all_failure, all_control from sizes where not discovery) where n_failure > 0), {bh()}, both_ as (select *, least(1.0, {YEK} * min(p * m / k) over (order by p range between current row and unbounded following)) as q_by from q)
  select array_to_string(chain, '|') as chain, n_failure, n_control, round({LIFT}, 6) as lift, round(span, 3) as median_span_min, round(lead_, 3) as median_lead_min, last_controls, round(last_lead, 3) as last_lead_min, n_control < last_controls or lead_ > last_lead + 5 as incremental, round(p, 6) as p, round(q, 6) as q, round(q_by, 6) as q_by from both_""")  # fmt: skip
def degradation_chains(spark, d):
    """Chains found on one half of the entities, scored on the other. The test tables hold no such signal: shares of 0.005
    of the failures and 0.05 of the controls stand for the operator's 0.05 and 0.02."""
    s = stream(spark, d)
    rows = windows.last_seqs(history(spark, d).select("entity_id", "us", "ordinal", "item"), windows.anchors_of(s, T.FAILURE, CLEAN), 5)
    rows = rows.withColumn("window_id", F.concat_ws("/", F.col("entity_id").cast("string"), F.col("anchor").cast("string"), F.col("is_failure").cast("int").cast("string")))
    halves = written(stats.split(written(chains.merged(rows), "chains"), 11), "halves")
    picked = written(chains.candidates(halves.where("discovery"), 0.005, 0.05), "picked")
    scored = chains.scores(halves.where("not discovery"), picked)
    out = scored.select(F.array_join("chain", "|").alias("chain"), "n_failure", "n_control", "lift", F.round("median_span_min", 3).alias("median_span_min"), F.round("median_lead_min", 3).alias("median_lead_min"), "last_controls", F.round("last_lead_min", 3).alias("last_lead_min"), "incremental", "p", "q", "q_by")
    return r6(out, "lift", "p", "q", "q_by")


@query("readout_events", """with s as (select o_custkey as entity_id, o_orderkey as time_step, abs(o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderkey)) as step from orders), q as (select entity_id, quantile_cont(step, 0.9) as q from s where step is not null group by 1)
  select entity_id, time_step, 'counter_surprise' as event_type, 'price' as event_subtype from s join q using (entity_id) where step > q
  union all select o_custkey, max(o_orderkey), 'terminal_repair', 'repair' from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY') group by 1""")
def readout_events(spark, d):
    """Orders as readouts of their customers' one counter, customers of one segment as those repaired."""
    readouts = T.table(spark, d, "orders").select(F.col("o_custkey").alias("vehicle_id"), F.col("o_orderkey").alias("time_step"), F.col("o_totalprice").alias("price"))
    survival = T.table(spark, d, "customer").select(F.col("c_custkey").alias("vehicle_id"), (F.col("c_mktsegment") == "MACHINERY").cast("int").alias("in_study_repair"))
    return formats.counter_steps(readouts, survival)


@query("feature_itemsets", f"{BASE}, ranked as (select itemset, row_number() over (order by n_failure desc, array_to_string(itemset, '|')) as k from frequent) select window_id, string_agg(case when list_has_all(item_set, itemset) then '1' else '0' end, '' order by k) as features from win, ranked group by 1")
def feature_itemsets(spark, d):
    """A presence matrix of mined itemsets, the most frequent first."""
    w = kept_windows(spark, d)
    patterns = [r.itemset for r in mining.itemsets(w).orderBy(F.desc("n_failure"), F.array_join("itemset", "|")).limit(features.MOST_WORDS + 1).collect()]
    if len(patterns) > features.MOST_WORDS:
        raise ValueError(f"over {features.MOST_WORDS} itemsets: state a higher support")
    return features.held_sets(w, patterns).select("window_id", F.array_join("features", "").alias("features"))


assert CLEAN == 6 * HOUR  # what BASE states
