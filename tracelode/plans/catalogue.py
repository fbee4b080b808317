"""All queries of the library proper, by name, with the SQL that states the same result.

The events table is the stream (an entity is a user, a failure an error); orders, line items and parts serve where a
second stream, baskets or numbers are needed. Arrays are joined by bars, doubles rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.functions import columns as C
from tracelode.operators import alarms, evaluation, features, mining, stats, windows
from tracelode.plans import sql as S
from tracelode.sources import tables as T
from tracelode.sources.shared import scratch, written

FLAGSHIP = "signatures_last5"
HOUR, DAY = T.HOUR, 24 * T.HOUR
CLEAN = 6 * HOUR
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def bars(column: str):
    return F.array_join(column, "|").alias(column)


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.events(spark, sf_dir)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream without failures: earlier ones are no history of later ones."""
    return stream(spark, sf_dir).where(F.col("event_type") != T.FAILURE)


def last_windows(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    anchors = windows.anchors_of(stream(spark, sf_dir), T.FAILURE, CLEAN)
    rows = windows.count_windows(history(spark, sf_dir), anchors, k)
    return rows.withColumn("window_id", F.concat_ws("/", F.col("entity_id").cast("string"), F.col("anchor").cast("string"), F.col("is_failure").cast("int").cast("string")))


def kept_windows(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The columns of last_windows that mining and models read, written once for a query that reads them several times."""
    rows = last_windows(spark, sf_dir, k).select("window_id", "entity_id", "anchor", "is_failure", "last_us", "n_events", "items", "item_set")
    return written(rows, f"last{k}")


# Windows.

WINDOW_ROWS = "select entity_id, anchor, cast(is_failure as int) as is_failure, cast(n_events as bigint) as n_events, last_us, window_start, array_to_string(items, '|') as items, array_to_string(item_set, '|') as item_set from win"


def window_rows(df: DataFrame) -> DataFrame:
    return df.select("entity_id", "anchor", F.col("is_failure").cast("int").alias("is_failure"), "n_events", "last_us", "window_start", bars("items"), bars("item_set"))


@query("win_last5", f"with {S.windows(5)} {WINDOW_ROWS}")
def win_last5(spark, d):
    return window_rows(last_windows(spark, d, 5))


@query("win_last10", f"with {S.windows(10)} {WINDOW_ROWS}")
def win_last10(spark, d):
    return window_rows(last_windows(spark, d, 10))


def time_sql(hours: int) -> str:
    return f"""with {S.EV}, {S.anchors(CLEAN)}, {S.HIST}, win as (
      select a.entity_id, a.anchor, a.is_failure, count(f.us) as n_events, max(f.us) as last_us, a.anchor - {hours * HOUR} as window_start,
        coalesce(list(f.item order by f.us, f.ordinal) filter (where f.us is not null), []) as items, coalesce(list_sort(list_distinct(list(f.item) filter (where f.us is not null))), []) as item_set
      from anchors a left join hist f on f.entity_id = a.entity_id and f.us >= a.anchor - {hours * HOUR} and f.us < a.anchor group by 1, 2, 3) {WINDOW_ROWS}"""


@query("win_time_6h", time_sql(6))
def win_time_6h(spark, d):
    return window_rows(windows.time_windows(history(spark, d), windows.anchors_of(stream(spark, d), T.FAILURE, CLEAN), 6))


@query("win_time_24h", time_sql(24))
def win_time_24h(spark, d):
    return window_rows(windows.time_windows(history(spark, d), windows.anchors_of(stream(spark, d), T.FAILURE, CLEAN), 24))


@query("win_control_clean", f"with {S.EV}, {S.anchors(CLEAN)} select entity_id, anchor from anchors where not is_failure")
def win_control_clean(spark, d):
    s = stream(spark, d)
    return windows.control_anchors(s, windows.failure_anchors(s, T.FAILURE), CLEAN).select("entity_id", "anchor")


@query("win_first_failure_other_entity", f"""with {S.EV}, ord as (select o_custkey as entity_id, epoch_us(o_orderdate) as us, o_orderkey as ordinal, o_orderstatus as event_type, o_orderpriority as event_subtype, o_orderstatus || ':' || o_orderpriority as item from orders),
  lab as (select entity_id, us, ordinal, case when event_type = 'F' and item like '%1-URGENT' then 'fail' else event_type end as event_type, event_subtype, item from ord),
  first as (select entity_id, min(us) as anchor from lab where event_type = 'fail' group by 1),
  failed as (select distinct entity_id, anchor, true as is_failure from lab join first using (entity_id) where us < anchor),
  others as (select entity_id, max(us) + 1000000 as anchor, count(*) as n from lab where entity_id not in (select entity_id from first) group by 1 having count(*) >= 3),
  drawn as (select *, row_number() over (order by {S.draw('entity_id')}, entity_id) as place from others),
  anchors as (select * from failed union all select entity_id, anchor, false from drawn where place <= 3 * (select count(*) from failed)),
  hist as (select * from lab where event_type <> 'fail'), {S.last_k(3)} {WINDOW_ROWS}""")  # fmt: skip
def win_first_failure(spark, d):
    return window_rows(windows.first_failure_windows(order_stream(spark, d), "fail", 3, 3))


def order_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events of customers; urgent finished ones are the failures."""
    o = T.table(spark, d, "orders")
    item = F.concat_ws(":", "o_orderstatus", "o_orderpriority")
    kind = F.when(item == "F:1-URGENT", "fail").otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_custkey").alias("entity_id"), T.micros("o_orderdate").alias("us"), F.col("o_orderkey").alias("ordinal"), kind.alias("event_type"), F.col("o_orderpriority").alias("event_subtype"), item.alias("item"))


@query("win_episode", f"""with {S.EV}, own as (select *, us - lag(us) over (partition by entity_id order by us, ordinal) as gap from ev where event_type = 'error'),
  marked as (select *, sum(case when gap is null or gap > {12 * HOUR} then 1 else 0 end) over (partition by entity_id order by us, ordinal rows unbounded preceding) as e from own)
  select entity_id, min(us) as anchor, max(us) as last, count(*) as n from marked group by entity_id, e""")  # fmt: skip
def win_episode(spark, d):
    return windows.episodes(stream(spark, d), T.FAILURE, 12 * HOUR)


@query("win_session_window", f"""with {S.EV}, own as (select *, us - lag(us) over (partition by entity_id order by us, ordinal) as gap from ev),
  marked as (select *, sum(case when gap is null or gap > {HOUR} then 1 else 0 end) over (partition by entity_id order by us, ordinal rows unbounded preceding) as e from own)
  select entity_id, min(us) as start_us, count(*) as n from marked group by entity_id, e""")  # fmt: skip
def win_session_window(spark, d):
    s = stream(spark, d).withColumn("time", F.timestamp_micros("us"))
    return s.groupBy("entity_id", F.session_window("time", "1 hour")).agg(F.min("us").alias("start_us"), F.count("*").alias("n")).select("entity_id", "start_us", "n")


@query("win_riskset", f"""with subjects as (select c_custkey as entity_id, cast(c_acctbal as bigint) as length, case when c_mktsegment = 'MACHINERY' then 1 else 0 end as failed from customer),
  ranked as (select *, row_number() over (order by length desc, entity_id) as rank from subjects),
  at_risk as (select length, max(rank) as n_at_risk from ranked group by 1),
  cases as (select r.*, n_at_risk from ranked r join at_risk using (length) where failed = 1),
  draws as (select entity_id as match_id, length as length_at, rank as own, n_at_risk, unnest(range(0, 48)) as i from cases),
  places as (select *, {S.draw('match_id', 'i')} % n_at_risk + 1 as rank from draws),
  first as (select match_id, length_at, rank, min(i) as i from places where rank <> own group by 1, 2, 3),
  chosen as (select *, row_number() over (partition by match_id order by i) as n from first)
  select entity_id as match_id, entity_id, length as length_at, 1 as is_case from cases union all
  select match_id, r.entity_id, length_at, 0 from chosen c join ranked r using (rank) where n <= 3""")  # fmt: skip
def win_riskset(spark, d):
    return windows.risk_sets(subjects(spark, d))


def subjects(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").try_cast("double").alias("b"), F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0).alias("failed")).select("entity_id", F.rint("b").cast("long").alias("length"), "failed")


@query("win_coverage", f"with {S.windows(5)} select cast(is_failure as int) as is_failure, count(*) as n, round(avg(case when n_events > 0 then 1.0 else 0 end), 6) as coverage, round(avg(n_events), 6) as mean_events, max(n_events) as max_events from win group by 1")
def win_coverage(spark, d):
    w = last_windows(spark, d)
    return w.groupBy(F.col("is_failure").cast("int").alias("is_failure")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("n_events") > 0).cast("double")), 6).alias("coverage"), F.round(F.avg("n_events"), 6).alias("mean_events"), F.max("n_events").alias("max_events"))


@query("recency_map", f"with {S.windows(5)}, per as (select entity_id, anchor, item, max(us) as last, min(us) as first from found group by 1, 2, 3) select entity_id, anchor, string_agg(item || '=' || cast((anchor - last + 500000) // 1000000 as varchar), '|' order by item) as recency, ((max(last) - min(first) + 500) // 1000)::double / 1000 as span_s from per group by 1, 2")
def recency_map(spark, d):
    s = stream(spark, d)
    found = windows.last_k(history(spark, d), windows.anchors_of(s, T.FAILURE, CLEAN), 5)
    out = windows.recency(found)
    # Rounded as whole microseconds, halves upwards: a double has no exact half of a millisecond.
    whole = lambda us, unit: F.floor((us + unit // 2) / unit).cast("long")
    shown = F.array_join(F.transform("gaps", lambda e: F.concat(e["item"], F.lit("="), whole(e["us"], 1_000_000).cast("string"))), "|")
    return out.select("entity_id", "anchor", shown.alias("recency"), (whole(F.col("span_us"), 1_000).cast("double") / 1000).alias("span_s"))


# Mining.

BASE = f"with {S.windows(5)}, {S.ITEMSETS}"
SEQ = f"with {S.windows(5)}, {S.SEQUENCES}"
SCORED_COLUMNS = ("support_failure", "support_control", "lift_failure", "p_fail_given_pattern", "relative_risk")


def score_sql(column: str) -> str:
    names = ", ".join(f"round({n}, 6) as {n}" for n in SCORED_COLUMNS)
    return f"select array_to_string({column}, '|') as {column}, n_failure, n_control, {names} from (select *, {S.SCORES} from frequent)"


def score_rows(df: DataFrame, column: str) -> DataFrame:
    return r6(df.select(bars(column), "n_failure", "n_control", *SCORED_COLUMNS), *SCORED_COLUMNS)


def itemset_scores(w: DataFrame) -> DataFrame:
    return mining.set_scores(w, mining.itemsets(w))


def sequence_scores(w: DataFrame) -> DataFrame:
    return mining.sequence_scores(w, mining.sequences(w))


@query("fp_itemsets", f"{BASE} select array_to_string(itemset, '|') as itemset, n_failure from frequent")
def fp_itemsets(spark, d):
    return mining.itemsets(kept_windows(spark, d)).select(bars("itemset"), "n_failure")


@query("fp_scored", f"{BASE} {score_sql('itemset')}")
def fp_scored(spark, d):
    return score_rows(itemset_scores(kept_windows(spark, d)), "itemset")


@query("fp_baskets", """with b as (select l_orderkey, max(case when l_returnflag = 'R' then 1 else 0 end) as failed, list_sort(list_distinct(list(p_type))) as item_set from lineitem join part on l_partkey = p_partkey group by 1),
  m as (select l_orderkey, item_set, unnest(range(1, cast(1 << len(item_set) as bigint))) as mask from b where failed = 1),
  s as (select list_transform(list_filter(range(1, len(item_set) + 1), lambda i: (mask >> (i - 1)) & 1 = 1), lambda i: item_set[i]) as itemset from m)
  select array_to_string(itemset, '|') as itemset, count(*) as n_failure from s group by itemset having count(*) >= ceil(0.05 * (select count(*) from b where failed = 1))""")  # fmt: skip
def fp_baskets(spark, d):
    lines = T.table(spark, d, "lineitem").join(T.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    b = lines.groupBy(F.col("l_orderkey").alias("window_id")).agg((F.max((F.col("l_returnflag") == "R").cast("int")) == 1).alias("is_failure"), F.array_sort(F.collect_set("p_type")).alias("item_set"))
    return mining.itemsets(b).select(bars("itemset"), "n_failure")


def relabel_sql(seed: int) -> str:
    return f"real as (select * from win), dealt as (select *, row_number() over (order by {S.draw('window_id', str(seed))}, window_id) <= (select count(*) from win where is_failure) as drawn from real)"


@query("fp_label_perm_null", f"with {S.windows(5)}, {relabel_sql(7)}, {S.ITEMSETS.replace('from win', 'from (select * replace (drawn as is_failure) from dealt)')} {score_sql('itemset')}")
def fp_label_perm_null(spark, d):
    w = mining.relabelled(kept_windows(spark, d), 7)
    return score_rows(itemset_scores(w), "itemset")


@query("ps_sequences", f"{SEQ} select array_to_string(sequence, '|') as sequence, n_failure from frequent")
def ps_sequences(spark, d):
    return mining.sequences(kept_windows(spark, d)).select(bars("sequence"), "n_failure")


@query("ps_scored_order_gain", f"""{SEQ}, sets as (select window_id, is_failure, item_set from win), named as (select sequence, list_sort(list_distinct(sequence)) as itemset, n_failure, n_control, all_failure, all_control from frequent),
  distinct_sets as (select distinct itemset from named), held as (select itemset, count(*) filter (where is_failure) as hf, count(*) filter (where not is_failure) as hc from distinct_sets join sets on list_has_all(item_set, itemset) group by 1)
  select array_to_string(sequence, '|') as sequence, n_failure, n_control, round(lift, 6) as lift_failure, round(lift - (hf / all_failure) / ((hf + hc) / (all_failure + all_control)), 6) as order_gain
  from (select *, (n_failure / all_failure) / ((n_failure + n_control) / (all_failure + all_control)) as lift from named) join held using (itemset)""")  # fmt: skip
def ps_scored_order_gain(spark, d):
    w = kept_windows(spark, d)
    seqs = sequence_scores(w).withColumn("itemset", F.array_sort(F.array_distinct("sequence")))
    sets = mining.set_scores(w, seqs.select("itemset").distinct()).select("itemset", F.col("lift_failure").alias("set_lift"))
    return r6(seqs.join(sets, "itemset").select(bars("sequence"), "n_failure", "n_control", "lift_failure", (F.col("lift_failure") - F.col("set_lift")).alias("order_gain")), "lift_failure", "order_gain")


SHUFFLED = "mixed as (select * replace (list_transform(list_sort(list_transform(range(1, len(items) + 1), lambda i: {'k': md5(concat_ws('|', window_id, i - 1, 7)), 'x': list_sort(items)[i]})), lambda s: s.x) as items) from win)"


@query("ps_shuffle_null", f"with {S.windows(5)}, {SHUFFLED}, {S.SEQUENCES.replace('from win', 'from mixed')} {score_sql('sequence')}")
def ps_shuffle_null(spark, d):
    return score_rows(sequence_scores(mining.shuffled(kept_windows(spark, d), 7)), "sequence")


@query("closed_itemsets", f"{BASE} select array_to_string(itemset, '|') as itemset, n_failure from frequent f where not exists (select 1 from frequent g where g.n_failure = f.n_failure and len(g.itemset) > len(f.itemset) and list_has_all(g.itemset, f.itemset))")
def closed_itemsets(spark, d):
    return mining.closed(mining.itemsets(kept_windows(spark, d)), "itemset").select(bars("itemset"), "n_failure")


#: Ordered containment by enumeration: the masks of the longer sequence that give the shorter one.
IN_ORDER = "list_contains(list_transform(range(1, cast(1 << len({0}) as bigint)), lambda m: list_transform(list_filter(range(1, len({0}) + 1), lambda i: (m >> (i - 1)) & 1 = 1), lambda i: {0}[i])), {1})"


@query("closed_sequences", f"{SEQ} select array_to_string(sequence, '|') as sequence, n_failure from frequent f where not exists (select 1 from frequent g where g.n_failure = f.n_failure and len(g.sequence) > len(f.sequence) and {IN_ORDER.format('g.sequence', 'f.sequence')})")
def closed_sequences(spark, d):
    return mining.closed(mining.sequences(kept_windows(spark, d)), "sequence", ordered=True).select(bars("sequence"), "n_failure")


LIFT = "(n_failure / all_failure) / ((n_failure + n_control) / (all_failure + all_control))"


@query("subseq_dominance", f"""{SEQ}, lifted as (select sequence, {LIFT} as lift from frequent), best as (select * from lifted where len(sequence) > 1 order by lift desc, sequence limit 200)
  select array_to_string(b.sequence, '|') as sequence, round(b.lift, 6) as lift_failure, round(max(p.lift), 6) as best_part_lift, coalesce(max(p.lift) >= b.lift - 0.05, false) as dominated
  from best b left join lifted p on len(p.sequence) < len(b.sequence) and {IN_ORDER.format('b.sequence', 'p.sequence')} group by b.sequence, b.lift""")  # fmt: skip
def subseq_dominance(spark, d):
    return r6(mining.dominance(sequence_scores(kept_windows(spark, d))).select(bars("sequence"), "lift_failure", "best_part_lift", "dominated"), "lift_failure", "best_part_lift")


@query("count_preserving", f"""{SEQ}, lifted as (select sequence, {LIFT} as real_lift from frequent), best as (select * from lifted where len(sequence) > 1 order by real_lift desc, sequence limit 30),
  copies as (select window_id, is_failure, items, unnest(range(1, 31)) as copy from win),
  mixed as (select window_id, is_failure, copy, list_transform(list_sort(list_transform(range(1, len(items) + 1), lambda i: {{'k': md5(concat_ws('|', window_id, i - 1, copy)), 'x': list_sort(items)[i]}})), lambda s: s.x) as items from copies),
  parts as (select copy, window_id, is_failure, items, unnest(range(1, cast(1 << len(items) as bigint))) as mask from mixed where len(items) > 1),
  held as (select distinct copy, window_id, is_failure, list_transform(list_filter(range(1, len(items) + 1), lambda i: (mask >> (i - 1)) & 1 = 1), lambda i: items[i]) as sequence from parts),
  hits as (select copy, sequence, count(*) filter (where is_failure) as n_failure, count(*) filter (where not is_failure) as n_control from held join (select sequence from best) using (sequence) group by 1, 2),
  lifts as (select sequence, sum({LIFT}) / 30 as s from hits, sizes group by 1)
  select array_to_string(sequence, '|') as sequence, round(real_lift, 6) as real_lift, round(coalesce(s, 0), 6) as shuffled_lift, round(case when real_lift = coalesce(s, 0) then 0 else real_lift - coalesce(s, 0) end, 6) as order_effect from best left join lifts using (sequence)""")  # fmt: skip
def count_preserving(spark, d):
    w = kept_windows(spark, d)
    return r6(mining.order_effect(w, sequence_scores(w), shuffles=30, top=30).withColumn("sequence", F.array_join("sequence", "|")), "real_lift", "shuffled_lift", "order_effect")


# Statistics.

P_ROWS = f"tested as (select *, {S.tail()} as p from frequent)"


def bh(p: str = "p", by: str = "", factor: str = "1.0") -> str:
    """q by its definition: the least p_k m / k over all that are at least as large."""
    part = f"partition by {by}" if by else ""
    return f"ordered as (select *, count(*) over ({part}) as m, row_number() over ({part} order by {p}) as k from tested), q as (select *, least(1.0, {factor} * min({p} * m / k) over ({part} order by {p} range between current row and unbounded following)) as q from ordered)"


YEK = "list_sum(list_transform(range(1, cast(m as bigint) + 1), lambda i: 1.0 / i))"


@query("hypergeom_bh", f"{BASE}, {P_ROWS}, {bh()} select array_to_string(itemset, '|') as itemset, n_failure, n_control, round(p, 6) as p, round(q, 6) as q from q")
def hypergeom_bh(spark, d):
    return r6(stats.with_q(stats.with_p(itemset_scores(kept_windows(spark, d)))).select(bars("itemset"), "n_failure", "n_control", "p", "q"), "p", "q")


@query("by_fdr", f"{BASE}, {P_ROWS}, {bh(factor=YEK)} select array_to_string(itemset, '|') as itemset, round(q, 6) as q from q")
def by_fdr(spark, d):
    return r6(stats.with_q(stats.with_p(itemset_scores(kept_windows(spark, d))), dependent=True).select(bars("itemset"), "q"), "q")


@query("fdr_summary", f"{BASE}, {P_ROWS}, {bh(by='len(itemset)')} select cast(len(itemset) as int) as itemset_size, count(*) as n, count(*) filter (where q < 0.05) as n_significant, round(min(q), 6) as min_q, round(quantile_cont(q, 0.5), 6) as median_q from q group by 1")
def fdr_summary(spark, d):
    rows = stats.with_p(itemset_scores(kept_windows(spark, d)).withColumn("itemset_size", F.size("itemset")))
    return r6(stats.summary(stats.with_q(rows, "itemset_size"), "itemset_size"), "min_q", "median_q")


SPLIT = f"halves as (select entity_id, row_number() over (order by {S.draw('entity_id', '11')}, entity_id) <= floor(0.5 * count(*) over ()) as discovery from (select distinct entity_id from win))"


@query("entity_split", f"with {S.windows(5)}, {SPLIT} select window_id, discovery from win join halves using (entity_id)")
def entity_split(spark, d):
    return stats.split(kept_windows(spark, d), 11).select("window_id", "discovery")


def split_sql(kind: str, column: str, held: str) -> str:
    block = (S.ITEMSETS if kind == "itemset" else S.SEQUENCES).replace("from win", "from (select * from win join halves using (entity_id) where discovery)")
    return f"""with {S.windows(5)}, {SPLIT}, {block}, other as (select * from win join halves using (entity_id) where not discovery),
      osizes as (select count(*) filter (where is_failure) as all_failure, count(*) filter (where not is_failure) as all_control from other),
      ocounts as (select {kind}, count(*) filter (where is_failure) as n_failure, count(*) filter (where not is_failure) as n_control from (select {kind} from frequent) join other on {held} group by 1),
      tested as (select *, {S.tail()} as p from ocounts, osizes), {bh()}
      select array_to_string({kind}, '|') as {kind}, n_failure, n_control, round({LIFT}, 6) as lift_failure, round(p, 6) as p, round(q, 6) as q from q"""


def post_selection(w: DataFrame, mine, scores, pattern: str) -> DataFrame:
    """Mined on the discovery half, tested on the other."""
    halves = written(stats.split(w, 11), "halves")
    other = halves.where(~F.col("discovery"))
    found = mine(halves.where("discovery"))
    tested = stats.with_q(stats.with_p(scores(other, found)))
    return r6(tested.select(bars(pattern), "n_failure", "n_control", "lift_failure", "p", "q"), "lift_failure", "p", "q")


@query("split_itemsets", split_sql("itemset", "item_set", "list_has_all(item_set, itemset)"))
def split_itemsets(spark, d):
    return post_selection(kept_windows(spark, d), mining.itemsets, mining.set_scores, "itemset")


@query("split_sequences", split_sql("sequence", "items", IN_ORDER.format("items", "sequence")))
def split_sequences(spark, d):
    return post_selection(kept_windows(spark, d), mining.sequences, mining.sequence_scores, "sequence")


@query("signature_catalog", f"select * from ({split_sql('itemset', 'item_set', 'list_has_all(item_set, itemset)')}) order by lift_failure desc, itemset limit 10")
def signature_catalog(spark, d):
    return split_itemsets(spark, d).orderBy(F.desc("lift_failure"), "itemset").limit(10)


@query("odds_ratio", f"""{BASE}, cells as (select itemset, n_failure + 0.5 as a, all_failure - n_failure + 0.5 as b, n_control + 0.5 as c, all_control - n_control + 0.5 as e from frequent),
  logs as (select itemset, ln(a * e / (b * c)) as l, sqrt(1 / a + 1 / b + 1 / c + 1 / e) as se from cells)
  select array_to_string(itemset, '|') as itemset, round(exp(l), 6) as odds_ratio, round(exp(l - 1.96 * se), 6) as or_low, round(exp(l + 1.96 * se), 6) as or_high, l - 1.96 * se > 0 as or_significant from logs""")  # fmt: skip
def odds_ratio(spark, d):
    parts = stats.odds(F.col("n_failure"), F.col("all_failure"), F.col("n_control"), F.col("all_control"))
    rows = itemset_scores(kept_windows(spark, d)).select(bars("itemset"), *[v.alias(k) for k, v in parts.items()])
    return r6(rows, "odds_ratio", "or_low", "or_high")


HITS = "hits as (select itemset, w.* from (select itemset from frequent) join win w on list_has_all(item_set, itemset))"
#: Which of the different sets of items hold which itemsets.
HELD = "held as (select s.item_set, f.itemset from (select distinct item_set from win) s join frequent f on list_has_all(s.item_set, f.itemset))"


def all_hits(w: DataFrame) -> DataFrame:
    return mining.set_hits(w, mining.itemsets(w))


def tallied_hits(w: DataFrame) -> DataFrame:
    """The hits of different sets of items, with the numbers of failures and controls that have each."""
    return written(mining.set_hits(mining.tallied(w, "item_set"), mining.itemsets(w)), "tallied-hits")


@query("within_entity_perm", f"""{BASE}, {HITS}, {HELD}, f as (select entity_id, count(*) filter (where is_failure) as f from win group by 1),
  labels as (select window_id, entity_id, f, unnest(range(1, 2001)) as b from win join f using (entity_id)),
  placed as (select window_id, b, f, row_number() over (partition by entity_id, b order by {S.draw('window_id', 'b')}, window_id) as place from labels),
  drawn as (select window_id, b from placed where place <= f), real as (select itemset, count(*) filter (where is_failure) as case_hits from hits group by 1),
  sets as (select b, item_set, count(*) as n from drawn join win using (window_id) group by 1, 2), null_counts as (select itemset, b, sum(n) as n from sets join held using (item_set) group by 1, 2),
  every as (select itemset, case_hits, b from real, (select unnest(range(1, 2001)) as b))
  select array_to_string(itemset, '|') as itemset, case_hits, round((1 + count(*) filter (where coalesce(n, 0) >= case_hits)) / 2001.0, 6) as p_within from every left join null_counts using (itemset, b) group by itemset, case_hits""")  # fmt: skip
def within_entity_perm(spark, d):
    w = kept_windows(spark, d)
    return r6(stats.within_entity_p(tallied_hits(w), w, "itemset", draws=2000).withColumn("itemset", F.array_join("itemset", "|")), "p_within")


@query("loeo", f"""{BASE}, {HITS}, folds as (select p.itemset, e.entity_id from (select distinct itemset from hits) p, (select distinct entity_id from win) e),
  hit as (select f.itemset, f.entity_id, count(*) filter (where h.is_failure) as hf, count(*) filter (where not h.is_failure) as hc from folds f join hits h on h.itemset = f.itemset and h.entity_id <> f.entity_id group by 1, 2),
  size as (select e.entity_id, count(*) filter (where w.is_failure) as nf, count(*) filter (where not w.is_failure) as nc from (select distinct entity_id from win) e join win w on w.entity_id <> e.entity_id group by 1)
  select array_to_string(itemset, '|') as itemset, count(*) filter (where nf > 0 and hf + hc > 0) as folds, count(*) filter (where nf > 0 and hf > 0 and (hf / nf) / ((hf + hc) / (nf + nc)) > 1) as consistent from hit join size using (entity_id) group by itemset""")  # fmt: skip
def loeo(spark, d):
    w = kept_windows(spark, d)
    return stats.leave_one_out(all_hits(w), w, "itemset").withColumn("itemset", F.array_join("itemset", "|"))


@query("min_p", f"""{BASE}, {HITS}, {HELD}, labels as (select window_id, unnest(range(1, 501)) as b from win),
  placed as (select window_id, b, row_number() over (partition by b order by {S.draw('window_id', 'b')}, window_id) <= (select all_failure from sizes) as fails from labels),
  sets as (select b, item_set, count(*) filter (where fails) as n_failure, count(*) filter (where not fails) as n_control from placed join win using (window_id) group by 1, 2),
  null_counts as (select b, itemset, sum(n_failure)::bigint as n_failure, sum(n_control)::bigint as n_control from sets join held using (item_set) group by 1, 2),
  tails as (select n_failure, n_control, {S.tail()} as p from (select distinct n_failure, n_control from null_counts), sizes), least_p as (select b, min(p) as least from null_counts join tails using (n_failure, n_control) group by 1),
  real as (select itemset, {S.tail()} as p from (select itemset, count(*) filter (where is_failure) as n_failure, count(*) filter (where not is_failure) as n_control from hits group by 1), sizes)
  select array_to_string(itemset, '|') as itemset, round(p, 6) as p, round(avg(case when least <= p + 1e-12 then 1.0 else 0 end), 6) as p_adjusted from real, least_p group by itemset, p""")  # fmt: skip
def min_p(spark, d):
    w = kept_windows(spark, d)
    return r6(stats.min_p(tallied_hits(w), w, "itemset", draws=500).withColumn("itemset", F.array_join("itemset", "|")), "p", "p_adjusted")


@query("jaccard_stability", """with s as (select distinct l_shipdate::date - date '1990-01-01' as day, l_suppkey from lineitem), sets as (select distinct day % 30 as k, l_suppkey as m from s),
  n as (select k, count(*) as n from sets group by 1), shared as (select a.k as a, b.k as b, count(*) as s from sets a join sets b on a.m = b.m and a.k < b.k group by 1, 2)
  select x.k as a, y.k as b, round(coalesce(s, 0) / (x.n + y.n - coalesce(s, 0)), 6) as jaccard from n x join n y on x.k < y.k left join shared on shared.a = x.k and shared.b = y.k""")  # fmt: skip
def jaccard_stability(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long") % 30
    sets = T.table(spark, d, "lineitem").select(day.alias("k"), F.col("l_suppkey").alias("m")).distinct()
    return r6(stats.jaccard(sets, "k", "m"), "jaccard")


@query("baseline_rules", f"""with {S.windows(5)}, {SPLIT}, discovery as (select * from win join halves using (entity_id) where discovery), other as (select * from win join halves using (entity_id) where not discovery),
  top as (select items[-1] as last from discovery where is_failure and n_events > 0 group by 1 order by count(*) desc, last limit 5), {S.ITEMSETS.replace('from win', 'from discovery')}, {P_ROWS}, {bh(factor=YEK)}, sig as (select itemset from q where q < 0.05),
  said as (select 'last_code' as rule, is_failure, coalesce(items[-1] in (select last from top), false) as said from other union all select 'significant_itemset', is_failure, exists (select 1 from sig where list_has_all(item_set, itemset)) from other
    union all select 'many_events', is_failure, n_events > (select quantile_cont(n_events, 0.5) from discovery where is_failure) from other),
  c as (select rule, count(*) filter (where is_failure and said) as tp, count(*) filter (where not is_failure and said) as fp, count(*) filter (where is_failure and not said) as fn, count(*) filter (where not is_failure and not said) as tn from said group by 1),
  m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(fp / nullif(fp + tn, 0), 0) as fpr from c)
  select rule, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1, round(coalesce(0.01 * recall / nullif(0.01 * recall + 0.99 * fpr, 0), 0), 6) as ppv from m""")  # fmt: skip
def baseline_rules(spark, d):
    """Three rules learned on one half of the entities and judged on the other: the last item is among the five most
    frequent last ones of failures; any significant itemset is held; more events than the median failure has."""
    w = written(stats.split(kept_windows(spark, d), 11).withColumn("last", F.try_element_at("items", F.lit(-1))), "halves")
    found, other = w.where("discovery"), w.where(~F.col("discovery"))
    top = found.where("is_failure and last is not null").groupBy("last").count().orderBy(F.desc("count"), "last").limit(5).select("last", F.lit(True).alias("said"))
    tested = stats.with_q(stats.with_p(mining.set_scores(found, mining.itemsets(found))), dependent=True).where("q < 0.05")
    held = mining.set_hits(mining.tallied(other, "item_set"), tested.select("itemset")).select("item_set").distinct().withColumn("said", F.lit(True))
    median = found.where("is_failure").agg(F.percentile("n_events", 0.5).alias("median"))  # one row
    rules = {"last_code": other.join(F.broadcast(top), "last", "left"), "significant_itemset": other.join(held, "item_set", "left"), "many_events": other.crossJoin(F.broadcast(median)).withColumn("said", F.col("n_events") > F.col("median"))}
    out = None
    for name, rows in rules.items():
        one = stats.confusion(rows.select("is_failure", F.coalesce("said", F.lit(False)).alias("said")), F.col("is_failure"), F.col("said")).select(F.lit(name).alias("rule"), "*")
        out = one if out is None else out.unionByName(one)
    return r6(out, "precision", "recall", "f1", "ppv")


RISKSET = ORACLES["win_riskset"]
#: Newton's steps of conditional logistic regression by pattern; needs strata (pattern, n, t, x).
NEWTON = """cells as (select pattern, n, t, count(*) as k, sum(x) as ones from strata where t > 0 and t < n group by 1, 2, 3),
  seen as (select pattern, sum(k) as strata, sum(ones) as observed from cells group by 1),
  steps as (select pattern, 0 as step, cast(0 as double) as beta from seen union all
    select s.pattern, s.step + 1, greatest(-30, least(30, s.beta + greatest(-1, least(1, coalesce((o.observed - m.expected) / nullif(m.information, 0), 0))))) from steps s join seen o on o.pattern = s.pattern,
      lateral (select sum(k * t * exp(s.beta) / (n - t + t * exp(s.beta))) as expected, sum(k * t * exp(s.beta) / (n - t + t * exp(s.beta)) * (1 - t * exp(s.beta) / (n - t + t * exp(s.beta)))) as information from cells c where c.pattern = s.pattern) m where s.step < 25),
  fitted as (select pattern, beta, 1 / sqrt(sum(k * t * exp(beta) / (n - t + t * exp(beta)) * (1 - t * exp(beta) / (n - t + t * exp(beta))))) as se from steps join cells using (pattern) where step = 25 group by 1, 2)"""
#: The complementary error function by Simpson's rule over [z, z + 12].
ERFC = "(list_sum(list_transform(range(0, 4001), lambda i: (case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow({0} + i * 0.003, 2)))) * 0.003 / 3 * 1.1283791670955126)"


@query("cond_logit", f"""with recursive rich as (select o_custkey as entity_id, case when avg(o_totalprice) > 250000 then 1 else 0 end as x from orders group by 1), sets as (select match_id, is_case, coalesce(x, 0) as x from ({RISKSET}) left join rich using (entity_id)),
  strata as (select 'large_orders' as pattern, match_id, count(*) as n, sum(x) as t, max(is_case * x) as x from sets group by match_id), {NEWTON}
  select pattern, cast(strata as bigint) as strata, cast(observed as bigint) as observed, round(exp(beta), 6) as hazard_ratio, round(exp(beta - 1.96 * se), 6) as hr_low, round(exp(beta + 1.96 * se), 6) as hr_high, round({ERFC.format('(abs(beta / se) / 1.4142135623730951)')}, 6) as p from fitted join seen using (pattern)""")  # fmt: skip
def cond_logit(spark, d):
    """Matched sets of customers; the covariate is a large balance of orders."""
    rich = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg((F.avg("o_totalprice") > 250_000).cast("int").alias("x"))
    sets = windows.risk_sets(subjects(spark, d)).join(rich, "entity_id", "left").withColumn("x", F.coalesce("x", F.lit(0)))
    strata = sets.groupBy("match_id").agg(F.count("*").alias("n"), F.sum("x").alias("t"), F.max(F.col("is_case") * F.col("x")).alias("x")).withColumn("pattern", F.lit("large_orders"))
    return r6(stats.matched_hazard(strata), "hazard_ratio", "hr_low", "hr_high", "p")


# Chains, alarms and normalisation of streams.


@query("three_chains", f"""with {S.windows(5)}, merged as (select window_id, is_failure, list_transform(list_filter(range(1, len(items) + 1), lambda i: i = 1 or items[i] <> items[i - 1]), lambda i: items[i]) as m from win),
  t as (select window_id, is_failure, unnest(list_transform(range(1, greatest(len(m) - 1, 1)), lambda i: m[i:i + 2])) as chain from merged where len(m) >= 3)
  select array_to_string(chain, '|') as chain, count(*) filter (where is_failure) as case_occurrences, count(distinct case when not is_failure then window_id end) as control_windows from t where len(list_distinct(chain)) = 3 group by chain""")  # fmt: skip
def three_chains(spark, d):
    return mining.chains_of_three(kept_windows(spark, d)).withColumn("chain", F.array_join("chain", "|"))


@query("chain_catalog", f"""{SEQ}, all_chains as (select sequence, count(*) filter (where is_failure) as n_failure, count(*) filter (where not is_failure) as n_control from subseqs where len(sequence) between 3 and 4 and len(list_distinct(sequence)) = len(sequence) group by 1)
  select array_to_string(sequence, '|') as chain, n_failure, n_control from all_chains""")  # fmt: skip
def chain_catalog(spark, d):
    return mining.chains(kept_windows(spark, d)).withColumn("chain", F.array_join("chain", "|"))


@query("precursor_codes", f"""with {S.EV}, hit as (select item, case when exists (select 1 from ev f where f.entity_id = e.entity_id and f.event_type = 'error' and f.us > e.us and f.us <= e.us + {DAY}) then 1 else 0 end as hit from ev e where event_type <> 'error'),
  base as (select avg(hit) as base from hit) select item, count(*) as firings, sum(hit)::bigint as hits from hit, base group by item, base having count(*) >= 5 and sum(hit) / count(*) >= 1.02 * base""")  # fmt: skip
def precursor_codes(spark, d):
    return mining.precursors(stream(spark, d), T.FAILURE, DAY, least=5, factor=1.02).select("item", "firings", "hits")


CODES = ("purchase:low", "purchase:high", "signup:low")
RAISED = f"""fired as (select distinct entity_id, us from ev where item in {CODES}),
  raised as (select entity_id, min(us) as us from fired group by 1 union all select r.entity_id, (select min(f.us) from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY}) from raised r
    where exists (select 1 from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY}))"""


def raised_alarms(spark: SparkSession, d: str) -> DataFrame:
    s = stream(spark, d)
    return alarms.raised(s, spark.createDataFrame([(c,) for c in CODES], "item string"), DAY)


@query("alarm_raised", f"with recursive {S.EV}, {RAISED} select entity_id, us from raised")
def alarm_raised(spark, d):
    return raised_alarms(spark, d)


#: How alarms (raised) foretell outages.
REPLAYED = f"""outage as (select distinct entity_id, us from ev where event_type = 'error'),
  a as (select r.*, (select min(o.us) from outage o where o.entity_id = r.entity_id and o.us > r.us and o.us <= r.us + {DAY}) - r.us as lead from raised r),
  o as (select o.*, exists (select 1 from raised r where r.entity_id = o.entity_id and r.us between o.us - {DAY} and o.us) as detected from outage o),
  x as (select count(*) as alarms, count(lead) as true_alarms, quantile_cont(lead / 6e7, 0.5) as m from a), y as (select count(*) as outages, count(*) filter (where detected) as detected from o)
  select alarms, true_alarms, round(m, 6) as median_lead_min, outages, detected, round(true_alarms / alarms, 6) as precision, round(detected / outages, 6) as recall from x, y"""


@query("alarm_replay", f"with recursive {S.EV}, {RAISED}, {REPLAYED}")
def alarm_replay(spark, d):
    outages = stream(spark, d).where(F.col("event_type") == T.FAILURE).select("entity_id", "us").distinct()
    return r6(alarms.metrics(*alarms.judged(raised_alarms(spark, d), outages)), "median_lead_min", "precision", "recall")


@query("transfer", f"""with recursive {S.EV}, farm as (select * from ev where entity_id % 2 = 0), codes as (
    select item from (select item, case when exists (select 1 from farm f where f.entity_id = e.entity_id and f.event_type = 'error' and f.us > e.us and f.us <= e.us + {DAY}) then 1 else 0 end as hit from farm e where event_type <> 'error') h group by item having sum(hit) / count(*) >= (select avg(case when exists (select 1 from farm f where f.entity_id = e.entity_id and f.event_type = 'error' and f.us > e.us and f.us <= e.us + {DAY}) then 1 else 0 end) from farm e where event_type <> 'error')),
  fired as (select distinct entity_id, us from ev where entity_id % 2 = 1 and item in (select item from codes)),
  raised as (select entity_id, min(us) as us from fired group by 1 union all select r.entity_id, (select min(f.us) from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY}) from raised r where exists (select 1 from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY}))
  select count(*) as alarms, count(distinct entity_id) as entities from raised""")  # fmt: skip
def transfer(spark, d):
    s = stream(spark, d)
    codes = mining.precursors(s.where("entity_id % 2 = 0"), T.FAILURE, DAY, least=1, factor=1.0)
    return alarms.raised(s.where("entity_id % 2 = 1"), codes, DAY).agg(F.count("*").alias("alarms"), F.count_distinct("entity_id").alias("entities"))


@query("dedupe_consecutive", f"with {S.EV}, l as (select *, lag(item) over (partition by entity_id order by us, ordinal) as b from ev) select entity_id, us, ordinal, item from l where b is null or b <> item")
def dedupe_consecutive(spark, d):
    return mining.collapsed(stream(spark, d)).select("entity_id", "us", "ordinal", "item")


@query("refractory_dedupe", f"""with recursive {S.EV}, f as (select distinct entity_id, item, us from ev), k as (select entity_id, item, min(us) as us from f group by 1, 2 union all
  select k.entity_id, k.item, (select min(f.us) from f where f.entity_id = k.entity_id and f.item = k.item and f.us >= k.us + {DAY}) from k where exists (select 1 from f where f.entity_id = k.entity_id and f.item = k.item and f.us >= k.us + {DAY}))
  select entity_id, item, us from k""")  # fmt: skip
def refractory_dedupe(spark, d):
    return C.thinned(stream(spark, d), ["entity_id", "item"], DAY)


@query("surprise_binning", f"with {S.EV}, s as (select entity_id, us, ordinal, round(abs(value - lag(value) over (partition by entity_id order by us, ordinal)), 9) as step from ev), q as (select entity_id, round(quantile_cont(step, 0.9), 9) as q from s where step is not null group by 1) select entity_id, ordinal, round(step, 6) as step from s join q using (entity_id) where step > q")
def surprise_binning(spark, d):
    return r6(features.surprises(stream(spark, d), ["value"]).select("entity_id", "ordinal", "step"), "step")


HOURLY = f"{S.EV}, rows_ as (select entity_id, event_type as channel, us // {HOUR} as hour, avg(value) as v from ev group by 1, 2, 3), scale as (select channel, case when quantile_cont(v, 0.75) - quantile_cont(v, 0.25) > 0 then quantile_cont(v, 0.75) - quantile_cont(v, 0.25) else 1.0 end as scale from rows_ where entity_id in (select distinct entity_id from rows_ order by 1 limit 400) group by 1)"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).groupBy("entity_id", F.col("event_type").alias("channel"), F.floor(F.col("us") / HOUR).alias("hour")).agg(F.avg("value").alias("v"))
    return rows.join(F.broadcast(features.iqr_scale(rows)), "channel")


@query("iqr_scale", f"with {HOURLY} select channel, round(scale, 6) as scale from scale")
def iqr_scale(spark, d):
    return r6(hourly(spark, d).select("channel", "scale").distinct(), "scale")


@query("trend_transitions", f"""with {HOURLY}, p as (select r.*, scale, (select arg_max(x.v, x.hour) from rows_ x where x.entity_id = r.entity_id and x.channel = r.channel and x.hour <= r.hour - 6) as past from rows_ r join scale using (channel)),
  w as (select *, case when past is null then null when (v - past) / scale > 0.5 then 1 when (v - past) / scale < -0.5 then -1 else 0 end as way from p),
  b as (select *, coalesce(last_value(way ignore nulls) over (partition by entity_id, channel order by hour rows between unbounded preceding and 1 preceding), 0) as before from w)
  select entity_id, hour, channel, case when way > 0 then 'rising' else 'falling' end as event_subtype from b where way is not null and way <> 0 and way <> before""")  # fmt: skip
def trend_transitions(spark, d):
    return features.trend_transitions(hourly(spark, d))


@query("band_entries", f"with {HOURLY}, b as (select *, case when v > 60 then 'severe' when v > 30 then 'high' else 'normal' end as band from rows_), l as (select *, lag(band) over (partition by entity_id, channel order by hour) as before from b) select entity_id, hour, channel, band from l where band <> 'normal' and (before is null or before <> band)")
def band_entries(spark, d):
    return features.band_entries(hourly(spark, d), F.col("v") > 30, F.col("v") > 60).select("entity_id", "hour", "channel", "band")


# Features and metrics.

WORDS = "words as (select item, row_number() over (order by n desc, item) as k from (select unnest(items) as item, count(*) as n from win group by 1))"


def words_of(w: DataFrame) -> list[str]:
    return features.vocabulary(w)


@query("feature_presence", f"with {S.windows(5)}, {WORDS} select window_id, string_agg(cast(cast(list_contains(items, item) as int) as varchar), '' order by k) as features from win, words group by window_id")
def feature_presence(spark, d):
    w = kept_windows(spark, d)
    return features.presence(w, words_of(w)).select("window_id", F.array_join("features", "").alias("features"))


@query("feature_multiset", f"with {S.windows(5)}, {WORDS} select window_id, string_agg(cast(len(list_filter(items, lambda x: x = item)) as varchar), '' order by k) as features from win, words group by window_id")
def feature_multiset(spark, d):
    w = kept_windows(spark, d)
    return features.multiset(w, words_of(w)).select("window_id", F.array_join("features", "").alias("features"))


@query("feature_bigram", f"with {S.windows(5)}, p as (select unnest(list_distinct(list_transform(range(1, cast(len(items) as bigint)), lambda i: items[i] || '>' || items[i + 1]))) as pair from win) select pair, count(*) as n from p group by 1")
def feature_bigram(spark, d):
    return features.adjacent_pairs(last_windows(spark, d))


@query("feature_precedence", f"with {S.windows(5)}, {WORDS}, pairs as (select a.item as a, b.item as b, a.k as i, b.k as j from words a join words b on a.k < b.k and b.k <= 20) select window_id, string_agg(case when list_contains(items, a) and list_contains(items, b) and list_position(items, a) < list_position(items, b) then '1' else '0' end, '' order by i, j) as features from win, pairs group by window_id")
def feature_precedence(spark, d):
    w = kept_windows(spark, d)
    return features.precedence_row(w, features.vocabulary(w, 20)).select("window_id", F.array_join("features", "").alias("features"))


@query("feature_patterns", f"{BASE} select window_id, count(itemset) as n_held from win left join frequent on list_has_all(item_set, itemset) group by 1")
def feature_patterns(spark, d):
    w = kept_windows(spark, d)
    return features.pattern_counts(w, mining.set_hits(w, mining.itemsets(w)), "itemset").select("window_id", "n_held")


@query("recency_null", f"""with {S.windows(5)}, per as (select f.entity_id || '/' || f.anchor || '/' || cast(f.is_failure as int) as window_id, item, cast(count(*) as bigint) as stratum, f.anchor - max(us) as recency from found f group by f.entity_id, f.anchor, f.is_failure, item),
  o as (select *, row_number() over (partition by item, stratum order by window_id) as place from per), x as (select item, stratum, recency as dealt, row_number() over (partition by item, stratum order by {S.draw('window_id', 'item', '5')}, window_id) as place from per)
  select window_id, item, recency, dealt from o join x using (item, stratum, place)""")  # fmt: skip
def recency_null(spark, d):
    found = windows.last_k(history(spark, d), windows.anchors_of(stream(spark, d), T.FAILURE, CLEAN), 5)
    per = found.groupBy("entity_id", "anchor", "is_failure", "item").agg(F.count("*").alias("stratum"), (F.col("anchor") - F.max("us")).alias("recency"))
    per = per.withColumn("window_id", F.concat_ws("/", F.col("entity_id").cast("string"), F.col("anchor").cast("string"), F.col("is_failure").cast("int").cast("string")))
    return features.recency_null(per.select("window_id", "item", "stratum", "recency"), 5).select("window_id", "item", "recency", "dealt")


@query("injected_order", f"with {S.windows(5)} select window_id, array_to_string(case when (is_failure and {S.draw('window_id', '3')} / 4294967296.0 < 0.5) or {S.draw('window_id', '3', chr(39) + 'coin' + chr(39))} % 2 = 0 then ['A', 'B'] else ['B', 'A'] end || items, '|') as items from win")
def injected_order(spark, d):
    return features.injected(last_windows(spark, d), 0.5, 3).select("window_id", bars("items"))


@query("histogram_descriptors", """with b as (select o_custkey as k, [count(*) filter (where o_orderpriority like '1%'), count(*) filter (where o_orderpriority like '2%'), count(*) filter (where o_orderpriority like '3%'), count(*) filter (where o_orderpriority like '4%'), count(*) filter (where o_orderpriority like '5%')] as h from orders group by 1),
  p as (select k, list_transform(h, lambda x: x / list_sum(h)) as p from b)
  select k, round(list_sum(list_transform(range(1, 6), lambda i: abs(list_sum(list_transform(range(1, i + 1), lambda j: p[j] - 0.2))))), 6) as w1, round(list_sum(list_transform(range(1, 6), lambda i: p[i] * (i - 1))), 6) as centroid,
    round(list_sum(list_transform(p, lambda x: case when x > 0 then -x * log2(x) else 0.0 end)), 6) as entropy, round(p[4] + p[5], 6) as tail from p""")  # fmt: skip
def histogram_descriptors(spark, d):
    bins = F.array(*[F.count_if(F.col("o_orderpriority").startswith(str(i))).cast("double") for i in range(1, 6)])
    rows = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(bins.alias("h"))
    flat = F.array(*[F.lit(1.0)] * 5)
    h = F.col("h")
    return rows.select("k", F.round(features.wasserstein(h, flat), 6).alias("w1"), F.round(features.centroid(h), 6).alias("centroid"), F.round(features.entropy(h), 6).alias("entropy"), F.round(features.tail_mass(h, 0.4), 6).alias("tail"))


@query("counter_features", f"""with {S.EV}, s as (select entity_id, value, value - lag(value) over w as step, row_number() over w as place, count(*) over (partition by entity_id) as n from ev window w as (partition by entity_id order by us, ordinal))
  select entity_id, round(arg_max(value, place), 6) as last_value, round(avg(step), 6) as rate, round(avg(step) - avg(case when place <= ceil(n * 0.3) then step end), 6) as rate_delta, round(regr_slope(value, place), 6) as slope from s group by 1""")  # fmt: skip
def counter_features(spark, d):
    return r6(features.counter_features(stream(spark, d), "value"), "last_value", "rate", "rate_delta", "slope")


@query("ols_residual", """with x as (select l_returnflag as g, l_orderkey, l_linenumber, l_extendedprice as y, l_quantity as q from lineitem), f as (select g, regr_slope(y, q) as b, regr_intercept(y, q) as a from x group by 1)
  select l_orderkey, l_linenumber, g, round(y - a - b * q, 3) as residual, y from x join f using (g)""")  # fmt: skip
def ols_residual(spark, d):
    rows = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("q"))
    return features.residuals(rows, "y", ["q"], "g").select("l_orderkey", "l_linenumber", "g", F.round("residual", 3).alias("residual"), "y")


SCORE = f"with {S.windows(5)}, scored as (select entity_id, anchor, last_us, is_failure, cast(is_failure as int) as label, len(list_filter(items, lambda x: x like 'purchase%')) - len(list_filter(items, lambda x: x like 'view%')) as score from win)"


def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.size(F.filter("items", lambda x: x.startswith(p)))
    return kept_windows(spark, d).withColumns({"label": F.col("is_failure").cast("int"), "score": n("purchase") - n("view")})


@query("auroc_ap_rule", f"""{SCORE}, pos as (select score, count(*) as n from scored where label = 1 group by 1), neg as (select score, count(*) as n from scored where label = 0 group by 1),
  a as (select sum(p.n * n.n * case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end) / (select count(*) filter (where label = 1) * count(*) filter (where label = 0) from scored) as auroc from pos p, neg n),
  t as (select s.score, count(*) filter (where x.label = 1) as hits, count(*) as seen from (select distinct score from scored) s join scored x on x.score >= s.score group by 1),
  ap as (select sum(pos.n * hits / seen) / (select count(*) filter (where label = 1) from scored) as average_precision from t join pos using (score))
  select round(auroc, 6) as auroc, round(average_precision, 6) as average_precision from a, ap""")  # fmt: skip
def auroc_ap_rule(spark, d):
    rows = rule_scores(spark, d)
    return r6(evaluation.auroc(rows).crossJoin(evaluation.average_precision(rows)), "auroc", "average_precision")


@query("leadtime", f"{SCORE}, h as (select (anchor - last_us) / 3.6e9 as h from scored where is_failure and score >= 0 and last_us is not null) select count(*) as n, round(quantile_cont(h, 0.25), 6) as p25, round(quantile_cont(h, 0.5), 6) as median, round(quantile_cont(h, 0.75), 6) as p75 from h")
def leadtime(spark, d):
    return r6(evaluation.lead_time(rule_scores(spark, d), F.col("score") >= 0), "p25", "median", "p75")


@query("temporal_split", f"with {S.windows(5)} select window_id, anchor <= (select quantile_cont(anchor, 0.7) from win) as train from win")
def temporal_split(spark, d):
    return evaluation.temporal_split(kept_windows(spark, d)).select("window_id", "train")


@query("entity_split_70", f"with {S.windows(5)}, e as (select entity_id, row_number() over (order by {S.draw('entity_id', '0')}, entity_id) <= floor(0.7 * count(*) over ()) as train from (select distinct entity_id from win)) select window_id, train from win join e using (entity_id)")
def entity_split_70(spark, d):
    return evaluation.entity_split(kept_windows(spark, d)).select("window_id", "train")


def judged_by_model(rows: DataFrame, name: str, balanced: bool = False, **names) -> DataFrame:
    """label and score of the rows that aren't train, with constant columns; written, so that no metric fits or scores again."""
    scored = evaluation.logistic(rows.where("train"), rows.where(~F.col("train")), balanced=balanced)
    return written(evaluation.weighted(scored).select("label", "score", "weight", *[F.lit(v).alias(k) for k, v in names.items()]), f"scored-{name}")


@query("gbt")
def gbt(spark, d):
    w = evaluation.temporal_split(kept_windows(spark, d)).withColumn("label", F.col("is_failure").cast("int"))
    words = words_of(w.where("train"))
    # Windows with the same counts are one row of the trees.
    rows = written(evaluation.tallied(features.multiset(w, words), ["features", "label", "train"]), "multisets")
    scored, weights = evaluation.boosted(rows.where("train"), rows.where(~F.col("train")))
    top = sorted(zip(weights, words, strict=True), reverse=True)[:15]
    return r6(evaluation.auroc(scored, weight="weight"), "auroc").crossJoin(spark.createDataFrame([(i, w, round(x, 6)) for i, (x, w) in enumerate(top)], "place int, item string, importance double"))


@query("bootstrap_ci", f"""{SCORE}, ent as (select entity_id, row_number() over (order by entity_id) as place, count(*) over () as n from (select distinct entity_id from scored)),
  picks as (select b, {S.draw('b', 'place')} % n + 1 as place, count(*) as times from (select place, n, unnest(range(1, 201)) as b from ent) group by 1, 2),
  steps as (select b, score, sum(label * times) as pos, sum((1 - label) * times) as neg from scored join ent using (entity_id) join picks using (place) group by 1, 2),
  below as (select *, coalesce(sum(neg) over (partition by b order by score rows between unbounded preceding and 1 preceding), 0) as low from steps),
  areas as (select b, sum(pos * (low + neg / 2)) / (sum(pos) * sum(neg)) as a from below group by 1)
  select count(*) as draws, round(quantile_cont(a, 0.025), 6) as low, round(quantile_cont(a, 0.975), 6) as high from areas""")  # fmt: skip
def bootstrap_ci(spark, d):
    return r6(evaluation.bootstrap(rule_scores(spark, d), draws=200), "low", "high")


@query("seed_exclusion", f"with {S.EV} select ordinal from ev where not (event_type = 'error' and us in (select us from ev where event_type = 'error' order by us limit 18))")
def seed_exclusion(spark, d):
    s = stream(spark, d)
    seeds = s.where(F.col("event_type") == T.FAILURE).orderBy("us").limit(18).select("us")
    return windows.without_seeds(s, T.FAILURE, seeds).select("ordinal")


@query("terminal_exclusion", f"{BASE} select array_to_string(itemset, '|') as itemset from frequent where len(list_filter(itemset, lambda x: contains(x, 'signup'))) = 0")
def terminal_exclusion(spark, d):
    return mining.itemsets(kept_windows(spark, d)).where(~F.exists("itemset", lambda x: x.contains("signup"))).select(bars("itemset"))


@query("length_match", f"with {S.windows(5)} select window_id from win where n_events = 5")
def length_match(spark, d):
    return last_windows(spark, d).where("n_events = 5").select("window_id")


@query("intervening_guard", f"with {S.EV}, f as (select distinct entity_id, us as anchor from ev where event_type = 'error') select entity_id, anchor from f a where not exists (select 1 from f b where b.entity_id = a.entity_id and b.anchor >= a.anchor - {DAY} and b.anchor < a.anchor)")
def intervening_guard(spark, d):
    fails = windows.failure_anchors(stream(spark, d), T.FAILURE)
    return windows.without_prior_failure(fails, fails, DAY).select("entity_id", "anchor")


@query("event_controls", f"""with {S.EV}, t as (select distinct entity_id, us from ev), drawn as (select *, row_number() over (partition by entity_id order by {S.draw('entity_id', 'us')}, us) as place from t)
  select entity_id, us as anchor from drawn x where place <= 40 and not exists (select 1 from ev f where f.entity_id = x.entity_id and f.event_type = 'error' and f.us between x.us and x.us + {DAY})""")  # fmt: skip
def event_controls(spark, d):
    s = stream(spark, d)
    return windows.event_controls(s, windows.failure_anchors(s, T.FAILURE), DAY).select("entity_id", "anchor")


@query("developing_window", f"""with {S.EV}, f as (select distinct entity_id, us as anchor from ev where event_type = 'error')
  select f.entity_id, anchor, count(*) as n, round(quantile_cont(value, 0.5), 6) as median, round(regr_slope(value, (us - anchor) / 3.6e9), 6) as slope from f join ev e on e.entity_id = f.entity_id and e.us between f.anchor - {14 * DAY} and f.anchor - {DAY} group by 1, 2 having count(*) >= 20""")  # fmt: skip
def developing_window(spark, d):
    s = stream(spark, d)
    return r6(windows.developing(s, windows.failure_anchors(s, T.FAILURE).drop("is_failure"), "value", 14 * DAY, DAY), "median", "slope")


@query("colocation_span", f"with {S.windows(5)}, s as (select (max(us) - min(us)) / 6e7 as m from found group by entity_id, anchor having count(*) >= 2) select count(*) as windows, round(quantile_cont(m, 0.5), 6) as median_min, round(avg(case when m < 1 then 1.0 else 0 end), 6) as under_one from s")
def colocation_span(spark, d):
    s = stream(spark, d)
    return r6(windows.spans_of(windows.last_k(history(spark, d), windows.anchors_of(s, T.FAILURE, CLEAN), 5)), "median_min", "under_one")


@query("support_sweep", f"{BASE.replace('ceil(0.05 * all_failure)', '1')} select cast(s as double) as min_support, count(*) as n from frequent, (values (0.02), (0.05), (0.1), (0.15)) v(s) where n_failure >= ceil(s * all_failure) group by 1")
def support_sweep(spark, d):
    """One mining at the lowest support serves all: a pattern's count doesn't depend on the threshold."""
    w = kept_windows(spark, d)
    n = w.agg(F.count_if("is_failure").alias("n_f"))
    sweep = spark.createDataFrame([(x,) for x in ("0.02", "0.05", "0.1", "0.15")], "s string").select(F.col("s").cast("decimal(3,2)").alias("min_support"))
    found = mining.itemsets(w, 0.02).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(sweep))
    return found.where(F.col("n_failure") >= F.ceil(F.col("min_support") * F.col("n_f"))).groupBy(F.col("min_support").cast("double").alias("min_support")).agg(F.count("*").alias("n"))


#: The largest lift of mining windows of another relation in place of win.
def ceiling_sql(block: str, relation: str) -> str:
    return f"(with {block.replace('from win', f'from {relation}')} select max({LIFT}) as top from frequent)"


@query("fp_survivors", f"""with {S.windows(5)}, {relabel_sql(7)}, random as (select * replace (drawn as is_failure) from dealt), top as (select * from {ceiling_sql(S.ITEMSETS, 'random')}), {S.ITEMSETS}
  select array_to_string(itemset, '|') as itemset, cast(len(itemset) as int) as itemset_size, n_failure, n_control, round({LIFT}, 6) as lift_failure, round(top, 6) as permuted_ceiling, {LIFT} > top as survives from frequent, top""")  # fmt: skip
def fp_survivors(spark, d):
    rows = mining.mined_itemsets(kept_windows(spark, d))
    return r6(rows.select(bars("itemset"), "itemset_size", "n_failure", "n_control", "lift_failure", "permuted_ceiling", "survives"), "lift_failure", "permuted_ceiling")


@query("ps_survivors", f"""with {S.windows(5)}, {SHUFFLED}, top as (select * from {ceiling_sql(S.SEQUENCES, 'mixed')}), {S.SEQUENCES}, named as (select *, list_sort(list_distinct(sequence)) as itemset, {LIFT} as lift from frequent),
  held as (select itemset, count(*) filter (where is_failure) as hf, count(*) filter (where not is_failure) as hc from (select distinct itemset from named) join win on list_has_all(item_set, itemset) group by 1)
  select array_to_string(sequence, '|') as sequence, cast(len(sequence) as int) as sequence_length, n_failure, n_control, round(lift, 6) as lift_failure, round(lift - (hf / all_failure) / ((hf + hc) / (all_failure + all_control)), 6) as order_gain, round(top, 6) as shuffled_ceiling, lift > top as survives from named join held using (itemset), top""")  # fmt: skip
def ps_survivors(spark, d):
    rows = mining.mined_sequences(kept_windows(spark, d))
    return r6(rows.select(bars("sequence"), "sequence_length", "n_failure", "n_control", "lift_failure", "order_gain", "shuffled_ceiling", "survives"), "lift_failure", "order_gain", "shuffled_ceiling")


@query("alarm_leave_one_out", f"""with recursive {S.EV}, marked as (select entity_id, item, us, case when exists (select 1 from ev f where f.entity_id = e.entity_id and f.event_type = 'error' and f.us > e.us and f.us <= e.us + {DAY}) then 1 else 0 end as hit from ev e where event_type <> 'error'),
  own as (select entity_id, item, count(*) as f, sum(hit) as h from marked group by 1, 2), items as (select item, sum(f) as tf, sum(h) as th from own group by 1), ents as (select entity_id, sum(f) as ef, sum(h) as eh from own group by 1), every as (select sum(f) as af, sum(h) as ah from own),
  codes as (select entity_id, item from own join items using (item) join ents using (entity_id), every where tf - f >= 5 and (th - h) / (tf - f) >= (ah - eh) / (af - ef)),
  fired as (select distinct entity_id, us from ev join codes using (entity_id, item)),
  raised as (select entity_id, min(us) as us from fired group by 1 union all select r.entity_id, (select min(f.us) from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY}) from raised r
    where exists (select 1 from fired f where f.entity_id = r.entity_id and f.us >= r.us + {DAY})), {REPLAYED}""")  # fmt: skip
def alarm_leave_one_out(spark, d):
    """Rules learned from all entities but one, replayed on that one; alarms and outages of all are pooled. The test
    tables have no code at three times the base rate (the operator's default), so codes from the base rate on are taken."""
    s = stream(spark, d)
    outages = s.where(F.col("event_type") == T.FAILURE).select("entity_id", "us").distinct()
    return r6(alarms.metrics(*alarms.judged(alarms.raised_elsewhere(s, T.FAILURE, DAY, factor=1.0), outages, DAY)), "median_lead_min", "precision", "recall")


# Joins, set operations, sorts and scans on the business tables.


@query("maint_join_classify", "select l.l_orderkey, l.l_linenumber, case when p.p_partkey is not null then 'replacement' else 'maintenance' end as kind from lineitem l left join (select distinct p_partkey from part where p_type = 'ECONOMY') p on p.p_partkey = l.l_partkey")
def maint_join_classify(spark, d):
    flagged = T.table(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("flag")).distinct()
    return T.table(spark, d, "lineitem").join(flagged, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.when(F.col("flag"), "replacement").otherwise("maintenance").alias("kind"))


@query("inner_first_failure", f"with {S.EV}, f as (select entity_id, min(us) as anchor from ev where event_type = 'error' group by 1) select e.entity_id, e.ordinal, f.anchor - e.us as lead from ev e join f using (entity_id) where e.us < f.anchor")
def inner_first_failure(spark, d):
    s = stream(spark, d)
    first = s.where(F.col("event_type") == T.FAILURE).groupBy("entity_id").agg(F.min("us").alias("anchor"))
    return s.join(first, "entity_id").where("us < anchor").select("entity_id", "ordinal", (F.col("anchor") - F.col("us")).alias("lead"))


@query("semi_join", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def semi_join(spark, d):
    o = T.table(spark, d, "orders").where("o_orderstatus = 'P'")
    return T.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti_join(spark, d):
    o = T.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return T.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("next_failure_within", f"with {S.EV} select e.ordinal, exists (select 1 from ev f where f.entity_id = e.entity_id and f.event_type = 'error' and f.us > e.us and f.us <= e.us + {DAY}) as followed from ev e")
def next_failure_within(spark, d):
    after = Window.partitionBy("entity_id").orderBy("us").rangeBetween(1, DAY)
    return stream(spark, d).select("ordinal", F.coalesce(F.max((F.col("event_type") == T.FAILURE).cast("int")).over(after) == 1, F.lit(False)).alias("followed"))


@query("union_all", "select n_name as name from nation union all select r_name from region")
def union_all(spark, d):
    return T.table(spark, d, "nation").select(F.col("n_name").alias("name")).unionByName(T.table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("intersect_codes", f"with {S.EV} select item from ev where entity_id % 2 = 0 intersect select item from ev where entity_id % 2 = 1")
def intersect_codes(spark, d):
    s = stream(spark, d)
    return s.where("entity_id % 2 = 0").select("item").intersect(s.where("entity_id % 2 = 1").select("item"))


@query("except_vocabulary", f"with {S.EV} select distinct event_type from ev except select * from (values ('click'), ('view')) v(event_type)")
def except_vocabulary(spark, d):
    return stream(spark, d).select("event_type").subtract(spark.createDataFrame([("click",), ("view",)], "event_type string"))


@query("unpivot", "select l_orderkey, l_linenumber, channel, v from (select l_orderkey, l_linenumber, l_quantity as quantity, l_discount as discount, l_tax as tax from lineitem) unpivot (v for channel in (quantity, discount, tax))")
def unpivot(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "channel", "v")


@query("pivot", "select o_orderpriority, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 4) as f, round(avg(case when o_orderstatus = 'O' then o_totalprice end), 4) as o, round(avg(case when o_orderstatus = 'P' then o_totalprice end), 4) as p from orders group by 1")
def pivot(spark, d):
    out = T.table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c.lower()) for c in "FOP"])


@query("hash_sample", f"select o_orderkey from (select o_orderkey, row_number() over (order by {S.draw('o_orderkey', '9')}, o_orderkey) as n from orders) where n <= 100")
def hash_sample(spark, d):
    return T.table(spark, d, "orders").orderBy(C.draw("o_orderkey", F.lit(9)), "o_orderkey").limit(100).select("o_orderkey")


@query("top_k_by_group", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n <= 3")
def top_k_by_group(spark, d):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return T.table(spark, d, "orders").withColumn("n", F.row_number().over(order)).where("n <= 3").select("o_custkey", "o_orderkey")


@query("first_per_group", "select o_custkey, min(o_orderkey) as o_orderkey from orders o where o_orderdate = (select min(o_orderdate) from orders i where i.o_custkey = o.o_custkey) group by 1")
def first_per_group(spark, d):
    return T.table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("group_quantile_back", "select l_orderkey, l_linenumber from lineitem join (select l_suppkey, quantile_cont(l_quantity, 0.9) as q from lineitem group by 1) using (l_suppkey) where l_quantity > q")
def group_quantile_back(spark, d):
    lines = T.table(spark, d, "lineitem")
    q = lines.groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.9).alias("q"))
    return lines.join(q, "l_suppkey").where("l_quantity > q").select("l_orderkey", "l_linenumber")


@query("describe_stream", f"with {S.EV} select event_type, count(*) as n, count(distinct entity_id) as entities, min(us) as first_us, max(us) as last_us, round(quantile_cont(value, 0.5), 6) as median from ev group by 1")
def describe_stream(spark, d):
    return r6(stream(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.percentile("value", 0.5).alias("median")), "median")


@query("monotonic_check", f"with {S.EV}, l as (select entity_id, us - lag(us) over (partition by entity_id order by ordinal) as g from ev) select entity_id, coalesce(bool_and(g >= 0), true) as monotonic from l group by 1")
def monotonic_check(spark, d):
    order = Window.partitionBy("entity_id").orderBy("ordinal")
    gaps = stream(spark, d).select("entity_id", (F.col("us") - F.lag("us").over(order)).alias("g"))
    return gaps.groupBy("entity_id").agg(F.coalesce(F.bool_and(F.col("g") >= 0), F.lit(True)).alias("monotonic"))


@query("illustrative_outage", f"""with {S.EV}, a as (select entity_id, us as anchor from ev where event_type = 'error'), w as (select a.entity_id, a.anchor, e.item, e.event_type, e.us from a join ev e on e.entity_id = a.entity_id and e.us >= a.anchor - {12 * HOUR} and e.us < a.anchor - {HOUR // 30}),
  s as (select entity_id, anchor, count(*) filter (where event_type = 'view') + 0.3 * count(distinct item) + 0.2 * (max(us) - min(us)) / 3.6e9 as score from w group by 1, 2)
  select entity_id, anchor, round(score, 6) as score from (select *, row_number() over (partition by entity_id order by round(score, 9) desc, anchor) as n from s) where n = 1""")  # fmt: skip
def illustrative_outage(spark, d):
    s = stream(spark, d)
    pre = windows.time_slice(s, windows.failure_anchors(s, T.FAILURE), 12 * HOUR).where(F.col("us") < F.col("anchor") - HOUR // 30)
    score = F.count_if(F.col("event_type") == "view") + 0.3 * F.count_distinct("item") + 0.2 * (F.max("us") - F.min("us")) / 3.6e9
    scored = pre.groupBy("entity_id", "anchor").agg(score.alias("score"))
    best = Window.partitionBy("entity_id").orderBy(F.desc(F.round("score", 9)), "anchor")
    return r6(scored.withColumn("n", F.row_number().over(best)).where("n = 1").select("entity_id", "anchor", "score"), "score")


@query("spmf_codec", f"with {S.windows(5)}, codes as (select item, row_number() over (order by item) as code from (select distinct unnest(items) as item from win)) select window_id, string_agg(code || ' -1', ' ' order by i) || ' -2' as line from (select window_id, unnest(items) as item, unnest(range(1, cast(len(items) as bigint) + 1)) as i from win) join codes using (item) group by 1")
def spmf_codec(spark, d):
    from tracelode.sources.formats import coded

    return coded(last_windows(spark, d))[0]


@query("parquet_round_trip", "select n_nationkey, n_name, n_regionkey from nation")
def parquet_round_trip(spark, d):
    from tracelode.sources.formats import write_parquet

    path = scratch(spark, "round-trip")
    write_parquet(T.table(spark, d, "nation"), path)
    return spark.read.parquet(path)


@query(FLAGSHIP, f"{BASE}, {P_ROWS}, {bh()} select array_to_string(itemset, '|') as itemset, n_failure, n_control, round({LIFT}, 6) as lift_failure, round(p, 6) as p, round(q, 6) as q from q")
def signatures_last5(spark, d):
    """From the stream to ranked failure signatures: windows, itemsets, scores, exact tests and their correction."""
    rows = stats.with_q(stats.with_p(itemset_scores(kept_windows(spark, d))))
    return r6(rows.select(bars("itemset"), "n_failure", "n_control", "lift_failure", "p", "q"), "lift_failure", "p", "q").orderBy(F.desc("lift_failure"), "itemset")


from tracelode.plans import assays, complements, studies  # noqa: E402, F401  (add their queries)
