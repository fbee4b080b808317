"""SQL building blocks of the oracles: the same relations as the operators', written for a relational engine by hand."""

from __future__ import annotations

#: The canonical stream of the events table.
EV = """ev as (
  select user_id as entity_id, epoch_us(ts) as us, event_id as ordinal, event_type,
         case when cast(regexp_extract(props, '([0-9]+)', 1) as int) < 50 then 'low' else 'high' end as event_subtype,
         event_type || ':' || case when cast(regexp_extract(props, '([0-9]+)', 1) as int) < 50 then 'low' else 'high' end as item, value
  from events)"""

HOUR = 3_600_000_000


def draw(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) as bigint)"


def anchors(clean: int, per_failure: int = 3, tries: int = 50, salt: str | None = None) -> str:
    """Failures and controls; needs ev."""
    return f"""fails as (select distinct entity_id, us as anchor, true as is_failure from ev where event_type = 'error'),
spans as (select entity_id, min(us) + {clean} as low, max(us) - {clean} as high from ev group by 1),
wanted as (select entity_id, count(*) * {per_failure} as wanted from fails group by 1),
tried as (select entity_id, low, high, wanted, unnest(range(0, cast(wanted * {tries} / {per_failure} as bigint))) as i from spans join wanted using (entity_id) where high > low),
spots as (select entity_id, wanted, i, low + {draw('entity_id', 'i', *([repr(salt)] if salt else []))} * 1000000 % (high - low) as anchor from tried),
clean as (select * from spots p where not exists (select 1 from fails f where f.entity_id = p.entity_id and abs(f.anchor - p.anchor) <= {clean})),
controls as (select entity_id, anchor from (select *, row_number() over (partition by entity_id order by i) as n from clean) where n <= wanted),
anchors as (select * from fails union all select distinct entity_id, anchor, false from controls)"""


def last_k(k: int, stream: str = "hist") -> str:
    """Windows of the k last events before each anchor; needs anchors and the stream."""
    return f"""found as (
  select entity_id, anchor, is_failure, s.us, s.ordinal, s.event_type, s.event_subtype, s.item, s.back from (
    select a.*, e.us, e.ordinal, e.event_type, e.event_subtype, e.item, row_number() over (partition by a.entity_id, a.anchor, a.is_failure order by e.us desc, e.ordinal desc) as back
    from anchors a join {stream} e on e.entity_id = a.entity_id and e.us < a.anchor) s where back <= {k}),
win as (
  select a.entity_id, a.anchor, a.is_failure, a.entity_id || '/' || a.anchor || '/' || cast(a.is_failure as int) as window_id, count(f.us) as n_events, max(f.us) as last_us, coalesce(min(f.us), a.anchor) as window_start,
         coalesce(list(f.item order by f.us, f.ordinal) filter (where f.us is not null), []) as items,
         coalesce(list_sort(list_distinct(list(f.item) filter (where f.us is not null))), []) as item_set
  from anchors a left join found f on f.entity_id = a.entity_id and f.anchor = a.anchor and f.is_failure = a.is_failure group by 1, 2, 3)"""


HIST = "hist as (select * from ev where event_type <> 'error')"


def windows(k: int = 5, clean: int = 6 * HOUR) -> str:
    return f"{EV}, {anchors(clean)}, {HIST}, {last_k(k)}"


#: All itemsets of failure windows by enumeration of subsets, and their hits; needs win. Supports count empty windows.
ITEMSETS = """sizes as (select count(*) filter (where is_failure) as all_failure, count(*) filter (where not is_failure) as all_control from win),
recursive_sets as (select window_id, is_failure, item_set, unnest(range(1, cast(1 << len(item_set) as bigint))) as mask from win where len(item_set) > 0),
subsets as (select window_id, is_failure, list_transform(list_filter(range(1, len(item_set) + 1), lambda i: (mask >> (i - 1)) & 1 = 1), lambda i: item_set[i]) as itemset from recursive_sets),
counted as (select itemset, count(*) filter (where is_failure) as n_failure, count(*) filter (where not is_failure) as n_control from subsets group by 1),
frequent as (select c.*, s.* from counted c, sizes s where n_failure >= ceil(0.05 * all_failure) and n_failure > 0)"""

#: All gapped subsequences of failure windows, each once per window; supports count windows that aren't empty.
SEQUENCES = """sizes as (select count(*) filter (where is_failure) as all_failure, count(*) filter (where not is_failure) as all_control, count(*) filter (where is_failure and n_events > 0) as full_failure from win),
masks as (select window_id, is_failure, items, unnest(range(1, cast(1 << len(items) as bigint))) as mask from win where len(items) > 0),
subseqs as (select distinct window_id, is_failure, list_transform(list_filter(range(1, len(items) + 1), lambda i: (mask >> (i - 1)) & 1 = 1), lambda i: items[i]) as sequence from masks),
counted as (select sequence, count(*) filter (where is_failure) as n_failure, count(*) filter (where not is_failure) as n_control from subseqs group by 1),
frequent as (select c.*, s.* from counted c, sizes s where n_failure >= ceil(0.05 * full_failure) and n_failure > 0)"""

#: Scores of rows with n_failure, n_control, all_failure, all_control.
SCORES = """n_failure / all_failure as support_failure, n_control / all_control as support_control,
  (n_failure / all_failure) / ((n_failure + n_control) / (all_failure + all_control)) as lift_failure,
  n_failure / (n_failure + n_control) as p_fail_given_pattern,
  (n_failure / (n_failure + n_control)) / nullif((all_failure - n_failure) / nullif(all_failure + all_control - n_failure - n_control, 0), 0) as relative_risk"""

LN_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"


def tail(hf: str = "n_failure", hc: str = "n_control", nf: str = "all_failure", nc: str = "all_control") -> str:
    """P(X >= hf) by summing the probabilities."""
    term = f"exp({LN_CHOOSE.format(f'({hf}+{hc})', 'j')} + {LN_CHOOSE.format(f'({nf}+{nc}-{hf}-{hc})', f'({nf}-j)')} - {LN_CHOOSE.format(f'({nf}+{nc})', nf)})"
    return f"case when {hf}+{hc} = 0 or {hf}+{hc} = {nf}+{nc} or {nf} = 0 or {nc} = 0 then 1.0 else least(1.0, list_sum(list_transform(range(cast(greatest({hf}, {hf}+{hc}-{nc}) as bigint), cast(least({hf}+{hc}, {nf}) as bigint) + 1), lambda j: {term}))) end"
