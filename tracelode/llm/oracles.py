"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: A tree of so many levels holds more rows than any test table has.
DEPTH = 10


def crc32(text: str) -> str:
    """Of an ASCII expression, bit by bit: each byte is met at the first of its eight steps."""
    bits = f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])))"
    met = "xor(c, x)"
    return f"xor(list_reduce(list_transform({bits}, lambda v: v::bigint), lambda c, x: xor({met} >> 1, 3988292384 * ({met} & 1))), 4294967295)"


def levels(name: str, table: str) -> str:
    """CTEs of the tree over table (g, rank, h): {name}0 to {name}DEPTH have g, i, h, the siblings a (left) and b
    (right) and n, the number of nodes; a lone node stays as it is."""
    out = [f"{name}0 as (select g, rank as i, h, count(*) over (partition by g) as n from {table})"]
    for k in range(DEPTH):
        run = "over (partition by g, i // 3 order by i rows between unbounded preceding and unbounded following)"
        out.append(f"{name}s{k} as (select *, list(h) {run} as run from {name}{k})")
        out.append(
            f"{name}p{k} as (select g, i, n, case when n > 1 then array_to_string(run[1:i % 3], '') else '' end as a, case when n > 1 then array_to_string(run[i % 3 + 2:], '') else '' end as b, "
            f"case when n > 1 then sha256(array_to_string(run, '')) else h end as up from {name}s{k})"
        )
        out.append(f"{name}{k + 1} as (select g, i // 3 as i, any_value(up) as h, (any_value(n) + 2) // 3 as n from {name}p{k} group by g, i // 3)")
    return ",\n".join(out)


def climbs(name: str, source: str, out: str, keep: str) -> str:
    """CTEs that carry the rows of source (g, rank, start, proof, keep...) up the tree; start is folded, proof grows."""
    ctes, last = [], source
    for k in range(DEPTH):
        now = out if k + 1 == DEPTH else f"{out}{k}"
        ctes.append(
            f"{now} as (select x.g, x.rank // 3 as rank, case when p.n > 1 then sha256(p.a || x.start || p.b) else x.start end as start, x.proof || p.a || p.b as proof, {keep} "
            f"from {last} x join {name}p{k} p on x.g = p.g and x.rank = p.i)"
        )
        last = now
    return ",\n".join(ctes)


def framed(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar))::varchar || ':' || {column}::varchar, '-')"


def manifest() -> str:
    leaf = "sha256(" + " || ".join(framed(c) for c in ["doc_id", "source", "lang", "n_chars"]) + " || {})"
    return f"""
with docs as (
  select doc_id, coalesce('s' || source, '') as g, {leaf.format(framed("text"))} as h, {crc32("doc_id::varchar")} % 2 = 0 as hit, {leaf.format(framed("replace(text, chr(10), '')"))} as other from documents),
leaves as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as rank from docs),
{levels("t", "leaves")},
tops as (select row_number() over (order by encode(g)) - 1 as rank, '' as g, g as source, h from t{DEPTH}),
{levels("u", "tops")},
begun as (select g, rank, case when hit then other else h end as start, '' as proof, doc_id, h as leaf from leaves),
{climbs("t", "begun", "low", "doc_id, leaf")},
middle as (select '' as g, t.rank, x.start, x.proof, x.doc_id, x.leaf, t.h as subroot from low x join tops t on x.g = t.source),
{climbs("u", "middle", "high", "doc_id, leaf, subroot")}
select doc_id, leaf, subroot, r.h as root, sha256(proof) as proof_sha256, start as folded_root, start = r.h as verified from high, u{DEPTH} r
"""


def licenses() -> str:
    """The same votes, joined by the k-grams' words instead of their hashes."""
    from tracelode.llm.licenses import NOTICES, SHARE, SLACK, WHOLE, values

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
words as (select r, generate_subscripts(w, 1) - 1 as pos, unnest(w) as a, unnest(list_append(w[2:], null)) as b, unnest(w[3:] || [null, null]) as c from docs where len(w) > 0),
named as (select template, label, base, string_split(t, ' ') as w from (values {values(NOTICES)}) x(template, label, t, base)),
sized as (select *, len(w) as length, len(w) - least(len(w), 3) + 1 as grams from named),
places as (select template, label, base, length, grams, case when length < {WHOLE} then grams else ceil(grams * {SHARE}) end as least, unnest(range(grams)) as place, w from sized),
keyed as (select *, w[place + 1] as a, w[place + 2] as b, case when length > 2 then w[place + 3] end as c from places),
hits as (select r, template, label, base, length, grams, least, pos, place, pos - place as diagonal
  from words join keyed on words.a = keyed.a and words.b = keyed.b and (keyed.c is null or words.c = keyed.c)),
diagonals as (select r, template, label, base, length, grams, least, diagonal, list(distinct place) as seen, min(pos) as first, max(pos) as last from hits group by all),
begun as (select *, case when base or diagonal - lag(diagonal) over (partition by r, template order by diagonal) > {SLACK} then 1 else 0 end as begins from diagonals),
numbered as (select *, sum(begins) over (partition by r, template order by diagonal) as span from begun),
merged as (select r, template, label, base, length, grams, least, span, len(list_distinct(flatten(list(seen)))) as found, min(first) as first, max(last) as last from numbered group by all),
judged as (select *, base or (found >= least and last - first <= length * 1.5 + {SLACK}) as stands, found::double / grams as share from merged)
select doc_id, len(w)::bigint as n_words, count(*) filter (base) as n_base, min(first) filter (base) as first_word, max(last) filter (base) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label) filter (stands), '') as labels,
  greatest(coalesce(max(share) filter (stands and not base), 0), coalesce(max(0.5) filter (base), 0))::double as score
from docs left join judged using (r) group by r, doc_id, w
"""


def collocations(least: int = 30, top: int = 2000, cover: int = 80) -> str:
    """N-grams of each size, exploded."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    size = lambda k: f"select lang, {k} as size, array_to_string(w[i:i + {k - 1}], ' ') as phrase from places where i + {k - 1} <= len(w)"
    part = lambda i, j: f"array_to_string(string_split(phrase, ' ')[{i}:{j}], ' ')"
    cuts = " union all ".join(f"select lang, phrase, size, a, {k} as k, {part(1, k)} as x, {part(k + 1, 'size')} as y from candidates where size > {k}" for k in (1, 2, 3))
    subs = " union all ".join(f"select lang, {part(i, i + j - 1)} as phrase, a from candidates where size = {k}" for k in (3, 4) for j in range(2, k) for i in range(1, k - j + 2))
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from split),
counted as (select lang, size, phrase, count(*)::hugeint as f from ({" union all ".join(size(k) for k in range(1, 5))}) group by all),
candidates as (select lang, size, phrase, f as a from counted where size >= 2 and f >= {least}),
cuts as ({cuts}),
scores as (select c.lang, c.phrase, any_value(c.a) as a, min(row((2000000 * c.a) // (l.f + r.f), k, l.f, r.f)) as m from cuts c join counted l on l.lang = c.lang and l.phrase = x join counted r on r.lang = c.lang and r.phrase = y group by c.lang, c.phrase),
inside as (select lang, phrase, max(a) as most from ({subs}) group by all),
kept as (select s.*, m[1] as score from scores s left join inside i on i.lang = s.lang and i.phrase = s.phrase where most is null or 100 * most < {cover} * a),
ranks as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept),
totals as (select lang, sum(f) as n from counted where size = 1 group by lang)
select lang, rank, phrase, a::bigint as a, m[3]::bigint as l, m[4]::bigint as r, n::bigint as n, score::bigint as score from ranks join totals using (lang) where rank <= {top}
"""
