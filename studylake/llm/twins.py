"""SQL (DuckDB) for operators whose statements are long: CRC-32 over bytes, edits by dynamic programming, windows of words."""

from __future__ import annotations

_CRC_TABLE = """crc as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
  case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i)))"""


def _crc(b: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {b}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def _bytes(s: str) -> str:
    return f"list_transform(range(0, octet_length(encode({s}))), lambda k: ('0x' || substr(hex(encode({s})), 2 * k + 1, 2))::bigint)"


def _plus(cost: int | str, edit: str, rest: str) -> str:
    """A cost in ten digits and an audit as one string: the least string is the cheapest, then the ASCII-least."""
    return f"lpad((substr({rest}, 1, 10)::bigint + {cost})::varchar, 10, '0') || '{edit}' || substr({rest}, 11)"


_KEEP_TO = ("case ini when 's' then 2 when 'u' then 3 end", "case ini when 'u' then 3 end", "case ini when 'a' then 4 end", "case ini when 'u' then 3 end")
_NEXT = (3, 3, 4, 3)
_STEP = ", ".join(
    f"least({_plus(3, 'D', f'v[{q + 1}]')}, case when fault < 2 then {_plus('fault', 'K', f'v[{_KEEP_TO[q]}]')} end, case when fault < 2 then {_plus('fault + 2', 'R', f'v[{_NEXT[q]}]')} end)"
    for q in range(4)
)
_CLOSE = ", ".join(f"least(w[{q + 1}], {_plus(2, 'I', f'w[{_NEXT[q]}]')}, {_plus(4, 'II', f'w[{_NEXT[_NEXT[q] - 1]}]')})" for q in range(4))

REPAIR_SQL = f"""
with recursive {_CRC_TABLE},
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {_crc(_bytes("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"))} % 20 as k from conversations, crc),
damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
  case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) as copy
  from named where k <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
  row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth, rtrim(translate(text, E'\\t\\n\\x0b\\x0c\\r', '     '), ' ') as said,
  substr(role, 1, 1) as ini from damaged),
r as (select conv_id, turn, role, text, i, ini, lead(ini) over (partition by conv_id order by i) as next_ini,
  case when said = '' then 3 when nth > 1 then 2 when right(said, 1) in ('.', '!', '?') then 0 else 1 end as fault from numbered),
convs as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 3) as blank,
  count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 1) as truncated,
  count(*) filter (i < total and (ini || next_ini) not in ('su', 'ua', 'au')) as illegal
  from (select *, count(*) over (partition by conv_id) as total from r) group by conv_id),
dp as (select conv_id, n + 1 as i, ['0000000000', '0000000004II', '0000000002I', '0000000000'] as v from convs
  union all select conv_id, i, [{_CLOSE}] from (select dp.conv_id, r.i, [{_STEP}] as w from dp join r on r.conv_id is not distinct from dp.conv_id and r.i = dp.i - 1)),
best as (select conv_id, substr(v[1], 1, 10)::bigint as cost, substr(v[1], 11) as audit from dp where i = 1),
edits as (select conv_id, p, substr(audit, p, 1) as e, (length(audit) - length(replace(audit, 'D', ''))) % 2 as dels, length(audit) as l from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as p from best)),
placed as (select *, count(*) filter (e <> 'I') over w as i, count(*) filter (e <> 'D') over w as o, (l - dels) % 2 as lead from edits window w as (partition by conv_id order by p)),
repaired as (select placed.conv_id, sha256(string_agg(case when e = 'K' then role when (o - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by p)) as s
  from placed left join r on r.conv_id is not distinct from placed.conv_id and r.i = placed.i where e <> 'D' group by placed.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(s, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join convs on convs.conv_id is not distinct from c.conv_id
left join best on best.conv_id is not distinct from c.conv_id left join repaired on repaired.conv_id is not distinct from c.conv_id
"""

RESAMPLE_SQL = f"""
with {_CRC_TABLE},
texts as (select 0 as rel, doc_id as id, row_number() over () as r, text from documents union all select 1, item_id, -row_number() over (), text from benchmark),
found as (select rel, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as w from texts),
w as (select rel, r, unnest(w) as w, generate_subscripts(w, 1) as i from found),
bytes as (select w, {_bytes("w")} as b from (select distinct w from w)),
seq as (select rel, r, b, lead(b) over (partition by r order by i) as b2, lead(b, 2) over (partition by r order by i) as b3 from w join bytes using (w)),
gram as (select rel, r, b from seq union all select rel, r, b || [32] || b2 from seq where b2 is not null
  union all select rel, r, b || [32] || b2 || [32] || b3 from seq where b3 is not null),
hashed as (select rel, r, {_crc("b")} % 10000 as k from gram, crc),
counts as (select k, count(*) filter (rel = 0) as s, count(*) filter (rel = 1) as t from hashed group by k),
sums as (select coalesce(sum(s), 0) as ss, coalesce(sum(t), 0) as tt from counts),
gain as (select k, cast(floor(1000 * ln(((t + 1) * (ss + 10000))::double / ((s + 1) * (tt + 10000))::double)) as bigint) as g from counts, sums),
weights as (select r, count(*) as n_features, sum(g) as weight from hashed join gain using (k) where rel = 0 group by r),
n as (select id as doc_id, texts.r, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0)::bigint as weight,
  ('0x' || substr(sha256('42:' || coalesce(id::varchar, '')), 1, 8))::bigint as h from texts join found using (r) left join weights using (r) where texts.rel = 0),
scored as (select doc_id, n_words, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from n),
placed as (select *, row_number() over (order by score desc, doc_id nulls first) as place, count(*) over () as total from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= 5 * total // 100 then place end as "rank" from placed
union all select doc_id, n_features, weight, score, null from scored where n_words < 20
"""

WORDS_50_SQL = """
with w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from w)),
gone as (select r, i from (select r, i, doc_id, min(doc_id) over (partition by h) as first from win) where doc_id > first),
marks as (select r, unnest(range(i, i + 50)) as p from (select r, min(i) as i from gone group by r, i)),
cover as (select r, list(distinct p) as p from marks group by r),
kept as (select w.r, doc_id, w, list_filter(range(1, len(w) + 1), lambda k: not list_contains(coalesce(p, []), k)) as k from w left join cover using (r))
select doc_id, len(w) as n_words, len(w) - len(k) as n_removed, sha256(array_to_string(list_transform(k, lambda x: w[x]), ' ')) as kept_sha256 from kept
"""
