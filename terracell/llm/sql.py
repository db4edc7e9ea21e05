"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_OP3 = """
with rows_ as (
    select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null
), t as (
    select conv_id, role, txt, row_number() over (partition by conv_id order by turn nulls first, role, txt) as k from rows_
), c as (
    select conv_id, max(case when k = 1 then role end) as r1, max(case when k = 1 then txt end) as t1,
           sum(case when role = 'assistant' then length(txt) else 0 end) as weight, count(*) as turns
    from t group by conv_id
), placed as (
    select *, (row_number() over (partition by r1, t1 order by conv_id) - 1) // 2 as pair from c
), slots as (
    select *, row_number() over (partition by r1, t1, pair order by weight desc, conv_id) as slot from placed
), pairs as (
    select a.conv_id as chosen_conv, b.conv_id as rejected_conv, a.turns as chosen_turns, coalesce(b.turns, 0) as rejected_turns
    from slots a left join slots b on a.r1 = b.r1 and a.t1 = b.t1 and a.pair = b.pair and b.slot = 2
    where a.slot = 1
), differ as (
    select p.chosen_conv, min(a.k) as k
    from pairs p join t a on a.conv_id = p.chosen_conv
    left join t b on b.conv_id = p.rejected_conv and b.k = a.k and b.role = a.role and b.txt = a.txt
    where b.k is null group by p.chosen_conv
), counted as (
    select p.*, least(coalesce(d.k - 1, p.chosen_turns), p.rejected_turns)::int as n_common
    from pairs p left join differ d on d.chosen_conv = p.chosen_conv
), pieces as (
    select conv_id, k, role, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) as head, replace(txt, '<|', '< |') || '<|end|>' as said from t
), rendered as (
    select p.chosen_conv, side, k, role, head, head || said || chr(10) as piece, length(said) as n_said, k <= n_common as in_prompt
    from counted p
    cross join (values ('chosen'), ('rejected')) as s(side)
    join pieces x on x.conv_id = case when side = 'chosen' then p.chosen_conv else p.rejected_conv end
), spans as (
    select *, coalesce(sum(length(piece)) over (partition by chosen_conv, side, in_prompt order by k rows between unbounded preceding and 1 preceding), 0) + length(head) as begin_ from rendered
), texts as (
    select chosen_conv,
        string_agg(piece, '' order by k) filter (side = 'chosen' and in_prompt) as prompt,
        string_agg(piece, '' order by k) filter (side = 'chosen' and not in_prompt) as chosen,
        string_agg(piece, '' order by k) filter (side = 'rejected' and not in_prompt) as rejected,
        string_agg(begin_::bigint || ':' || (begin_ + n_said)::bigint, ',' order by k) filter (side = 'chosen' and not in_prompt and role = 'assistant') as chosen_mask,
        string_agg(begin_::bigint || ':' || (begin_ + n_said)::bigint, ',' order by k) filter (side = 'rejected' and not in_prompt and role = 'assistant') as rejected_mask
    from spans group by chosen_conv
)
select p.chosen_conv, p.rejected_conv, p.n_common, coalesce(x.prompt, '') as prompt, coalesce(x.chosen, '') as chosen,
       coalesce(x.chosen_mask, '') as chosen_mask, coalesce(x.rejected, '') as rejected, coalesce(x.rejected_mask, '') as rejected_mask
from counted p join texts x on x.chosen_conv = p.chosen_conv
"""

_OP4 = """
with d as (
    select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), windows as (
    select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from d where n >= 50)
), owners as (
    select s, min(doc_id) as owner from windows group by s
), gone as (
    select w.doc_id, w.i from windows w join owners o on o.s = w.s where o.owner < w.doc_id
), marked as (
    select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from gone
), numbered as (
    select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span from marked
), spans as (
    select doc_id, span, min(i) as a, max(i) + 50 as b from numbered group by doc_id, span
), cuts as (
    select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before_ from spans
), pieces as (
    select d.doc_id, sum(b - a) as n_removed, count(*) as n_spans,
           string_agg(substr(h, 2 * before_ + 1, 2 * (a - before_)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept
    from cuts c join d on d.doc_id = c.doc_id group by d.doc_id
)
select d.doc_id, d.n::bigint as n_bytes, coalesce(p.n_removed, 0)::bigint as n_removed, coalesce(p.n_spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(p.kept, d.h))) as kept_sha256
from d left join pieces p on p.doc_id = d.doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7 = f"""
with d as (
    select row_number() over () as row_, doc_id, {_WORDS} as w from documents
), items as (
    select item_id, {_WORDS} as w from benchmark where item_id is not null
), windows as (
    select distinct item_id, w[k : k + 7] as win from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as k from items where len(w) > 0)
), sizes as (
    select distinct len(win) as m from windows
), places as (
    select row_, k, m, w[k : k + m - 1] as win from (select row_, w, m, unnest(range(1, len(w) - m + 2)) as k from d cross join sizes where len(w) >= m)
), hits as (
    select p.row_, p.k, p.m, x.item_id from places p join windows x on x.win = p.win
), covered as (
    select row_, count(distinct spot) as n_hit from (select row_, unnest(range(k, k + m)) as spot from hits) group by row_
), found as (
    select row_, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct row_, item_id::varchar as item from hits) group by row_
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
       sha256(coalesce(f.ids, '')) as items_sha256, coalesce(f.n_items, 0) >= 2 as contaminated
from d left join covered c on c.row_ = d.row_ left join found f on f.row_ = d.row_
"""

SQL: dict[str, str] = {"op3_chat_preferences": _OP3, "op4_suffix_array_dedup": _OP4, "op7_benchmark_decontamination": _OP7}
