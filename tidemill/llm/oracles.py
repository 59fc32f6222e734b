"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemill.llm import quality_rules as q

_SPACE = r"[\x20\x09-\x0D]+"


def _count(pattern: str, of: str) -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


_q = lambda p: p.replace("'", "''")
_SYMBOL = "[#*$%&|<>]"
_bare = rf"regexp_replace(l, '{_SPACE}$', '')"

OP7 = rf"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
             regexp_replace(text, '{_SPACE}', '', 'g') as packed, row_number() over () as rid from d),
windows as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] as g
            from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from windows) where c > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest([i, i+1, i+2]) as p from again) group by rid),
lines as (select rid, unnest(string_split(text, chr(10))) as l from w),
judged as (
  select rid, l, {_count('[^\\x20\\x09-\\x0D]+', 'l')} as n, length(regexp_replace(l, '{_SPACE}', '', 'g')) as chars,
         {_count(_q(q.SEPARATOR_RE), _bare)} as seps, {_count(_SYMBOL, _bare)} as syms,
         {_count(_q(q.UPPER_RE), _bare)} as up, {_count(_q(q.LOWER_RE), _bare)} as low, length({_bare}) as bare,
         regexp_matches({_bare}, '{_q(q.END_RE)}') as ends, regexp_matches({_bare}, '{_q(q.INSIDE_RE)}') as inside,
         regexp_matches(translate({_bare}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{'|'.join(q.BOILERPLATE)}') as phrase
  from lines),
verdicts as (
  select *, not (ends or n >= 10 and inside) or (seps >= 2 and 4 * seps >= n) or 100 * syms > 10 * chars
            or (n >= 3 and up * 10 > bare and 100 * up > 70 * (up + low)) or (n <= 25 and phrase) as bad
  from judged where n > 0),
by_doc as (
  select rid, count(*) as n_lines, count(*) - count(distinct l) as dups, count(*) filter (where bad) as lost,
         coalesce(sum(chars) filter (where bad), 0) as lost_chars from verdicts group by rid),
facts as (
  select doc_id, len(ws) as n_words, length(packed) as word_chars, {_count(_SYMBOL, 'text')} as n_symbols,
         coalesce(dups, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
         coalesce(lost, 0) as lost_lines, coalesce(lost_chars, 0) as lost_chars
  from w left join covered c using (rid) left join by_doc using (rid))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) as base_failed,
       not (n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)
         and 100 * lost_chars <= {q.MAX_LOST_PERCENT} * word_chars as kept,
       n_lines::bigint as n_lines, lost_lines::bigint as lost_lines, lost_chars::bigint as lost_chars
from facts"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') as ws from documents),
b as (select item_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') as ws from benchmark),
windows as (
  select distinct item_id, long, array_to_string(ws[i : i + long - 1], ' ') as w
  from (select item_id, ws, least(10, len(ws)) as long, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
runs as (
  select rid, i, long, array_to_string(ws[i : i + long - 1], ' ') as w
  from (select rid, ws, long, unnest(range(1, len(ws) - long + 2)) as i from d, (select distinct long from windows) where len(ws) >= long)),
met as (select rid, i, long, item_id from runs join windows using (long, w)),
hit as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + long)) as p from (select distinct rid, i, long from met)) group by rid),
named as (select rid, count(*) as n, string_agg(x, ',' order by x) as ids from (select distinct rid, item_id::varchar as x from met) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(m.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join hit h using (rid) left join named m using (rid)"""

OP13 = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') as ws from documents),
docs as (select rid, doc_id, ws, len(ws)::bigint as n from d where len(ws) > 0),
totals as (select count(*)::bigint as nn, sum(n)::bigint as l from docs),
q as (select distinct item_id, unnest(regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}')) as t from benchmark),
tf as (select rid, doc_id, n, t, count(*)::bigint as tf from (select rid, doc_id, n, unnest(ws) as t from docs) where t in (select t from q) group by all),
weights as (select t, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, totals group by t),
impacts as (select rid, doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // l))) as impact from tf, totals),
scores as (select item_id, rid, doc_id, sum(w * impact)::bigint as score from q join impacts using (t) join weights using (t) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id, rid) as rank from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50"""

ORACLES: dict[str, str] = {"op7_line_quality": OP7, "op11_window_decontamination": OP11, "op13_lexical_search": OP13}
