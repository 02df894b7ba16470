"""DuckDB SQL of the queries that SQL can state, in another form than the operators."""

from __future__ import annotations

from stationflow.llm import chat, lexical

FILL_IN_MIDDLE = """
with hashed as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
    sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), drawn as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as c2,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as h3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as h4
  from hashed
), formed as (
  select doc_id, text, n, least(c1, c2) as a, greatest(c1, c2) as b,
    case when n = 0 or h3 >= 90 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
      when h4 < 20 then 'spm' else 'psm' end as form
  from drawn
), cut as (
  select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from formed
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(a as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from cut
"""

CHAT_FORMAT = f"""
with given as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), plain as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from given
), sized as (
  select *, length(regexp_replace(text, '{chat.CONTROL}', '\\1\\\\\\2\\3', 'g'))
    + length(regexp_replace(role, '{chat.CONTROL}', '\\1\\\\\\2\\3', 'g')) + {len(chat.ROLE + chat.TEXT + chat.END)} as chars
  from plain
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

_TERMS = lexical.BETWEEN.replace("[", "[^", 1)
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
RANKED_SEARCH = f"""
with wanted as (
  select distinct item_id, term from (select item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERMS}')) as term from benchmark)
), texts as (
  select row_number() over () as row, doc_id, regexp_extract_all({_LOWERED}, '{_TERMS}') as found from documents
), sizes as (
  select row, doc_id, cast(len(found) as bigint) as n from texts where len(found) > 0
), totals as (
  select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as terms from sizes
), counted as (
  select row, term, cast(count(*) as bigint) as tf from (select row, unnest(found) as term from texts)
  where term in (select term from wanted) group by row, term
), weighted as (
  select term, cast(floor(1000 * ln((2.0::double * max(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from counted, totals group by term
), scored as (
  select item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) as bigint) as score
  from wanted join counted using (term) join weighted using (term) join sizes using (row), totals group by item_id, row, doc_id
), placed as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
  from scored where score > 0
)
select * from placed where rank <= 10
"""

STATEMENTS = {
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_chat_format": CHAT_FORMAT,
    "op13_ranked_search": RANKED_SEARCH,
}
