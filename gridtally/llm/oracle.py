"""DuckDB SQL for the rows of the queries that SQL can express.

The remaining queries have none: SQL has no XXH64 (op3), no fitted model (op2), no HTML
parser (op5), no search that may leave out a pair (op4), no bin packing (op10) and no look
around in patterns (op1). Tests hold them against brute force.
"""

from gridtally.llm import licenses

TOP_K = r"""
with v as (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(1024 * x::double)) as w
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, q.row, v.vec_id,
         list_dot_product(q.w, v.w)::bigint as score
  from v q join v on v.row <> q.row
  where q.vec_id % 100 = 0
)
select query_id,
       row_number() over (partition by row order by score desc, vec_id)::int as rank,
       vec_id, score
from pairs
qualify rank <= 10
"""

MIXING = r"""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), d as (
  select *,
         ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || coalesce(source, '')
           || ':' || size || ':' || (row_number() over (partition by doc_id, source, size) - 1)),
           1, 13))::bigint as key
  from sized
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), weighed as (
  select *, row_number() over (order by source nulls last) as position,
         [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
  from s
), ranked as (
  select *, source_size * 2.0::double as most,
         sum(source_size) over () * 1.5::double as budget,
         sum(weight) over () as weights
  from weighed
), leveled as (
  select *,
         (budget - coalesce(sum(most) over before, 0))
           / (weights - coalesce(sum(weight) over before, 0)) as level
  from ranked
  window before as (order by most / weight, position
                    rows between unbounded preceding and 1 preceding)
), goals as (
  select source, source_size, budget,
         least(most, coalesce(max(case when most / weight > level then level end) over ()
                              * weight, most)) as target
  from leveled
), timed as (
  select d.doc_id, d.size, d.key, row_number() over () as row, g.source_size, g.target, g.budget,
         sum(d.size) over (partition by d.source order by d.key, d.size
                           rows unbounded preceding)::bigint as played
  from d join goals g on g.source is not distinct from d.source
), copies as (
  select row, size, key, budget, (played + source_size * n) / target as finish
  from timed, range(2) as r(n)
  where size > 0 and target > 0
), served as (
  select row, size, budget, sum(size) over (order by finish, key) as served from copies
), times as (
  select row, sum(size) as taken from served where served <= budget group by row
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken
from timed left join times using (row)
"""

CHAT = r"""
with all_rows as (
  select conv_id, case when conv_id is null then row_number() over () end as alone,
         turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
  union all
  select -1, null, n, r, '<|im_end|><|im_start|>assistant ok'
  from (values (0, 'user'), (1, 'assistant')) as own(n, r)
), ordered as (
  select *,
         row_number() over (partition by conv_id, alone order by turn nulls first, role, text)
           as place
  from all_rows
), marked as (
  select *,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as written,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
                        '<(\\*)\|', '<\\\1|', 'g') as written_role,
         coalesce(lag(role) over (partition by conv_id, alone order by place) <> role, true) as opens
  from ordered
)
select conv_id,
       count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), ''))
         as loss_sha256,
       -- <|im_start|>, a line break, <|im_end|> and a line break, or <|im_part|>
       sum(length(written)
           + case when opens then 12 + length(written_role) + 1 + 11 else 11 end)::bigint
         as formatted_chars
from marked
group by conv_id, alone
"""

_TEMPLATES = ",\n    ".join(
    f"({number}, '{label}', {number < len(licenses.BASE)}, '{phrase}')"
    for number, (label, phrase) in enumerate(licenses.BASE + licenses.NOTICES)
)

# Runs of words are compared as words here.
LICENSES = rf"""
with templates as (
  select number, label, base, regexp_extract_all(lower(phrase), '[a-z0-9]+') as words
  from (values
    {_TEMPLATES}) as t(number, label, base, phrase)
), template_runs as (
  select number, label, base, len(words) as length, i as place, words[i + 1:i + 3] as run
  from templates, unnest(range(len(words) - 2)) as r(i)
), docs as (
  select doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), runs as (
  select doc_id, i as pos, words[i + 1:i + 3] as run
  from docs, unnest(range(greatest(len(words) - 2, 0))) as r(i)
), diagonals as (
  select doc_id, number, label, base, length, pos - place as diagonal, list(distinct place) as votes,
         list_distinct(flatten(list(range(place, place + 3)))) as covered
  from runs join template_runs using (run)
  group by all
), marked as (
  select *,
         case when diagonal - lag(diagonal) over (partition by doc_id, number order by diagonal)
                   <= {licenses.NEIGHBOURS} then 0 else 1 end as opens
  from diagonals
), banded as (
  select *, sum(opens) over (partition by doc_id, number order by diagonal) as band from marked
), bands as (
  select doc_id, number, label, length,
         case when max(diagonal + list_max(covered)) + 1 - min(diagonal + list_min(covered))
                   <= length * {licenses.STRETCH} + {licenses.MORE_WORDS}
              then len(list_distinct(flatten(list(covered)))) else max(len(covered)) end
           / length::double as share
  from banded group by doc_id, number, label, length, band
), places as (
  select doc_id, label, diagonal from diagonals where base and len(votes) = length - 2
), based as (
  select doc_id, count(*) as n, min(diagonal) as first, max(diagonal) as last,
         string_agg(distinct label, ',' order by label) as labels
  from places group by doc_id
), labelled as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels
  from (select doc_id, label from places
        union all select doc_id, label from bands where share >= {licenses.MIN_COVERAGE})
  group by doc_id
), best as (
  select doc_id, max(share) as share from bands group by doc_id
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base,
       b.first::bigint as first_word, b.last::bigint as last_word,
       coalesce(b.labels, '') as base_labels, coalesce(l.labels, '') as labels,
       case when b.n > 0 then 1.0::double else least(coalesce(m.share, 0), 1)::double end as score
from docs d
left join based b on b.doc_id = d.doc_id
left join labelled l on l.doc_id = d.doc_id
left join best m on m.doc_id = d.doc_id
"""

WARC = r"""
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h
  from pages
), k as (
  select *,
         row_number() over (partition by payload order by page_id desc nulls last) as place,
         first_value(page_id) over (partition by payload order by page_id desc nulls last) as kept
  from p
)
select page_id, strlen(payload)::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1, 1)),
         '') as payload_digest,
       case when place = 1 then 'response' else 'revisit' end as record_type,
       case when place > 1 then kept end as refers_to
from k
"""

FILL_IN_MIDDLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text,
         sha256('1:' || coalesce(doc_id::varchar, '')) as h
  from documents
), t as (
  select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as tokens,
         ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4
  from d
), c as (
  select *, len(tokens)::bigint as n,
         least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a,
         greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
         case when text = '' or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from t
), p as (
  select doc_id, n, form, text,
         array_to_string(tokens[1:a], '') as prefix,
         array_to_string(tokens[a + 1:b], '') as middle,
         array_to_string(tokens[b + 1:n], '') as suffix
  from c
)
select doc_id, n, form,
       case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
       case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        else text end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""

ORACLES = {
    "op6_topk": TOP_K,
    "op7_mixing": MIXING,
    "op8_chat": CHAT,
    "op9_licenses": LICENSES,
    "op12_warc": WARC,
    "op13_fill_in_middle": FILL_IN_MIDDLE,
}
