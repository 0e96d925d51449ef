"""SQL for those queries that SQL can express."""

_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _missing(c: str) -> str:
    strip = f"regexp_replace(lower({c}), '^{_WS}+|{_WS}+$', '', 'g')"
    return f"({c} is null or {strip} = '' or {strip} in (select lower(trim(token)) from null_token))"


_SQUEEZED = f"trim(regexp_replace(description, '{_WS}+', ' ', 'g'))"

_LEAKS = r"""
with letters as (select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as t from documents),
items as (select item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as t from eval_item),
windows as (select distinct item_id, t[i:i + 59] as w from items, unnest(range(1, length(t) - 58)) as u(i) where length(t) >= 60),
places as (select doc_id, t[i:i + 59] as w from letters, unnest(range(1, length(t) - 58)) as u(i) where length(t) >= 60)
select distinct doc_id, item_id from places join windows using (w)
"""

ORACLES: dict[str, str] = {
    "p3_found": f"""
with entries as (
  select distinct on (e.entry_id, e.canonical_id) e.entry_id, e.canonical_id, e.category, e.description, e.updated_at, coalesce(t.trust_rank, 1073741824) as rank
  from format_registry e
  left join (select distinct src_ord, source_id from source_record) s on s.src_ord = e.src_ord
  left join source_trust t on t.source_id = s.source_id
  where e.canonical_id is not null),
several as (select canonical_id from entries group by canonical_id having count(distinct entry_id) > 1),
cat as (select canonical_id, entry_id, row_number() over (partition by canonical_id order by rank, updated_at desc nulls last, entry_id) as n from entries where not {_missing('category')}),
des as (select canonical_id, entry_id, row_number() over (partition by canonical_id order by length({_SQUEEZED}) desc, updated_at desc nulls last, rank, entry_id) as n from entries where not {_missing('description')})
select s.canonical_id, coalesce(c.entry_id, -1) as category_entry_id, coalesce(d.entry_id, -1) as description_entry_id
from several s left join cat c on c.canonical_id = s.canonical_id and c.n = 1 left join des d on d.canonical_id = s.canonical_id and d.n = 1
""",
    "p3_survivors": f"""
with entries as (
  select distinct on (e.entry_id, e.canonical_id) e.entry_id, e.canonical_id, e.category, e.description, e.updated_at, coalesce(t.trust_rank, 1073741824) as rank
  from format_registry e
  left join (select distinct src_ord, source_id from source_record) s on s.src_ord = e.src_ord
  left join source_trust t on t.source_id = s.source_id
  where e.canonical_id is not null),
cat as (select *, row_number() over (partition by canonical_id order by rank, updated_at desc nulls last, entry_id) as n from entries where not {_missing('category')}),
des as (select *, row_number() over (partition by canonical_id order by length({_SQUEEZED}) desc, updated_at desc nulls last, rank, entry_id) as n from entries where not {_missing('description')})
select e.canonical_id, e.n_entries, trim(regexp_replace(c.category, '{_WS}+', ' ', 'g')) as category, trim(regexp_replace(d.description, '{_WS}+', ' ', 'g')) as description, c.entry_id as category_entry_id, d.entry_id as description_entry_id
from (select canonical_id, count(*) as n_entries from entries group by canonical_id) e
left join cat c on c.canonical_id = e.canonical_id and c.n = 1 left join des d on d.canonical_id = e.canonical_id and d.n = 1
""",
    "p7_found": f"""
with recursive ties as (
  select distinct canonical_id as id, identifier_type || chr(1) || lower(trim(identifier_value)) as value
  from format_identifier where identifier_type in ('puid', 'loc', 'nara') and not {_missing('identifier_value')} and canonical_id is not null),
pairs as (select distinct a.id as a, b.id as b from ties a join ties b using (value) where a.id <> b.id),
reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on p.a = r.b)
select a as canonical_id, min(least(a, b)) as group_id from reach group by a
""",
    "p9_found": _LEAKS,
    "p9_items": f"""
with found as ({_LEAKS})
select i.item_id, max(length(regexp_replace(lower(i.text), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))) >= 60 as long_enough, count(distinct f.doc_id) as n_documents, count(distinct d.source) as n_sources
from eval_item i left join found f on f.item_id = i.item_id left join documents d on d.doc_id = f.doc_id group by i.item_id
""",
}
