"""Queries of the general pipeline problems (history, drift, snapshots), with their SQL."""

from __future__ import annotations

from archivum.operators import drift, history, snapshots

QUERIES = {
    "p1_found": history.p1_found,
    "p1_current": history.p1_current,
    "p2_found": drift.p2_found,
    "p2_table": drift.p2_table,
    "p2_rescued": drift.p2_rescued,
    "p6_found": snapshots.p6_found,
}

_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _fold(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{_WS}', ' ', 'g'))"


ORACLES = {
    "p1_found": f"""
with runs as (
  select run_id, institution_id, as_of_day, row_number() over w as seq, lead(as_of_day) over w as next_day
  from registry_run where status = 'completed' window w as (partition by institution_id order by as_of_day, run_id)),
latest as (
  select r.institution_id, o.institution_format_id, r.seq, r.as_of_day, r.next_day,
    {_fold('o.local_risk_level')} || chr(1) || {_fold('o.local_preservation_action')} as state,
    row_number() over (partition by r.institution_id, o.institution_format_id, r.seq order by o.recorded_at desc, o.overlay_id desc) as n
  from institution_policy_overlay o join runs r using (run_id)),
marked as (
  select *, case when lag(seq) over w = seq - 1 and lag(state) over w = state then 0 else 1 end as starts
  from latest where n = 1 window w as (partition by institution_id, institution_format_id order by seq)),
grouped as (
  select *, sum(starts) over (partition by institution_id, institution_format_id order by seq) as version from marked)
select institution_id, institution_format_id, min(as_of_day) as valid_from, coalesce(arg_max(coalesce(next_day, '9999-12-31'), seq), '9999-12-31') as valid_to
from grouped group by institution_id, institution_format_id, version
""",
    "p1_current": f"""
with runs as (
  select run_id, institution_id, as_of_day, row_number() over w as seq, count(*) over (partition by institution_id) as n_runs
  from registry_run where status = 'completed' window w as (partition by institution_id order by as_of_day, run_id)),
latest as (
  select r.institution_id, o.institution_format_id, r.seq, r.as_of_day, r.n_runs, {_fold('o.local_risk_level')} as risk_level, {_fold('o.local_preservation_action')} as preservation_action,
    row_number() over (partition by r.institution_id, o.institution_format_id, r.seq order by o.recorded_at desc, o.overlay_id desc) as n
  from institution_policy_overlay o join runs r using (run_id)),
marked as (
  select *, case when lag(seq) over w = seq - 1 and lag(risk_level) over w = risk_level and lag(preservation_action) over w = preservation_action then 0 else 1 end as starts
  from latest where n = 1 window w as (partition by institution_id, institution_format_id order by seq)),
grouped as (select *, sum(starts) over (partition by institution_id, institution_format_id order by seq) as version from marked)
select institution_id, institution_format_id, any_value(risk_level) as risk_level, any_value(preservation_action) as preservation_action, min(as_of_day) as valid_from
from grouped group by institution_id, institution_format_id, version having max(seq) = any_value(n_runs)
""",
    "p2_found": """
with heads as (
  select file_id, key as header, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') as hkey, json_type(value) as jt
  from (select distinct * from policy_file_row), json_each(payload)),
mapped as (
  select distinct on (hkey) regexp_replace(lower(header), '[^a-z0-9]', '', 'g') as hkey, logical_field
  from field_map order by hkey, preference, logical_field),
seen as (
  select h.file_id, coalesce(m.logical_field, h.hkey) as field, h.hkey,
    case when jt = 'VARCHAR' then 'string' when jt in ('BIGINT', 'UBIGINT', 'HUGEINT') then 'integer' when jt = 'DOUBLE' then 'double' when jt = 'BOOLEAN' then 'boolean' when jt = 'ARRAY' then 'array' when jt = 'OBJECT' then 'object' end as kind
  from heads h left join mapped m using (hkey)),
profile as (
  select file_id, field, string_agg(distinct hkey, ',' order by hkey) as headers,
    case when count(distinct kind) = 1 then max(kind) when count(distinct kind) = 2 and min(kind) = 'double' and max(kind) = 'integer' then 'double' when count(distinct kind) > 1 then 'string' end as kind
  from seen group by file_id, field),
files as (
  select feed_id, file_id, row_number() over w as seq, lead(file_id) over w as next_file
  from policy_file window w as (partition by feed_id order by delivered_at, file_id)),
lined as (
  select *, coalesce(lag(seq) over w = seq - 1, false) as kept, lag(headers) over w as was, lead(seq) over w as later
  from profile join files using (file_id) window w as (partition by feed_id, field order by seq)),
stretched as (select *, sum(case when kept then 0 else 1 end) over (partition by feed_id, field order by seq) as stretch from lined),
typed as (
  select *, last_value(kind ignore nulls) over (partition by feed_id, field, stretch order by seq rows between unbounded preceding and 1 preceding) as before
  from stretched)
select file_id, field as field_name, 'added' as change_kind from typed where not kept and seq > 1
union all select file_id, field, 'renamed' from typed where kept and was <> headers
union all select file_id, field, 'retyped' from typed where kept and before <> kind
union all select next_file, field, 'removed' from typed where next_file is not null and later is distinct from seq + 1
""",
    "p2_rescued": """
with once as (select file_id, row_no, max(payload) as payload from policy_file_row group by file_id, row_no),
heads as (select file_id, row_no, key as header, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') as hkey, json_type(value) as jt, value from once, json_each(payload)),
mapped as (
  select distinct on (hkey) regexp_replace(lower(header), '[^a-z0-9]', '', 'g') as hkey, logical_field, preference
  from field_map order by hkey, preference nulls last, logical_field),
seen as (
  select h.*, coalesce(m.logical_field, h.hkey) as field, coalesce(m.preference, 1073741824) as pref,
    case when coalesce(m.logical_field, h.hkey) = 'holdings_count' then jt in ('BIGINT', 'UBIGINT') and try_cast(value as bigint) is not null
      else jt = 'VARCHAR' and coalesce(m.logical_field, h.hkey) in ('institution_format_id', 'name', 'extensions', 'mime_types', 'category', 'description', 'risk_level', 'preservation_action', 'preferred_tools') end as fits
  from heads h left join mapped m using (hkey) where jt <> 'NULL'),
ranked as (select *, row_number() over (partition by file_id, row_no, field, fits order by pref, hkey, header) as n from seen)
select file_id, field as field_name, count(*) as n_values, count(*) filter (where not (fits and n = 1)) as n_rescued from ranked group by file_id, field
""",
    "p6_found": f"""
with snaps as (
  select source_id, snapshot_id, acquired_at, first_value(snapshot_id) over (partition by source_id, lower(trim(sha256)) order by acquired_at, snapshot_id) as content
  from source_snapshot),
steps as (
  select source_id, snapshot_id, content, lag(content) over (partition by source_id order by acquired_at, snapshot_id) as before from snaps),
moved as (select * from steps where before is not null and before <> content),
recs as (
  select distinct snapshot_id as content, lower(trim(source_record_id)) as key,
    {_fold('name')} || chr(1) || {_fold('category')} || chr(1) || {_fold('format_version')} || chr(1) ||
    coalesce(array_to_string(list_sort(list_distinct(extensions)), chr(2)), '') || chr(1) || coalesce(array_to_string(list_sort(list_distinct(mime_types)), chr(2)), '') as body
  from source_record),
now as (select m.source_id, m.snapshot_id, r.key, r.body from moved m join recs r on r.content = m.content),
old as (select m.source_id, m.snapshot_id, r.key, r.body from moved m join recs r on r.content = m.before)
select coalesce(n.source_id, o.source_id) as source_id, coalesce(n.key, o.key) as source_record_id, coalesce(n.snapshot_id, o.snapshot_id) as snapshot_id,
  case when o.key is null then 'added' when n.key is null then 'removed' else 'changed' end as change_kind
from now n full outer join old o on n.source_id = o.source_id and n.snapshot_id = o.snapshot_id and n.key = o.key
where n.key is null or o.key is null or n.body <> o.body
""",
}
