"""Queries of joins, latest-per-key, reconcile, lookup, set operations and versions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivum.functions import normalize as N
from archivum.functions.text import fold
from archivum.operators import audit, claims, graph, latest, reconcile, search
from archivum.queries.base import fold as sql_fold, query, slug, strip, words

# --- latest per key, runs, augmentation -----------------------------------------------

_RECS = """recs as (select r.*, s.acquired_at, row_number() over (partition by r.source_id, lower(trim(r.source_record_id)) order by s.acquired_at desc, r.src_ord desc) as n
  from (select distinct * from source_record) r join source_snapshot s using (snapshot_id))"""


def _with_time(t):
    return t.source_record.dropDuplicates(["src_ord"]).join(t.source_snapshot.select("snapshot_id", "acquired_at"), "snapshot_id")


@query("a14_latest_record", f"with {_RECS} select source_id, lower(trim(source_record_id)) as record_id, src_ord, snapshot_id from recs where n = 1")
def latest_record(t):
    rows = _with_time(t).withColumn("record_id", F.lower(F.trim("source_record_id")))
    return latest.latest(rows.select("source_id", "record_id", "src_ord", "snapshot_id", "acquired_at"), ["source_id", "record_id"], [F.col("acquired_at"), F.col("src_ord")]).drop("acquired_at")


@query("a15_latest_completed_run", "select institution_id, run_id from (select *, row_number() over (partition by institution_id order by finished_at desc nulls last, run_id desc) as n from registry_run where status = 'completed') where n = 1")
def latest_completed(t):
    return latest.latest_completed(t.registry_run, ["institution_id"]).select("institution_id", "run_id")


@query("a41_run_status", "select institution_id, count(*) as n_runs, count(*) filter (status = 'completed') as n_completed, count(*) filter (status is distinct from 'completed') as n_other, max(as_of_day) filter (status = 'completed') as last_day from registry_run group by 1")
def run_status(t):
    return latest.run_source_status(t.registry_run)


@query(
    "v1_augmented_records",
    """with s as (select *, row_number() over (partition by source_id order by acquired_at desc, snapshot_id desc) as n from source_snapshot where snapshot_id in (select snapshot_id from source_record)),
    r as (select r.* from (select distinct * from source_record) r join s using (snapshot_id) where s.n = 1)
    select source_id, count(*) as n, source_id >= 'm' as reused from r group by 1""",
)
def augmented(t):
    rows = t.source_record.dropDuplicates(["src_ord"]).select("source_id", "source_record_id", "src_ord", F.col("snapshot_id").alias("run_id"))
    held = t.source_snapshot.join(rows.select(F.col("run_id").alias("snapshot_id")).distinct(), "snapshot_id", "left_semi")
    last = held.groupBy("source_id").agg(F.max(F.struct("acquired_at", "snapshot_id")).alias("m")).select("source_id", F.col("m.snapshot_id").alias("run_id"))
    fresh = rows.where("source_id < 'm'").join(last, ["source_id", "run_id"], "left_semi")
    return latest.augment(fresh, rows, last).groupBy("source_id", "reused").agg(F.count("*").alias("n"))


@query("w8_run_over_run", """with c as (select r.institution_id, r.as_of_day, count(distinct o.overlay_id) as n from registry_run r left join institution_policy_overlay o using (run_id) where r.status = 'completed' group by 1, 2)
  select institution_id, as_of_day, n, n - lag(n) over (partition by institution_id order by as_of_day) as change from c""")
def run_over_run(t):
    runs = t.registry_run.where("status = 'completed'").select("run_id", "institution_id", "as_of_day")
    rows = t.institution_policy_overlay.select("run_id", "overlay_id").distinct()
    per = runs.join(rows, "run_id", "left").groupBy("institution_id", "as_of_day").agg(F.count("overlay_id").alias("n"))
    return per.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("institution_id").orderBy("as_of_day")))


# --- reconcile, collisions, validation ----------------------------------------------------

_LAST = """last as (select arg_max(snapshot_id, acquired_at) as snapshot_id from source_snapshot where snapshot_id in (select snapshot_id from source_record) group by source_id)"""


def _current_records(t):
    held = t.source_snapshot.join(t.source_record.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    last = held.groupBy("source_id").agg(F.max_by("snapshot_id", "acquired_at").alias("snapshot_id")).select("snapshot_id")
    return t.source_record.dropDuplicates(["src_ord"]).join(last, "snapshot_id", "left_semi")


@query(
    "a1_reconciled_formats",
    f"""with {_LAST}, r as (select distinct r.* from source_record r join last using (snapshot_id) where coalesce(record_role, '') <> 'evidence_only'),
    k as (select *, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') as nm, list_sort(list_distinct(list_transform(extensions, lambda x: regexp_replace(regexp_replace({strip('lower(x)')}, '^\\.+', ''), '\\s+', '', 'g')))) as ex from r),
    g as (select *, case when nm is not null and len(ex) > 0 then 'e:' || lower(nm) || '|' || array_to_string(ex, ',') when nm is not null then 'n:' || lower(nm) else 's:' || coalesce(source_id, '') || ':' || coalesce(source_record_id, '') end as g from k)
    select 'fmt-' || {slug("coalesce(arg_min(nm, src_ord) filter (nm is not null), min(substring(g, 3)))")} as canonical_id, count(*) as n_records, count(distinct source_id) as n_sources from g group by g""",
)
def reconciled(t):
    return reconcile.reconcile(_current_records(t)).select("canonical_id", "n_records", "n_sources")


@query(
    "a1_members",
    f"""with {_LAST}, r as (select distinct r.* from source_record r join last using (snapshot_id) where coalesce(record_role, '') <> 'evidence_only')
    select source_id, count(*) as n from r group by 1""",
)
def members(t):
    """Every record belongs to one format."""
    return reconcile.reconciled(_current_records(t)).members.groupBy("source_id").agg(F.count_distinct("src_ord").alias("n"))


@query("a2_identifier_claims", f"""with {_LAST}, r as (select distinct r.* from source_record r join last using (snapshot_id))
  select src_ord, 'mime' as kind, {strip('lower(v)')} as value from r, unnest(mime_types) as u(v) where {strip('lower(v)')} <> ''
  union select src_ord, 'extension', regexp_replace(regexp_replace({strip('lower(v)')}, '^\\.+', ''), '\\s+', '', 'g') as x from r, unnest(extensions) as u(v) where x <> ''""")
def claims_of_records(t):
    return reconcile.identifier_claims(_current_records(t)).select("src_ord", "kind", "value")


_IDS = "ids as (select distinct canonical_id, identifier_type as kind, lower(trim(identifier_value)) as value from format_identifier where canonical_id is not null and identifier_value is not null)"


def _ids(t):
    return t.format_identifier.where("canonical_id is not null and identifier_value is not null").select("canonical_id", F.col("identifier_type").alias("kind"), F.lower(F.trim("identifier_value")).alias("value")).distinct()


@query("a21_collisions", f"with {_IDS} select kind, value, count(distinct canonical_id) as n_owners, min(canonical_id) as first_owner, max(canonical_id) as last_owner from ids group by 1, 2 having count(distinct canonical_id) > 1")
def collided(t):
    return reconcile.collisions(_ids(t))


@query("a22_validation", f"""with {_IDS}, reg as (select distinct entry_id, canonical_id, preferred_name from format_registry)
  select 'duplicate_id' as rule, canonical_id as subject, count(*) as n from reg group by 2 having count(*) > 1
  union all select 'missing_name', canonical_id, count(*) from reg where preferred_name is null or trim(preferred_name) = '' group by 2
  union all select 'strong_id_overlap', kind || ':' || value, count(distinct canonical_id) from ids where kind in ('puid', 'loc', 'nara') group by 2 having count(distinct canonical_id) > 1""")
def validated(t):
    return reconcile.validate_registry(t.format_registry.select("entry_id", "canonical_id", "preferred_name").distinct(), _ids(t))


# --- joins ----------------------------------------------------------------------------------


@query("j1_entries_with_source", "select distinct e.entry_id, e.src_ord, s.source_id, s.record_role from format_registry e left join (select distinct src_ord, source_id, record_role from source_record) s using (src_ord)")
def entries_with_source(t):
    return t.format_registry.select("entry_id", "src_ord").distinct().join(t.source_record.select("src_ord", "source_id", "record_role").distinct(), "src_ord", "left")


_PU = f"with {_IDS}, c as (select distinct evidence_id, lower(trim(p)) as value from institution_format_evidence, unnest(fmt.puids) as u(p))"


def _copied(t):
    return t.institution_format_evidence.select(F.col("evidence_id").alias("source_record_id"), F.explode("fmt.puids").alias("p")).select("source_record_id", F.lit("puid").alias("kind"), F.lower(F.trim("p")).alias("value")).distinct()


@query("j3_unique_owner", f"{_PU} select evidence_id, min(canonical_id) as canonical_id from c join ids on ids.kind = 'puid' and ids.value = c.value group by 1 having count(distinct canonical_id) = 1")
def unique_owner(t):
    hits = _copied(t).join(_ids(t), ["kind", "value"]).groupBy(F.col("source_record_id").alias("evidence_id")).agg(F.count_distinct("canonical_id").alias("n"), F.min("canonical_id").alias("canonical_id"))
    return hits.where("n = 1").drop("n")


@query("j7_edges", f"""{_PU}, h as (select evidence_id as source_record_id, canonical_id, string_agg(distinct 'puid:' || c.value, '|' order by 'puid:' || c.value) as copied_identifiers from c join ids on ids.kind = 'puid' and ids.value = c.value group by 1, 2)
  select canonical_id, source_record_id, case when count(*) over (partition by source_record_id) > 1 then 'multi_target_record' else 'exact_copied_identifier' end as relationship, copied_identifiers from h""")
def edges(t):
    return graph.edges_by_copied_ids(_copied(t), _ids(t))


@query("j11_claims_by_alias", f"""with {_IDS}, al as (select canonical_id, lower(canonical_id) as alias from ids union select canonical_id, kind || '-' || replace(value, '/', '-') from ids where kind in ('puid', 'loc', 'nara')),
  q as (select distinct response_id, lower(canonical_id) as ref from question_response) select al.canonical_id, count(distinct response_id) as n_claims from al join q on q.ref = al.alias group by 1""")
def claims_by_alias(t):
    ids = _ids(t)
    own = ids.select("canonical_id", F.lower("canonical_id").alias("alias"))
    alias = own.unionByName(ids.where(F.col("kind").isin(*N.STRONG_KINDS)).select("canonical_id", F.concat(F.col("kind"), F.lit("-"), F.replace("value", F.lit("/"), F.lit("-"))).alias("alias"))).distinct()
    refs = t.question_response.select("response_id", F.lower("canonical_id").alias("alias")).distinct()
    return alias.join(refs, "alias").groupBy("canonical_id").agg(F.count_distinct("response_id").alias("n_claims"))


@query("j14_shadowed", "select distinct overlay_id from institution_policy_overlay o where not exists (select 1 from question_response q where q.canonical_id = o.canonical_id and q.institution_id = o.institution_id)")
def shadowed(t):
    return latest.shadowed(t.institution_policy_overlay.select("overlay_id", "canonical_id", "institution_id").distinct(), t.question_response, ["canonical_id", "institution_id"]).select("overlay_id")


@query("j15_institution_formats", "select distinct canonical_id, preferred_name from format_registry r where exists (select 1 from institution_policy_overlay o where o.canonical_id = r.canonical_id and o.institution_id = (select min(institution_id) from registry_run))")
def institution_formats(t):
    first = t.registry_run.agg(F.min("institution_id")).first()[0]
    mine = t.institution_policy_overlay.where(F.col("institution_id") == first).select("canonical_id")
    return t.format_registry.select("canonical_id", "preferred_name").distinct().join(mine, "canonical_id", "left_semi")


@query("j16_identifier_lookup", f"""with {_IDS}, m as (select distinct canonical_id, lower(trim(v)) as value from format_registry, unnest(identifiers['puid']) as u(v)),
  b as (select value, canonical_id, 0 as p from m union all select value, canonical_id, 1 from ids where kind = 'puid')
  select value, canonical_id from (select *, row_number() over (partition by value order by p, canonical_id) as n from b) where n = 1 and value is not null""")
def identifier_lookup(t):
    own = t.format_registry.select("canonical_id", F.explode(F.col("identifiers")["puid"]).alias("v")).select("canonical_id", F.lower(F.trim("v")).alias("value"), F.lit(0).alias("p")).distinct()
    both = own.unionByName(_ids(t).where("kind = 'puid'").select("canonical_id", "value", F.lit(1).alias("p"))).where("value is not null")
    return latest.first_of_each(both, ["value"], [F.col("p"), F.col("canonical_id")]).select("value", "canonical_id")


@query("j19_evidence_links", f"""with {_IDS}, e as (select distinct evidence_id, fmt from institution_format_evidence),
  l as (select evidence_id, 'puid' as kind, 0 as rank, lower(trim(x)) as value from e, unnest(fmt.puids) as u(x) union all select evidence_id, 'mime', 1, lower(trim(x)) from e, unnest(fmt.mime_types) as u(x) union all select evidence_id, 'extension', 2, lower(trim(x)) from e, unnest(fmt.extensions) as u(x)),
  h as (select evidence_id, rank, count(distinct canonical_id) as n from l join ids using (kind, value) group by 1, 2)
  select evidence_id, min(rank) as rank, arg_min(n, rank) as n_formats from h group by 1""")
def evidence_links(t):
    e = t.institution_format_evidence.select("evidence_id", "fmt").dropDuplicates(["evidence_id"])
    parts = None
    for rank, (kind, field) in enumerate((("puid", "puids"), ("mime", "mime_types"), ("extension", "extensions"))):
        one = e.select("evidence_id", F.explode(f"fmt.{field}").alias("x")).select("evidence_id", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.lower(F.trim("x")).alias("value"))
        parts = one if parts is None else parts.unionByName(one)
    per = parts.join(_ids(t), ["kind", "value"]).groupBy("evidence_id", "rank").agg(F.count_distinct("canonical_id").alias("n"))
    return per.groupBy("evidence_id").agg(F.min("rank").alias("rank"), F.min_by("n", "rank").alias("n_formats"))


@query("a17_alias_components", f"""with recursive {_IDS}, own as (select canonical_id, value from ids where kind = 'puid'),
  pr as (select distinct a.canonical_id as a, b.canonical_id as b from own a join own b using (value) where a.canonical_id <> b.canonical_id), re(a, b) as (select a, b from pr union select re.a, pr.b from re join pr on pr.a = re.b)
  select a as node, min(least(a, b)) as component from re group by 1""")
def components(t):
    own = _ids(t).where("kind = 'puid'")
    # Star pairs per value: every owner with the smallest one.
    low = own.groupBy("value").agg(F.min("canonical_id").alias("a"))
    return graph.alias_components(own.join(low, "value").select("a", F.col("canonical_id").alias("b")))


# --- versions, sets, lifecycle --------------------------------------------------------------

_VERS = """v as (select source_id, arg_min(snapshot_id, acquired_at) as first_id, arg_max(snapshot_id, acquired_at) as last_id from source_snapshot where snapshot_id in (select snapshot_id from source_record) group by 1),
  b as (select distinct v.source_id || ':' || lower(trim(r.source_record_id)) as canonical_id, r.name, r.category from v join source_record r on r.snapshot_id = v.first_id),
  n as (select distinct v.source_id || ':' || lower(trim(r.source_record_id)) as canonical_id, r.name, r.category from v join source_record r on r.snapshot_id = v.last_id)"""


def _versions(t):
    held = t.source_snapshot.join(t.source_record.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    v = held.groupBy("source_id").agg(F.min_by("snapshot_id", "acquired_at").alias("first_id"), F.max_by("snapshot_id", "acquired_at").alias("last_id"))
    key = F.concat_ws(":", "source_id", F.lower(F.trim("source_record_id"))).alias("canonical_id")

    def side(which):
        return t.source_record.drop("source_id").join(v.select("source_id", F.col(which).alias("snapshot_id")), "snapshot_id").select(key, F.col("name").alias("preferred_name"), "category").distinct()

    return side("first_id"), side("last_id")



@query("a17_alias_coverage", f"""with recursive {_IDS}, own as (select canonical_id, value from ids where kind = 'puid'),
  pr as (select distinct a.canonical_id as a, b.canonical_id as b from own a join own b using (value) where a.canonical_id <> b.canonical_id), re(a, b) as (select a, b from pr union select re.a, pr.b from re join pr on pr.a = re.b),
  comp as (select a as node, min(least(a, b)) as component from re group by 1), q as (select distinct response_id, canonical_id, question_id, institution_id from question_response where canonical_id is not null)
  select coalesce(component, canonical_id) as component, question_id as criterion_id, count(*) as n_claims, count(distinct institution_id) as n_sources from q left join comp on node = canonical_id group by all""")
def alias_coverage(t):
    rows = t.question_response.where("canonical_id is not null").select("response_id", "canonical_id", F.col("question_id").alias("criterion_id"), F.col("institution_id").alias("source_id")).distinct()
    return graph.coverage_by_component(components(t), rows)


@query("j8_u2_version_sets", f"with {_VERS} select coalesce(b.canonical_id, n.canonical_id) as canonical_id, case when b.canonical_id is null then 'added' when n.canonical_id is null then 'removed' else 'retained' end as side from (select distinct canonical_id from b) b full outer join (select distinct canonical_id from n) n using (canonical_id)")
def version_sets(t):
    return claims.version_sets(*_versions(t))


@query("v7_change_events", f"""with {_VERS}, ev as (
  select 'format_added' as change_type, n.canonical_id, cast(null as varchar) as field from n anti join b using (canonical_id)
  union all select 'format_removed', b.canonical_id, null from b anti join n using (canonical_id)
  union all select 'name_changed', n.canonical_id, 'preferred_name' from n join b using (canonical_id) where n.name is distinct from b.name
  union all select 'category_changed', n.canonical_id, 'category' from n join b using (canonical_id) where n.category is distinct from b.category),
  lim as (select greatest(25, floor(greatest((select count(*) from b), (select count(*) from n)) * 0.25)) as l), c as (select change_type, count(*) as n from ev group by 1)
  select ev.change_type, ev.canonical_id, ev.field, 1 as n from ev join c using (change_type), lim where c.n < l
  union all select 'source_coverage_changed', null, change_type, n from c, lim where n >= l""")
def change_events(t):
    before, now = _versions(t)
    refs = lambda df: df.select("canonical_id", F.concat(F.lit("ref:"), "canonical_id").alias("ref"))
    return claims.change_events(before, now, refs(before), refs(now), "run-1").select("change_type", "canonical_id", "field", "n")


@query("v2_superseded_claims", """with o as (select distinct response_id, canonical_id, question_id, institution_id, lower(trim(answer_text)) as v, answered_at from question_response where canonical_id is not null and answer_text is not null),
  old as (select distinct canonical_id, question_id, institution_id from o where answered_at < timestamp '2023-01-01'), act as (select distinct canonical_id, question_id, institution_id from o where answered_at >= timestamp '2023-01-01'),
  m as (select distinct question_id from act)
  select old.question_id, (a.canonical_id is not null or m.question_id is null) as current, count(*) as n from old left join act a on a.canonical_id = old.canonical_id and a.question_id = old.question_id and a.institution_id is not distinct from old.institution_id left join m on m.question_id = old.question_id where a.canonical_id is null group by 1, 2
  union all select question_id, true, count(*) from act group by 1""")
def superseded(t):
    rows = t.question_response.where("canonical_id is not null and answer_text is not null")
    keys = ["canonical_id", "question_id", "institution_id"]
    old = rows.where("answered_at < timestamp_ntz'2023-01-01'").select(*keys).distinct().withColumn("current", F.lit(True)).withColumn("superseded_by_run_id", F.lit(None).cast("string"))
    active = rows.where("answered_at >= timestamp_ntz'2023-01-01'").select(*keys).distinct()
    out = claims.supersede(old, active, "run-2", keys, managed="question_id")
    return out.groupBy("question_id", "current").agg(F.count("*").alias("n"))


@query("v4_soft_deleted", f"with {_VERS} select source, current, count(*) as n from (select split_part(b.canonical_id, ':', 1) as source, (n.canonical_id is not null) as current from (select distinct canonical_id from b) b left join (select distinct canonical_id from n) n using (canonical_id)) group by 1, 2")
def soft_deleted(t):
    before, now = _versions(t)
    reg = before.select("canonical_id").distinct().withColumn("current", F.lit(None).cast("boolean")).withColumn("removed_at", F.lit(None).cast("string"))
    out = claims.soft_delete(reg, now, "2025-01-01")
    return out.groupBy(F.split("canonical_id", ":")[0].alias("source"), F.coalesce("current", F.lit(True)).alias("current")).agg(F.count("*").alias("n"))


@query("k1_upserted", f"with {_VERS} select split_part(canonical_id, ':', 1) as source, count(*) as n, count(*) filter (origin = 'new') as n_new from (select canonical_id, 'new' as origin from (select distinct canonical_id from n) union all select canonical_id, 'old' from (select distinct canonical_id from b) x where not exists (select 1 from n where n.canonical_id = x.canonical_id)) group by 1")
def upserted(t):
    before, now = _versions(t)
    mark = lambda df, o: df.select("canonical_id").distinct().withColumn("origin", F.lit(o))
    out = claims.upsert(mark(before, "old"), mark(now, "new"), ["canonical_id"])
    return out.groupBy(F.split("canonical_id", ":")[0].alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("origin") == "new").alias("n_new"))


@query("a34_population_change", f"with {_VERS}, x as (select (select count(distinct canonical_id) from n where canonical_id not in (select canonical_id from b)) as n_added, (select count(distinct canonical_id) from b where canonical_id not in (select canonical_id from n)) as n_removed, (select count(distinct canonical_id) from b where canonical_id in (select canonical_id from n)) as n_retained) select *, round((n_added + n_removed) / greatest(n_removed + n_retained, 1), 4) as turnover, (n_added + n_removed) <= 2000 as within_rows, round((n_added + n_removed) / greatest(n_removed + n_retained, 1), 4) <= 0.1 as within_share, (n_added + n_removed) <= 2000 and round((n_added + n_removed) / greatest(n_removed + n_retained, 1), 4) <= 0.1 as passed from x")
def population(t):
    return audit.drift_gate(audit.population_change(*_versions(t), "canonical_id"), 2000, 0.1)


@query("u4_u5_shared_sets", "select canonical_id from question_response where canonical_id is not null intersect select canonical_id from institution_policy_overlay except select canonical_id from documents where canonical_id is not null")
def shared_sets(t):
    one = lambda df: df.where("canonical_id is not null").select("canonical_id")
    return one(t.question_response).intersect(one(t.institution_policy_overlay)).subtract(one(t.documents))


# --- search and lookup ------------------------------------------------------------------------

_NAMES = "names as (select canonical_id, arg_max(nm, (c, nm)) as preferred_name from (select canonical_id, preferred_name as nm, count(*) as c from (select distinct entry_id, canonical_id, preferred_name from format_registry) where preferred_name is not null group by 1, 2) group by 1)"


def _names(t):
    per = t.format_registry.select("entry_id", "canonical_id", "preferred_name").distinct().where("preferred_name is not null").groupBy("canonical_id", "preferred_name").agg(F.count("*").alias("c"))
    return per.groupBy("canonical_id").agg(F.max_by("preferred_name", F.struct("c", "preferred_name")).alias("preferred_name"))


@query("o3_search", f"with {_NAMES}, h as (select *, {words('preferred_name')} as w from names) select canonical_id, preferred_name, case when w = 'map layer' then 2 else 1 end as score from h where contains(w, 'map layer') order by score desc, lower(preferred_name), canonical_id limit 50")
def searched(t):
    return search.search(_names(t), "Map Layer", 50)


@query("o4_family_search", f"with {_NAMES}, c as (select canonical_id, max(category) as category from format_registry group by 1), h as (select canonical_id, {words('preferred_name')} as w, {words('category')} as f from names left join c using (canonical_id)) select canonical_id, case when f = 'disk image' then 4 when w = 'disk image' then 3 when starts_with(w, 'disk image ') then 2 else 1 end as score from h where f = 'disk image' or contains(w, 'disk image')")
def family_search(t):
    cats = t.format_registry.groupBy("canonical_id").agg(F.max("category").alias("category"))
    return _names(t).join(cats, "canonical_id", "left").select("canonical_id", search.family_score(F.col("preferred_name"), F.col("category"), "Disk Image").alias("score")).where("score is not null")


@query("o6_shortlist")
def shortlisted(t):
    return search.shortlist(_names(t), "tiled scan file version 3")


@query("r12_resolved_names", f"""with {_NAMES}, k as (select canonical_id, {words('preferred_name')} as key, 85 as p from names union select canonical_id, lower(canonical_id), 100 from names),
  t as (select distinct fmt.name as term from institution_format_evidence where fmt.name is not null), s as (select term, lower(trim(term)) as key from t union select term, {words('term')} from t),
  h as (select distinct term, canonical_id, p from s join k using (key) where key <> ''), b as (select *, max(p) over (partition by term) as top from h), r as (select term, canonical_id, p, count(*) over (partition by term) as n, row_number() over (partition by term order by canonical_id) as rank from b where p = top)
  select term, p as priority, canonical_id, n as n_matches from r where rank <= 10""")
def resolved(t):
    names = _names(t)
    keys = search.lookup_keys(names, t.spark.createDataFrame([], "canonical_id string, kind string, value string, verified boolean"))
    terms = t.institution_format_evidence.select(F.col("fmt.name").alias("term")).where("term is not null").distinct()
    return search.resolve(terms, keys).select("term", "priority", "canonical_id", "n_matches")


@query("w6_preferred_by_puid", f"with {_IDS}, p as (select distinct canonical_id, value from ids where kind = 'puid'), s as (select canonical_id, count(*) = 1 as single from p group by 1) select value, canonical_id from (select value, p.canonical_id, row_number() over (partition by value order by starts_with(p.canonical_id, 'puid-') desc, single desc, p.canonical_id desc) as n from p join s using (canonical_id)) where n = 1")
def preferred_by_puid(t):
    return search.preferred_by_puid(_ids(t), _names(t)).select("value", "canonical_id")


@query("o1_o12_orders", f"with {_IDS}, p as (select distinct value from ids where kind = 'puid') select value, row_number() over (order by regexp_extract(value, '^([^/]*)/', 1), try_cast(nullif(regexp_extract(value, '/(\\d+)$', 1), '') as integer) nulls first, value) as place from p")
def orders(t):
    p = _ids(t).where("kind = 'puid'").select("value").distinct()
    return search.places(p, [*search.puid_order(F.col("value")), F.col("value")])


@query("o14_w5_bounded_evidence", "select canonical_id, response_id, printf('E%03d', n) as reference from (select canonical_id, response_id, row_number() over (partition by canonical_id order by answered_at desc nulls last, response_id) as n from (select distinct canonical_id, response_id, answered_at from question_response where canonical_id is not null)) where n <= 80")
def bounded_evidence(t):
    rows = t.question_response.where("canonical_id is not null").select("canonical_id", "response_id", "answered_at").distinct()
    return search.references(rows, ["canonical_id"], [F.col("answered_at").desc_nulls_last(), F.col("response_id")], most=80).select("canonical_id", "response_id", "reference")


@query("w5_reference_numbers", "select institution_id, overlay_id, printf('E%03d', row_number() over (partition by institution_id order by recorded_at, overlay_id)) as reference from (select distinct institution_id, overlay_id, recorded_at from institution_policy_overlay)")
def reference_numbers(t):
    rows = t.institution_policy_overlay.select("institution_id", "overlay_id", "recorded_at").distinct()
    return search.references(rows, ["institution_id"], [F.col("recorded_at"), F.col("overlay_id")]).select("institution_id", "overlay_id", "reference")


@query("l1_puid_lookup", f"with {_IDS}, {_NAMES} select n.canonical_id, n.preferred_name, i.value as puid from names n join ids i on i.canonical_id = n.canonical_id and i.kind = 'puid' where {sql_fold('n.preferred_name')} like '%tagged transcript%'")
def puid_lookup(t):
    hits = _names(t).where(fold(F.col("preferred_name")).contains("tagged transcript"))
    return hits.join(_ids(t).where("kind = 'puid'"), "canonical_id").select("canonical_id", "preferred_name", F.col("value").alias("puid"))
