"""Queries of crosswalks, bridges and jobs over claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.functions.text import fold
from archivum.operators import crosswalk, lifecycle
from archivum.queries.analysis import _ANS, _claims
from archivum.queries.base import query
from archivum.queries.relations import _IDS, _NAMES, _copied, _ids, _names

_TOK = r"list_sort(list_distinct(list_transform(regexp_extract_all({}, '(?i)\b(\d+\.\d+(?:\.\d+)?|\d{{2,4}}[a-z]|(?:pdf|iso)?/?[a-z]-\d+[a-z]?|\d{{2,4}}-\d{{2,4}})\b', 1), lambda x: lower(x))))"
_BROAD = "coalesce(regexp_matches(lower({}), 'family|generic|unspecified|all versions|multiple versions'), false)"


@query(
    "j5_copied_references",
    f"""with {_IDS}, {_NAMES}, c as (select distinct evidence_id, fmt.name as name, lower(trim(p)) as value from institution_format_evidence, unnest(fmt.puids) as u(p)),
    o as (select value, max(canonical_id) as canonical_id from ids where kind = 'puid' group by 1),
    h as (select c.evidence_id, c.name, c.value, o.canonical_id, n.preferred_name, string_agg(c.value, ',') over (partition by evidence_id order by c.value rows between unbounded preceding and unbounded following) as related, count(*) over (partition by evidence_id) as k from c join o using (value) left join names n using (canonical_id)),
    t as (select *, coalesce({_TOK.format('name')}, []) as a, coalesce({_TOK.format('preferred_name')}, []) as b from h)
    select distinct canonical_id, evidence_id as record_id, case when k > 1 then 'multi_puid_source_record' when (len(a) > 0 and len(b) > 0 and a <> b) or {_BROAD.format('name')} then null
      when (len(a) > 0) <> (len(b) > 0) then 'version_ambiguous_puid_cross_reference' else 'exact_puid_cross_reference' end as evidence_scope, related as related_puids from t where evidence_scope is not null""",
)
def copied(t):
    named = t.institution_format_evidence.select(F.col("evidence_id").alias("source_record_id"), F.col("fmt.name").alias("name")).distinct()
    rows = _copied(t).join(named, "source_record_id").select(F.col("source_record_id").alias("record_id"), "name", F.col("value").alias("puid"))
    owners = _ids(t).where("kind = 'puid'").join(_names(t), "canonical_id", "left").select(F.col("value").alias("puid"), "canonical_id", "preferred_name", F.lit(0).alias("ord"))
    return crosswalk.copied_references(rows, owners)


@query(
    "r8_mapping_status",
    r"""with e as (select distinct evidence_id, coalesce(len(fmt.puids), 0) as n, trim(regexp_replace(lower(coalesce(description, '')), '\s+', ' ', 'g')) as h from institution_format_evidence)
    select evidence_id, case when n > 1 then 'direct_multiple_review' when n = 1 and regexp_matches(h, 'not precisely|not exactly|not equivalent|does not distinguish|superclass|subtype|related format|see related|broader|narrower|family') then 'direct_single_review' when n = 1 then 'direct_single_candidate'
      when regexp_matches(h, 'no relevant match|no corresponding|no match|does not have an? entry|not found') then 'no_mapping' when h <> '' then 'contextual_only' else 'unmapped' end as status from e""",
)
def mapping_status(t):
    e = t.institution_format_evidence.dropDuplicates(["evidence_id"])
    ids = F.coalesce("fmt.puids", F.array().cast("array<string>"))
    return e.select("evidence_id", crosswalk.mapping_status(ids, F.lit(None).cast("string"), F.col("description")).alias("status"))


_BR = f"""{_IDS}, {_NAMES}, own as (select kind, value, min(canonical_id) as canonical_id from ids where kind in ('loc', 'puid') group by 1, 2),
  cand as (select a.value as fdd, b.value as puid, a.canonical_id as loc_id, b.canonical_id as pronom_id from own a join ids i on i.canonical_id = a.canonical_id and i.kind = 'puid' join own b on b.kind = 'puid' and b.value = i.value where a.kind = 'loc'),
  ver as (select fdd, puid, loc_id, pronom_id, nl.preferred_name as ln, np.preferred_name as pn, coalesce({_TOK.format('nl.preferred_name')}, []) as a, coalesce({_TOK.format('np.preferred_name')}, []) as b from cand left join names nl on nl.canonical_id = loc_id left join names np on np.canonical_id = pronom_id),
  st as (select *, case when {_BROAD.format('ln')} then 'broad_scope_review' when len(a) > 0 and len(b) > 0 and a <> b then 'version_conflict_review' when (len(a) > 0) <> (len(b) > 0) then 'version_scope_review' when loc_id = pronom_id then 'already_reconciled_authoritatively' else 'bridge_candidate_authority_confirmed' end as status from ver)"""


def _verified(t):
    own = _ids(t).where("kind in ('loc', 'puid')").groupBy("kind", "value").agg(F.min("canonical_id").alias("canonical_id")).join(_names(t), "canonical_id", "left").withColumn("verified", F.lit(True))
    loc, puid = own.where("kind = 'loc'"), own.where("kind = 'puid'")
    mine = _ids(t).where("kind = 'puid'").select("canonical_id", F.col("value").alias("p"))
    cand = loc.join(mine, "canonical_id").select(F.concat_ws(">", "value", "p").alias("record_id"), F.lit(None).cast("string").alias("title"), F.array("value").alias("fdd_ids"), F.array("p").alias("puids"))
    return crosswalk.verify_bridges(cand, loc, puid)


@query("r9_bridge_status", f"with {_BR} select fdd || '>' || puid as record_id, status from st")
def bridge_status(t):
    return _verified(t).select("record_id", "status")


@query("v18_bridge_decisions", f"with {_BR} select fdd, puid, case when count(*) over (partition by puid) = 1 then 'approved_by_policy' else 'many_to_one_scope_review' end as decision from st where status = 'bridge_candidate_authority_confirmed'")
def decisions(t):
    return crosswalk.approve_bridges(_verified(t)).select("fdd", "puid", "decision")


@query("r10_identity_evidence", f"with {_IDS} select canonical_id, string_agg(value, ',' order by value) as puids, count(*) as n_puids from ids where kind = 'puid' group by 1")
def identity_evidence(t):
    return crosswalk.identity_evidence(_ids(t).withColumn("verified", F.lit(True)))


@query("o5_without_shared_ids")
def without_shared(t):
    ids = _ids(t).where(F.col("kind").isin("puid", "loc", "nara")).select("canonical_id", F.concat_ws(":", "kind", "value").alias("id"))
    return crosswalk.keep_first_without_shared_ids(_names(t).select("canonical_id", F.lower("preferred_name").alias("label")), ids, "canonical_id", ["label"])


@query("j6_orphan_claims", "select response_id, canonical_id from (select distinct response_id, canonical_id from question_response where canonical_id is not null) q where not exists (select 1 from format_registry r where r.canonical_id = q.canonical_id)")
def orphans(t):
    rows = t.question_response.where("canonical_id is not null").select("response_id", "canonical_id").distinct()
    return lifecycle.materialize(t.format_registry.select("canonical_id").distinct(), rows, ["response_id"])[1].select("response_id", "canonical_id")


@query("v5_replayed_claims", "select distinct response_id from question_response where canonical_id is not null and response_id % 3 <> 0")
def replayed(t):
    rows = t.question_response.where("canonical_id is not null").select("response_id", F.lit(None).cast("boolean").alias("current")).distinct()
    return lifecycle.replay(rows.where("response_id % 3 = 0"), rows, ["response_id"]).select("response_id")


@query("v6_refreshed_view", "select source_id, origin, count(*) as n from (select institution_id as source_id, 'governed' as origin from (select distinct response_id, institution_id from question_response where institution_id < 'inst-m') union all select institution_id, 'legacy' from (select distinct overlay_id, institution_id from institution_policy_overlay where institution_id not in (select institution_id from question_response where institution_id < 'inst-m'))) group by all")
def refreshed(t):
    governed = t.question_response.where("institution_id < 'inst-m'").select("response_id", F.col("institution_id").alias("source_id")).distinct()
    legacy = t.institution_policy_overlay.select("overlay_id", F.col("institution_id").alias("source_id")).distinct()
    return lifecycle.refreshed_view(legacy, governed).groupBy("source_id", "origin").agg(F.count("*").alias("n"))


@query("a31_conflict_kinds", f"with {_ANS}, p as (select canonical_id, question_id, institution_id as field, count(distinct answer_id) as n from got where answer_id is not null group by 1, 2, 3), x as (select canonical_id, question_id, max(n) as most, count(*) as k from p group by 1, 2), tot as (select canonical_id, question_id from got group by 1, 2 having count(distinct answer_id) > 1) select canonical_id, question_id, case when most > 1 then 'same_criterion_evidence_conflict' when k > 1 then 'composite_field_aggregation' else 'unclassified_conflict' end as classification from x join tot using (canonical_id, question_id)")
def conflict_kinds(t):
    labels = t.framework_answer.select(F.col("question_id").alias("field"), F.lower("label").alias("value"), "answer_id")
    rows = _claims(t).join(labels, ["field", "value"]).select("canonical_id", F.col("field").alias("question_id"), F.coalesce("source_id", F.lit("")).alias("field"), "answer_id")
    return lifecycle.conflict_kinds(rows)


@query("a29_draft_uplift", "select criterion_id, count(*) as n_claims, count(distinct canonical_id) as n_formats from (select distinct response_id, question_id as criterion_id, canonical_id from question_response where canonical_id is not null and answered_at is null or canonical_id is not null and answered_at >= timestamp '2024-01-01') group by 1")
def uplift(t):
    rows = t.question_response.where("canonical_id is not null").select("response_id", F.col("question_id").alias("criterion_id"), "canonical_id", "answered_at").distinct()
    return lifecycle.draft_uplift(rows.where("answered_at < timestamp_ntz'2024-01-01'"), rows, ["response_id"])


@query("a35_storage_status", "select 'formats' as collection, count(*) as n_rows, count(distinct canonical_id) as n_keys from format_registry union all select 'identifiers', count(*), count(distinct canonical_id) from format_identifier union all select 'policies', count(*), count(distinct canonical_id) from institution_policy_overlay")
def status(t):
    return lifecycle.storage_status({"formats": t.format_registry, "identifiers": t.format_identifier, "policies": t.institution_policy_overlay})


@query("v14_simulated_change")
def simulated(t):
    return lifecycle.simulate(t.format_identifier, lambda df: df.withColumn("identifier_value", fold(F.col("identifier_value"))), ["canonical_id", "identifier_type", "identifier_value"])
