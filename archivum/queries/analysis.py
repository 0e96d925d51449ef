"""Queries of risk, evidence, scoring, audits and policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from archivum.functions.text import fold
from archivum.operators import audit, evidence, policy, risk
from archivum.queries.base import fold as sql_fold, query

# --- risk ---------------------------------------------------------------------------------

#: Typed labels of the overlay as governed levels, and where they apply, by rule.
RULES = [
    {"rule_id": "direct", "source_match": {"direct": "yes"}, "role": "headline", "value_fields": ["native_label"], "value_map": {"low risk": "low", "medium risk": "moderate", "high risk": "high", "severe risk": "critical", "on watch": "minimal"}, "default_scope": "exact_format"},
    {"rule_id": "indirect", "source_match": {}, "role": "headline", "value_fields": ["native_label"], "value_map": {"low risk": "low", "medium risk": "moderate", "high risk": "high", "severe risk": "critical"}, "default_scope": "format_group"},
]

_ASSESSED = f"""a as (select distinct overlay_id, canonical_id, institution_id as source_id, {sql_fold('local_risk_level')} as l, case when local_preservation_plan is null then 'no' else 'yes' end as direct from institution_policy_overlay),
  m as (select *, case when l = 'low risk' then 'low' when l = 'medium risk' then 'moderate' when l = 'high risk' then 'high' when l = 'severe risk' then 'critical' when l = 'on watch' and direct = 'yes' then 'minimal' end as level,
    case when direct = 'yes' then 0 else 2 end as scope from a),
  r as (select *, case level when 'minimal' then 0 when 'low' then 1 when 'moderate' then 2 when 'high' then 3 when 'critical' then 4 end as rank from m)"""
_LEVEL = "case {} when 0 then 'minimal' when 1 then 'low' when 2 then 'moderate' when 3 then 'high' when 4 then 'critical' end"


def _assessments(t):
    rows = t.institution_policy_overlay.select(
        "overlay_id", "canonical_id", F.col("institution_id").alias("source_id"), fold(F.col("local_risk_level")).alias("native_label"),
        F.when(F.col("local_preservation_plan").isNull(), "no").otherwise("yes").alias("direct"), F.lit(None).cast("string").alias("semantic_level"), F.lit(None).cast("string").alias("scope_type"),
    ).distinct()
    return risk.normalize_assessments(rows, RULES)


@query("a9_normalized_assessments", f"with {_ASSESSED} select level as semantic_level, case when direct = 'yes' then 'direct' else 'indirect' end as rule_id, case when level is null then 'unmapped_value' else 'mapped' end as mapping_status, case when scope = 0 then 'exact_format' else 'format_group' end as scope_type, count(*) as n from r group by all")
def normalized(t):
    return _assessments(t).groupBy("semantic_level", "rule_id", "mapping_status", "scope_type").agg(F.count("*").alias("n"))


_SYN = f"""{_ASSESSED}, w as (select *, min(scope) filter (rank is not null) over (partition by canonical_id) as best from r), p as (select *, rank is not null and scope = best as prim from w),
  s as (select canonical_id, max(rank) filter (prim) as hi, min(rank) filter (prim) as lo, min(best) as scope_rank, count(*) filter (prim) as n_primary, count(*) filter (rank is not null and not prim) as n_context,
    string_agg(distinct source_id, ',' order by source_id) filter (prim) as deciding_sources, count(distinct rank) filter (prim) as n_levels from p group by 1)"""


@query("a7_synthesis", f"""with {_SYN} select canonical_id, hi is not null as assessed, {_LEVEL.format('hi')} as level, scope_rank, n_primary, n_context, hi - lo as spread,
  case when n_primary = 0 then 'low' when n_primary = 1 then 'medium' when hi = lo then 'high' when hi - lo = 1 then 'medium' else 'low' end as confidence, n_levels > 1 as source_divergence from s""")
def synthesis(t):
    return risk.synthesize(_assessments(t)).select("canonical_id", "assessed", "level", "scope_rank", "n_primary", "n_context", "spread", "confidence", "source_divergence")


@query("a8_at_risk_with_deciding_source", f"with {_SYN}, nm as (select canonical_id, max(preferred_name) as preferred_name from format_registry group by 1) select s.canonical_id, nm.preferred_name, {_LEVEL.format('hi')} as level, coalesce(deciding_sources, '') as deciding_sources, n_context from s left join nm using (canonical_id) where hi >= 2")
def at_risk(t):
    names = t.format_registry.groupBy("canonical_id").agg(F.max("preferred_name").alias("preferred_name"))
    out = risk.synthesize(_assessments(t)).where(F.col("level_rank") >= 2)
    return out.join(names, "canonical_id", "left").select("canonical_id", "preferred_name", "level", "deciding_sources", "n_context")


@query("a8_policy_majority", f"with {_SYN}, v as (select canonical_id, rank, count(*) as n from p where prim group by 1, 2), b as (select canonical_id, arg_max(rank, (n, rank)) as rank, sum(n) as n_counted from v group by 1) select c.canonical_id, {_LEVEL.format('b.rank')} as level, b.rank, coalesce(b.n_counted, 0) as n_counted from (select distinct canonical_id from a) c left join b using (canonical_id)")
def majority(t):
    return risk.policy_synthesis(_assessments(t), {"aggregate": "majority", "tie": "highest"})


@query("a8_policy_lowest_all_scopes", f"with {_ASSESSED} select canonical_id, {_LEVEL.format('min(rank)')} as level, min(rank) as rank, count(rank) as n_counted from r group by 1")
def lowest(t):
    return risk.policy_synthesis(_assessments(t), {"aggregate": "lowest", "scope": "all_mapped", "broader": "include"})


@query("a8_policy_strict_missing", f"with {_SYN}, f as (select *, bool_or(rank is null) over (partition by canonical_id) as bad from r), g as (select *, min(scope) filter (rank is not null) over (partition by canonical_id) as bs from f) select canonical_id, {_LEVEL.format('max(rank) filter (not bad and scope = bs)')} as level, max(rank) filter (not bad and scope = bs) as rank, count(rank) filter (not bad and scope = bs) as n_counted from g group by 1")
def strict(t):
    return risk.policy_synthesis(_assessments(t), {"aggregate": "highest", "missing": "unassessed_if_any_unmapped"})


_HAZ = f"""i as (select canonical_id, max(case {sql_fold('local_risk_level')} when 'low risk' then 1.0 when 'medium risk' then 2.0 when 'high risk' then 3.0 end) as inst from institution_policy_overlay group by 1),
  x as (select q.canonical_id, round(least(3.0, 1 + avg(f.points) / 3), 2) as ext from (select distinct * from question_response) q join framework_answer f on f.question_id = q.question_id and f.label = q.answer_text where q.canonical_id is not null group by 1)"""


@query("a4_hazard", f"""with {_HAZ}, b as (select coalesce(i.canonical_id, x.canonical_id) as canonical_id, inst, ext from i full outer join x on i.canonical_id = x.canonical_id where coalesce(i.canonical_id, x.canonical_id) is not null),
  c as (select *, case when ext is null and inst is null then 'no_estimator_available' when ext is null then 'institution_only' when inst is null then 'external_only' when abs(ext - inst) <= 0.5 then 'corroborated' else 'institution_override' end as basis from b),
  d as (select *, case when basis in ('institution_only', 'institution_override') then inst else ext end as rating from c)
  select canonical_id, basis, round(rating, 2) as rating, case when rating is null then null when rating <= 1.49 then 'Low' when rating <= 2.49 then 'Moderate' else 'High' end as band, basis in ('no_estimator_available', 'institution_override') as review_required from d""")
def hazard(t):
    label = fold(F.col("local_risk_level"))
    inst = t.institution_policy_overlay.groupBy("canonical_id").agg(F.max(F.when(label == "low risk", 1.0).when(label == "medium risk", 2.0).when(label == "high risk", 3.0)).alias("inst"))
    answers = t.framework_answer.select("question_id", F.col("label").alias("answer_text"), "points")
    ext = t.question_response.dropDuplicates(["response_id"]).where("canonical_id is not null").join(answers, ["question_id", "answer_text"]).groupBy("canonical_id").agg(F.round(F.least(F.lit(3.0), 1 + F.avg("points") / 3), 2).alias("ext"))
    out = inst.join(ext, "canonical_id", "full_outer").where("canonical_id is not null").withColumn("h", risk.reconcile_hazard(F.col("ext"), F.col("inst")))
    return out.select("canonical_id", "h.basis", F.round("h.rating", 2).alias("rating"), "h.band", "h.review_required")


@query("a12_bands", "select event_id, case when s <= 3 then 'low' when s <= 6 then 'mid' else 'high' end as band from (select event_id, event_id % 10 as s from events)")
def banded(t):
    bands = t.spark.createDataFrame([("low", 0.0, 3.0), ("mid", 4.0, 6.0), ("high", 7.0, 9.0)], "band string, min_score double, max_score double")
    return risk.band_of(t.events.select("event_id", (F.col("event_id") % 10).cast("double").alias("score")), bands).select("event_id", "band")


# --- evidence -------------------------------------------------------------------------------

_ANS = f"""cl as (select distinct response_id, canonical_id, question_id, institution_id, {sql_fold('answer_text')} as v from question_response where canonical_id is not null and answer_text is not null and trim(answer_text) <> ''),
  got as (select cl.*, f.answer_id, f.points from cl left join framework_answer f on f.question_id = cl.question_id and lower(f.label) = cl.v),
  d as (select canonical_id, question_id, arg_max(answer_id, (points, answer_id)) filter (answer_id is not null) as answer_id, max(points) as points, count(*) as n_claims, count(distinct answer_id) as n_answers from got group by 1, 2),
  da as (select *, answer_id is not null and answer_id <> 'impossible' as answered from d),
  fm as (select distinct canonical_id from format_registry where canonical_id is not null), qs as (select question_id, 1.0 + (min(points) > 0)::int as weight, question_id in ('q_loss', 'q_tools') as critical,
    case when question_id in ('q_staff', 'q_size') then 'local_institutional_feasibility' when question_id = 'q_selfdoc' then 'essential_characteristics' when question_id in ('q_openness', 'q_validation') then 'technical' else '' end as domain_id from framework_answer group by 1)"""


def _claims(t):
    rows = t.question_response.dropDuplicates(["response_id"]).where("canonical_id is not null and trim(answer_text) != ''")
    return rows.select("response_id", "canonical_id", F.col("question_id").alias("field"), fold(F.col("answer_text")).alias("value"), F.col("institution_id").alias("source_id"))


def _domain():
    return F.when(F.col("question_id").isin("q_staff", "q_size"), evidence.LOCAL_DOMAIN).when(F.col("question_id") == "q_selfdoc", evidence.CONTENT_DOMAIN).when(F.col("question_id").isin("q_openness", "q_validation"), "technical").otherwise("")


def _answers(t):
    # A validity that cannot be decided is no answer.
    return t.framework_answer.select("question_id", "answer_id", "points", (F.col("answer_id") == "impossible").alias("abstention"))


def _questions(t):
    return t.framework_answer.groupBy("question_id").agg((F.lit(1.0) + (F.min("points") > 0).cast("int")).alias("weight")).withColumn("critical", F.col("question_id").isin("q_loss", "q_tools")).withColumn("domain_id", _domain())


def _derived(t):
    fields = t.framework_answer.select("question_id", F.col("question_id").alias("field")).distinct()
    labels = t.framework_answer.select("question_id", F.lower("label").alias("value"), "answer_id")
    return evidence.derive_answers(_claims(t), fields, _answers(t), labels)


def _formats(t):
    return t.format_registry.where("canonical_id is not null").select("canonical_id").distinct()


@query("a10_derived_answers", f"with {_ANS} select canonical_id, question_id, answer_id, points, case when n_answers = 0 then 'unknown' when n_answers = 1 then 'derived' else 'derived_conflict_conservative' end as status, n_claims, n_answers from d")
def derived(t):
    return _derived(t).drop("abstention")


_SCORES = f"""{_ANS}, s as (select canonical_id, sum(weight * points) as score, count(*) as n_answered, count(*) filter (critical) as nc from da join qs using (question_id) where answered group by 1)
  select fm.canonical_id, round(coalesce(score, 0), 4) as score, coalesce(n_answered, 0) as n_answered, round(coalesce(n_answered, 0) / (select count(*) from qs), 4) as completeness,
    case when coalesce(n_answered, 0) = 0 then 'Not Assessed' when coalesce(nc, 0) < (select count(*) from qs where critical) then 'Needs Assessment' when n_answered < (select count(*) from qs) then 'Partially Assessed' else 'Assessed' end as status,
    REASON as suppressed_reason from fm left join s using (canonical_id)"""


@query("a11_scores", "with " + _SCORES.replace("REASON", "case when coalesce(n_answered, 0) = 0 then 'not_assessed' when coalesce(nc, 0) < (select count(*) from qs where critical) then 'critical_abstention' when n_answered / (select count(*) from qs) < 0.5 then 'insufficient_evidence_completeness' end"))
def scores(t):
    return evidence.score(_formats(t), _questions(t), _derived(t), 0.5).withColumn("score", F.round("score", 4))


@query("a11_scores_uncalibrated", "with " + _SCORES.replace("REASON", "'framework_not_calibrated'"))
def scores_uncalibrated(t):
    return evidence.score(_formats(t), _questions(t), _derived(t), 0.5, banding=False).withColumn("score", F.round("score", 4))


@query("a13_max_score", f"with {_ANS} select sum(weight * p) as max_score from qs join (select question_id, max(points) as p from framework_answer group by 1) using (question_id)")
def max_score(t):
    return evidence.max_score(_questions(t), t.framework_answer)


_GAP = f"""{_ANS}, g as (select fm.canonical_id, qs.question_id, critical, case when d.canonical_id is null then 'no_matching_evidence' else 'claims_exist_but_do_not_map' end as gap, coalesce(n_claims, 0) as n_claims,
    case when d.canonical_id is not null then 'deterministic_mapping_review' when domain_id = 'local_institutional_feasibility' then 'institution_evidence_required' when domain_id = 'essential_characteristics' then 'content_specific_assessment_required'
      when domain_id <> '' then 'automated_evidence_research_required' else 'source_evidence_required' end as work_type
    from fm cross join qs left join d on d.canonical_id = fm.canonical_id and d.question_id = qs.question_id where d.canonical_id is null or d.n_answers = 0),
  it as (select *, case when critical then 'P1' when work_type in ('deterministic_mapping_review', 'institution_evidence_required', 'content_specific_assessment_required') then 'P2' else 'P3' end as p from g)"""


def _gaps(t):
    return evidence.gaps(_formats(t), _questions(t), _derived(t))


@query("a25_a26_gaps", f"with {_GAP} select question_id, gap, work_type, count(*) as n from g group by 1, 2, 3")
def gap_summary(t):
    return audit.count_by(_gaps(t), "question_id", "gap", "work_type")


_CLASSES = f"""{_GAP}, per as (select canonical_id, count(*) as n_gaps, count(*) filter (gap like 'claims%') as u, count(*) filter (gap like 'no_%') as z from g group by 1), nc as (select canonical_id, count(*) as n from cl group by 1),
  classes as (select fm.canonical_id, case when n_gaps is null then 'none' when u > 0 and z > 0 then 'mixed_mapping_and_evidence_gaps' when u > 0 then 'claims_exist_but_do_not_map' when n is null then 'no_evidence'
      when not exists (select 1 from d where d.canonical_id = fm.canonical_id) then 'claims_exist_but_not_for_framework' else 'missing_matching_evidence' end as gap_classification, coalesce(n_gaps, 0) as n_gaps, coalesce(n, 0) as n_claims
    from fm left join per using (canonical_id) left join nc using (canonical_id))"""


@query("a25_gap_classes", f"with {_CLASSES} select * from classes")
def gap_classes(t):
    return evidence.gap_classes(_formats(t), _gaps(t), _claims(t), _derived(t))


@query("a26_gap_class_counts", f"with {_CLASSES} select gap_classification, count(*) as n from classes group by 1")
def gap_class_counts(t):
    return audit.count_by(gap_classes(t), "gap_classification")


@query("o7_gap_order", f"with {_GAP} select canonical_id, count(*) as n_gaps from g group by 1 order by 2 desc, 1 limit 25")
def gap_order(t):
    return evidence.gap_order(_gaps(t)).limit(25)


@query("a27_items", f"""with {_GAP} select canonical_id, question_id, p as priority, case work_type when 'deterministic_mapping_review' then 'mapping_rule_needed' when 'institution_evidence_required' then 'institution_evidence_needed'
  when 'content_specific_assessment_required' then 'content_specific_assessment_needed' when 'automated_evidence_research_required' then 'automated_evidence_research' else 'source_evidence_needed' end as action_type from it""")
def remediation_items(t):
    return evidence.remediation_items(_gaps(t)).select("canonical_id", "question_id", "priority", "action_type")


@query("a27_remediation", f"with {_GAP} select canonical_id, count(*) filter (p = 'P1') as p1, count(*) filter (p = 'P2') as p2, count(*) filter (p = 'P3') as p3, count(*) as n_gaps, case when count(*) filter (p = 'P1') > 0 then 'P1' when count(*) filter (p = 'P2') > 0 then 'P2' else 'P3' end as priority from it group by 1")
def remediation(t):
    return evidence.remediation(_gaps(t))


@query("a30_conflict_combinations", f"with {_ANS}, c as (select canonical_id, question_id, string_agg(distinct answer_id, ' vs ' order by answer_id) as combination from got where answer_id is not null group by 1, 2 having count(distinct answer_id) > 1) select question_id, combination, count(*) as n_formats from c group by 1, 2")
def conflicts(t):
    labels = t.framework_answer.select(F.col("question_id").alias("field"), F.lower("label").alias("value"), "answer_id")
    return evidence.conflict_combinations(_claims(t).join(labels, ["field", "value"]).withColumnRenamed("field", "question_id"))


@query("a16_coverage", f"with {_ANS}, p as (select question_id as criterion_id, canonical_id, count(distinct institution_id) as s, count(*) as n from cl group by 1, 2) select criterion_id, count(*) as n_formats, count(*) filter (s >= 2) as n_corroborated, sum(n) as n_claims from p group by 1")
def coverage(t):
    return audit.criterion_coverage(_claims(t).withColumnRenamed("field", "criterion_id"))


@query("l10_claim_summary", f"with {_ANS} select canonical_id, count(*) as n_claims, count(distinct question_id) as n_questions, count(distinct institution_id) as n_sources from cl group by 1")
def claim_summary(t):
    return _claims(t).groupBy("canonical_id").agg(F.count("*").alias("n_claims"), F.count_distinct("field").alias("n_questions"), F.count_distinct("source_id").alias("n_sources"))


@query("r11_evidence_packs", f"with {_ANS}, x as (select canonical_id, response_id from cl union all select canonical_id, overlay_id from (select distinct overlay_id, canonical_id from institution_policy_overlay where canonical_id is not null)) select canonical_id, least(count(*), 120) as n_items, count(*) as n_total from x group by 1")
def packs(t):
    answers = _claims(t).select("canonical_id", F.lit("answer").alias("kind"), F.col("response_id").cast("string").alias("ref"), F.col("value").alias("text"))
    policies = t.institution_policy_overlay.where("canonical_id is not null").dropDuplicates(["overlay_id"]).select("canonical_id", F.lit("policy").alias("kind"), F.col("overlay_id").cast("string").alias("ref"), fold(F.col("local_risk_level")).alias("text"))
    return evidence.evidence_pack(answers, policies).select("canonical_id", F.col("n_items").cast("bigint").alias("n_items"), "n_total")


# --- audits -----------------------------------------------------------------------------------


@query("a18_counts", "select source_id, record_role, coalesce(category, 'none') as category, count(*) as n from (select distinct * from source_record) group by all")
def counts(t):
    return audit.count_by(t.source_record.dropDuplicates(["src_ord"]).withColumn("category", F.coalesce("category", F.lit("none"))), "source_id", "record_role", "category")


@query("a19_top_values", "select source_id, category, n, rank from (select source_id, category, count(*) as n, row_number() over (partition by source_id order by count(*) desc, category nulls first) as rank from (select distinct * from source_record) group by 1, 2) where rank <= 25")
def top_values(t):
    return audit.top_values(t.source_record.dropDuplicates(["src_ord"]), ["source_id"], "category", 25)


@query("a20_metrics", "select event_type, round(avg(value), 4) as avg_value, max(value) as max_value, min(value) as min_value, count(value) as n from events group by 1")
def metrics(t):
    return audit.profile_metrics(t.events, "event_type", "value")


@query("a32_level_counts", f"select l.label, coalesce(c.n, 0) as n from risk_level l left join (select {sql_fold('local_risk_level')} as f, count(*) as n from (select distinct * from institution_policy_overlay) group by 1) c on c.f = lower(l.label)")
def level_counts(t):
    rows = t.institution_policy_overlay.dropDuplicates(["overlay_id"]).select(fold(F.col("local_risk_level")).alias("f"))
    return audit.level_counts(t.risk_level.select(F.lower("label").alias("f")), rows, "f").join(t.risk_level.select(F.lower("label").alias("f"), "label"), "f").select("label", "n")


@query("a33_field_coverage", """with r as (select distinct * from source_record), n as (select source_id, count(*) as n, count(*) filter (trim(name) <> '') as a, count(*) filter (trim(category) <> '') as b, count(*) filter (trim(format_version) <> '') as c from r group by 1)
  select source_id, 'name' as field, a as n_filled, n, round(a * 100 / n, 2) as percent from n union all select source_id, 'category', b, n, round(b * 100 / n, 2) from n union all select source_id, 'format_version', c, n, round(c * 100 / n, 2) from n""")
def field_coverage(t):
    return audit.field_coverage(t.source_record.dropDuplicates(["src_ord"]), "source_id", ["name", "category", "format_version"])


@query("a37_migration_gate", "select bool_and(canonical_id is not null) as has_id, bool_and(preferred_name is not null) as has_name, bool_and(entry_id > 0) as positive_entry, bool_and(canonical_id is not null) and bool_and(preferred_name is not null) and bool_and(entry_id > 0) as passed from format_registry")
def migration_gate(t):
    return audit.migration_gate(t.format_registry, {"has_id": F.col("canonical_id").isNotNull(), "has_name": F.col("preferred_name").isNotNull(), "positive_entry": F.col("entry_id") > 0})


@query("a38_fingerprint")
def fingerprint(t):
    return audit.fingerprint(t.format_identifier, ["canonical_id", "identifier_type", "identifier_value"])


@query("w7_affected_share", "select identifier_type, count(distinct canonical_id) as n, round(count(distinct canonical_id) / (select count(distinct canonical_id) from format_identifier), 4) as share from format_identifier group by 1")
def affected(t):
    size = t.format_identifier.select("canonical_id").distinct().count()
    return audit.affected_share(t.format_identifier, "canonical_id", "identifier_type", size)


@query("a40_catalogue", "select question_id, question_label, count(*) as n_answers, max(points) as max_points from framework_answer group by 1, 2")
def catalogue(t):
    return t.framework_answer.groupBy("question_id", "question_label").agg(F.count("*").alias("n_answers"), F.max("points").alias("max_points"))


# --- policies -----------------------------------------------------------------------------------


PROFILES = [
    {"id": "base"}, {"id": "logs", "inherits": "base", "terms": ["exit 2", "warnings"]}, {"id": "costs", "inherits": "base", "terms": ["items cost"]}, {"id": "plain", "fallback": True, "terms": [" "]},
]


@query("r5_profiles", """select doc_id, case when l and c then 'base,logs,costs' when l then 'base,logs' when c then 'base,costs' when contains(lower(text), ' ') then 'plain' else '' end as profiles
  from (select doc_id, text, contains(lower(text), 'exit 2') or contains(lower(text), 'warnings') as l, contains(lower(text), 'items cost') as c from documents)""")
def profiles(t):
    return policy.assign_profiles(t.documents.select("doc_id", "text"), PROFILES, "text").select("doc_id", F.array_join("profiles", ",").alias("profiles"))


_POL = f"""base as (select distinct canonical_id, institution_id, overlay_id, recorded_at, coalesce(source_row, 0) as specificity, case when local_preservation_plan is null then 'supplement' else 'replace' end as mode, {sql_fold('local_preservation_action')} as action
    from institution_policy_overlay where canonical_id is not null),
  pol as (select *, lag(overlay_id) over (partition by canonical_id, institution_id order by recorded_at, overlay_id) as gone from base),
  chosen as (select canonical_id, arg_max(overlay_id, (specificity, overlay_id)) as chosen from pol where mode = 'replace' group by 1),
  sup as (select distinct canonical_id, gone as overlay_id from pol where gone is not null),
  outcome as (select p.*, case when s.overlay_id is not null then 'explicitly_suppressed' when mode = 'replace' and p.overlay_id <> chosen then 'less_specific' else 'applied' end as outcome
    from pol p left join chosen using (canonical_id) left join sup s on s.canonical_id = p.canonical_id and s.overlay_id = p.overlay_id)"""
#: Actions that exclude each other.
_EXCLUDE = [("return to depositor", "keep as received"), ("normalise on ingest", "store bit-level only")]


def _policies(t):
    """Each recorded row as a policy: its row number how specific it is, a later one of its institution suppresses it."""
    before = F.lag("overlay_id").over(Window.partitionBy("canonical_id", "institution_id").orderBy("recorded_at", "overlay_id"))
    rows = t.institution_policy_overlay.where("canonical_id is not null").select("canonical_id", "institution_id", "overlay_id", "recorded_at", "source_row", "local_preservation_plan", fold(F.col("local_preservation_action")).alias("action")).distinct()
    return rows.withColumn("before", before).select(
        "canonical_id", F.col("overlay_id").alias("policy_id"), F.coalesce("source_row", F.lit(0)).alias("specificity"), F.when(F.col("local_preservation_plan").isNull(), "supplement").otherwise("replace").alias("mode"),
        F.array("action").alias("actions"), F.array_compact(F.array("before")).alias("suppresses"),
    )


@query("r6_policy_outcomes", f"with {_POL} select canonical_id, overlay_id as policy_id, outcome from outcome")
def policy_outcomes(t):
    return policy.policy_outcomes(_policies(t)).select("canonical_id", "policy_id", "outcome")


@query("r6_actions", f"""with {_POL}, applied as (select distinct canonical_id, action from outcome where outcome = 'applied' and action <> ''),
  e1 as (select distinct canonical_id from (select canonical_id from pol where mode = 'replace' group by canonical_id, specificity having count(*) > 1)),
  e2 as (select distinct a.canonical_id from applied a join applied b using (canonical_id) where (a.action, b.action) in (('return to depositor', 'keep as received'), ('normalise on ingest', 'store bit-level only'))),
  err as (select c.canonical_id, concat_ws(',', case when e1.canonical_id is not null then 'same_specificity_replace_conflict' end, case when e2.canonical_id is not null then 'conflicting_actions' end) as errors
    from (select distinct canonical_id from pol) c left join e1 using (canonical_id) left join e2 using (canonical_id))
  select distinct err.canonical_id, case when errors = '' then a.action end as action, errors from err left join applied a using (canonical_id)""")
def actions(t):
    return policy.action_policies(_policies(t), t.spark.createDataFrame(_EXCLUDE, "action_a string, action_b string"))


_LOCAL = f"""x as (select distinct overlay_id, case {sql_fold('local_risk_level')} when 'low risk' then 'Low' when 'medium risk' then 'Moderate' when 'high risk' then 'High' when 'severe risk' then 'High' when '' then null when 'not assessed' then 'Not Assessed' else 'Unknown' end as band,
    case when local_preferred_tools is not null and local_preservation_plan is not null then 'Covered' when local_preferred_tools is not null or local_preservation_plan is not null then 'Partially Covered' when {sql_fold('local_preservation_action')} <> '' then 'Uncovered' end as readiness,
    case when source_row is null then 'Unknown' when source_row < 50 then 'Low' when source_row < 200 then 'Moderate' else 'High' end as exposure, {sql_fold('local_preservation_action')} = '' as undecided from institution_policy_overlay),
  y as (select *, case when band is null or band in ('Unknown', 'Not Assessed') then 'Needs Assessment' when band = 'High' then 'High' when readiness is null then 'Needs Assessment' when readiness = 'Uncovered' then case band when 'Moderate' then 'High' else 'Moderate' end else band end as posture from x)"""


def _local(t):
    level, tools, plan = fold(F.col("local_risk_level")), F.col("local_preferred_tools").isNotNull(), F.col("local_preservation_plan").isNotNull()
    band = F.when(level == "low risk", "Low").when(level == "medium risk", "Moderate").when(level.isin("high risk", "severe risk"), "High").when(level == "not assessed", "Not Assessed").when(level != "", "Unknown")
    ready = F.when(tools & plan, "Covered").when(tools | plan, "Partially Covered").when(fold(F.col("local_preservation_action")) != "", "Uncovered")
    row = F.col("source_row")
    exposure = F.when(row.isNull(), "Unknown").when(row < 50, "Low").when(row < 200, "Moderate").otherwise("High")
    return t.institution_policy_overlay.select("overlay_id", band.alias("band"), ready.alias("readiness"), exposure.alias("exposure"), (fold(F.col("local_preservation_action")) == "").alias("undecided")).distinct()


@query("r7_posture", f"with {_LOCAL} select overlay_id, posture, coalesce(band = 'High', false) and (exposure = 'High')::int + coalesce(readiness = 'Uncovered', false)::int + undecided::int >= 2 as alert from y")
def postures(t):
    alert = policy.critical_alert(F.col("band"), F.col("exposure") == "High", F.col("readiness") == "Uncovered", F.col("undecided"))
    return _local(t).select("overlay_id", policy.posture(F.col("band"), F.col("readiness")).alias("posture"), alert.alias("alert"))


@query("o11_triage", f"with {_LOCAL} select overlay_id, case posture when 'Low' then 0 when 'Moderate' then 1 else 2 end as posture_rank, case exposure when 'Low' then 0 when 'High' then 2 else 1 end as exposure_rank from y")
def triage(t):
    rows = _local(t).select("overlay_id", policy.triage_rank(policy.posture(F.col("band"), F.col("readiness")), F.col("exposure")).alias("r"))
    return rows.select("overlay_id", "r.posture_rank", "r.exposure_rank")


@query("v9_currency", """with o as (select distinct overlay_id, institution_id, institution_format_id, recorded_at, local_risk_level as e, local_preservation_action as a, local_preservation_plan as p from institution_policy_overlay),
  w as (select *, lag(overlay_id) over k as was, lag(e) over k as pe, lag(a) over k as pa, lag(p) over k as pp from o window k as (partition by institution_id, institution_format_id order by recorded_at, overlay_id)),
  r as (select overlay_id, list_filter([case when e is distinct from pe then 'evidence' end, case when a is distinct from pa then 'analysis' end, case when p is distinct from pp then 'policy' end], lambda x: x is not null) as reasons from w where was is not null)
  select overlay_id, case when len(reasons) = 0 then 'current' else 'stale' end as recommendation_status, array_to_string(reasons, ',') as stale_reason,
    case when len(reasons) = 0 then 'none' when len(reasons) > 1 then 'full_refresh' when reasons[1] = 'evidence' then 'rebuild_evidence_pack_and_rerun_analysis' when reasons[1] = 'analysis' then 'rerun_analysis_and_action_resolution' else 'rerun_action_resolution_only' end as minimum_refresh from r""")
def currency(t):
    """Each recorded row against the one before it of its institution and format."""
    parts = {"evidence": "local_risk_level", "analysis": "local_preservation_action", "policy": "local_preservation_plan"}
    rows = t.institution_policy_overlay.select("overlay_id", "institution_id", "institution_format_id", "recorded_at", *parts.values()).distinct()
    w = Window.partitionBy("institution_id", "institution_format_id").orderBy("recorded_at", "overlay_id")
    rows = rows.withColumn("was", F.lag(F.struct("overlay_id", *parts.values())).over(w)).where("was is not null")
    c = policy.currency({k: F.col(f"was.{c}") for k, c in parts.items()}, {k: F.col(c) for k, c in parts.items()})
    return rows.select("overlay_id", c.alias("c")).select("overlay_id", "c.recommendation_status", F.array_join("c.stale_reason", ",").alias("stale_reason"), "c.minimum_refresh")
