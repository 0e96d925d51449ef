"""Queries of mapping scopes, questions, carried risk, identification and watchlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.functions.text import fold
from archivum.operators import evidence, mapping, risk, search
from archivum.queries.analysis import _CLASSES, _LEVEL, _SYN, _assessments, _claims, _derived, _formats, _gaps
from archivum.queries.base import fold as sql_fold, query, words
from archivum.queries.relations import _IDS, _NAMES, _ids, _names

_MAPPINGS = [("m1", None, None, False), ("m2", None, "registry_json", True), ("m3", "src-none", None, False)]


@query(
    "f8_source_scope",
    """with r as (select distinct src_ord, source_id, source_type, case when canonical_id is null then 'related' end as relationship, case when len(extensions) > 0 then 'exact_puid_cross_reference' else 'family' end as evidence_scope from source_record),
    m as (select * from (values ('m1', null, null, false), ('m2', null, 'registry_json', true), ('m3', 'src-none', null, false)) as v(mapping_id, want_id, want_type, allow_related))
    select mapping_id, src_ord from r join m on (want_id is null or want_id = source_id) and (want_type is null or want_type = source_type) and (relationship is null or evidence_scope = 'exact_puid_cross_reference' or allow_related)""",
)
def source_scope(t):
    refs = t.source_record.select("src_ord", "source_id", "source_type", F.when(F.col("canonical_id").isNull(), "related").alias("relationship"), F.when(F.size(F.coalesce("extensions", F.array().cast("array<string>"))) > 0, mapping.EXACT_SCOPE).otherwise("family").alias("evidence_scope")).distinct()
    rules = t.spark.createDataFrame(_MAPPINGS, "mapping_id string, want_source_id string, want_source_type string, allow_related boolean")
    return mapping.source_in_scope(refs, rules).select("mapping_id", "src_ord")


@query(
    "f12_selected_questions",
    """with q as (select distinct question_id, question_label, case when question_id in ('q_staff', 'q_size') then 'Local feasibility' else 'technical' end as domain, case when question_id = 'q_size' then 'image' when question_id = 'q_staff' then 'all' end as kind from framework_answer)
    select question_id, question_label from q where domain = 'Local feasibility' and (kind is null or kind in ('all', 'moving_image'))""",
)
def selected_questions(t):
    local = F.col("question_id").isin("q_staff", "q_size")
    q = t.framework_answer.select("question_id", "question_label").distinct().select(
        "question_id", "question_label", F.when(local, "local_feasibility").otherwise("technical").alias("domain_id"), F.lit(None).cast("string").alias("domain_label"), F.array().cast("array<string>").alias("aliases"),
        F.when(F.col("question_id") == "q_size", F.array(F.lit("image"))).when(F.col("question_id") == "q_staff", F.array(F.lit("All"))).alias("applicability"),
    )
    return mapping.select_questions(q, ["Local Feasibility"], content_type="moving image").select("question_id", "question_label")


# --- risk of one record carried to many formats ---------------------------------------------

_CARRY = f"""ru as (select category, row_number() over (order by category) as n from (select distinct {sql_fold('category')} as category from format_registry) where category <> ''),
  rules as (select 'r-' || category as rule_id, category, case when n % 5 = 0 then 'draft' when n % 7 = 0 then 'contextual_only' else 'approved' end as status from ru),
  recs as (select distinct 'r-' || {sql_fold('fmt.category')} as rule_id, evidence_id as record_id, case when fmt.puids is null or len(fmt.puids) = 0 then null when len(fmt.puids) = 1 then 'low' else 'high' end as level from institution_format_evidence where fmt.name is not null and institution_id < 'inst-f'),
  tg as (select distinct 'r-' || {sql_fold('category')} as rule_id, canonical_id from format_registry where canonical_id is not null and {sql_fold('category')} <> ''),
  rn as (select rule_id, count(distinct record_id) as n_records, max(record_id) as record_id, count(distinct level) as n_levels from recs group by 1), tn as (select rule_id, count(distinct canonical_id) as n_targets from tg group by 1),
  rep as (select r.rule_id, status, coalesce(n_records, 0) as n_records, coalesce(n_targets, 0) as n_targets, rn.record_id, case when status = 'contextual_only' then status when status <> 'approved' then 'not_approved' when coalesce(n_records, 0) <> 1 then 'source_record_match_count'
      when coalesce(n_targets, 0) = 0 then 'no_target_formats' when coalesce(n_levels, 0) = 0 then 'no_source_risk_assessment' else 'applied' end as outcome from rules r left join rn using (rule_id) left join tn using (rule_id))"""


def _carried(t):
    from pyspark.sql import Window

    cat = lambda c: F.concat(F.lit("r-"), fold(c))
    listed = t.format_registry.select(fold(F.col("category")).alias("category")).distinct().where("category != ''")
    # Categories are a short list; their place in it says which rules are drafts.
    n = F.row_number().over(Window.orderBy("category"))
    rules = listed.withColumn("n", n).select(F.concat(F.lit("r-"), "category").alias("rule_id"), F.when(F.col("n") % 5 == 0, "draft").when(F.col("n") % 7 == 0, "contextual_only").otherwise("approved").alias("status"), F.lit("format_group").alias("scope_type"), F.col("category").alias("scope_name"))
    puids = F.size(F.coalesce("fmt.puids", F.array().cast("array<string>")))
    e = t.institution_format_evidence.where("fmt.name is not null and institution_id < 'inst-f'")
    records = e.select(cat(F.col("fmt.category")).alias("rule_id"), F.col("evidence_id").alias("record_id"), F.when(puids == 1, "low").when(puids > 1, "high").alias("level")).distinct()
    targets = t.format_registry.where("canonical_id is not null").select(cat(F.col("category")).alias("rule_id"), "canonical_id").where("rule_id != 'r-'").distinct()
    return mapping.carry_risk(rules, records, targets)


@query("r4_risk_rule_outcomes", f"with {_CARRY} select rule_id, status, n_records, n_targets, outcome from rep")
def risk_rule_outcomes(t):
    return _carried(t)[1].select("rule_id", "status", "n_records", "n_targets", "outcome")


@query("r4_carried_risk", f"with {_CARRY} select tg.canonical_id, rep.rule_id, recs.level from rep join recs on recs.rule_id = rep.rule_id and recs.record_id = rep.record_id and recs.level is not null join tg on tg.rule_id = rep.rule_id where outcome = 'applied'")
def carried_risk(t):
    return _carried(t)[0].select("canonical_id", "rule_id", "level")


_RISK = f"rk as (select distinct overlay_id, canonical_id, institution_id as source_id, institution_format_id as record_id, nullif({sql_fold('local_risk_level')}, '') as level, run_id in (select run_id from registry_run where status = 'completed') as governed from institution_policy_overlay)"


@query("j21_undoubled_risk", f"with {_RISK} select overlay_id from rk a where not governed and not exists (select 1 from rk b where b.governed and b.source_id = a.source_id and b.record_id = a.record_id and b.level = a.level)")
def undoubled_risk(t):
    rows = t.institution_policy_overlay.select("overlay_id", "run_id", F.col("institution_id").alias("source_id"), F.col("institution_format_id").alias("record_id"), F.nullif(fold(F.col("local_risk_level")), F.lit("")).alias("level")).distinct()
    done = t.registry_run.where("status = 'completed'").select("run_id").distinct()
    return mapping.undoubled(rows.join(done, "run_id", "left_anti"), rows.join(done, "run_id", "left_semi")).select("overlay_id")


@query("a24_o13_risk_context", f"""with {_SYN}, few as (select canonical_id, source_id, case scope when 0 then 'exact_format' else 'format_group' end as scope_type, scope, {_LEVEL.format('rank')} as level, count(*) as n from r group by all)
  select canonical_id, source_id, scope_type, level, n, row_number() over (partition by canonical_id order by scope, coalesce(source_id, ''), coalesce(level, '')) as place from few""")
def context(t):
    return mapping.risk_context(_assessments(t), F.when(F.col("scope_type") == "exact_format", 0).otherwise(1)).select("canonical_id", "source_id", "scope_type", "level", "n", "place")


# --- identification -------------------------------------------------------------------------

_KEYS = f"""{_IDS}, {_NAMES}, keys as (select canonical_id, {words('preferred_name')} as key, 85 as p from names union select canonical_id, lower(canonical_id), 100 from names
    union select canonical_id, value, case when kind = 'puid' then 95 when kind in ('loc', 'nara') then 90 when kind = 'mime' then 80 when kind = 'extension' then 70 end as p from ids where kind in ('puid', 'loc', 'nara', 'mime', 'extension')
    union select canonical_id, kind || '-' || replace(value, '/', '-'), 50 from ids where kind in ('puid', 'loc', 'nara')),
  raw as (select fmt.name as term from institution_format_evidence union select unnest(fmt.puids) from institution_format_evidence union select unnest(fmt.mime_types) from institution_format_evidence union select unnest(fmt.extensions) from institution_format_evidence),
  terms as (select distinct term from raw where term is not null and trim(term) <> '')"""


def _spelled(terms: str) -> str:
    low = "lower(trim(term))"
    part = lambda n: f"regexp_extract({low}, '^(?:puid-)?([a-z-]*?)[/-](\\d+)$', {n})"
    return f"(select term, {low} as key from {terms} union select term, {words('term')} from {terms} union select term, {part(1)} || '/' || {part(2)} from {terms} where {part(2)} <> '' union select term, 'puid-' || {part(1)} || '-' || {part(2)} from {terms} where {part(2)} <> '')"


def _best(terms: str) -> str:
    return f"""(select term, p, canonical_id, count(*) over (partition by term) as n, row_number() over (partition by term order by canonical_id) as rank
    from (select distinct term, canonical_id, p, max(p) over (partition by term) as top from {_spelled(terms)} s join keys using (key) where key <> '') where p = top)"""


def _lookup(t):
    return search.lookup_keys(_names(t), _ids(t).withColumn("verified", F.col("kind") == "puid"))


def _terms(t):
    e = t.institution_format_evidence
    parts = [e.select(F.col("fmt.name").alias("term")), *[e.select(F.explode(f"fmt.{c}").alias("term")) for c in ("puids", "mime_types", "extensions")]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("term is not null and trim(term) != ''").distinct()


@query("r12_resolved_terms", f"with {_KEYS} select term, p as priority, canonical_id, n as n_matches from {_best('terms')} where rank <= 10")
def resolved_terms(t):
    """Names, PUIDs, MIME types and extensions as institutions write them, through all tiers."""
    return search.resolve(_terms(t), _lookup(t)).select("term", "priority", "canonical_id", "n_matches")


@query(
    "r13_identified_terms",
    f"""with {_KEYS}, wrapped as (select '[' || term || '];' as term from terms union select term from terms), one as (select * from {_best('wrapped')} where rank = 1),
    bare as (select distinct term as was, trim(regexp_replace(term, '^(?:[\\[\\](){{}}<>,;"'']|\\s)+|(?:[\\[\\](){{}}<>,;"'']|\\s)+$', '', 'g')) as term from wrapped where term not in (select term from one where n = 1)), two as (select * from {_best('bare')} where rank = 1)
    select term, canonical_id, 'deterministic_exact' as method from one where n = 1
    union all select was, case when n = 1 and bare.term <> trim(was) then canonical_id end, case when n = 1 and bare.term <> trim(was) then 'deterministic_normalization' else 'deterministic_best_effort' end from bare left join two on two.term = bare.term""",
)
def identified(t):
    terms = _terms(t)
    wrapped = terms.unionByName(terms.select(F.concat(F.lit("["), "term", F.lit("];")).alias("term")))
    return mapping.identify(wrapped, _lookup(t)).select("term", "canonical_id", "method")


@query(
    "l2_watchlist",
    f"""with {_KEYS}, wl as (select distinct lower(trim(p)) as term from institution_format_evidence, unnest(fmt.puids) as u(p) where trim(p) <> ''), one as (select * from {_best('wl')} where rank = 1),
    {_SYN}, lv as (select canonical_id, {_LEVEL.format('hi')} as level from s), {_CLASSES}
    select wl.term as format_id, case when n = 1 then one.canonical_id end as canonical_id, case when n = 1 then 'ok' when n > 1 then 'ambiguous' else 'not_found' end as status, case when n = 1 then coalesce(level, 'unassessed') end as level, case when n = 1 then gap_classification end as gap_classification
    from wl left join one using (term) left join lv on lv.canonical_id = one.canonical_id left join classes on classes.canonical_id = one.canonical_id""",
)
def watchlist(t):
    ids = t.institution_format_evidence.select(F.explode("fmt.puids").alias("format_id")).where("trim(format_id) != ''").distinct()
    classes = evidence.gap_classes(_formats(t), _gaps(t), _claims(t), _derived(t))
    return mapping.assess_watchlist(ids, _lookup(t), risk.synthesize(_assessments(t)), classes)
