"""Queries of scalar normalisation, filters and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivum.functions import documents, normalize as N
from archivum.functions.text import fold
from archivum.operators import evidence, rules
from archivum.queries.base import fold as sql_fold, query, slug, strip, words
from archivum.session import collect_bounded

_EXT = f"regexp_replace(regexp_replace({strip('lower(identifier_value)')}, '^\\.+', ''), '\\s+', '', 'g')"
_TOKENS = r"list_sort(list_distinct(list_transform(regexp_extract_all(preferred_name, '(?i)\b(\d+\.\d+(?:\.\d+)?|\d{2,4}[a-z]|(?:pdf|iso)?/?[a-z]-\d+[a-z]?|\d{2,4}-\d{2,4})\b', 1), lambda x: lower(x))))"


@query(
    "fn_identifiers",
    f"""select identifier_type, case when identifier_type = 'extension' then {_EXT} when identifier_type in ('mime', 'loc') then {strip('lower(identifier_value)')}
      when identifier_type = 'wikidata' then {strip('upper(identifier_value)')} else {strip('identifier_value')} end as value, count(*) as n
    from format_identifier group by all""",
)
def identifiers(t):
    return t.format_identifier.select("identifier_type", N.identifier(F.col("identifier_type"), F.col("identifier_value")).alias("value")).groupBy("identifier_type", "value").agg(F.count("*").alias("n"))


@query("fn_canonical_ids", f"select distinct entry_id, 'fmt-' || {slug('preferred_name')} as canonical_id, {slug('category')} as category_slug from format_registry")
def canonical_ids(t):
    return t.format_registry.select("entry_id", N.canonical_id(F.lit("name"), F.lit(""), F.col("preferred_name")).alias("canonical_id"), N.slug(F.col("category")).alias("category_slug")).distinct()


@query("fn_version_tokens", f"select distinct entry_id, coalesce(array_to_string({_TOKENS}, ' '), '') as tokens, coalesce(regexp_matches(lower(preferred_name), 'family|generic|unspecified|all versions|multiple versions'), false) as broad from format_registry")
def version_tokens(t):
    return t.format_registry.select("entry_id", F.array_join(N.version_tokens(F.col("preferred_name")), " ").alias("tokens"), N.is_broad(F.col("preferred_name")).alias("broad")).distinct()


@query(
    "fn_puid_variants",
    r"""with v as (select distinct lower(trim(identifier_value)) as low from format_identifier where identifier_type = 'puid'),
    s as (select low, regexp_extract(low, '^(?:puid-)?([a-z-]*?)[/-](\d+)$', 1) as space, regexp_extract(low, '^(?:puid-)?([a-z-]*?)[/-](\d+)$', 2) as num from v)
    select low as value, case when num = '' then low when space || '/' || num = low then low || ',puid-' || space || '-' || num
      when 'puid-' || space || '-' || num = low then low || ',' || space || '/' || num else low || ',' || space || '/' || num || ',puid-' || space || '-' || num end as variants from s where low is not null""",
)
def puid_variants(t):
    low = F.lower(F.trim("identifier_value"))
    return t.format_identifier.where("identifier_type = 'puid' and identifier_value is not null").select(low.alias("value"), F.array_join(N.puid_variants(F.col("identifier_value")), ",").alias("variants")).distinct()


@query(
    "fn_match_texts",
    rf"""select question_id, trim(regexp_replace(translate(lower(coalesce(answer_text, '')), '_-', '  '), '\s+', ' ', 'g')) as for_rules, {words('answer_text')} as for_search, count(*) as n from question_response group by all""",
)
def match_texts(t):
    return t.question_response.select("question_id", N.match_text(F.col("answer_text")).alias("for_rules"), N.match_words(F.col("answer_text")).alias("for_search")).groupBy("question_id", "for_rules", "for_search").agg(F.count("*").alias("n"))


@query(
    "fn_levels",
    """with x as (select lower(local_risk_level) as l, trim(regexp_replace(regexp_replace(replace(lower(coalesce(local_risk_level, '')), '_', ' '), ' risk$', ''), '\\s+concern$', '')) as s from institution_policy_overlay)
    select case when l like '%high%' then 'High' when l like '%moderate%' or l like '%medium%' then 'Moderate' when l like '%low%' then 'Low' end as band,
      case when s in ('minimal', 'lower risk') then 'minimal' when s = 'medium' then 'moderate' when s in ('minimal', 'low', 'moderate', 'high', 'critical') then s end as level, count(*) as n from x group by all""",
)
def levels(t):
    plain = F.regexp_replace(F.replace(F.lower("local_risk_level"), F.lit("_"), F.lit(" ")), " risk$", "")
    return t.institution_policy_overlay.select(N.three_band(F.col("local_risk_level")).alias("band"), N.semantic_level(plain).alias("level")).groupBy("band", "level").agg(F.count("*").alias("n"))


@query("fn_dates", "select doc_id, cast(acquired_at as date) as day, greatest(0, date_diff('day', cast(acquired_at as date), date '2024-01-01')) as age_days from documents")
def dates(t):
    spelled = F.concat(F.lit(""), F.element_at(F.array(*[F.date_format("acquired_at", f) for f in ("yyyy-MM-dd HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "yyyy/MM/dd", "EEE, d MMM yyyy HH:mm:ss +0000")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int")))
    day = F.to_date(N.parse_date(spelled))
    return t.documents.select("doc_id", day.alias("day"), N.days_since(day, F.lit("2024-01-01").cast("date")).cast("bigint").alias("age_days"))


@query(
    "fn_native_ratings",
    """with r as (select event_id, value - 50 as rating from events)
    select event_id, case when rating >= 23 then 'Low' when rating <= -23 then 'High' when rating is not null then 'Moderate' end as band,
      round(case when rating is not null then greatest(0.0, 23 - rating) end, 2) as gap_to_low, round(case when rating is not null then greatest(0.0, rating + 23) end, 2) as gap_to_high from r""",
)
def native_ratings(t):
    r = F.col("value") - 50
    return t.events.select("event_id", N.native_band(r).alias("band"), F.round(N.native_gap(r, F.lit("Low")), 2).alias("gap_to_low"), F.round(N.native_gap(r, F.lit("High")), 2).alias("gap_to_high"))


@query("fn_paths", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, 'deep' as nested from events")
def paths(t):
    deep = F.parse_json(F.lit('{"a.b": {"c": "deep"}, "a": {"b": {"c": "shadowed"}}}'))
    return t.events.select("event_id", N.path_get(F.try_parse_json("props"), "k", "bigint").alias("k"), N.path_get(deep, "a.b.c").alias("nested"))


@query("fn_field_paths", "select key as path, count(*) as n, count(distinct file_id) as n_files from (select distinct * from policy_file_row), json_each(payload) group by key")
def field_paths(t):
    keys = F.explode(F.map_keys(F.from_json("payload", "map<string,variant>")))
    return t.policy_file_row.distinct().select("file_id", keys.alias("path")).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


@query(
    "fn_nested_paths",
    """with d as (select distinct file_id, row_no, payload from policy_file_row where payload is not null), k as (select distinct file_id, row_no, payload, key from d, json_each(payload)),
    p as (select 'file' as path from d union all select 'file.id' from d union all select 'file.row' from d union all select 'file.row.' || key from k)
    select path, count(*) as n from p group by 1""",
)
def nested_paths(t):
    doc = F.concat(F.lit('{"file": {"id": "'), "file_id", F.lit('", "row": '), "payload", F.lit("}}"))
    return t.policy_file_row.distinct().select(F.explode(documents.field_paths(doc)).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query("fn_stable_hashes", "select run_id, sha256(coalesce(run_id, '') || '|' || coalesce(institution_id, '') || '|' || coalesce(as_of_day, '') || '|' || coalesce(cast(finished_at as varchar), '')) as stable_id from registry_run")
def stable_hashes(t):
    return t.registry_run.select("run_id", N.stable_hash(F.col("run_id"), F.col("institution_id"), F.col("as_of_day"), F.col("finished_at")).alias("stable_id"))


@query(
    "fn_multi_values",
    r"""with v as (select distinct file_id, row_no, json_extract_string(payload, '$."File Suffixes"') as s from policy_file_row)
    select file_id, row_no, array_to_string(list_filter(list_transform(regexp_split_to_array(s, '[;,|\n]+'), lambda x: trim(x)), lambda x: x <> ''), ' ') as suffixes from v where s is not null""",
)
def multi_values(t):
    s = F.get_json_object("payload", "$['File Suffixes']")
    return t.policy_file_row.distinct().where(s.isNotNull()).select("file_id", "row_no", F.array_join(N.split_multi(s), " ").alias("suffixes"))


@query("fn_first_of", f"select distinct overlay_id, coalesce(nullif({strip('local_preferred_tools')}, ''), nullif({strip('local_preservation_plan')}, ''), nullif({strip('local_preservation_action')}, ''), 'none given') as advice from institution_policy_overlay")
def first_of(t):
    return t.institution_policy_overlay.select("overlay_id", F.coalesce(N.first_of(F.col("local_preferred_tools"), F.col("local_preservation_plan"), F.col("local_preservation_action")), F.lit("none given")).alias("advice")).distinct()


@query("fn_folded_names", f"select {sql_fold('preferred_name')} as name, count(*) as n, count(distinct canonical_id) as n_formats from format_registry group by 1")
def folded_names(t):
    return t.format_registry.select(fold(F.col("preferred_name")).alias("name"), "canonical_id").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("canonical_id").alias("n_formats"))


# --- filters --------------------------------------------------------------------


@query("f1_f3_usable_claims", "select distinct response_id, canonical_id, question_id from question_response where canonical_id is not null and answered_at >= timestamp '2021-01-01' and (answer_text is null or lower(trim(answer_text)) not in ('draft', 'rejected', 'withdrawn', 'superseded'))")
def usable_claims(t):
    rows = t.question_response.withColumn("current", F.when(F.col("answered_at") < F.lit("2021-01-01").cast("timestamp_ntz"), F.lit(False))).where(F.col("answered_at").isNotNull())
    return rows.where(evidence.is_current() & evidence.is_usable("answer_text") & F.col("canonical_id").isNotNull()).select("response_id", "canonical_id", "question_id").distinct()


@query("f2_claims_in_scope", "select distinct response_id, question_id from question_response where nullif(trim(institution_id), '') is null or institution_id = (select min(institution_id) from registry_run)")
def claims_in_scope(t):
    first = t.registry_run.agg(F.min("institution_id")).first()[0]
    return t.question_response.where(evidence.in_scope(first)).select("response_id", "question_id").distinct()


_HAY = r"trim(regexp_replace(translate(lower(coalesce(text, '')), '_-', '  '), '\s+', ' ', 'g'))"


@query("f6_text_rules", f"select doc_id from (select doc_id, {_HAY} as h from documents) where contains(h, 'migration of') and (contains(h, 'quarantine') or contains(h, 'emulating')) and not contains(h, 'big endian')")
def text_rules(t):
    return t.documents.where(N.text_rule(F.col("text"), contains_all=["Migration of"], contains_any=["quarantine", "emulating"], not_contains_any=["big-endian"])).select("doc_id")


@query("f7_guard_words", f"select doc_id from (select doc_id, ' ' || {_HAY} || ' ' as h from documents) where regexp_matches(h, '[^a-z0-9](?:exit 2|clear text)[^a-z0-9]')")
def guard_words(t):
    return t.documents.where(N.has_word(F.col("text"), "exit 2", "clear text")).select("doc_id")


@query(
    "f9_target_selector",
    "select distinct entry_id from format_registry where regexp_matches(preferred_name, '(?i)^[a-m].*(map|sheet)') and regexp_matches(coalesce(category, ''), '(?i)dataset|sheet') and list_has_any(coalesce(identifiers['extension'], []), ['xml', 'txt', 'dat', 'img', 'bin', 'fdr'])",
)
def target_selector(t):
    hit = F.col("preferred_name").rlike("(?i)^[a-m].*(map|sheet)") & F.coalesce(F.col("category"), F.lit("")).rlike("(?i)dataset|sheet") & F.arrays_overlap(F.coalesce(F.col("identifiers")["extension"], F.array().cast("array<string>")), F.array(*[F.lit(x) for x in ("xml", "txt", "dat", "img", "bin", "fdr")]))
    return t.format_registry.where(hit).select("entry_id").distinct()


@query("f13_f15_changed_since", "select institution_id, count(distinct overlay_id) as n from institution_policy_overlay where recorded_at > timestamp '2023-01-01' and local_risk_level in ('High Risk', 'Severe Risk') group by 1")
def changed_since(t):
    return t.institution_policy_overlay.where((F.col("recorded_at") > F.lit("2023-01-01").cast("timestamp_ntz")) & F.col("local_risk_level").isin("High Risk", "Severe Risk")).groupBy("institution_id").agg(F.count_distinct("overlay_id").alias("n"))


# --- rules ------------------------------------------------------------------------

CRITERIA = {
    "structure.layout": {"kind": "nominal", "values": ["word_based", "wrapped", "keyed", "vendor_bundled"], "null_value": "unknown"},
    "structure.detail": {"kind": "ordinal", "values": ["cut", "short", "full"], "null_value": None},
    "source.currency": {"kind": "temporal"},
}
MAPPING = {
    "source_id": "registry", "mapping_version": "v1", "criteria_version": "v1", "claim_review_status": "approved",
    "rules": [
        {"id": "layout", "criterion": "structure.layout", "from_field": "description", "text_rules": [
            {"value": "word_based", "contains_any": ["-bit words"]}, {"value": "wrapped", "contains_all": ["wraps one", "per file"]}, {"value": "keyed", "contains_any": ["keeps a"]}, {"value": "vendor_bundled", "contains_any": ["shipped with"], "not_contains_any": ["legacy"]}]},
        {"id": "detail", "criterion": "structure.detail", "from_field": "detail", "values": {"…": "cut", "SHORT": "short", "full": "full"}},
        {"id": "age", "criterion": "source.currency", "from_field": "updated", "transform": "days_since_date", "directness": "derived"},
        {"id": "draft", "criterion": "structure.layout", "from_field": "description", "when_present": "unknown", "mapping_status": "draft"},
    ],
}


@query(
    "r1_criterion_claims",
    r"""with e as (select distinct entry_id, trim(regexp_replace(translate(lower(coalesce(description, '')), '_-', '  '), '\s+', ' ', 'g')) as h, description, updated_at from format_registry),
    d as (select *, case when right(description, 1) = '…' then '…' when length(description) < 60 then 'short' else 'full' end as detail from e)
    select entry_id, 'structure.layout' as criterion_id, case when contains(h, 'bit words') then 'word_based' when contains(h, 'wraps one') and contains(h, 'per file') then 'wrapped' when contains(h, 'keeps a') then 'keyed'
      when contains(h, 'shipped with') and not contains(h, 'legacy') then 'vendor_bundled' end as value, 'layout' as rule_id, 'explicit' as directness from d where description <> '' and value is not null
    union all select entry_id, 'structure.detail', case detail when '…' then 'cut' else detail end, 'detail', 'explicit' from d where description is not null
    union all select entry_id, 'source.currency', cast(greatest(0, date_diff('day', cast(updated_at as date), date '2025-01-01')) as varchar), 'age', 'derived' from d where updated_at is not null""",
)
def criterion_claims(t):
    d = F.col("description")
    rows = t.format_registry.select("entry_id", "description", F.when(d.isNotNull(), F.when(F.right(d, F.lit(1)) == "…", "…").when(F.length(d) < 60, "short").otherwise("full")).alias("detail"), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated")).distinct()
    return rules.claims(rows, MAPPING, CRITERIA, F.lit("2025-01-01").cast("date"), ["entry_id"]).select("entry_id", "criterion_id", "value", "rule_id", "directness")


@query("d2_ordinal_distance", "with l as (select level_id, risk_rank from risk_level where risk_rank > 0) select a.level_id as left_level, b.level_id as right_level, abs(a.risk_rank - b.risk_rank) as steps from l a, l b where a.risk_rank < b.risk_rank")
def distance(t):
    ranked = t.risk_level.where("risk_rank > 0").select("level_id", "risk_rank")
    scale = [r[0] for r in collect_bounded(ranked.orderBy("risk_rank"), 1000, "the levels")]
    others = F.explode(F.array(*[F.lit(x) for x in scale])).alias("right_level")
    pairs = ranked.select(F.col("level_id").alias("left_level"), others).where(F.array_position(F.lit(scale), F.col("left_level")) < F.array_position(F.lit(scale), F.col("right_level")))
    return pairs.select("left_level", "right_level", rules.ordinal_distance(F.col("left_level"), F.col("right_level"), scale, None).alias("steps"))



