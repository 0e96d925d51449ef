"""Which mapping rules, questions, records and terms apply to what, and risk carried over by rule.

Rules and questions are reference lists; they stay tables and are joined, so
their number is no limit.  Rows of registries and records are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions.normalize import match_value
from archivum.operators import search

#: Fixed value: the only scope in which a related record may add claims unless a mapping allows more.
EXACT_SCOPE = "exact_puid_cross_reference"
#: Brackets, quotes and separators that are no part of an id (fixed values).
_WRAPPING = r"[\[\](){}<>,;\"']"


def source_in_scope(refs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Pairs of source references and mappings that fit.

    refs: source_id, source_type, relationship, evidence_scope and others;
    mappings: mapping_id, want_source_id, want_source_type (null: any), allow_related.
    A reference by relationship counts only in ``EXACT_SCOPE``, unless the mapping allows related records.
    """
    m = F.broadcast(mappings) if mappings.limit(1001).count() <= 1000 else mappings
    same = lambda want, have: F.col(want).isNull() | (F.col(want) == "") | F.col(want).eqNullSafe(F.col(have))
    related = F.coalesce(F.nullif("relationship", F.lit("")), F.lit("")) != ""
    scoped = ~related | (F.coalesce(F.trim("evidence_scope"), F.lit("")) == EXACT_SCOPE) | F.coalesce("allow_related", F.lit(False))
    return refs.join(m, same("want_source_id", "source_id") & same("want_source_type", "source_type") & scoped)


def select_questions(questions: DataFrame, domains: list[str] = (), question_ids: list[str] = (), content_type: str | None = None) -> DataFrame:
    """Questions of the domains (by id, label or alias), among the ids, that apply to a kind of content; empty means any.

    questions: question_id, domain_id, domain_label, aliases, applicability.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s_-]+", "_")
    own = lambda x: "_".join(x.lower().replace("_", " ").replace("-", " ").split())
    out = questions
    wanted = [own(d) for d in domains if d.strip()]
    if wanted:
        names = F.concat(F.array(norm(F.col("domain_id")), norm(F.col("domain_label"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), norm))
        out = out.where(F.arrays_overlap(names, F.array(*map(F.lit, wanted))))
    ids = [q.strip() for q in question_ids if q.strip()]
    if ids:
        out = out.where(F.col("question_id").isin(ids))
    if content_type:
        kinds = F.transform(F.coalesce("applicability", F.array().cast("array<string>")), norm)
        out = out.where((F.size(kinds) == 0) | F.array_contains(kinds, "all") | F.array_contains(kinds, own(content_type)))
    return out


def carry_risk(rules: DataFrame, records: DataFrame, targets: DataFrame, drafts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reviewed risk of one source record attached to many formats: (attached, outcome per rule).

    rules: rule_id, status, scope_type, scope_name; records: rule_id, record_id, level
    (null: no assessment), the records each rule's source selector matches; targets:
    rule_id, canonical_id, the formats its target selector matches.  A rule applies
    only if it is approved and exactly one record matches.
    """
    status = F.lower(F.coalesce("status", F.lit("draft")))
    n_records = records.groupBy("rule_id").agg(F.count_distinct("record_id").alias("n_records"), F.max("record_id").alias("record_id"), F.count_distinct("level").alias("n_levels"))
    n_targets = targets.groupBy("rule_id").agg(F.count_distinct("canonical_id").alias("n_targets"))
    j = rules.withColumn("status", status).join(n_records, "rule_id", "left").join(n_targets, "rule_id", "left").fillna(0, ["n_records", "n_targets", "n_levels"])
    usable = (F.col("status") == "approved") | (F.lit(drafts) & (F.col("status") == "draft"))
    outcome = (
        F.when(F.col("status").isin("contextual_only", "excluded"), F.col("status")).when(~usable, "not_approved").when(F.col("n_records") != 1, "source_record_match_count")
        .when(F.col("n_targets") == 0, "no_target_formats").when(F.col("n_levels") == 0, "no_source_risk_assessment").otherwise("applied")
    )
    report = j.select("rule_id", "status", "scope_type", "scope_name", "record_id", "n_records", "n_targets", outcome.alias("outcome"))
    applied = report.where("outcome = 'applied'").select("rule_id", "scope_type", "scope_name", "record_id")
    levels = records.where("level is not null").select("rule_id", "record_id", "level").distinct()
    attached = applied.join(levels, ["rule_id", "record_id"]).join(targets.select("rule_id", "canonical_id").distinct(), "rule_id")
    return attached.select("canonical_id", "rule_id", "record_id", "level", "scope_type", "scope_name"), report


def undoubled(raw: DataFrame, governed: DataFrame) -> DataFrame:
    """Raw risk rows whose record has no governed row of the same level: (source_id, record_id, level) compared, nulls never equal."""
    keys = ["source_id", "record_id", "level"]
    return raw.join(governed.where("level is not null").select(*keys).distinct(), keys, "left_anti")


def risk_context(claims: DataFrame, scope_rank: Column) -> DataFrame:
    """(canonical_id, place, source_id, scope_type, level, n): the current assessments of each format, most specific scope first.

    claims: canonical_id, source_id, scope_type, semantic_level.  Equal ones are
    summed up before they are ordered, so a format with very many claims is a few rows.
    """
    few = claims.groupBy("canonical_id", "source_id", "scope_type", F.col("semantic_level").alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("canonical_id").orderBy(scope_rank, F.coalesce("source_id", F.lit("")), F.coalesce("scope_type", F.lit("")), F.coalesce("level", F.lit("")))
    return few.withColumn("place", F.row_number().over(w))


def observed(term: Column) -> Column:
    """A term without wrapping signs."""
    return F.trim(F.regexp_replace(term, f"^(?:{_WRAPPING}|\\s)+|(?:{_WRAPPING}|\\s)+$", ""))


def identify(terms: DataFrame, keys: DataFrame) -> DataFrame:
    """(term, normalized, canonical_id, n_matches, method): as written, else unwrapped, else left open.

    A term with several matches of its best tier is ambiguous and gets no id; an
    unwrapped spelling is tried only for terms that are not resolved as written.
    """
    first = lambda df: search.resolve(df, keys).where("rank = 1").select("term", F.when(F.col("n_matches") == 1, F.col("canonical_id")).alias("canonical_id"), "n_matches")
    terms = terms.select("term").where("term is not null and trim(term) != ''").distinct()
    exact = first(terms)
    solved = exact.where("n_matches = 1").select("term", F.col("term").alias("normalized"), "canonical_id", "n_matches", F.lit("deterministic_exact").alias("method"))
    open_ = terms.join(solved.select("term"), "term", "left_anti").withColumn("normalized", observed(F.col("term")))
    again = first(open_.where("normalized != trim(term)").select(F.col("normalized").alias("term")).distinct()).withColumnsRenamed({"term": "normalized", "n_matches": "n_again", "canonical_id": "found"})
    rest = open_.join(again, "normalized", "left").join(exact.select("term", F.col("n_matches").alias("n_first")), "term", "left")
    hit = F.col("found").isNotNull()
    rest = rest.select(
        "term", F.when(hit, F.col("normalized")).otherwise(F.lit(None).cast("string")).alias("normalized"), F.when(hit, F.col("found")).alias("canonical_id"),
        F.coalesce(F.when(hit, F.lit(1).cast("bigint")), F.col("n_first"), F.col("n_again"), F.lit(0).cast("bigint")).alias("n_matches"), F.when(hit, "deterministic_normalization").otherwise("deterministic_best_effort").alias("method"),
    )
    return solved.unionByName(rest)


def assess_watchlist(ids: DataFrame, keys: DataFrame, rated: DataFrame, gap_classes: DataFrame) -> DataFrame:
    """(format_id, canonical_id, status, level, gap_classification) for each distinct id of a watchlist.

    rated: canonical_id, level; gap_classes: canonical_id, gap_classification.
    """
    found = identify(ids.select(match_value(F.col("format_id")).alias("term")), keys)
    status = F.when(F.col("canonical_id").isNotNull(), "ok").when(F.col("n_matches") > 1, "ambiguous").otherwise("not_found")
    out = found.select(F.col("term").alias("format_id"), "canonical_id", status.alias("status"))
    out = out.join(rated.select("canonical_id", "level"), "canonical_id", "left").join(gap_classes.select("canonical_id", "gap_classification"), "canonical_id", "left")
    return out.select("format_id", "canonical_id", "status", F.when(F.col("status") == "ok", F.coalesce("level", F.lit("unassessed"))).alias("level"), "gap_classification")
