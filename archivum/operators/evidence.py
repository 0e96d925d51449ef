"""Answers, scores, gaps and remediation from claims, for all formats in one pass.

Missing evidence and answers that abstain contribute nothing and stay visible;
conflicting claims take the answer with most points (ties by answer id) and are
no gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.session import collect_bounded

#: A questionnaire is a list people answer; more questions than this are an error.
MAX_QUESTIONS = 10_000
UNUSABLE = ("draft", "rejected", "withdrawn", "superseded")


def is_current(c: str = "current") -> Column:
    """Only an explicit false makes a row stale."""
    return ~F.col(c).eqNullSafe(F.lit(False))


def in_scope(institution: str | None, column: str = "institution_id") -> Column:
    """Globally only unscoped claims; for an institution these and its own."""
    scoped = F.nullif(F.trim(F.col(column)), F.lit("")).isNotNull()
    return ~scoped if institution is None else ~scoped | (F.col(column) == institution)


def is_usable(c: str = "review_status") -> Column:
    return ~F.coalesce(F.lower(F.trim(F.col(c))).isin(*UNUSABLE), F.lit(False))


def _or(df: DataFrame, name: str, default: Column) -> Column:
    """A column that may be absent or null."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def derive_answers(claims: DataFrame, question_fields: DataFrame, answers: DataFrame, value_map: DataFrame | None = None) -> DataFrame:
    """(canonical_id, question_id, answer_id, points, abstention, status, n_claims, n_answers).

    claims(canonical_id, field, value); question_fields(question_id, field);
    answers(question_id, answer_id, points, and optionally abstention); value_map(question_id, value, answer_id), values folded.
    The three last ones are small reference lists; what Spark joins how follows their size.
    """
    matched = claims.join(question_fields, "field")
    folded = matched.withColumn("v", F.lower(F.trim("value")))
    direct = answers.select("question_id", F.lower(F.trim("answer_id")).alias("v"), F.col("answer_id").alias("direct"))
    got = folded.join(direct, ["question_id", "v"], "left")
    if value_map is not None:
        got = got.join(value_map.select("question_id", F.col("value").alias("v"), F.col("answer_id").alias("mapped")), ["question_id", "v"], "left")
    else:
        got = got.withColumn("mapped", F.lit(None).cast("string"))
    got = got.withColumn("answer_id", F.coalesce("direct", "mapped")).join(answers.select("question_id", "answer_id", "points", _or(answers, "abstention", F.lit(False)).alias("abstention")), ["question_id", "answer_id"], "left")
    best = F.max(F.when(F.col("answer_id").isNotNull(), F.struct("points", "answer_id", "abstention")))
    out = got.groupBy("canonical_id", "question_id").agg(best.alias("b"), F.count("*").alias("n_claims"), F.count_distinct("answer_id").alias("n_answers"))
    status = F.when(F.col("n_answers") == 0, "unknown").when(F.col("n_answers") == 1, "derived").otherwise("derived_conflict_conservative")
    return out.select("canonical_id", "question_id", F.col("b.answer_id").alias("answer_id"), F.col("b.points").alias("points"), F.col("b.abstention").alias("abstention"), status.alias("status"), "n_claims", "n_answers")


def answer_sheet(formats: DataFrame, questions: DataFrame) -> DataFrame:
    """(canonical_id, question_id, critical): each format's empty sheet, spelled out from the list of questions."""
    listed = collect_bounded(questions.select("question_id", "critical"), MAX_QUESTIONS, "the questionnaire")
    sheet = F.array(*[F.struct(F.lit(q["question_id"]).alias("question_id"), F.lit(q["critical"]).alias("critical")) for q in listed])
    if not listed:
        sheet = F.array().cast("array<struct<question_id:string,critical:boolean>>")
    return formats.select("canonical_id", F.explode(sheet).alias("q")).select("canonical_id", "q.question_id", "q.critical")


def score(formats: DataFrame, questions: DataFrame, derived: DataFrame, min_completeness: float = 0.0, banding: bool = True) -> DataFrame:
    """(canonical_id, score, answered, completeness, status, why there is no band) over all questions.

    questions(question_id, weight, critical), a list of bounded length.  A question
    without an answer, or with one that abstains, is not answered.
    """
    n_questions, n_critical = questions.agg(F.count("*"), F.count_if("critical")).first()
    answered = derived.where("answer_id is not null and not abstention").join(questions, "question_id").groupBy("canonical_id").agg(
        F.sum(F.col("weight") * F.col("points")).alias("score"), F.count("*").alias("n_answered"), F.count_if("critical").alias("n_critical_answered")
    )
    out = formats.select("canonical_id").join(answered, "canonical_id", "left")
    n, missing = F.coalesce("n_answered", F.lit(0)), F.lit(n_critical) > F.coalesce("n_critical_answered", F.lit(0))
    completeness = n / F.lit(n_questions) if n_questions else F.lit(0.0)
    status = F.when(n == 0, "Not Assessed").when(missing, "Needs Assessment").when(n < F.lit(n_questions), "Partially Assessed").otherwise("Assessed")
    reason = F.when(n == 0, "not_assessed").when(missing, "critical_abstention").when(completeness < min_completeness, "insufficient_evidence_completeness")
    if not banding:
        reason = F.lit("framework_not_calibrated")
    return out.select("canonical_id", F.coalesce("score", F.lit(0.0)).alias("score"), n.alias("n_answered"), F.round(completeness, 4).alias("completeness"), status.alias("status"), reason.alias("suppressed_reason"))


def max_score(questions: DataFrame, answers: DataFrame) -> DataFrame:
    best = answers.groupBy("question_id").agg(F.max("points").alias("p"))
    return questions.join(best, "question_id").agg(F.sum(F.col("weight") * F.col("p")).alias("max_score"))


#: Domains of questions that only the institution, or only the content, can answer.
LOCAL_DOMAIN, CONTENT_DOMAIN = "local_institutional_feasibility", "essential_characteristics"
#: What each kind of work calls for (action, reason, priority if the question is not critical).
WORK = {
    "deterministic_mapping_review": ("mapping_rule_needed", "matched_claim_value_not_in_deterministic_mapping", "P2"),
    "institution_evidence_required": ("institution_evidence_needed", "question_requires_institution_scoped_evidence", "P2"),
    "content_specific_assessment_required": ("content_specific_assessment_needed", "question_requires_content_specific_significant_properties", "P2"),
    "automated_evidence_research_required": ("automated_evidence_research", "locked_registry_has_no_deterministic_question_evidence", "P3"),
    "source_evidence_required": ("source_evidence_needed", "no_claim_matches_framework_evidence_field", "P3"),
}


def gaps(formats: DataFrame, questions: DataFrame, derived: DataFrame) -> DataFrame:
    """(canonical_id, question_id, critical, gap, work_type, n_claims): what each format lacks, why, and the work it takes.

    questions(question_id, critical, and optionally domain_id and applicability).
    """
    about = questions.select("question_id", _or(questions, "domain_id", F.lit("")).alias("domain_id"), _or(questions, "applicability", F.array().cast("array<string>")).alias("applicability"))
    sheet = answer_sheet(formats, questions).join(derived, ["canonical_id", "question_id"], "left").where("status is null or status = 'unknown'").join(about, "question_id", "left")
    unmapped = F.col("status").isNotNull()
    work = (
        F.when(unmapped, "deterministic_mapping_review").when(F.col("domain_id") == LOCAL_DOMAIN, "institution_evidence_required")
        .when((F.col("domain_id") == CONTENT_DOMAIN) | (F.size("applicability") > 0), "content_specific_assessment_required").when(F.col("domain_id") != "", "automated_evidence_research_required").otherwise("source_evidence_required")
    )
    return sheet.select("canonical_id", "question_id", "critical", F.when(unmapped, "claims_exist_but_do_not_map").otherwise("no_matching_evidence").alias("gap"), work.alias("work_type"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def gap_classes(formats: DataFrame, gap_rows: DataFrame, claims: DataFrame, derived: DataFrame) -> DataFrame:
    """(canonical_id, gap_classification, n_gaps, n_claims) of every format."""
    of = lambda df, name: df.groupBy("canonical_id").agg(F.count("*").alias(name))
    per = gap_rows.groupBy("canonical_id").agg(F.count("*").alias("n_gaps"), F.count_if(F.col("gap") == "claims_exist_but_do_not_map").alias("n_unmapped"), F.count_if(F.col("gap") == "no_matching_evidence").alias("n_none"))
    out = formats.select("canonical_id").join(per, "canonical_id", "left").join(of(claims, "n_claims"), "canonical_id", "left").join(of(derived, "n_matched"), "canonical_id", "left").fillna(0, ["n_gaps", "n_unmapped", "n_none", "n_claims", "n_matched"])
    kind = (
        F.when(F.col("n_gaps") == 0, "none").when((F.col("n_unmapped") > 0) & (F.col("n_none") > 0), "mixed_mapping_and_evidence_gaps").when(F.col("n_unmapped") > 0, "claims_exist_but_do_not_map")
        .when(F.col("n_claims") == 0, "no_evidence").when(F.col("n_matched") == 0, "claims_exist_but_not_for_framework").otherwise("missing_matching_evidence")
    )
    return out.select("canonical_id", kind.alias("gap_classification"), "n_gaps", "n_claims")


def gap_order(gap_rows: DataFrame) -> DataFrame:
    """Formats with most gaps first, then by id."""
    return gap_rows.groupBy("canonical_id").agg(F.count("*").alias("n_gaps")).orderBy(F.desc("n_gaps"), "canonical_id")


def remediation_items(gap_rows: DataFrame) -> DataFrame:
    """One item of work per gap: priority, action and reason."""
    looked_up = lambda n: F.element_at(F.create_map(*[F.lit(x) for k, v in WORK.items() for x in (k, v[n])]), F.col("work_type"))
    priority = F.when(F.col("critical"), "P1").otherwise(looked_up(2))
    return gap_rows.select("canonical_id", "question_id", "critical", "gap", "work_type", priority.alias("priority"), looked_up(0).alias("action_type"), looked_up(1).alias("reason_code"))


def remediation(gap_rows: DataFrame) -> DataFrame:
    """Per format: items by priority, most urgent first."""
    p = F.col("priority")
    per = remediation_items(gap_rows).groupBy("canonical_id").agg(F.count_if(p == "P1").alias("p1"), F.count_if(p == "P2").alias("p2"), F.count_if(p == "P3").alias("p3"), F.count("*").alias("n_gaps"))
    return per.withColumn("priority", F.when(F.col("p1") > 0, "P1").when(F.col("p2") > 0, "P2").otherwise("P3"))


def conflict_combinations(answers_per_claim: DataFrame) -> DataFrame:
    """Which answers stand against each other, and how often."""
    per = answers_per_claim.groupBy("canonical_id", "question_id").agg(F.array_join(F.array_sort(F.collect_set("answer_id")), " vs ").alias("combination"), F.count_distinct("answer_id").alias("n")).where("n > 1")
    return per.groupBy("question_id", "combination").agg(F.count("*").alias("n_formats"))


#: Items of an evidence pack; a pack is meant to be read, its total says what it leaves out.
PACK_ITEMS = 120


def evidence_pack(*tagged: DataFrame, most: int = PACK_ITEMS) -> DataFrame:
    """Evidence rows of several kinds (canonical_id, kind, ref, text) as one document per format with a stable hash.

    The first ``most`` items by kind and ref are shown and all are counted, so a
    format with very many rows is never gathered.
    """
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more)
    totals = rows.groupBy("canonical_id").agg(F.count("*").alias("n_total"))
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("canonical_id").orderBy("kind", "ref", "text"))).where(F.col("__n") <= most)
    items = F.array_sort(F.collect_list(F.struct("kind", "ref", "text")))
    return first.groupBy("canonical_id").agg(items.alias("items")).join(totals, "canonical_id").withColumn("n_items", F.size("items")).withColumn("sha256", F.sha2(F.to_json("items"), 256))
