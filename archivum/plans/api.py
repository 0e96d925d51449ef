"""Request actions over a registry: each answers for all formats at once and returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.functions.normalize import match_words
from archivum.operators import evidence, risk, search

ACTIONS = ("assess_format", "assess_format_questions", "search_formats", "assess_format_family", "list_at_risk_formats", "list_assessment_questions", "list_evidence_gaps", "plan_evidence_remediation")
MAX_LIMIT = 5000


class RequestError(ValueError):
    """A request that cannot be answered."""


@dataclass(frozen=True)
class Request:
    action: str
    format: str | None = None
    query: str | None = None
    institution_id: str | None = None
    levels: tuple[str, ...] = ("moderate", "high", "critical")
    limit: int = 100
    #: The limit is applied to candidates before filtering; switch to cut the filtered list instead.
    limit_after_filter: bool = False

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise RequestError(f"unknown action {self.action}")
        if not 1 <= self.limit <= MAX_LIMIT:
            raise RequestError(f"limit has to be in 1..{MAX_LIMIT}")
        if self.action in ("assess_format", "assess_format_questions") and not self.format:
            raise RequestError(f"{self.action} needs a format")
        if self.action in ("search_formats", "assess_format_family") and not self.query:
            raise RequestError(f"{self.action} needs a query")

    @classmethod
    def parse(cls, document: dict) -> Request:
        unknown = set(document) - set(cls.__dataclass_fields__)
        if unknown:
            raise RequestError(f"unknown fields {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in document.items()})


@dataclass
class Registry:
    """The tables that requests are answered from."""

    formats: DataFrame  # canonical_id, preferred_name, category
    identifiers: DataFrame  # canonical_id, kind, value, verified
    assessments: DataFrame  # normalised: canonical_id, semantic_level, scope_type, source_id, role, mapping_status
    claims: DataFrame  # canonical_id, field, value, institution_id
    questions: DataFrame  # question_id, weight, critical
    question_fields: DataFrame  # question_id, field
    answers: DataFrame  # question_id, answer_id, points
    value_map: DataFrame | None = None
    policy: dict = field(default_factory=dict)

    def execute(self, request: Request) -> DataFrame:
        return getattr(self, f"_{request.action}")(request)

    def _derived(self, r: Request) -> DataFrame:
        return evidence.derive_answers(self.claims.where(evidence.in_scope(r.institution_id)), self.question_fields, self.answers, self.value_map)

    def _named(self, r: Request) -> DataFrame:
        terms = self.formats.sparkSession.createDataFrame([(r.format,)], "term string")
        return search.resolve(terms, search.lookup_keys(self.formats, self.identifiers))

    def _with_risk(self, formats: DataFrame) -> DataFrame:
        rated = risk.synthesize(self.assessments.join(formats.select("canonical_id"), "canonical_id", "left_semi"))
        return formats.join(rated, "canonical_id", "left").withColumn("level", F.coalesce("level", F.lit("unassessed")))

    def _assess_format(self, r: Request) -> DataFrame:
        hit = self._named(r).select("canonical_id", "tier", "ambiguous", "n_matches")
        return self._with_risk(self.formats.join(hit, "canonical_id"))

    def _assess_format_questions(self, r: Request) -> DataFrame:
        hit = self._named(r).select("canonical_id")
        sheet = evidence.answer_sheet(hit, self.questions)
        return sheet.join(self._derived(r), ["canonical_id", "question_id"], "left").withColumn("status", F.coalesce("status", F.lit("missing_evidence")))

    def _search_formats(self, r: Request) -> DataFrame:
        return search.search(self.formats, r.query, r.limit)

    def _assess_format_family(self, r: Request) -> DataFrame:
        hits = self.formats.withColumn("score", search.family_score(F.col("preferred_name"), F.col("category"), r.query)).where("score is not null")
        return self._with_risk(hits.orderBy(F.desc("score"), match_words(F.col("preferred_name")), "canonical_id").limit(r.limit))

    def _list_at_risk_formats(self, r: Request) -> DataFrame:
        formats = self.formats if r.limit_after_filter else self.formats.orderBy(F.lower("preferred_name"), "canonical_id").limit(r.limit)
        hits = self._with_risk(formats).where(F.col("level").isin(*r.levels)).orderBy(F.desc("level_rank"), F.lower("preferred_name"), "canonical_id")
        return hits.limit(r.limit) if r.limit_after_filter else hits

    def _list_assessment_questions(self, r: Request) -> DataFrame:
        return self.questions.join(self.answers.groupBy("question_id").agg(F.count("*").alias("n_answers")), "question_id", "left")

    def _list_evidence_gaps(self, r: Request) -> DataFrame:
        return evidence.gaps(self.formats, self.questions, self._derived(r))

    def _plan_evidence_remediation(self, r: Request) -> DataFrame:
        plan = evidence.remediation(self._list_evidence_gaps(r))
        return plan.join(self.formats.select("canonical_id", "preferred_name"), "canonical_id").orderBy(F.desc("p1"), F.desc("p2"), F.desc("n_gaps"), F.lower("preferred_name"), "canonical_id").limit(r.limit)
