"""Method profiles, action policies, posture and currency of recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands, states of readiness, the standard matrix of postures, and how postures and exposure rank in a work queue.
BANDS = ("Low", "Moderate", "High")
ANALYSIS_STATES = ("Low", "Moderate", "High", "Unknown", "Not Assessed")
READINESS = ("Covered", "Partially Covered", "Uncovered", "Unknown", "Not Assessed")
ANY_READINESS = "any_readiness"
POSTURE_MATRIX = {
    "Not Assessed": {ANY_READINESS: "Needs Assessment"},
    "Unknown": {ANY_READINESS: "Needs Assessment"},
    "High": {ANY_READINESS: "High"},
    "Moderate": {"Uncovered": "High", "Partially Covered": "Moderate", "Covered": "Moderate", "Unknown": "Needs Assessment", "Not Assessed": "Needs Assessment"},
    "Low": {"Uncovered": "Moderate", "Partially Covered": "Low", "Covered": "Low", "Unknown": "Needs Assessment", "Not Assessed": "Needs Assessment"},
}
POSTURE_RANK = {"Low": 0, "Moderate": 1, "High": 2, "Needs Assessment": 2}
EXPOSURE_RANK = {"Low": 0, "Moderate": 1, "Unknown": 1, "High": 2}
#: The least refresh for a single stale part; several at once need a full one.
REFRESH = {"evidence": "rebuild_evidence_pack_and_rerun_analysis", "analysis": "rerun_analysis_and_action_resolution", "policy": "rerun_action_resolution_only"}


def profile_matches(rule: dict, text: Column, extensions: Column | None = None) -> Column:
    """A profile applies if a term is in the text or an extension is in its list."""
    ok = F.lit(False)
    for term in rule.get("terms", []):
        ok = ok | F.coalesce(F.lower(text).contains(term.lower()), F.lit(False))
    if extensions is not None and rule.get("extensions"):
        ok = ok | F.coalesce(F.arrays_overlap(extensions, F.array(*[F.lit(e) for e in rule["extensions"]])), F.lit(False))
    return ok


def assign_profiles(df: DataFrame, rules: list[dict], text: str, extensions: str | None = None) -> DataFrame:
    """Primary profiles that apply; only if none does, the fallback ones.  Parents come before their children."""
    parents = {r["id"]: r.get("inherits") for r in rules}

    def chain(rule_id: str) -> list[str]:
        out, seen = [], set()
        while rule_id and rule_id not in seen:
            out.insert(0, rule_id)
            seen.add(rule_id)
            rule_id = parents.get(rule_id)
        return out

    def found(fallback: bool) -> Column:
        items = [F.when(profile_matches(r, F.col(text), F.col(extensions) if extensions else None), F.array(*[F.lit(x) for x in chain(r["id"])])) for r in rules if bool(r.get("fallback")) == fallback]
        return F.array_distinct(F.flatten(F.array_compact(F.array(*items)))) if items else F.array().cast("array<string>")

    primary = found(False)
    return df.withColumn("profiles", F.when(F.size(primary) > 0, primary).otherwise(found(True)))


def policy_outcomes(policies: DataFrame) -> DataFrame:
    """(canonical_id, policy_id, outcome) from matched policies.

    ``policies``: canonical_id, policy_id, specificity, mode (``replace`` or
    ``supplement``), actions, suppresses (policy ids); one row per matched policy.
    Of the replacing ones the most specific holds (ties: the greatest id), all
    supplementing ones do, and any policy may be suppressed by its id.
    """
    chosen = policies.where("mode = 'replace'").groupBy("canonical_id").agg(F.max_by("policy_id", F.struct("specificity", "policy_id")).alias("chosen"))
    gone = policies.select("canonical_id", F.explode("suppresses").alias("policy_id")).distinct().withColumn("gone", F.lit(True))
    out = policies.join(chosen, "canonical_id", "left").join(gone, ["canonical_id", "policy_id"], "left")
    outcome = F.when(F.col("gone"), "explicitly_suppressed").when((F.col("mode") == "replace") & (F.col("policy_id") != F.col("chosen")), "less_specific").otherwise("applied")
    return out.select("canonical_id", "policy_id", "actions", outcome.alias("outcome"))


def action_policies(policies: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(canonical_id, action, errors): the actions that remain, or the errors that leave none.

    ``conflicts``: action_a, action_b, pairs that must not stand together, in
    either order.  Errors are ``same_specificity_replace_conflict`` (several
    replacing policies of one specificity) and ``conflicting_actions``, joined by commas.
    """
    applied = policy_outcomes(policies).where("outcome = 'applied'").select("canonical_id", F.explode("actions").alias("action")).where("action != ''").distinct()
    equal = policies.where("mode = 'replace'").groupBy("canonical_id", "specificity").count().where("count > 1").select("canonical_id").distinct().withColumn("e1", F.lit("same_specificity_replace_conflict"))
    against = applied.join(conflicts.select(F.col("action_a").alias("action"), "action_b"), "action").select("canonical_id", F.col("action_b").alias("action"))
    clash = against.join(applied, ["canonical_id", "action"], "left_semi").select("canonical_id").distinct().withColumn("e2", F.lit("conflicting_actions"))
    out = policies.select("canonical_id").distinct().join(equal, "canonical_id", "left").join(clash, "canonical_id", "left").withColumn("errors", F.concat_ws(",", "e1", "e2"))
    return out.join(applied, "canonical_id", "left").select("canonical_id", F.when(F.col("errors") == "", F.col("action")).alias("action"), "errors").distinct()


def check_matrix(matrix: dict[str, dict[str, str]] = POSTURE_MATRIX) -> None:
    """Every state has a posture that exists, and readiness never lowers what a band asks for."""
    cells = {(band, ready): row.get(ready, row.get(ANY_READINESS)) for band, row in matrix.items() for ready in READINESS}
    lacking = [(b, r) for b in ANALYSIS_STATES for r in READINESS if cells.get((b, r)) not in POSTURE_RANK]
    lowered = [(b, r) for (b, r), p in cells.items() if b in BANDS and (b, r) not in lacking and POSTURE_RANK[p] < BANDS.index(b)]
    if lacking or lowered:
        raise ValueError(f"the posture matrix lacks {lacking} and goes below the band at {lowered}")


def posture(band: Column, readiness: Column, matrix: dict[str, dict[str, str]] = POSTURE_MATRIX) -> Column:
    """What the matrix says for a band (none: not assessed) at a state of readiness (none: unknown)."""
    check_matrix(matrix)
    table = F.create_map(*[F.lit(x) for b, row in matrix.items() for r, p in row.items() for x in (f"{b}|{r}", p)])
    b = F.when(band.isin(*matrix), band).otherwise("Not Assessed")
    at = lambda r: F.element_at(table, F.concat_ws("|", b, r))
    return F.coalesce(at(F.coalesce(F.nullif(readiness, F.lit("")), F.lit("Unknown"))), at(F.lit(ANY_READINESS)), F.lit("Needs Assessment"))


def critical_alert(band: Column, exposure_high: Column, readiness_weak: Column, trend_negative: Column) -> Column:
    """High hazard and any two of three aggravating facts (declared policy, an extension)."""
    n = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in (exposure_high, readiness_weak, trend_negative)])
    return F.coalesce(band == "High", F.lit(False)) & (n >= 2)


def currency(stored: dict[str, Column], current: dict[str, Column]) -> Column:
    """Which parts of a stored recommendation (evidence, analysis, policy) are stale, and the least refresh that mends it."""
    stale = [F.when(~stored[part].eqNullSafe(current[part]), part) for part in REFRESH]
    reasons = F.array_compact(F.array(*stale))
    plan = F.element_at(F.create_map(*[F.lit(x) for kv in REFRESH.items() for x in kv]), F.get(reasons, F.lit(0)))
    refresh = F.when(F.size(reasons) == 0, "none").when(F.size(reasons) == 1, plan).otherwise("full_refresh")
    return F.struct(F.when(F.size(reasons) == 0, "current").otherwise("stale").alias("recommendation_status"), reasons.alias("stale_reason"), refresh.alias("minimum_refresh"))


def _ranked(ranks: dict[str, int], c: Column, default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), c), F.lit(default))


def triage_rank(posture_: Column, exposure: Column) -> Column:
    """A sortable rank: posture, then exposure; what needs assessment ranks with High, unknown exposure with Moderate."""
    return F.struct(_ranked(POSTURE_RANK, posture_, POSTURE_RANK["Needs Assessment"]).alias("posture_rank"), _ranked(EXPOSURE_RANK, exposure, EXPOSURE_RANK["Unknown"]).alias("exposure_rank"))


def triage_order(df: DataFrame) -> DataFrame:
    """Most pressing first, ties by id."""
    return df.orderBy(triage_rank(F.col("posture"), F.col("exposure")).desc(), "canonical_id")
