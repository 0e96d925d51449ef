"""Declarative mapping rules compiled to column expressions.

Rules are data, checked on the driver and turned into one array of expressions
per source; a row is evaluated against all rules in a single pass, without a
join between rows and rules and without interpreting a rule per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions.normalize import days_since, match_value, parse_date, text_rule

REVIEW_STATUSES = ("unreviewed", "approved", "rejected", "superseded")
DIRECTNESS = ("explicit", "derived", "inferred")
COVERS = ("full", "partial")
#: Fields that hold conclusions or decisions; mapping them needs a named decider.
CONCLUSIONS = ("risk level", "numeric risk rating", "overall risk", "risk band", "hazard band", "rating", "band")
DECISIONS = ("preservation action", "preservation plan", "preferred tool", "action", "tooling")


class RuleError(ValueError):
    """A mapping that must not be run."""


def _has_phrase(text: str, tokens) -> bool:
    words = f" {' '.join(''.join(c if c.isalnum() else ' ' for c in text.lower()).split())} "
    return any(f" {t} " in words for t in tokens)


def validate(mapping: dict, criteria: dict[str, dict]) -> list[str]:
    """Problems of a mapping; an empty list means it may run.

    ``criteria``: id to {kind: ordinal|nominal|temporal, values, null_value}.
    """
    out = []
    for field in ("source_id", "mapping_version", "criteria_version", "claim_review_status"):
        if not mapping.get(field):
            out.append(f"missing {field}")
    if mapping.get("claim_review_status") not in (None, *REVIEW_STATUSES):
        out.append(f"unknown review status {mapping['claim_review_status']}")
    seen = set()
    for rule in mapping.get("rules", []):
        name = rule.get("id") or "?"
        if name in seen:
            out.append(f"{name}: repeated id")
        seen.add(name)
        criterion = criteria.get(rule.get("criterion"))
        if criterion is None:
            out.append(f"{name}: unknown criterion {rule.get('criterion')}")
            continue
        if rule.get("directness", "explicit") not in DIRECTNESS:
            out.append(f"{name}: unknown directness")
        if rule.get("covers", "full") not in COVERS:
            out.append(f"{name}: unknown coverage")
        legal = {*criterion.get("values", []), criterion.get("null_value")}
        for value in [*rule.get("values", {}).values(), rule.get("when_present"), *[t.get("value") for t in rule.get("text_rules", [])]]:
            if value is not None and criterion["kind"] != "temporal" and value not in legal:
                out.append(f"{name}: {value} is not a value of {rule['criterion']}")
        if not (rule.get("values") or rule.get("text_rules") or rule.get("when_present") or rule.get("transform")):
            out.append(f"{name}: decides nothing")
        if _has_phrase(rule.get("from_field", ""), (*CONCLUSIONS, *DECISIONS)) and not rule.get("decided_by"):
            out.append(f"{name}: {rule['from_field']} is a conclusion and needs decided_by")
    return out


def _produced(rule: dict, value: Column, observed: Column) -> Column:
    """Precedence: transform, text rule, presence, exact value, value without regard to case."""
    found: list[Column] = []
    if rule.get("transform") == "days_since_date":
        return days_since(parse_date(value), observed).cast("string")
    for t in rule.get("text_rules", []):
        conditions = {k: t[k] for k in ("equals_any", "contains_any", "contains_all", "not_contains_any") if t.get(k)}
        found.append(F.when(text_rule(value, **conditions), F.lit(t["value"])))
    if rule.get("when_present") is not None:
        found.append(F.lit(rule["when_present"]))
    if rule.get("values"):
        exact = rule["values"]
        folded = {k.strip().lower(): v for k, v in reversed(list(exact.items()))}
        found.append(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv])[value])
        found.append(F.create_map(*[F.lit(x) for kv in folded.items() for x in kv])[match_value(value)])
    return F.coalesce(*found)


def claims(records: DataFrame, mapping: dict, criteria: dict[str, dict], observed: Column, keys: list[str], include_drafts: bool = False) -> DataFrame:
    """(keys..., criterion_id, value, rule_id, source_field, source_value, directness, covers, review_status) from every rule that applies."""
    problems = validate(mapping, criteria)
    if problems:
        raise RuleError("; ".join(problems))
    out = []
    for rule in mapping["rules"]:
        if rule.get("mapping_status", "accepted") not in ("accepted", "approved") and not include_drafts:
            continue
        fields = [rule["from_field"], *rule.get("alternate_fields", [])]
        value = F.coalesce(*[F.nullif(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields])
        hit = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in rule.get("where", {}).items()], value.isNotNull())
        got = _produced(rule, value, observed)
        if criteria[rule["criterion"]]["kind"] != "temporal":
            legal = [v for v in (*criteria[rule["criterion"]].get("values", []), criteria[rule["criterion"]].get("null_value")) if v is not None]
            got = F.when(got.isNull() | got.isin(*legal), got).otherwise(F.raise_error(F.concat(F.lit(f"{rule['id']}: illegal value "), got)))
        item = F.struct(
            F.lit(rule["criterion"]).alias("criterion_id"), got.alias("value"), F.lit(rule["id"]).alias("rule_id"), F.lit(rule["from_field"]).alias("source_field"), value.alias("source_value"),
            F.lit(rule.get("directness", "explicit")).alias("directness"), F.lit(rule.get("covers", "full")).alias("covers"), F.lit(rule.get("claim_review_status") or mapping["claim_review_status"]).alias("review_status"),
        )
        out.append(F.when(hit & got.isNotNull(), item))
    return records.select(*keys, F.explode(F.array_compact(F.array(*out))).alias("c")).select(*keys, "c.*")


def ordinal_distance(a: Column, b: Column, values: list[str], null_value: str | None) -> Column:
    """Steps between two values of an ordinal criterion; null if either is the null value, an error off the scale."""
    scale = F.array(*[F.lit(v) for v in values])
    x, y = F.array_position(scale, a), F.array_position(scale, b)
    none = F.lit(False) if null_value is None else (a == null_value) | (b == null_value)
    return F.when(none, None).when((x == 0) | (y == 0), F.raise_error(F.concat(F.lit("off the scale: "), a, F.lit(", "), b)).cast("int")).otherwise(F.abs(x - y).cast("int"))


def claim_confidence(directness: Column, n_sources: Column) -> Column:
    return F.when((directness == "explicit") & (n_sources >= 2), "high").when(directness.isin("explicit", "derived"), "medium").otherwise("low")


def reconcile_claims(df: DataFrame, keys: list[str]) -> DataFrame:
    """One value per criterion: most direct, then most independent; the declared policy, an extension."""
    direct = F.when(F.col("directness") == "explicit", 2).when(F.col("directness") == "derived", 1).otherwise(0)
    return df.groupBy(*keys, "criterion_id").agg(F.max_by("value", F.struct(direct.alias("d"), F.col("independence").alias("i"), F.col("value").alias("v"))).alias("value"), F.count_distinct("value").alias("n_values"))
