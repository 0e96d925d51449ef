"""Risk: two estimators of hazard, and synthesis of governed levels that never averages.

Native scores are carried along and never added up; levels are compared by rank
only, the most specific scope decides, and disagreement stays visible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions.normalize import LEVEL_RANK, SCOPE_RANK, match_value, rank_of, semantic_level
from archivum.session import collect_bounded

#: Upper ends of the hazard bands and the score of each band (fixed values).
BAND_ENDS = ((1.49, "Low"), (2.49, "Moderate"))
BAND_SCORE = {"Low": 1.0, "Moderate": 2.0, "High": 3.0}
DIVERGENCE = 0.5
#: The nine fields that make two assessments the same.
ASSESSMENT_KEY = ["canonical_id", "source_id", "source_record_id", "native_label", "native_score", "native_scale", "semantic_level", "scope_type", "scope_name"]


def score_band(score: Column) -> Column:
    band = F.when(score.isNull(), F.lit(None).cast("string"))
    for end, name in BAND_ENDS:
        band = band.when(score <= end, name)
    return band.otherwise("High")


def reconcile_hazard(external: Column, institution: Column, threshold: float = DIVERGENCE) -> Column:
    """External and local estimates of one quantity: agreement confirms, disagreement follows the institution and asks for review."""
    apart = F.abs(external - institution)
    basis = (
        F.when(external.isNull() & institution.isNull(), "no_estimator_available").when(external.isNull(), "institution_only").when(institution.isNull(), "external_only")
        .when(apart <= threshold, "corroborated").otherwise("institution_override")
    )
    rating = F.when(basis.isin("institution_only", "institution_override"), institution).otherwise(external)
    return F.struct(
        rating.isNotNull().alias("assessed"), rating.alias("rating"), score_band(rating).alias("band"), basis.alias("basis"), F.round(apart, 3).alias("divergence"),
        F.when(basis == "corroborated", "high").when(basis.isin("institution_only", "external_only"), "medium").otherwise("low").alias("confidence"),
        (basis == "institution_override").alias("divergence_flag"), basis.isin("no_estimator_available", "institution_override").alias("review_required"),
    )


def distinct_assessments(df: DataFrame, order: str) -> DataFrame:
    """The first of equal assessments; nulls are equal to each other."""
    w = Window.partitionBy(*ASSESSMENT_KEY).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def synthesize(df: DataFrame, key: str = "canonical_id") -> DataFrame:
    """Scope-aware synthesis: the most specific scope that has a level decides, by its highest level.

    Columns used: key, semantic_level, scope_type, source_id.  Rows are first summed
    up by key, scope and level, so a key with very many rows is a few rows after the
    map side, before a window looks at all of a key.
    """
    ranked = df.withColumn("level_rank", rank_of(semantic_level(F.col("semantic_level")), LEVEL_RANK)).withColumn("scope_rank", F.coalesce(rank_of(F.col("scope_type"), SCOPE_RANK, 5), F.lit(5)))
    few = ranked.groupBy(key, "scope_rank", "level_rank").agg(
        F.count("*").alias("n"), F.collect_set("source_id").alias("sources"), F.collect_set(F.when(F.col("level_rank").isNotNull(), F.nullif(F.trim("scope_type"), F.lit("")))).alias("scopes")
    )
    w = Window.partitionBy(key)
    scored = few.withColumn("best_scope", F.min(F.when(F.col("level_rank").isNotNull(), F.col("scope_rank"))).over(w))
    scored = scored.withColumn("primary", F.col("level_rank").isNotNull() & (F.col("scope_rank") == F.col("best_scope")))
    primary = F.when(F.col("primary"), F.col("level_rank"))
    context = F.when(F.col("level_rank").isNotNull() & ~F.col("primary"), F.col("level_rank"))
    out = scored.groupBy(key).agg(
        F.max(primary).alias("level_rank"), F.min(primary).alias("lowest_rank"), F.min("best_scope").alias("scope_rank"), F.coalesce(F.sum(F.when(primary.isNotNull(), F.col("n"))), F.lit(0)).alias("n_primary"), F.coalesce(F.sum(F.when(context.isNotNull(), F.col("n"))), F.lit(0)).alias("n_context"),
        F.sort_array(F.collect_set(primary)).alias("primary_ranks"), F.sort_array(F.collect_set(context)).alias("context_ranks"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("primary"), F.col("sources")))))), ",").alias("deciding_sources"),
        F.size(F.array_distinct(F.flatten(F.collect_list("scopes")))).alias("n_scopes"),
    )
    names = F.create_map(*[x for n, r in LEVEL_RANK.items() for x in (F.lit(r), F.lit(n))])
    spread = F.col("level_rank") - F.col("lowest_rank")
    return out.select(
        key, F.col("level_rank").isNotNull().alias("assessed"), names[F.col("level_rank")].alias("level"), "level_rank", "scope_rank", "n_primary", "n_context", spread.alias("spread"), "deciding_sources",
        F.when(F.col("n_primary") == 0, "low").when(F.col("n_primary") == 1, "medium").when(spread == 0, "high").when(spread == 1, "medium").otherwise("low").alias("confidence"),
        (F.size("primary_ranks") > 1).alias("source_divergence"), (F.col("n_scopes") > 1).alias("scope_divergence"), (F.size(F.array_except("context_ranks", "primary_ranks")) > 0).alias("cross_scope_level_divergence"),
    )


def normalize_assessments(df: DataFrame, rules: list[dict]) -> DataFrame:
    """First matching source rule, then its first mapped field.

    A rule: ``source_match`` (column to value; empty matches all), ``role``,
    ``value_fields``, ``value_map`` (folded), ``accept_existing``, ``default_scope``.
    The rules become one expression; rows are never joined to rules.
    """
    level, role, rule_id, scope, status = (F.lit(None).cast("string") for _ in range(5))
    for n, rule in reversed(list(enumerate(rules))):
        hit = F.lit(True)
        for field, value in rule.get("source_match", {}).items():
            hit = hit & (F.coalesce(match_value(F.col(field)), F.lit("")) == value.strip().lower())
        table = rule.get("value_map", {})
        found = []
        for field in rule["value_fields"]:
            if table:
                found.append(F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0].strip().lower(), kv[1])])[match_value(F.col(field))])
            if field == "semantic_level" and rule.get("accept_existing"):
                found.append(semantic_level(F.col(field)))
        mapped = F.coalesce(*found) if found else F.lit(None).cast("string")
        level, status = F.when(hit, mapped).otherwise(level), F.when(hit, F.when(mapped.isNull(), "unmapped_value").otherwise("mapped")).otherwise(status)
        role, rule_id = F.when(hit, F.lit(rule.get("role", "headline"))).otherwise(role), F.when(hit, F.lit(rule.get("rule_id", str(n)))).otherwise(rule_id)
        scope = F.when(hit, F.lit(rule.get("default_scope"))).otherwise(scope)
    return df.select(
        *[c for c in df.columns if c not in ("semantic_level", "scope_type")], level.alias("semantic_level"), role.alias("role"), rule_id.alias("rule_id"),
        F.coalesce(status, F.lit("unmapped_source")).alias("mapping_status"), F.coalesce(F.nullif(F.trim("scope_type"), F.lit("")), scope).alias("scope_type"),
    )


def policy_synthesis(df: DataFrame, policy: dict, key: str = "canonical_id") -> DataFrame:
    """Synthesis by a policy: ``scope`` (most_specific | all_mapped), ``broader`` (context | include),
    ``aggregate`` (highest | lowest | majority), ``tie`` (highest | lowest), ``missing`` (exclude | unassessed_if_any_unmapped).

    Takes the output of ``normalize_assessments``.  Numeric aggregation is not offered.
    """
    if policy.get("numeric", "forbidden") != "forbidden":
        raise ValueError("native scores of different scales are not aggregated")
    rows = df.where(F.col("role").isin(*policy.get("headline_roles", ["headline"])) | F.col("role").isNull())
    rows = rows.withColumn("rank", rank_of(F.col("semantic_level"), LEVEL_RANK)).withColumn("scope_rank", F.coalesce(rank_of(F.col("scope_type"), policy.get("scopes", SCOPE_RANK), policy.get("unknown_scope", 5)), F.lit(5)))
    # A few rows per key from here on.
    rows = rows.groupBy(key, "scope_rank", "rank").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    if policy.get("missing") == "unassessed_if_any_unmapped":
        rows = rows.withColumn("rank", F.when(~F.bool_or(F.col("rank").isNull()).over(w), F.col("rank")))
    if policy.get("scope", "most_specific") == "most_specific" and policy.get("broader", "context") == "context":
        rows = rows.withColumn("__best", F.min(F.when(F.col("rank").isNotNull(), F.col("scope_rank"))).over(w)).withColumn("rank", F.when(F.col("scope_rank") == F.col("__best"), F.col("rank")))
    how = policy.get("aggregate", "highest")
    if how == "majority":
        sign = 1 if policy.get("tie", "highest") == "highest" else -1
        votes = rows.groupBy(key, "rank").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rank").isNotNull(), F.col("n")).otherwise(0)).alias("m"))
        best = votes.groupBy(key).agg(F.max_by("rank", F.when(F.col("rank").isNotNull(), F.struct("n", sign * F.col("rank")))).alias("rank"), F.sum("m").alias("n_counted"))
    else:
        best = rows.groupBy(key).agg((F.max if how == "highest" else F.min)("rank").alias("rank"), F.sum(F.when(F.col("rank").isNotNull(), F.col("n")).otherwise(0)).alias("n_counted"))
    names = F.create_map(*[x for n, r in LEVEL_RANK.items() for x in (F.lit(r), F.lit(n))])
    return best.select(key, names[F.col("rank")].alias("level"), "rank", "n_counted")


def band_of(df: DataFrame, bands: DataFrame, score: str = "score") -> DataFrame:
    """Band by ranges that may have gaps; a score outside all of them is an error, not a guess.

    ``bands`` (band, min_score, max_score) is a short list and becomes one expression; the first that fits counts.
    """
    listed = collect_bounded(bands.select("band", "min_score", "max_score").orderBy("min_score", "band"), 1000, "the bands")
    band = F.when(F.col(score).isNull(), F.lit(None).cast("string"))
    for b in listed:
        band = band.when(F.col(score).between(b["min_score"], b["max_score"]), b["band"])
    return df.withColumn("band", band.otherwise(F.raise_error(F.concat(F.lit("no band for score "), F.col(score).cast("string")))))


def rank_by_risk(df: DataFrame) -> DataFrame:
    """Highest band first, then score, then label; bands that are unknown come last."""
    order = F.coalesce(rank_of(F.col("band"), {"Low": 0, "Moderate": 1, "High": 2, "Critical": 3}), F.lit(-1))
    return df.orderBy(order.desc(), F.col("score").desc_nulls_last(), F.lower("label"), "canonical_id")
