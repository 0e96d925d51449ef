"""Jobs over claims and registries: materialise, replay, refresh views, preview and gate before a write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.operators.audit import fingerprint
from archivum.operators.claims import version_sets
from archivum.operators.latest import shadowed


def materialize(registry: DataFrame, claims: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(registry with its claims nested, claims without a format).  A format's current claims are bounded by criteria and sources."""
    nested = claims.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("claims"))
    return registry.join(nested, "canonical_id", "left"), claims.join(registry.select("canonical_id"), "canonical_id", "left_anti")


def replay(materialized: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Current claims that a rebuilt registry does not hold yet; replaying twice adds nothing."""
    return claims.where(~F.col("current").eqNullSafe(F.lit(False))).join(materialized.select(*keys).distinct(), keys, "left_anti")


def refreshed_view(legacy: DataFrame, governed: DataFrame, key: str = "source_id") -> DataFrame:
    """Governed rows, and legacy projections of those sources only that have none."""
    return governed.withColumn("origin", F.lit("governed")).unionByName(shadowed(legacy, governed, [key]).withColumn("origin", F.lit("legacy")), allowMissingColumns=True)


def merged_claims(embedded: DataFrame, exported: DataFrame, keys: list[str]) -> DataFrame:
    """Embedded rows first, exported ones where their key is new."""
    return embedded.unionByName(exported.join(embedded.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def draft_uplift(accepted: DataFrame, with_drafts: DataFrame, keys: list[str], by: str = "criterion_id") -> DataFrame:
    """What approving the drafts would add."""
    return with_drafts.join(accepted.select(*keys).distinct(), keys, "left_anti").groupBy(by).agg(F.count("*").alias("n_claims"), F.count_distinct("canonical_id").alias("n_formats"))


def conflict_kinds(answers_per_claim: DataFrame) -> DataFrame:
    """(canonical_id, question_id, classification) of conflicting answers: within one field, or between fields."""
    per = answers_per_claim.groupBy("canonical_id", "question_id", "field").agg(F.count_distinct("answer_id").alias("n"), F.collect_set("answer_id").alias("a")).where("n > 0")
    all_ = per.groupBy("canonical_id", "question_id").agg(F.max("n").alias("most"), F.count("*").alias("n_fields"), F.size(F.array_distinct(F.flatten(F.collect_list("a")))).alias("n_answers")).where("n_answers > 1")
    kind = F.when(F.col("most") > 1, "same_criterion_evidence_conflict").when(F.col("n_fields") > 1, "composite_field_aggregation").otherwise("unclassified_conflict")
    return all_.select("canonical_id", "question_id", kind.alias("classification"))


def impact(baseline: DataFrame, augmented: DataFrame) -> DataFrame:
    """How a second build differs from a first one: formats added, removed and retained, by count."""
    return version_sets(baseline, augmented).groupBy("side").agg(F.count("*").alias("n"))


def simulate(table: DataFrame, change: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """A changed source tried out on a view: digests before and after, the stored table untouched."""
    before, after = fingerprint(table, columns), fingerprint(change(table), columns)
    return before.withColumn("state", F.lit("before")).unionByName(after.withColumn("state", F.lit("after")))


def guarded(gate: DataFrame, write: Callable[[], None]) -> bool:
    """Write only if every row of the gate has passed."""
    if gate.where(~F.coalesce(F.col("passed"), F.lit(False))).isEmpty():
        write()
        return True
    return False


def storage_status(tables: dict[str, DataFrame], key: str = "canonical_id") -> DataFrame:
    """Rows and distinct keys of each table."""
    parts = [df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).withColumn("collection", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("collection", "n_rows", "n_keys")
