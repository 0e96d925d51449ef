"""Claims with supersession, registry versions, and the events between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.session import Scratch

CLAIM_KEY = ["canonical_id", "criterion_id", "source_id", "source_record_id", "rule_id", "institution_id"]


def _null_safe(df: DataFrame, keys: list[str]) -> DataFrame:
    """A key column that treats nulls as equal."""
    return df.withColumn("__key", F.to_json(F.struct(*keys)))


def supersede(existing: DataFrame, active: DataFrame, run_id: str, keys: list[str] = CLAIM_KEY, managed: str = "rule_id", by_source: bool = False) -> DataFrame:
    """Persist ``active`` over ``existing``: keep history, flip what is gone, never delete.

    A current row is superseded if its rule (or with ``by_source`` its source)
    produced claims in this run and its key is not among them.  A rule that
    produced nothing leaves its claims as they are.  Running it twice with the
    same input changes nothing.
    """
    scope = "source_id" if by_source else managed
    now = _null_safe(active, keys)
    old = _null_safe(existing, keys)
    managed_here = active.select(scope).distinct().withColumn("__managed", F.lit(True))
    marks = old.join(managed_here, scope, "left").join(now.select("__key", F.lit(True).alias("__active")).distinct(), "__key", "left")
    stale = F.col("__managed").isNotNull() & F.col("__active").isNull() & ~F.col("current").eqNullSafe(F.lit(False))
    # A key that is active again replaces its old row.
    kept = marks.where(F.col("__active").isNull()).withColumn("superseded_by_run_id", F.when(stale, F.lit(run_id)).otherwise(F.col("superseded_by_run_id"))).withColumn("current", F.when(stale, F.lit(False)).otherwise(F.col("current")))
    history = marks.where(F.col("__active").isNotNull() & F.col("current").eqNullSafe(F.lit(False)))
    fresh = now.withColumn("current", F.lit(True)).withColumn("superseded_by_run_id", F.lit(None).cast("string"))
    columns = existing.columns
    return kept.select(*columns).unionByName(history.select(*columns)).unionByName(fresh.select(*columns))


def soft_delete(registry: DataFrame, current_ids: DataFrame, when: str) -> DataFrame:
    """Canonicals that are gone stay, marked as removed."""
    here = current_ids.select("canonical_id").distinct().withColumn("__here", F.lit(True))
    gone = F.col("__here").isNull() & ~F.col("current").eqNullSafe(F.lit(False))
    return registry.join(here, "canonical_id", "left").withColumn("removed_at", F.when(gone, F.lit(when)).otherwise(F.col("removed_at"))).withColumn("current", F.when(gone, F.lit(False)).otherwise(F.col("current"))).select(*registry.columns)


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key: new ones replace old ones."""
    old = _null_safe(existing, keys).join(_null_safe(rows, keys).select("__key").distinct(), "__key", "left_anti").drop("__key")
    return old.unionByName(rows, allowMissingColumns=True)


# --- registry versions ------------------------------------------------------------

BULK_COUNT, BULK_SHARE = 25, 0.25


def version_sets(before: DataFrame, now: DataFrame, key: str = "canonical_id") -> DataFrame:
    """(key, side): added, removed or retained, by one full outer join."""
    b, n = before.select(key).distinct().withColumn("__b", F.lit(True)), now.select(key).distinct().withColumn("__n", F.lit(True))
    return b.join(n, key, "full_outer").select(key, F.when(F.col("__b").isNull(), "added").when(F.col("__n").isNull(), "removed").otherwise("retained").alias("side"))


def transitions(before_refs: DataFrame, now_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where ids that are gone went, by shared source records: (old, new) moves, and (old, new) splits.

    Refs: (canonical_id, ref), one row per source record of a format.
    """
    sides = version_sets(before_refs, now_refs)
    gone = before_refs.join(sides.where("side = 'removed'"), "canonical_id", "left_semi")
    owners = now_refs.select("ref", F.col("canonical_id").alias("new_id")).distinct()
    unique = owners.groupBy("ref").agg(F.count("*").alias("n"), F.min("new_id").alias("new_id")).where("n = 1").select("ref", "new_id")
    per = gone.join(owners, "ref").groupBy("canonical_id").agg(F.count_distinct("new_id").alias("n"), F.min("new_id").alias("new_id"))
    moves = per.where("n = 1").select(F.col("canonical_id").alias("old_id"), "new_id")
    shared = gone.join(unique, "ref").select(F.col("canonical_id").alias("old_id"), "new_id").distinct()
    split = shared.withColumn("n", F.count("*").over(Window.partitionBy("old_id"))).where("n > 1").select("old_id", "new_id")
    return moves, split


FIELDS = {"preferred_name": ("name_changed", "info"), "category": ("category_changed", "review"), "identifiers": ("identifiers_changed", "review"), "band": ("hazard_band_changed", "review"), "basis": ("hazard_basis_changed", "info"), "rating": ("native_rating_changed", "info")}


def change_events(before: DataFrame, now: DataFrame, before_refs: DataFrame, now_refs: DataFrame, run_id: str, baseline: bool = False) -> DataFrame:
    """(change_id, run_id, change_type, canonical_id, field, previous, current, severity) between two registry versions.

    Columns used where present: preferred_name, category, identifiers (text), band, basis,
    rating, divergence.  The first version of a registry is a baseline without events.
    A type that hits many formats at once collapses into one row with a sample.
    """
    columns = "change_type string, canonical_id string, field string, previous string, current string, severity string"
    if baseline:
        return before.sparkSession.createDataFrame([], "change_id string, run_id string, " + columns + ", n bigint")
    scratch = Scratch(before.sparkSession, "changes")
    before, now = scratch.save(before, "before"), scratch.save(now, "now")
    before_refs, now_refs = scratch.save(before_refs, "before_refs"), scratch.save(now_refs, "now_refs")
    moves, split = (scratch.save(df, "transitions") for df in transitions(before_refs, now_refs))
    sides = scratch.save(version_sets(before, now), "sides")
    target = moves.groupBy("new_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("old_id")), ",").alias("old"))
    existed = before.select(F.col("canonical_id").alias("new_id")).distinct().withColumn("was", F.lit(True))
    event = lambda df, kind, cid, field=None, prev=None, cur=None, severity="info": df.select(
        kind.alias("change_type") if not isinstance(kind, str) else F.lit(kind).alias("change_type"), cid.alias("canonical_id"), F.lit(field).cast("string").alias("field"),
        (prev if prev is not None else F.lit(None)).cast("string").alias("previous"), (cur if cur is not None else F.lit(None)).cast("string").alias("current"), F.lit(severity).alias("severity"),
    )
    merged = target.join(existed, "new_id", "left")
    moved = event(merged, F.when((F.col("n") > 1) | F.col("was"), "format_merged").otherwise("format_rekeyed"), F.col("new_id"), None, F.col("old"), F.col("new_id"), "review")
    splits = event(split.groupBy("old_id").agg(F.array_join(F.array_sort(F.collect_list("new_id")), ",").alias("new")), "format_split", F.col("old_id"), None, F.col("old_id"), F.col("new"), "review")
    explained_new = target.select(F.col("new_id").alias("canonical_id")).unionByName(split.select(F.col("new_id").alias("canonical_id")))
    explained_old = moves.select(F.col("old_id").alias("canonical_id")).unionByName(split.select(F.col("old_id").alias("canonical_id")))
    added = event(sides.where("side = 'added'").join(explained_new, "canonical_id", "left_anti"), "format_added", F.col("canonical_id"))
    removed = event(sides.where("side = 'removed'").join(explained_old, "canonical_id", "left_anti"), "format_removed", F.col("canonical_id"), severity="review")
    b, n = before.alias("b"), now.alias("n")
    both = b.join(n, F.col("b.canonical_id") == F.col("n.canonical_id"))
    parts = [F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(F.lit(kind).alias("change_type"), F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("previous"), F.col(f"n.{f}").cast("string").alias("current"), F.lit(sev).alias("severity"))) for f, (kind, sev) in FIELDS.items() if f in before.columns and f in now.columns]
    if "divergence" in before.columns and "divergence" in now.columns:
        was, now_ = F.coalesce("b.divergence", F.lit(False)), F.coalesce("n.divergence", F.lit(False))
        parts.append(F.when(was != now_, F.struct(F.when(now_, "divergence_opened").otherwise("divergence_resolved").alias("change_type"), F.lit("divergence").alias("field"), was.cast("string").alias("previous"), now_.cast("string").alias("current"), F.when(now_, "review").otherwise("info").alias("severity"))))
    fields = both.select(F.col("n.canonical_id").alias("canonical_id"), F.explode(F.array_compact(F.array(*parts))).alias("c")).select("c.change_type", "canonical_id", "c.field", "c.previous", "c.current", "c.severity")
    events = moved.unionByName(splits).unionByName(added).unionByName(removed).unionByName(fields)
    events = scratch.save(events, "events")
    counts = events.groupBy("change_type").agg(F.count("*").alias("n"))
    limit = max(BULK_COUNT, int(max(before.count(), now.count()) * BULK_SHARE))
    # One row per change type, of which there are fourteen.
    counts = counts.withColumn("bulk", F.col("n") >= limit)
    events = events.join(F.broadcast(counts), "change_type")
    bulk = events.where("bulk").groupBy("change_type").agg(F.max("n").alias("n"), F.min("canonical_id").alias("first"))
    collapsed = bulk.select(F.lit("source_coverage_changed").alias("change_type"), F.lit(None).cast("string").alias("canonical_id"), F.col("change_type").alias("field"), F.col("first").alias("previous"), F.col("n").cast("string").alias("current"), F.lit("review").alias("severity"), "n")
    out = events.where("not bulk").select("change_type", "canonical_id", "field", "previous", "current", "severity", F.lit(1).cast("bigint").alias("n")).unionByName(collapsed)
    change_id = F.sha2(F.concat_ws("|", F.lit(run_id), *[F.coalesce(c, F.lit("")) for c in ("change_type", "canonical_id", "field", "previous", "current")]), 256)
    return out.select(change_id.alias("change_id"), F.lit(run_id).alias("run_id"), "*")
