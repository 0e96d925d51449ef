"""Full history of changing attributes (type-two dimension).

The dimension holds one row per version: key columns, attribute columns,
``attr_hash``, ``first_seq`` / ``last_seq`` (the periods it was seen in),
``valid_from``, ``valid_to`` (labels of periods; open versions end at
``OPEN_END``) and ``is_current``.

``merge`` brings the states of one period (or of several) into the dimension:
the attribute hashes of open versions are compared with those of the states, a
differing or missing one closes the version with the period's label, and changed
or new keys get a new open version.  ``MergedHistory`` keeps the dimension stored:
its open versions as one table that each merge writes anew, its closed versions
as parts that are only added to.  So a period costs its own states and the open
versions, whatever the length of the history, and a merge that is lost is
repeated from the tables before it.

Periods of different scopes (institutions) do not depend on each other, so the
n-th periods of all scopes are merged together.  ``merge`` also takes several
periods at once, with the same rows as period by period (tested): a back-fill of
years can be one shuffle by key.

Hot groups: the shuffle is by the whole entity key, so an owner with a third of
all rows spreads over all partitions.  Nothing is broadcast but the period list.

Edge cases (tested): null attributes equal the empty string once folded; rows
delivered twice count once; of several rows of a key in one period the one with
the greatest ``order_by`` wins, ties go to the greatest ``tie_break``; an empty
batch closes versions that are absent from later periods; extra columns are
ignored; null keys form a key of their own.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions.text import fold
from archivum.session import Scratch, column, table

OPEN_END = "9999-12-31"


def number_periods(periods: DataFrame, scope: list[str], label: str, tie_break: str) -> DataFrame:
    """Add ``seq`` (1, 2, ... within scope) and ``next_label`` to a list of periods; equal labels are ordered by ``tie_break``."""
    w = Window.partitionBy(*scope).orderBy(label, tie_break)
    return periods.withColumn("seq", F.row_number().over(w)).withColumn("next_label", F.lead(label).over(w))


def states_of(rows: DataFrame, keys: list[str], attrs: dict[str, str], order_by: str, tie_break: str) -> DataFrame:
    """One state per key and period: the latest row, attributes folded, and their hash.

    ``rows`` carries ``seq``, ``label`` and ``next_label``.  ``attrs`` maps output
    names to input columns.
    """
    slim = rows.select(*[column(k) for k in keys], "seq", "label", "next_label", column(order_by).alias("__o"), column(tie_break).alias("__t"), *[column(c).alias(f"__{a}") for a, c in attrs.items()])
    # The same clustering serves this window and those of merge(): one exchange in all.
    w = Window.partitionBy(*keys, "seq").orderBy(F.col("__o").desc_nulls_last(), F.col("__t").desc_nulls_last())
    latest = slim.repartition(*[column(k) for k in keys]).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    folded = latest.select(*keys, "seq", "label", "next_label", *[fold(F.col(f"__{a}")).alias(a) for a in attrs])
    return folded.withColumn("attr_hash", attribute_hash(list(attrs)))


def attribute_hash(attrs: list[str]):
    """128 bits over the attributes; lengths are part of it, so values cannot run into each other."""
    parts = [x for a in attrs for x in (F.length(a), F.col(a))]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


def merge(dimension: DataFrame | None, states: DataFrame, periods: DataFrame, keys: list[str], attrs: list[str], scope: list[str]) -> DataFrame:
    """Merge ``states`` of later periods into ``dimension``; returns the whole new dimension.

    ``periods`` (scope, seq, label, next_label) lists every period known so far;
    it is small and joined to the open versions only.
    """
    new = states.select(*keys, *attrs, "attr_hash", F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"), F.col("label").alias("valid_from"), "next_label")
    if dimension is not None:
        nexts = periods.select(*scope, F.col("seq").alias("last_seq"), "next_label")
        still_open = dimension.where("is_current").select(*keys, *attrs, "attr_hash", "first_seq", "last_seq", "valid_from").join(nexts, [*scope, "last_seq"], "left")
        new = new.unionByName(still_open)
    w = Window.partitionBy(*keys).orderBy("first_seq")
    starts = ~(F.lag("last_seq").over(w).eqNullSafe(F.col("first_seq") - 1) & F.lag("attr_hash").over(w).eqNullSafe(F.col("attr_hash")))
    ends = ~(F.lead("first_seq").over(w).eqNullSafe(F.col("last_seq") + 1) & F.lead("attr_hash").over(w).eqNullSafe(F.col("attr_hash")))
    edges = new.withColumn("__s", starts).withColumn("__e", ends).where("__s or __e")
    # Of a version only its first and last row are left; the first takes over where the last one ends.
    for c in ("last_seq", "next_label"):
        edges = edges.withColumn(f"__{c}", F.when(F.col("__e"), F.col(c)).otherwise(F.lead(c).over(w)))
    versions = edges.where("__s").select(
        *keys, *attrs, "attr_hash", "first_seq", F.col("__last_seq").alias("last_seq"), "valid_from",
        F.coalesce("__next_label", F.lit(OPEN_END)).alias("valid_to"), F.col("__next_label").isNull().alias("is_current"),
    )
    return versions if dimension is None else versions.unionByName(dimension.where("not is_current"))


class MergedHistory:
    """A stored dimension that periods are merged into one after another."""

    def __init__(self, keys: list[str], attrs: list[str], scope: list[str], scratch: Scratch):
        self.keys, self.attrs, self.scope, self.scratch = keys, attrs, scope, scratch
        self.current: DataFrame | None = None
        self.closed: list[DataFrame] = []
        self.turn = 0

    def update(self, states: DataFrame, arrivals: DataFrame) -> None:
        """Merge one period of each scope: ``arrivals`` (scope, seq, label) lists the periods, ``states`` their rows.

        Every open version of a scope whose period arrives is either confirmed (same hash) or closed with the
        period's label; versions of other scopes are left as they are.
        """
        keys, attrs, scope = self.keys, self.attrs, self.scope
        new = states.select(*keys, *attrs, "attr_hash", F.col("seq").alias("new_seq"), F.col("label").alias("new_label"))
        if self.current is None:
            opened = new.select(*keys, *attrs, "attr_hash", F.col("new_seq").alias("first_seq"), F.col("new_label").alias("valid_from"))
            self.current = self.scratch.save(opened, "current0")
            return
        old = self.current.select(*[column(k).alias(f"old_{k}") for k in keys], *[F.col(a).alias(f"old_{a}") for a in attrs], F.col("attr_hash").alias("old_hash"), "first_seq", "valid_from")
        match = functools.reduce(lambda x, y: x & y, [column(k).eqNullSafe(column(f"old_{k}")) for k in keys])
        both = old.join(new, match, "full_outer")
        was_there = F.col("old_hash").isNotNull()
        both = both.select(*[F.when(was_there, column(f"old_{k}")).otherwise(column(k)).alias(k) for k in keys], *[c for c in both.columns if c not in keys and c not in [f"old_{k}" for k in keys]])
        both = both.join(F.broadcast(arrivals.select(*scope, F.col("label").alias("arrived"))), scope, "left")
        same = F.col("old_hash").eqNullSafe(F.col("attr_hash"))
        due = F.col("old_hash").isNotNull() & F.col("arrived").isNotNull() & ~same
        kept = F.when(F.col("old_hash").isNotNull() & ~due, F.struct(*[F.col(f"old_{a}").alias(a) for a in attrs], F.col("old_hash").alias("attr_hash"), "first_seq", "valid_from", F.lit(None).cast("string").alias("valid_to")))
        opened = F.when(F.col("attr_hash").isNotNull() & ~same, F.struct(*attrs, "attr_hash", F.col("new_seq").alias("first_seq"), F.col("new_label").alias("valid_from"), F.lit(None).cast("string").alias("valid_to")))
        ended = F.when(due, F.struct(*[F.col(f"old_{a}").alias(a) for a in attrs], F.col("old_hash").alias("attr_hash"), "first_seq", "valid_from", F.col("arrived").alias("valid_to")))
        rows = both.select(*keys, F.explode(F.array_compact(F.array(kept, opened, ended))).alias("v")).select(*keys, "v.*").withColumn("open", F.col("valid_to").isNull())
        self.turn += 1
        merged = self.scratch.save_parts(rows, "open", f"merged{self.turn}")
        # The open rows are the next current versions, the closed ones a part of the history.
        self.current = merged.where("open").drop("valid_to", "open")
        self.closed.append(merged.where("not open").drop("open"))
        if self.turn == 1:
            self.scratch.drop("current0")
        else:
            self.scratch.drop_part(f"merged{self.turn - 1}", "open=true")

    def dimension(self) -> DataFrame | None:
        """All versions; open ones end at ``OPEN_END``."""
        if self.current is None:
            return None
        out = self.current.withColumn("valid_to", F.lit(OPEN_END)).withColumn("is_current", F.lit(True))
        for part in self.closed:
            out = out.unionByName(part.withColumn("is_current", F.lit(False)))
        return out


def as_of(dimension: DataFrame, day: str) -> DataFrame:
    """The versions valid on a day."""
    return dimension.where((F.col("valid_from") <= day) & (F.col("valid_to") > day))


# --- the overlay of institutions ------------------------------------------------

OVERLAY_KEYS = ["institution_id", "institution_format_id"]
OVERLAY_ATTRS = {"risk_level": "local_risk_level", "preservation_action": "local_preservation_action"}


def overlay_periods(runs: DataFrame) -> DataFrame:
    """Completed runs of each institution in the order of as_of_day."""
    done = runs.where("status = 'completed'").select("institution_id", "run_id", F.col("as_of_day").alias("label"))
    return number_periods(done, ["institution_id"], "label", "run_id")


#: Periods of one scope; more are an error and not a cut.
MAX_PERIODS = 10_000


def _overlay_states(overlay: DataFrame, periods: DataFrame) -> DataFrame:
    wanted = overlay.select("run_id", "institution_format_id", *OVERLAY_ATTRS.values(), "recorded_at", "overlay_id")
    # The run's institution holds for all of its rows; runs that did not complete delivered nothing.
    return states_of(wanted.join(periods, "run_id"), OVERLAY_KEYS, OVERLAY_ATTRS, "recorded_at", "overlay_id")


def overlay_history(overlay: DataFrame, runs: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Every version of the risk level and action an institution recorded for a format, all runs in one merge."""
    periods = overlay_periods(runs)
    return merge(dimension, _overlay_states(overlay, periods), periods, OVERLAY_KEYS, list(OVERLAY_ATTRS), ["institution_id"])


def overlay_history_by_runs(overlay: DataFrame, runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same, merged run by run into a stored dimension."""
    periods = scratch.save(overlay_periods(runs), "periods")
    # Written once by period, so that each merge reads its own states only; already placed by entity.
    states = scratch.save_parts(_overlay_states(overlay, periods), "seq", "states")
    history = MergedHistory(OVERLAY_KEYS, list(OVERLAY_ATTRS), ["institution_id"], scratch)
    for seq in range(1, (periods.agg(F.max("seq")).first()[0] or 0) + 1):
        if seq > MAX_PERIODS:
            raise ValueError(f"more than {MAX_PERIODS} periods; merge several of them at once")
        history.update(states.where(F.col("seq") == seq), periods.where(F.col("seq") == seq))
    out = history.dimension()
    return out if out is not None else overlay_history(overlay, runs)


def p1_found(spark, sf_dir):
    dim = overlay_history_by_runs(table(spark, sf_dir, "institution_policy_overlay"), table(spark, sf_dir, "registry_run"), Scratch(spark, "history"))
    return dim.select("institution_id", "institution_format_id", "valid_from", "valid_to")


def p1_current(spark, sf_dir):
    """The open versions with their attributes and the day they are valid from, all runs in one merge."""
    dim = overlay_history(table(spark, sf_dir, "institution_policy_overlay"), table(spark, sf_dir, "registry_run"))
    return dim.where("is_current").select(*OVERLAY_KEYS, *OVERLAY_ATTRS, "valid_from")
