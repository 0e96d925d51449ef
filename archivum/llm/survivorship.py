"""One surviving record per group of duplicates, each field with the best value there is.

Skyline selection.  Records of a group are compared as wholes in completeness
(how much of a value the leading field holds), recency and trust; the smaller id
is the last dimension, so that ties are settled.  A record is dominated if
another is at least as good in all of them and better in one; the undominated
records are the first dominance layer.

A lexicographic policy per field picks one record of the layer.  If that record
holds a value for the field, the field is settled: everything below the layer is
dominated, so no later record can precede it in any order made of the
dimensions.  If it does not, the field is a null to be filled: the next layer is
computed among the remaining records that hold the field (others could not fill
it), and the policy picks from both layers' holders.  As that layer's pick holds a
value, the field is then settled; so two layers per field are the most that can
be needed, however deep the dominance chains of a group are.

Scale: a group is cut into ``SALTS`` sub-groups by record id.  Each sub-group is
streamed in sorted order through a block-nested-loop skyline that holds the
undominated records only; the skylines of the sub-groups are merged by a second
pass of the same kind over what is left.  No group is ever gathered, no pair is
ever emitted, and a group with a third of all records costs each task
1/``SALTS`` of it.  Later layers read only the groups with an open field.

Edge cases (tested): repeated rows count once; null recency is the oldest, an
unknown source ranks after all others; ties in all dimensions go to the smallest
id; a field for which no record has a value gives -1; null group keys are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions.text import is_missing, squeeze
from archivum.session import Scratch, collect_bounded, table

SALTS = 32
#: Rank of an unknown source, and time of an unknown date.
NO_RANK, NO_TIME = 1 << 30, -(1 << 62)


_DIMS = ("fullness", "recency", "trust", "record_id")


class _Front:
    """Undominated rows of one run; rows come by fullness, recency and trust downwards and by id upwards."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.dims = np.zeros((16, 3), dtype=np.int64)

    def offer(self, row: tuple, recency: int, trust: int, record_id: int) -> None:
        # A later row is never better in fullness, so three dimensions decide; equal rows cannot both be kept, as ids differ.
        held = self.dims[: len(self.rows)]
        if ((held[:, 0] >= recency) & (held[:, 1] >= trust) & (held[:, 2] <= record_id)).any():
            return
        if len(self.rows) == len(self.dims):
            self.dims = np.concatenate([self.dims, np.zeros_like(self.dims)])
        self.dims[len(self.rows)] = recency, trust, record_id
        self.rows.append(row)


def _front(width: int, run_columns: list[str], columns: list[str]):
    """Per run of equal ``run_columns`` (rows coming sorted) the undominated rows, as ``columns``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, front, out = None, _Front(), []
        for b in batches:
            for key, row, r, t, i in zip(b[run_columns].itertuples(index=False, name=None), b[columns].itertuples(index=False, name=None), b["recency"].tolist(), b["trust"].tolist(), b["record_id"].tolist()):
                if key != now:
                    out += front.rows
                    now, front = key, _Front()
                front.offer(row, r, t, i)
            if len(out) >= width:
                yield pd.DataFrame(out, columns=columns)
                out = []
        out += front.rows
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def skyline(candidates: DataFrame, by: list[str], salts: int = SALTS) -> DataFrame:
    """Undominated rows of each group ``by``; ``candidates`` holds ``by``, fullness, recency, trust, record_id and others."""
    columns = candidates.columns
    order = [F.col("fullness").desc(), F.col("recency").desc(), F.col("trust").desc(), F.col("record_id")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    schema = candidates.schema
    local = salted.repartition(*by, "salt").sortWithinPartitions(*by, "salt", *order).mapInPandas(_front(10_000, [*by, "salt"], columns), schema)
    return local.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(_front(10_000, by, columns), schema)


#: Order in which the dimensions decide, per field; the smaller id comes last in every policy.
Policy = dict[str, tuple[str, ...]]


def _rank(order: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(order)], (-F.col("record_id")).alias("id"))


def survivors(records: DataFrame, policies: Policy, scratch: Scratch, salts: int = SALTS) -> DataFrame:
    """(key, one record_id per field): which record each field is taken from, -1 if none has a value.

    ``records``: key, record_id, fullness, recency, trust, and a boolean ``has_<field>`` for each field of ``policies``.
    """
    whole = scratch.save(records.select("key", *_DIMS, *[f"has_{f}" for f in policies]), "records")
    first = scratch.save(skyline(whole, ["key"], salts), "layer1")
    # Per field: the pick of the layer, whether it holds a value, and the best holder of the layer.
    picks = first.groupBy("key").agg(
        *[F.max(F.struct(_rank(o).alias("rank"), F.col(f"has_{f}").alias("holds"))).alias(f"top_{f}") for f, o in policies.items()],
        *[F.max(F.when(F.col(f"has_{f}"), _rank(o))).alias(f"best_{f}") for f, o in policies.items()],
    )
    picks = scratch.save(picks, "picks")
    open_ = picks.select("key", F.explode(F.array_compact(F.array(*[F.when(~F.col(f"top_{f}.holds"), F.lit(f)) for f in policies]))).alias("field"))
    holders = whole.select("key", *_DIMS, F.explode(F.array_compact(F.array(*[F.when(F.col(f"has_{f}"), F.lit(f)) for f in policies]))).alias("field"))
    # The next layer, only where a field is open, among the records that can fill it.
    second = skyline(holders.join(open_, ["key", "field"], "left_semi"), ["key", "field"], salts)
    fills = second.groupBy("key").agg(*[F.max(F.when(F.col("field") == f, _rank(o))).alias(f"fill_{f}") for f, o in policies.items()])
    chosen = lambda f: F.coalesce(-F.greatest(F.col(f"best_{f}"), F.col(f"fill_{f}"))["id"], F.lit(-1)).alias(f)
    return picks.join(fills, "key", "left").select("key", *[chosen(f) for f in policies])


POLICIES: Policy = {"category": ("trust", "recency"), "description": ("fullness", "recency", "trust")}


def _entries(spark, sf_dir) -> DataFrame:
    """Registry entries with the trust rank of the source their record came from; each entry once.

    Of rows that share an id but differ the greatest counts, field order as written here.
    """
    fields = ["updated_at", "preferred_name", "category", "description", "src_ord"]
    registry = table(spark, sf_dir, "format_registry").where("canonical_id is not null and entry_id is not null")
    registry = registry.groupBy("entry_id", "canonical_id").agg(F.max(F.struct(*fields)).alias("r")).select("entry_id", "canonical_id", "r.*")
    source = table(spark, sf_dir, "source_record").where("src_ord is not null").groupBy("src_ord").agg(F.min("source_id").alias("source_id"))
    trust = table(spark, sf_dir, "source_trust").groupBy("source_id").agg(F.min("trust_rank").alias("trust_rank"))
    # Only the records that entries came from are wanted of the much larger source table.
    known = registry.select("src_ord").where("src_ord is not null").distinct().join(source, "src_ord").join(trust, "source_id", "left").select("src_ord", "trust_rank")
    return registry.join(known, "src_ord", "left")


def _records(spark, sf_dir, entries: DataFrame) -> DataFrame:
    tokens = [r[0] for r in collect_bounded(table(spark, sf_dir, "null_token").where("token is not null"), 10_000, "the null tokens")]
    there = lambda c: ~is_missing(F.col(c), tokens)
    return entries.select(
        F.col("canonical_id").alias("key"), F.col("entry_id").alias("record_id"),
        F.when(there("description"), F.length(squeeze(F.col("description")))).otherwise(0).cast("bigint").alias("fullness"),
        F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(NO_TIME)).alias("recency"),
        (-F.coalesce("trust_rank", F.lit(NO_RANK))).cast("bigint").alias("trust"),
        there("category").alias("has_category"), there("description").alias("has_description"),
    )


def p3_found(spark, sf_dir):
    scratch = Scratch(spark, "survivors")
    entries = scratch.save(_entries(spark, sf_dir), "entries")
    several = entries.groupBy("canonical_id").agg(F.min("entry_id").alias("lo"), F.max("entry_id").alias("hi")).where("lo != hi").select("canonical_id")
    best = survivors(_records(spark, sf_dir, entries.join(several, "canonical_id", "left_semi")), POLICIES, scratch)
    return best.select(F.col("key").alias("canonical_id"), *[F.col(f).alias(f"{f}_entry_id") for f in POLICIES])


def p3_survivors(spark, sf_dir):
    """One entry per format: the best value of each field, and the entry it came from."""
    scratch = Scratch(spark, "survivors")
    entries = scratch.save(_entries(spark, sf_dir), "entries")
    best = survivors(_records(spark, sf_dir, entries), POLICIES, scratch)
    value = F.when(F.col("field") == "category", squeeze(F.col("category"))).otherwise(squeeze(F.col("description")))
    long = best.select(F.col("key").alias("canonical_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("entry_id")) for f in POLICIES])).alias("f")).select("canonical_id", "f.*").where("entry_id >= 0")
    held = long.join(entries.select("canonical_id", "entry_id", "category", "description"), ["canonical_id", "entry_id"])
    wide = held.groupBy("canonical_id").agg(
        *[F.max(F.when(F.col("field") == f, value)).alias(f) for f in POLICIES],
        *[F.max(F.when(F.col("field") == f, F.col("entry_id"))).alias(f"{f}_entry_id") for f in POLICIES],
    )
    return entries.groupBy("canonical_id").agg(F.count("*").alias("n_entries")).join(wide, "canonical_id", "left")
