"""Edges between source records and formats, and components of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.session import Scratch

MAX_TURNS = 60


def role_of(classes: Column, rules: list[tuple[str, list[str]]], otherwise: str = "other") -> Column:
    """The first role whose class list meets a row's classes; the order of the rules decides."""
    expr = F.lit(otherwise)
    for role, members in reversed(rules):
        expr = F.when(F.coalesce(F.arrays_overlap(classes, F.array(*[F.lit(m) for m in members])), F.lit(False)), role).otherwise(expr)
    return expr


def edges_by_copied_ids(copied: DataFrame, owners: DataFrame) -> DataFrame:
    """(canonical_id, source_record_id, relationship, copied_identifiers): one edge per pair that shares an id.

    copied(source_record_id, kind, value); owners(canonical_id, kind, value).
    """
    hits = copied.distinct().join(owners.distinct(), ["kind", "value"])
    per = hits.groupBy("source_record_id", "canonical_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))), "|").alias("copied_identifiers"))
    many = per.groupBy("source_record_id").agg((F.count("*") > 1).alias("many"))
    return per.join(many, "source_record_id").select("canonical_id", "source_record_id", F.when(F.col("many"), "multi_target_record").otherwise("exact_copied_identifier").alias("relationship"), "copied_identifiers")


def alias_components(pairs: DataFrame, turns: int = MAX_TURNS, prefer: str | None = None) -> DataFrame:
    """(node, component): the smallest node reached over pairs (a, b), of those that begin with ``prefer`` if there are any.

    Large-star and small-star steps in turn: neighbours move to the smallest node
    seen, in a logarithmic number of turns, each a grouped minimum and a join.
    """
    scratch = Scratch(pairs.sparkSession, "aliases")
    edges = pairs.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.save(edges, "t0")
    # A sum over all edges instead of a comparison of both tables; minima only ever fall, so equal sums mean equal edges.
    checksum = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
    before = checksum(edges)
    for turn in range(1, turns + 1):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        up = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(up, "b").select(F.col("m").alias("a"), "b").unionByName(large.join(up, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        new = scratch.save(small, f"t{turn}")
        now = checksum(new)
        edges = new
        if turn > 1:
            scratch.drop(f"t{turn - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    stars = stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    if prefer is None:
        return stars
    named = stars.groupBy("component").agg(F.min(F.struct((~F.col("node").startswith(prefer)).alias("x"), "node"))["node"].alias("named"))
    return stars.join(named, "component").select("node", F.col("named").alias("component"))


def coverage_by_component(components: DataFrame, claims: DataFrame) -> DataFrame:
    """(component, criterion_id, n_claims, n_sources): claims counted for all aliases of a format together.

    claims: canonical_id, criterion_id, source_id; formats without aliases are their own component.
    """
    mine = claims.join(components.select(F.col("node").alias("canonical_id"), "component"), "canonical_id", "left").withColumn("component", F.coalesce("component", "canonical_id"))
    return mine.groupBy("component", "criterion_id").agg(F.count("*").alias("n_claims"), F.count_distinct("source_id").alias("n_sources"))


def claim_turnover(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """One row: claims opened, closed and kept between two sets."""
    b, n = before.select(*keys).distinct().withColumn("__b", F.lit(1)), now.select(*keys).distinct().withColumn("__n", F.lit(1))
    j = b.join(n, keys, "full_outer")
    return j.agg(F.count_if(F.col("__b").isNull()).alias("opened"), F.count_if(F.col("__n").isNull()).alias("closed"), F.count_if(F.col("__b").isNotNull() & F.col("__n").isNotNull()).alias("kept"))
