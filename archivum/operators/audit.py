"""Coverage, conflicts, drift and status reports: grouped passes over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def criterion_coverage(claims: DataFrame) -> DataFrame:
    """(criterion_id, n_formats, n_corroborated, n_claims): corroborated by two or more sources."""
    per = claims.groupBy("criterion_id", "canonical_id").agg(F.count_distinct("source_id").alias("s"), F.count("*").alias("n"))
    return per.groupBy("criterion_id").agg(F.count("*").alias("n_formats"), F.count_if(F.col("s") >= 2).alias("n_corroborated"), F.sum("n").alias("n_claims"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, keys: list[str], value: str, k: int = 25) -> DataFrame:
    """The k most frequent values of each key; ties by value.  A top-k report, cut on purpose."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(value).asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def field_coverage(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, n_filled, n, percent): in a single pass over the rows."""
    filled = [F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).alias(f"__{f}") for f in fields]
    wide = df.groupBy(key).agg(F.count("*").alias("n"), *filled)
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("n_filled")) for f in fields])).alias("c")
    return wide.select(key, "n", stack).select(key, "c.field", "c.n_filled", "n", F.round(F.col("c.n_filled") * 100 / F.col("n"), 2).alias("percent"))


def population_change(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """One row: how many keys were added, removed, retained, and the share that changed."""
    b, n = before.select(key).distinct().withColumn("__b", F.lit(1)), now.select(key).distinct().withColumn("__n", F.lit(1))
    j = b.join(n, key, "full_outer")
    out = j.agg(F.count_if(F.col("__b").isNull()).alias("n_added"), F.count_if(F.col("__n").isNull()).alias("n_removed"), F.count_if(F.col("__b").isNotNull() & F.col("__n").isNotNull()).alias("n_retained"))
    share = (F.col("n_added") + F.col("n_removed")) / F.greatest(F.col("n_removed") + F.col("n_retained"), F.lit(1))
    return out.withColumn("turnover", F.round(share, 4))


def drift_gate(change: DataFrame, max_rows: int, max_share: float) -> DataFrame:
    """Whether a population change stays within an absolute and a relative bound; both must hold."""
    moved = F.col("n_added") + F.col("n_removed")
    return change.withColumn("within_rows", moved <= max_rows).withColumn("within_share", F.col("turnover") <= max_share).withColumn("passed", F.col("within_rows") & F.col("within_share"))


def migration_gate(df: DataFrame, invariants: dict[str, Column]) -> DataFrame:
    """One row with each invariant over all rows, and their conjunction."""
    out = df.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(name) for name, c in invariants.items()])
    return out.withColumn("passed", reduce(lambda a, b: a & b, [F.col(n) for n in invariants]))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: count, and sum and xor of row hashes; equal tables have equal digests."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return df.agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def level_counts(levels: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A count for every level of the list, zero where there is none."""
    return levels.select(key).join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def affected_share(df: DataFrame, key: str, kind: str, size: int) -> DataFrame:
    return df.groupBy(kind).agg(F.count_distinct(key).alias("n")).withColumn("share", F.round(F.col("n") / size, 4))


def profile_metrics(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.avg(value), 4).alias("avg_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.count(value).alias("n"))
