"""Latest-per-key, runs and incremental augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.session import with_columns_free


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` has to be total (add an ordinal), so the result is the same on every run."""
    n, *_ = with_columns_free(df, "__n")
    w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First occurrence wins (null keys are equal to each other)."""
    n, *_ = with_columns_free(df, "__n")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def latest_completed(runs: DataFrame, scope: list[str], finished: str = "finished_at", run: str = "run_id") -> DataFrame:
    """The completed run that finished last, ties by run id; a failed run never counts, however new."""
    best = runs.where("status = 'completed'").groupBy(*scope).agg(F.max(F.struct(finished, run)).alias("m"))
    return best.select(*scope, F.col(f"m.{run}").alias(run), F.col(f"m.{finished}").alias(finished))


def augment(fresh: DataFrame, stored: DataFrame, latest_runs: DataFrame, source: str = "source_id", run: str = "run_id") -> DataFrame:
    """Fresh rows, and for sources that were not refreshed the stored rows of their last completed run.

    Sources without any completed run fall back to the latest stored row of each record.
    """
    refreshed = fresh.select(source).distinct()
    reused = stored.join(refreshed, source, "left_anti")
    known = latest_runs.select(source, run)
    by_run = reused.join(known, [source, run], "left_semi")
    legacy = latest(reused.join(known.select(source).distinct(), source, "left_anti"), [source, "source_record_id"], [F.col(run), F.col("src_ord")])
    return fresh.withColumn("reused", F.lit(False)).unionByName(by_run.unionByName(legacy).withColumn("reused", F.lit(True)), allowMissingColumns=True)


def shadowed(legacy: DataFrame, governed: DataFrame, keys: list[str]) -> DataFrame:
    """Legacy rows without a governed row of the same key; rows with a null in the key are kept."""
    return legacy.join(governed.select(*keys).distinct(), keys, "left_anti")


def run_source_status(runs: DataFrame) -> DataFrame:
    """Runs by status for each institution, zero-filled."""
    return runs.groupBy("institution_id").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.coalesce(F.col("status") != "completed", F.lit(True))).alias("n_other"), F.max(F.when(F.col("status") == "completed", F.col("as_of_day"))).alias("last_day")
    )
