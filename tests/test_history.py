import datetime as dt

from pyspark.sql import functions as F

from archivum.operators import history
from archivum.session import Scratch

RUNS = "run_id string, institution_id string, as_of_day string, status string"
ROWS = "overlay_id bigint, run_id string, institution_format_id string, local_risk_level string, local_preservation_action string, recorded_at timestamp_ntz, extra string"
AT = dt.datetime(2024, 1, 1)


def runs(spark, n=4):
    days = [(f"r{k}", "i", f"2024-0{k}-01", "completed") for k in range(1, n + 1)]
    return spark.createDataFrame([*days, ("rx", "i", "2024-02-15", "failed")], RUNS)


def rows(spark, cells):
    return spark.createDataFrame([(n, r, f, level, action, AT + dt.timedelta(minutes=m), "x") for n, (r, f, level, action, m) in enumerate(cells)], ROWS)


def found(df):
    return sorted((tuple(r) for r in df.select("institution_format_id", "risk_level", "valid_from", "valid_to", "is_current").collect()), key=str)


CELLS = [
    ("r1", "a", "Low", "keep", 0), ("r2", "a", " low ", "KEEP", 0), ("r3", "a", "high", None, 0), ("r4", "a", "High", "", 0),
    ("r1", "b", "low", "x", 0), ("r3", "b", "low", "x", 0), ("rx", "b", "odd", "x", 0),
    ("r2", "c", "first", "x", 0), ("r2", "c", "last", "x", 9), ("r2", "c", "last", "x", 9), ("r4", None, None, None, 0),
]
WANT = [
    ("a", "high", "2024-03-01", "9999-12-31", True), ("a", "low", "2024-01-01", "2024-03-01", False), ("b", "low", "2024-01-01", "2024-02-01", False),
    ("b", "low", "2024-03-01", "2024-04-01", False), ("c", "last", "2024-02-01", "2024-03-01", False),
]


def test_versions_close_on_change_and_on_withdrawal(spark):
    got = history.overlay_history(rows(spark, CELLS), runs(spark))
    assert found(got.where("institution_format_id is not null")) == sorted(WANT)
    assert got.where("institution_format_id is null").count() == 1


def test_merging_run_by_run_equals_merging_at_once(spark):
    dim = None
    for k in range(1, 5):
        batch = rows(spark, CELLS).where((F.col("run_id") == f"r{k}"))
        known = runs(spark).where(F.col("as_of_day") <= f"2024-0{k}-01")
        dim = history.overlay_history(batch, known, dim)
        dim = spark.createDataFrame(dim.collect(), dim.schema)
    assert found(dim.where("institution_format_id is not null")) == sorted(WANT)


def test_empty_batch_closes_what_is_absent(spark):
    first = history.overlay_history(rows(spark, CELLS[:1]), runs(spark, 1))
    first = spark.createDataFrame(first.collect(), first.schema)
    assert first.first()["is_current"]
    later = history.overlay_history(rows(spark, CELLS[:1]).limit(0), runs(spark, 2), first)
    assert found(later) == [("a", "low", "2024-01-01", "2024-02-01", False)]


def test_as_of(spark):
    dim = history.overlay_history(rows(spark, CELLS), runs(spark))
    assert {r[0] for r in history.as_of(dim, "2024-02-20").select("institution_format_id").collect()} == {"a", "c"}


def test_empty_tables(spark):
    assert history.overlay_history(rows(spark, CELLS).limit(0), runs(spark).limit(0)).count() == 0


def test_a_stored_dimension_merged_run_by_run(spark):
    got = history.overlay_history_by_runs(rows(spark, CELLS), runs(spark), Scratch(spark, "t"))
    assert found(got.where("institution_format_id is not null")) == sorted(WANT)
    null = found(got.where("institution_format_id is null"))
    assert null == [(None, "", "2024-04-01", "9999-12-31", True)]
    assert found(got) == found(history.overlay_history(rows(spark, CELLS), runs(spark)))


def test_runs_of_one_day_follow_their_ids(spark):
    two = spark.createDataFrame([("b", "i", "2024-01-01", "completed"), ("a", "i", "2024-01-01", "completed")], RUNS)
    assert [r["run_id"] for r in history.overlay_periods(two).orderBy("seq").collect()] == ["a", "b"]


def test_empty_tables_run_by_run(spark):
    assert history.overlay_history_by_runs(rows(spark, CELLS).limit(0), runs(spark).limit(0), Scratch(spark, "t")).count() == 0
    closed = history.overlay_history_by_runs(rows(spark, CELLS).limit(0), runs(spark), Scratch(spark, "t"))
    assert closed.count() == 0
