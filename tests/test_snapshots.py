import datetime as dt
import random

from archivum.operators import snapshots

REC = "src_ord bigint, snapshot_id int, source_id string, source_record_id string, name string, category string, format_version string, extensions array<string>, mime_types array<string>, kh string"
SNAP = "snapshot_id int, source_id string, acquired_at timestamp_ntz, sha256 string"


def tables(spark, contents, plan):
    """contents: snapshot id to {key: name}; plan: (snapshot id, digest) in order of time."""
    rows = [(n, s, "src", k, v, None, "", None if n % 2 else [], ["b", "a"], "clash") for n, (s, k, v) in enumerate((s, k, v) for s, kv in contents.items() for k, v in kv.items())]
    snaps = [(s, "src", dt.datetime(2024, 1, 1) + dt.timedelta(days=n), d) for n, (s, d) in enumerate(plan)]
    return spark.createDataFrame(rows, REC), spark.createDataFrame(snaps, SNAP)


def found(df):
    return sorted((r["snapshot_id"], r["source_record_id"], r["change_kind"]) for r in df.collect())


def test_changes_and_repeated_contents(spark):
    rows, snaps = tables(spark, {5: {"A ": "x", "b": "y", "c": "z"}, 3: {"a": " X", "b": "w", "d": "z"}}, [(5, "AA"), (3, "bb"), (4, "BB"), (9, "aa")])
    got = found(snapshots.snapshot_changes(rows.unionByName(rows), snaps))
    assert got == sorted([(3, "b", "changed"), (3, "c", "removed"), (3, "d", "added"), (9, "b", "changed"), (9, "c", "added"), (9, "d", "removed")])


def test_small_tables_are_enlarged_until_they_peel(spark):
    rng = random.Random(3)
    old = {f"k{n}": str(rng.random()) for n in range(400)}
    new = {k: (v if n % 2 else v + "!") for n, (k, v) in enumerate(old.items()) if n % 7} | {f"n{n}": "x" for n in range(90)}
    rows, snaps = tables(spark, {1: old, 2: new}, [(1, "a"), (2, "b")])
    want = sorted([(2, k, "removed") for k in old.keys() - new.keys()] + [(2, k, "added") for k in new.keys() - old.keys()] + [(2, k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]])
    assert found(snapshots.snapshot_changes(rows, snaps, first_cells=12, bucket_rows=64)) == want


def test_emptied_source_and_no_rows(spark):
    rows, snaps = tables(spark, {1: {"a": "x"}}, [(1, "a"), (2, "b")])
    assert found(snapshots.snapshot_changes(rows, snaps)) == [(2, "a", "removed")]
    assert snapshots.snapshot_changes(rows.limit(0), snaps.limit(0)).count() == 0
