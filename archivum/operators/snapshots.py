"""Differences between consecutive full snapshots by invertible Bloom lookup tables.

Each record of a content is a pair (key hash, row hash).  Its hash bucket and
``HASHES`` cells of that bucket take part in sums: count, key, row and a checksum,
each hash in halves of 32 bits, so that sums are exact and a cell of n equal
pairs gives the pair back by division.  Of the records only the two hashes are
placed by source and bucket, where repeated ones fall together; each task sums up
the tables of its buckets, those of the earlier content with a minus.  So equal
records cancel before anything else is moved, and what is shuffled and peeled is
the cells that are left.  A bucket whose cells do not come
out empty, or whose digest (an independent sum over the whole bucket) differs
from that of the recovered pairs, is built again with ``GROWTH`` times the cells
and other hash functions, until none is left; a bucket that has as many cells as
records can always be peeled, so that ends.  Recovered keys are looked up in the
records of both contents, which verifies them, drops what was only repeated in
one of them and gives the ids; keys that both hold with other rows are changed.

The number of cells of a step follows its expected difference: it is measured on
one hash class in ``PROBE`` of the records before the tables are laid out.

Hot groups: a source with a third of all rows is cut into hash buckets like any
other; a peeling task holds one bucket's cells.  The number of buckets follows
the size of the largest content, so a bucket holds ``BUCKET_ROWS`` keys or so.

Edge cases (tested): records delivered twice count once (a key with several
different rows in one content is represented by the greatest row hash); null
and empty lists are equal sets; null text is empty text; a snapshot without
records empties its source; the same content twice in a row changes nothing;
keys that are null are one key, the empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions.text import fold, strip
from archivum.session import Scratch, table

HASHES = 3
BUCKET_ROWS = 2048
GROWTH = 4
MOST_TURNS = 20
#: One key in so many is compared directly, to lay out tables for the difference that is there.
PROBE = 64
#: Cells for each differing pair that is expected, and the fewest of a bucket.
CELLS_A_PAIR, FEWEST_CELLS = 1.6, 48
#: Sums that a task holds before it passes them on.
_HELD = 1 << 22


def contents(snapshots: DataFrame) -> DataFrame:
    """For each snapshot the one that stored its content, and the content of the snapshot before it."""
    by_time = Window.partitionBy("source_id").orderBy("acquired_at", "snapshot_id")
    same = Window.partitionBy("source_id", "sha").orderBy("acquired_at", "snapshot_id")
    s = snapshots.select("source_id", "snapshot_id", "acquired_at", F.lower(F.trim("sha256")).alias("sha")).dropDuplicates(["snapshot_id"])
    # A snapshot without a digest can only be its own content.
    s = s.withColumn("content", F.when(F.col("sha").isNull(), F.col("snapshot_id")).otherwise(F.first("snapshot_id").over(same)))
    return s.withColumn("before", F.lag("content").over(by_time)).select("source_id", "snapshot_id", "content", "before")


def record_pairs(records: DataFrame) -> DataFrame:
    """(content, place, key, kh, rh) of every delivered row; ``place`` only says what is kept together."""
    key = F.lower(strip(F.coalesce(F.col("source_record_id"), F.lit(""))))
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    texts = [fold(F.col(c)) for c in ("name", "category", "format_version")]
    digest = F.xxhash64(*[x for t in texts for x in (F.length(t), t)], *[x for c in ("extensions", "mime_types") for x in (F.size(as_set(c)), F.array_join(as_set(c), "\x1f", "\x1e"))])
    return records.select(F.col("snapshot_id").alias("content"), F.col("source_id").alias("place"), key.alias("key"), digest.alias("rh")).withColumn("kh", F.xxhash64("key"))


# --- hashing, the same for whole columns and single pairs -------------------------

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(k: np.ndarray, r: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each pair under a seed."""
    with np.errstate(over="ignore"):
        x = (k.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))) * _C1
        x = (x ^ (x >> np.uint64(29)) ^ r.view(np.uint64)) * _C2
        x = (x ^ (x >> np.uint64(32))) * _C1
    return x ^ (x >> np.uint64(30))


def _low(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _high(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.int64)


def _places(k: np.ndarray, r: np.ndarray, n_cells: np.ndarray | int, turn: int) -> list[np.ndarray]:
    part = np.asarray(n_cells // HASHES, dtype=np.int64)
    return [j * part + (mixed(k, r, 100 * turn + 10 + j) % part.astype(np.uint64)).astype(np.int64) for j in range(HASHES)]


def _weights(k: np.ndarray, r: np.ndarray, seed: int) -> np.ndarray:
    """The seven summands of each pair; ``seed`` is that of the checksum."""
    ku, ru = k.view(np.uint64), r.view(np.uint64)
    return np.stack([np.ones(len(k), dtype=np.int64), _high(ku), _low(ku), _high(ru), _low(ru), _low(mixed(k, r, seed)), _high(mixed(k, r, seed))], axis=1)


_SUMS = ["n", "kh1", "kh2", "rh1", "rh2", "c1", "c2"]
_CHECK, _DIGEST = 1, 2


def _tables(turn: int):
    """Signed sums per (before, content, bucket, cell) of the rows a task reads, without those that are 0; cell -1 holds the digest of the bucket."""
    key = ["before", "content", "bucket", "cell"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def summed() -> pd.DataFrame:
            out = pd.concat(held).groupby(key, sort=False, as_index=False).sum()
            return out[(out[_SUMS] != 0).any(axis=1)]

        for b in batches:
            if b.empty:
                continue
            k, r, sign = b["kh"].to_numpy(dtype=np.int64), b["rh"].to_numpy(dtype=np.int64), b["sign"].to_numpy(dtype=np.int64)[:, None]
            cells = [*_places(k, r, b["n_cells"].to_numpy(dtype=np.int64), turn), np.full(len(k), -1, dtype=np.int64)]
            sums = np.concatenate([*[_weights(k, r, _CHECK) * sign] * HASHES, _weights(k, r, _DIGEST) * sign])
            part = pd.DataFrame({c: np.tile(b[c].to_numpy(), HASHES + 1) for c in key[:3]} | {"cell": np.concatenate(cells)} | {c: sums[:, n] for n, c in enumerate(_SUMS)})
            held.append(part)
            size += len(part)
            if size >= _HELD:
                held = [summed()]
                size = len(held[0])
                # Half full of what does not cancel: it is passed on, as sums can be summed up again.
                if size >= _HELD // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield summed()

    return run


def _peel(turn: int):
    def one(n_cells: int, cell: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The pairs in one bucket's difference and their counts, or None if it cannot be peeled to its digest."""
        table, digest = np.zeros((n_cells, len(_SUMS)), dtype=np.int64), np.zeros(len(_SUMS), dtype=np.int64)
        for c, row in zip(cell, sums):
            if c < 0:
                digest += row
            else:
                table[c] += row
        found = []
        while True:
            live = np.flatnonzero(table[:, 0])
            if not len(live):
                break
            n, s = table[live, 0], table[live]
            # All of a cell's pairs may be one: then its count divides every sum, and the checksum is right.
            whole = (s[:, 1:] % n[:, None] == 0).all(axis=1)
            live, n, q = live[whole], n[whole], s[whole, 1:] // n[whole][:, None]
            inside = ((q >= 0) & (q < 1 << 32)).all(axis=1)
            live, n, q = live[inside], n[inside], q[inside]
            k = ((q[:, 0].astype(np.uint64) << np.uint64(32)) | q[:, 1].astype(np.uint64)).view(np.int64)
            r = ((q[:, 2].astype(np.uint64) << np.uint64(32)) | q[:, 3].astype(np.uint64)).view(np.int64)
            check = mixed(k, r, _CHECK)
            ok = (_low(check) == q[:, 4]) & (_high(check) == q[:, 5])
            # The cell must be one of the pair's own.
            ok &= np.any([p == live for p in _places(k, r, n_cells, turn)], axis=0)
            if not ok.any():
                return None
            pairs = pd.DataFrame({"k": k[ok], "r": r[ok], "n": n[ok]}).drop_duplicates(["k", "r"])
            k, r, n = (pairs[c].to_numpy(dtype=np.int64) for c in ("k", "r", "n"))
            w = _weights(k, r, _CHECK) * n[:, None]
            for p in _places(k, r, n_cells, turn):
                np.subtract.at(table, p, w)
            found.append((k, r, n))
            if len(found) > 10 * n_cells:
                return None
        if table.any():
            return None
        k, r, n = (np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in (zip(*found) if found else ((), (), ())))
        digest -= (_weights(k, r, _DIGEST) * n[:, None]).sum(axis=0) if len(k) else 0
        return None if digest.any() else (k, r, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["before", "content", "bucket", "kh", "failed"]
        for b in batches:
            out = []
            for before, content, bucket, n_cells, cell, *sums in zip(b["before"], b["content"], b["bucket"], b["n_cells"], b["cell"], *[b[c] for c in _SUMS]):
                got = one(int(n_cells), np.asarray(cell, dtype=np.int64), np.stack([np.asarray(x, dtype=np.int64) for x in sums], axis=1))
                if got is None:
                    out.append(pd.DataFrame([(before, content, bucket, 0, True)], columns=columns))
                elif len(got[0]):
                    out.append(pd.DataFrame({"before": before, "content": content, "bucket": bucket, "kh": np.unique(got[0]), "failed": False}))
            if out:
                yield pd.concat(out)

    return run


def _expected(pairs: DataFrame, steps: DataFrame, buckets: int, probe: int) -> DataFrame:
    """(before, content, n_cells) of each step: the keys of one hash class in ``probe`` are compared directly."""
    some = pairs.where(F.pmod(F.xxhash64("kh", F.lit(11)), F.lit(probe)) == 0).select(F.col("content").alias("c"), "kh", "rh")
    by = some.join(_sides(steps), "c").groupBy("before", "content", "kh", "rh").agg(F.sum("sign").alias("n")).where("n != 0")
    found = by.groupBy("before", "content").count()
    cells = F.greatest(F.lit(FEWEST_CELLS), F.ceil((F.coalesce("count", F.lit(0)) + 2) * (probe * CELLS_A_PAIR / buckets)))
    return steps.join(found, ["before", "content"], "left").select("before", "content", (F.ceil(cells / HASHES) * HASHES).cast("int").alias("n_cells"))


def _sides(steps: DataFrame) -> DataFrame:
    """Each step's two contents: (before, content, c, sign)."""
    each = F.explode(F.array(F.struct(F.col("content").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign"))))
    return steps.select("before", "content", each.alias("s")).select("before", "content", "s.c", "s.sign")


def differing_keys(pairs: DataFrame, steps: DataFrame, scratch: Scratch, first_cells: int | None = None, bucket_rows: int = BUCKET_ROWS, probe: int = PROBE) -> DataFrame:
    """(before, content, kh) for every key with a pair in only one of the two contents of a step, and for some that are repeated.

    ``pairs``: (place, content, kh, rh).  ``steps``: distinct (before, content), before and content non-null and different.
    """
    kind = dict(steps.dtypes)["content"]
    largest = pairs.groupBy("content").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // bucket_rows))
    placed = pairs.select("place", "content", F.pmod(F.xxhash64("kh", F.lit(3)), F.lit(buckets)).cast("int").alias("bucket"), "kh", "rh")
    # The same placing serves to drop repeated pairs, and brings the contents of a step together.
    todo = scratch.save(placed.repartition("place", "bucket").dropDuplicates(["place", "content", "bucket", "kh", "rh"]), "hashed").withColumnRenamed("content", "c")
    sized = _expected(todo.withColumnRenamed("c", "content"), steps, buckets, probe) if first_cells is None else steps.withColumn("n_cells", F.lit(-(-first_cells // HASHES) * HASHES))
    sized = scratch.save(sized, "sized")
    turn, failed, done = 0, None, []
    while True:
        sides = _sides(steps).join(sized, ["before", "content"]).withColumn("n_cells", (F.col("n_cells") * GROWTH**turn).cast("int"))
        if failed is not None:
            sides = sides.join(failed, ["before", "content"])
        signed = todo.join(sides, ["c"] if failed is None else ["c", "bucket"]).select("before", "content", "bucket", "sign", "n_cells", "kh", "rh")
        sums = signed.mapInPandas(_tables(turn), f"before {kind}, content {kind}, bucket int, cell int, " + ", ".join(f"{c} bigint" for c in _SUMS))
        diff = sums.groupBy("before", "content", "bucket", "cell").agg(*[F.sum(c).alias(c) for c in _SUMS])
        # Cells that came out empty are not needed to peel.
        live = diff.where(" or ".join(f"{c} != 0" for c in _SUMS))
        tables = live.groupBy("before", "content", "bucket").agg(F.collect_list(F.struct("cell", *_SUMS)).alias("x")).join(sides.select("before", "content", "n_cells").distinct(), ["before", "content"])
        tables = tables.select("before", "content", "bucket", "n_cells", "x.cell", *[f"x.{c}" for c in _SUMS])
        got = scratch.save(tables.mapInPandas(_peel(turn), f"before {kind}, content {kind}, bucket int, kh bigint, failed boolean"), f"peeled{turn}")
        done.append(got.where("not failed").select("before", "content", "kh"))
        failed = got.where("failed").select("before", "content", "bucket")
        if failed.isEmpty():
            break
        turn += 1
        if turn > MOST_TURNS:
            raise RuntimeError(f"tables for {bucket_rows} rows cannot be peeled in {turn} turns")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct()


def snapshot_changes(records: DataFrame, snapshots: DataFrame, **sizes) -> DataFrame:
    """(source_id, source_record_id, snapshot_id, change_kind) for every two consecutive snapshots of a source."""
    spark = records.sparkSession
    scratch = Scratch(spark, "snapshots")
    seq = scratch.save(contents(snapshots), "contents")
    moved = seq.where("before is not null and before != content")
    steps = moved.select("before", "content").distinct()
    pairs = record_pairs(records)
    keys = scratch.save(differing_keys(pairs.select("place", "content", "kh", "rh"), steps, scratch, **sizes), "keys")
    # The records of the keys that were found, in both contents of their step: verified, classified, and their ids.
    sides = keys.select("before", F.col("content").alias("after"), "kh", F.explode(F.array(F.col("content"), F.col("before"))).alias("content"))
    held = sides.join(pairs, ["content", "kh"]).groupBy("before", "after", "content", "key").agg(F.max("rh").alias("rh"))
    now, old = F.col("content") == F.col("after"), F.col("content") == F.col("before")
    both = held.groupBy("before", "after", "key").agg(F.max(F.when(now, F.col("rh"))).alias("rh_now"), F.max(F.when(old, F.col("rh"))).alias("rh_old"))
    kind = F.when(F.col("rh_old").isNull(), "added").when(F.col("rh_now").isNull(), "removed").when(F.col("rh_now") != F.col("rh_old"), "changed")
    named = both.select("before", F.col("after").alias("content"), "key", kind.alias("change_kind")).where("change_kind is not null")
    return named.join(moved, ["before", "content"]).select("source_id", F.col("key").alias("source_record_id"), "snapshot_id", "change_kind")


def p6_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "source_record"), table(spark, sf_dir, "source_snapshot"))
