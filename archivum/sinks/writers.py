"""Sinks: keyed tables, JSON, CSV, a four-table SQLite export, and rendered reports.

Everything is written by the executors; only bounded summaries are rendered on
the driver, and the SQLite file, a single-file format, is streamed into by it.
"""

from __future__ import annotations

import html
import sqlite3
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.operators.claims import upsert
from archivum.session import _delete, collect_bounded

MAX_REPORT_ROWS = 10_000


class TableStore:
    """Parquet tables by name; each write makes a new version and then moves the pointer, so readers never see half a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, name: str) -> str | None:
        path, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return None
        done = sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(self._fs(f"{s.getPath().toString()}/_SUCCESS")[0]))
        return f"{self.root}/{name}/{done[-1]}" if done else None

    def read(self, name: str) -> DataFrame | None:
        path = self._current(name)
        return None if path is None else self.spark.read.parquet(path)

    def query(self, name: str, **equal) -> DataFrame:
        """Equality scan; None matches null.  The filters reach the Parquet reader."""
        df = self.read(name)
        for k, v in equal.items():
            df = df.where(F.col(k).isNull() if v is None else F.col(k) == v)
        return df

    def write(self, name: str, df: DataFrame) -> None:
        old = self._current(name)
        n = int(old.rsplit("/v", 1)[1].split("-")[0]) + 1 if old else 1
        df.write.parquet(f"{self.root}/{name}/v{n:012d}-{uuid.uuid4().hex[:8]}")
        if old:
            _delete(self.spark, old)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        old = self.read(name)
        self.write(name, rows if old is None else upsert(old, rows, keys))


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines, one row each; ``single`` is for results that are small by nature."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


CSV_COLUMNS = ("canonical_id", "preferred_name", "category", "description", "version", "extensions", "mime_types", "puids", "loc_ids", "nara_ids", "wikidata_ids", "hazard_band", "hazard_basis", "confidence", "n_records", "sources")


def write_csv(df: DataFrame, path: str, columns=CSV_COLUMNS) -> None:
    """Fixed columns in order; lists joined by semicolons, absent columns empty."""
    kinds = dict(df.dtypes)
    out = [(F.array_join(F.col(c), ";") if kinds[c].startswith("array") else F.col(c)).alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*out).write.mode("overwrite").option("header", "true").csv(path)


SQLITE_TABLES = {
    "formats": "canonical_id TEXT PRIMARY KEY, preferred_name TEXT, category TEXT, hazard_band TEXT",
    "identifiers": "canonical_id TEXT, kind TEXT, value TEXT",
    "source_records": "canonical_id TEXT, source_id TEXT, source_record_id TEXT",
    "claims": "canonical_id TEXT, criterion_id TEXT, value TEXT, source_id TEXT",
}


def write_sqlite(tables: dict[str, DataFrame], path: str) -> None:
    """Four tables in one SQLite file; rows arrive partition by partition and are never held together."""
    with sqlite3.connect(path) as db:
        for name, ddl in SQLITE_TABLES.items():
            db.execute(f"DROP TABLE IF EXISTS {name}")
            db.execute(f"CREATE TABLE {name} ({ddl})")
            columns = [c.split()[0] for c in ddl.split(", ")]
            if name in tables:
                rows = (tuple(r) for r in tables[name].select(*columns).toLocalIterator())
                db.executemany(f"INSERT OR REPLACE INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)


def _summary(df: DataFrame) -> tuple[list[str], list]:
    return df.columns, collect_bounded(df, MAX_REPORT_ROWS, "a report section")


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    out = [f"# {title}", ""]
    for name, df in sections.items():
        columns, rows = _summary(df)
        out += [f"## {name}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def html_report(title: str, sections: dict[str, DataFrame]) -> str:
    esc = lambda v: html.escape("" if v is None else str(v))
    out = [f"<!doctype html><meta charset='utf-8'><title>{esc(title)}</title><h1>{esc(title)}</h1>"]
    for name, df in sections.items():
        columns, rows = _summary(df)
        out.append(f"<h2>{esc(name)}</h2><table><tr>" + "".join(f"<th>{esc(c)}</th>" for c in columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows] + ["</table>"]
    return "".join(out)
