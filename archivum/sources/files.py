"""Files as rows: content-addressed snapshots, archives, and text with front matter.

Acquisition over the network happens before Spark; a source starts at a folder.
Parsers that need a tree or an archive run per file in ``mapInPandas``, so files
are read where they lie and the driver sees none of them.
"""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivum.session import ship


def snapshots(spark: SparkSession, path: str, source_id: str, previous: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """(source_id, uri, sha256, n_bytes, modified_at, changed, content): ``changed`` unless the uri had this digest before.

    ``previous``: (uri, sha256) of the last acquisition; without it everything is new.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    now = files.select(F.lit(source_id).alias("source_id"), F.col("path").alias("uri"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    if previous is None:
        return now.withColumn("changed", F.lit(True))
    before = previous.select("uri", F.lower("sha256").alias("before")).dropDuplicates(["uri"])
    return now.join(before, "uri", "left").withColumn("changed", ~F.col("before").eqNullSafe(F.col("sha256"))).drop("before")


def cached(stored: DataFrame, uris: DataFrame) -> DataFrame:
    """Offline reuse: stored snapshots of the uris asked for, marked as neither changed nor fetched."""
    return stored.join(uris.select("uri").distinct(), "uri", "left_semi").withColumn("changed", F.lit(False)).withColumn("from_cache", F.lit(True))


def members(name: str, content: bytes, suffixes: tuple[str, ...]) -> Iterator[tuple[str, bytes]]:
    """A file itself, or the members of a zip archive, that have one of the suffixes; damaged archives give nothing."""
    if content[:4] == b"PK\x03\x04" and not name.lower().endswith(".xlsx"):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in sorted(z.infolist(), key=lambda i: i.filename):
                    if not info.is_dir() and info.filename.lower().endswith(suffixes):
                        yield info.filename, z.read(info)
        except zipfile.BadZipFile:
            return
    elif name.lower().endswith(suffixes):
        yield name, content


def parse_files(spark: SparkSession, path: str, suffixes: tuple[str, ...], parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``parse`` finds in each file or archive member."""
    ship(spark)
    names = [c.split()[0].strip("`") for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for uri, content in zip(b["path"], b["content"]):
                rows = [r for name, data in members(uri, content, suffixes) for r in parse(name, data)]
                if rows:
                    yield pd.DataFrame([{k: r.get(k) for k in names} for r in rows], columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def _fault(name: str, data: bytes) -> str | None:
    """Why a file cannot be read as what its suffix says, or None."""
    low = name.lower()
    try:
        if low.endswith((".json", ".jsonl")):
            text = data.decode("utf-8-sig")
            for part in text.splitlines() if low.endswith(".jsonl") else [text]:
                if part.strip():
                    json.loads(part)
        elif low.endswith(".xml"):
            ET.fromstring(data)
        elif low.endswith((".csv", ".md", ".txt")):
            data.decode("utf-8-sig")
        elif low.endswith((".xlsx", ".zip")):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                bad = z.testzip()
                return f"damaged member {bad}" if bad else None
    except (ValueError, ET.ParseError, zipfile.BadZipFile) as e:
        return f"{type(e).__name__}: {e}"[:500]
    return None


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, reason) of every file and archive member under ``path`` that cannot be read; the adapters leave these out."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uri, content in zip(b["path"], b["content"]):
                name = uri.rsplit("/", 1)[-1]
                if fault := _fault(name, content):
                    rows.append((uri, "", fault))
                elif content[:4] == b"PK\x03\x04" and not name.lower().endswith(".xlsx"):
                    rows += [(uri, m, fault) for m, data in members(uri, content, ("",)) if (fault := _fault(m, data))]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "member", "reason"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, member string, reason string")


def front_matter(text: str) -> tuple[dict[str, str | list[str]], str]:
    """(header, body) of a text that begins with a block between ``---`` lines: key: value, and - items."""
    m = re.match(r"\A﻿?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)(.*)\Z", text, re.S)
    if not m:
        return {}, text
    head: dict[str, str | list[str]] = {}
    key = None
    for line in m.group(1).splitlines():
        if item := re.match(r"\s+-\s+(.*)$|-\s+(.*)$", line):
            if key is not None:
                old = head.get(key)
                head[key] = [*(old if isinstance(old, list) else []), (item.group(1) or item.group(2) or "").strip().strip("'\"")]
        elif pair := re.match(r"([\w][\w .-]*):\s*(.*)$", line):
            key, value = pair.group(1).strip(), pair.group(2).strip()
            if value.startswith("[") and value.endswith("]"):
                head[key] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()]
            else:
                head[key] = value.strip("'\"")
    return head, m.group(2)


def id_list(spark: SparkSession, path: str, column: str = "puid") -> DataFrame:
    """(ord, id, label, notes) of a watch list: text or CSV, with or without a header; the first of equal ids counts."""

    def parse(name: str, data: bytes) -> Iterator[dict]:
        import csv

        rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))) if r and r[0].strip() and not r[0].lstrip().startswith("#")]
        head = [c.strip().lower() for c in rows[0]] if rows else []
        at = {n: head.index(n) for n in (column, "id", "label", "notes") if n in head}
        if column in at or "id" in at:
            rows, where = rows[1:], at.get(column, at.get("id", 0))
        else:
            where = 0
        get = lambda r, i: r[i].strip() if i is not None and i < len(r) else None
        for n, r in enumerate(rows):
            yield {"ord": n, "id": get(r, where), "label": get(r, at.get("label")), "notes": get(r, at.get("notes"))}

    rows = parse_files(spark, path, (".csv", ".txt"), parse, "ord int, id string, label string, notes string").where("id is not null and id != ''")
    from archivum.operators.latest import first_of_each

    return first_of_each(rows.withColumn("__k", F.lower("id")), ["__k"], [F.col("ord"), F.col("id")]).drop("__k")
