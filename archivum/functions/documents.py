"""Nested JSON documents as text: their field paths and a hash of what they mean.

Documents nest to any depth, which column expressions cannot follow, so they are
handled in Arrow batches of a Pandas UDF.  Null and unparsable text give null.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that say when a document was made or seen, and nothing of what it means.
VOLATILE = ("evidence_hash", "computed_at", "created_at", "updated_at", "last_seen_at", "modified_at")
#: List items of which field paths are taken.
FIRST_ITEMS = 5


def _parsed(text):
    try:
        return None if text is None else (json.loads(text),)
    except ValueError:
        return None


def paths_of(value, depth: int) -> set[str]:
    """Dotted paths of a document; every dict or list on the way takes one level of ``depth``, counted from 0."""
    found, todo = set(), [("", value, depth)]
    while todo:
        prefix, v, left = todo.pop()
        if left < 0:
            continue
        if isinstance(v, dict):
            for k, x in v.items():
                path = f"{prefix}.{k}" if prefix else str(k)
                found.add(path)
                todo.append((path, x, left - 1))
        elif isinstance(v, list):
            todo += [(prefix, x, left - 1) for x in v[:FIRST_ITEMS]]
    return found


def meaning_of(value, volatile: frozenset[str]) -> str:
    """One text for all documents that differ only in the order of keys and items and in volatile keys, at any level."""
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k) + ":" + meaning_of(value[k], volatile) for k in sorted(value) if k not in volatile) + "}"
    if isinstance(value, list):
        return "[" + ",".join(sorted(meaning_of(x, volatile) for x in value)) + "]"
    return json.dumps(value)


def field_paths(c: Column, depth: int = 3) -> Column:
    """The sorted distinct field paths of a JSON text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (d := _parsed(t)) is None else sorted(paths_of(d[0], depth)) for t in texts], dtype=object)

    return run(c)


def document_hash(c: Column, volatile: tuple[str, ...] = VOLATILE) -> Column:
    """SHA-256 of what a JSON text means."""
    dropped = frozenset(volatile)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (d := _parsed(t)) is None else hashlib.sha256(meaning_of(d[0], dropped).encode()).hexdigest() for t in texts], dtype=object)

    return run(c)
