"""Registration of queries, and SQL snippets their oracles share."""

from __future__ import annotations

from archivum.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def fold(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '{WS}+', ' ', 'g'))"


def words(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def slug(c: str) -> str:
    dashes = lambda x: f"regexp_replace({x}, '^-+|-+$', '', 'g')"
    body = dashes(f"regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '-', 'g')")
    return f"coalesce(nullif({dashes(f'substring({body}, 1, 80)')}, ''), 'unnamed')"


def query(name: str, sql: str | None = None):
    """Register a function of (tables) as a query; ``tables.name`` reads a table."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


class Tables:
    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return table(self.spark, self.sf_dir, name)
