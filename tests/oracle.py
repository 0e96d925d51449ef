"""Compare a query with its SQL: columns, and rows as a multiset."""

import math
from collections import Counter


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


def check(name, f, sql, spark, sf, duck):
    got = f(spark, sf)
    columns = sorted(got.columns)
    mine = Counter(tuple(norm(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    assert columns == sorted(duck.sql(sql).columns), name
    true = Counter(tuple(norm(v) for v in r) for r in duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall())
    assert mine == true, (name, list((mine - true).items())[:3], list((true - mine).items())[:3])
