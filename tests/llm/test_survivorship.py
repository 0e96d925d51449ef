import random

from archivum.llm import survivorship as S
from archivum.session import Scratch

SCHEMA = "key string, record_id bigint, fullness bigint, recency bigint, trust bigint, has_category boolean, has_description boolean"


def brute_front(rows):
    better = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
    dims = lambda r: (r[2], r[3], r[4], -r[1])
    return [r for r in rows if not any(better(dims(o), dims(r)) for o in rows)]


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        cat = max((r for r in mine if r[5]), key=lambda r: (r[4], r[3], -r[1]), default=None)
        des = max((r for r in mine if r[6]), key=lambda r: (r[2], r[3], r[4], -r[1]), default=None)
        out[key] = (cat[1] if cat else -1, des[1] if des else -1)
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        full = rng.choice([0, 0, 3, 5, 9])
        # One group holds half of all records, and in it few hold a category.
        key = "hot" if i % 2 else f"g{rng.randrange(n // 12)}"
        rows.append((key, i, full, rng.choice([S.NO_TIME, 1, 2, 3, rng.randrange(50)]), -rng.choice([1, 2, 3, S.NO_RANK]), rng.random() < (0.05 if key == "hot" else 0.5), full > 0))
    return rows


def test_layers_equal_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed, 600)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r["key"]: (r["category"], r["description"]) for r in S.survivors(df, S.POLICIES, Scratch(spark, "t"), salts=4).collect()}
        assert got == brute(rows)
        front = {(r["key"], r["record_id"]) for r in S.skyline(df, ["key"], 4).collect()}
        assert front == {(r[0], r[1]) for k in {r[0] for r in rows} for r in brute_front([x for x in rows if x[0] == k])}


def test_a_null_of_the_first_layer_is_filled_from_the_next(spark):
    # Record 1 dominates all but holds no category; of the others, 3 precedes 2 in trust.
    rows = [("a", 1, 9, 9, -1, False, True), ("a", 2, 5, 5, -3, True, True), ("a", 3, 4, 4, -2, True, True), ("b", 4, 0, 1, -1, False, False)]
    got = {r["key"]: (r["category"], r["description"]) for r in S.survivors(spark.createDataFrame(rows, SCHEMA), S.POLICIES, Scratch(spark, "t")).collect()}
    assert got == {"a": (3, 1), "b": (-1, -1)}


def test_empty(spark):
    assert S.survivors(spark.createDataFrame([], SCHEMA), S.POLICIES, Scratch(spark, "t")).count() == 0
