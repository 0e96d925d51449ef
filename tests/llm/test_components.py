import random

from archivum.llm import components as C


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["root"], set()).add(r["node"])
    return {frozenset(v) for v in out.values()}


def test_levels_equal_brute_force(spark):
    rng = random.Random(5)
    names = [f"n{k:03d}" for k in range(300)]
    pairs = [(names[k], names[k + 1]) for k in range(120)] + [("hub", n) for n in names[130:200]] + [(rng.choice(names[200:]), rng.choice(names[200:])) for _ in range(40)]
    pairs += pairs[:20]
    df = spark.createDataFrame([*pairs, ("n001", None), (None, None)], "u string, v string")
    want = brute([p for p in pairs if p[0] != p[1]])
    assert groups(C.components(df)) == want
    # Bounded partitions: many levels, a hub with more edges than a partition takes, a long chain.
    assert groups(C.components(df, final_edges=25)) == want


def test_shared_values(spark):
    rows = [("c", "puid", "1"), ("a", "puid", "1"), ("c", "loc", "1"), ("b", "loc", "1"), ("d", "nara", "1"), ("e", "puid", None), (None, "puid", "1"), ("a", "puid", "1"), ("x", "p", "uid1"), ("y", "pu", "id1")]
    df = spark.createDataFrame(rows, "canonical_id string, t string, v string")
    got = {tuple(r) for r in C.groups_by_shared_value(df, "canonical_id", ["t", "v"]).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a")}
    assert C.groups_by_shared_value(df.limit(0), "canonical_id", ["t", "v"]).count() == 0


def test_a_forest_fed_in_batches():
    import numpy as np

    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [(f"c{k}", f"c{k + 1}") for k in range(300)]
    rng.shuffle(pairs)
    forest = C.Forest()
    for lo in range(0, len(pairs), 37):
        u, v = (np.array(x, dtype=object) for x in zip(*pairs[lo : lo + 37]))
        forest.add(u, v)
    names, roots = forest.stars()
    out = {}
    for n, r in zip(names, roots):
        out.setdefault(r, set()).add(n)
    assert {frozenset(v) for v in out.values()} == brute(pairs) and all(r == min(v) for r, v in out.items())
