import random

import pytest

from archivum.llm import packing as P


def check(rows, sizes, capacity):
    by_doc, boxes = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["container"] >= 0:
            boxes.setdefault(r["container"], []).append((r["offset"], r["n_tokens"]))
        else:
            assert r["n_tokens"] == 0
    for d, n in sizes.items():
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in pieces) == n and (n > capacity or len(pieces) == 1)
        assert all(r["n_tokens"] == capacity for r in pieces[:-1]) and [r["piece"] for r in pieces] == list(range(len(pieces)))
    for items in boxes.values():
        at = 0
        for off, n in sorted(items):
            assert off == at
            at += n
        assert at <= capacity
    total = sum(sizes.values())
    return len(boxes), -(-total // capacity)


def one_by_one(sizes, capacity):
    """Containers of best fit decreasing, piece after piece."""
    pieces, used, gaps = [], 0, []
    for n in sizes.values():
        used += n // capacity
        pieces += [n % capacity] if n % capacity else []
    for s in sorted(pieces, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            used, fit = used + 1, capacity
        else:
            gaps.remove(fit)
        gaps.append(fit - s)
    return used


@pytest.mark.parametrize("seed, capacity", [(1, 100), (2, 64), (3, 7)])
def test_containers_hold_and_are_full(spark, seed, capacity):
    rng = random.Random(seed)
    sizes = {n: (rng.choice([0, 5, capacity, 2 * capacity, 3 * capacity + 1]) if n % 4 == 0 else 5 if n % 3 == 0 else rng.randrange(1, capacity)) for n in range(400)}
    counts = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    used, least = check(P.pack(counts, capacity, counts=counts).collect(), sizes, capacity)
    assert least <= used <= one_by_one(sizes, capacity) * 1.02 + 1


def test_many_shards_are_merged_over_several_steps(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN", 3)
    rng = random.Random(9)
    sizes = {n: rng.choice([0, 64, 200, 130, rng.randrange(1, 64)]) for n in range(1500)}
    counts = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    rows = P.pack(counts, 64, counts=counts, shard_texts=150).collect()
    used, least = check(rows, sizes, 64)
    assert least <= used <= one_by_one(sizes, 64) * 1.02 + 1
    assert {r["container"] for r in rows} - {-1} == set(range(used))


def test_tokens_equal_the_tokenizer(spark):
    texts = ["Hello  world's it's 12,000 x_y\n\n  end ", "Größe №5 ½ ² Ⅷ é 日本語 🙂", "a\x1cb\x85c\xa0d", "", None, "x" * 3000, "​　 q"]
    enc = P._encoding(P.VOCABULARY)
    got = [r["n_tokens"] for r in P.token_counts(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got == [len(enc.encode_ordinary(t or "")) for t in texts]


def test_repeated_ids_and_empty(spark):
    counts = spark.createDataFrame([(1, 3), (1, 3), (2, 12)], "doc_id bigint, n_tokens bigint")
    got = P.pack(counts, 5, counts=counts).collect()
    assert sum(r["n_tokens"] for r in got) == 18 and sum(r["doc_id"] == 1 for r in got) == 2
    assert P.pack(counts.limit(0), 5, counts=counts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.pack(counts, 0, counts=counts)
