import random
import re

from archivum.llm import contamination as C


def brute(docs, items, window=60):
    norm = lambda s: "".join(c for c in (s or "").casefold() if c.isalnum())
    out = set()
    for i, t in items:
        s = norm(t)
        grams = {s[p : p + window] for p in range(len(s) - window + 1)}
        out |= {(d, i) for d, x in docs if (y := norm(x)) and any(y[p : p + window] in grams for p in range(len(y) - window + 1))}
    return out


def texts(spark):
    rng = random.Random(2)
    words = ["reel", "ledger", "Straße", "naïve", "vault", "codec", "mesh", "12", "signs", "the", "every", "Größe"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    items = [(n, make(40)) for n in range(12)] + [(90, "short"), (91, None), (92, "")]
    docs = []
    for n in range(60):
        i, t = items[n % 12]
        a = rng.randrange(60)
        cut = t[a : a + rng.randrange(40, 130)]
        cut = cut.upper() if n % 3 == 0 else re.sub(" ", " - \n", cut) if n % 3 == 1 else cut
        docs.append((n, make(rng.randrange(30)) + " " + cut + " " + make(rng.randrange(30))))
    docs += [(100, None), (101, ""), (102, items[0][1]), (103, items[0][1]), (104, "\x00" + items[1][1]), (105, make(20_000) + items[2][1])]
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = texts(spark)
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, token string")
    i = spark.createDataFrame(items + items[:2], "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 20
    assert {tuple(r) for r in C.leaks(d, i).collect()} == want
    assert {tuple(r) for r in C.leaks(d, i, token_block=50).collect()} == want


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert C.leaks(d, i).count() == 0


def test_hashes_agree_with_places():
    codes, starts = C.normalise(["Abc-1", None, "", "aBC 1"])
    assert starts.tolist() == [0, 5, 6, 7]
    h = C.shingle_hashes(codes, 4)
    assert h[0] == h[7] and C._inside(codes, 4).tolist() == [True] + [False] * 6 + [True, False]


def test_folding_that_lengthens_a_text_loses_no_link(spark):
    docs = spark.createDataFrame([(1, "ß" * 40), (2, "ﬃ" * 20), (3, "s" * 59), (4, "ss" * 30)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "s" * 80), (8, "ß" * 30), (9, "ffi" * 25)], "item_id bigint, text string")
    assert {tuple(r) for r in C.leaks(docs, items).collect()} == {(1, 7), (4, 7), (1, 8), (4, 8), (2, 9)}


def test_no_character_folds_to_more_than_is_reckoned_with():
    assert max(len(chr(c).casefold()) for c in range(0x110000)) == C.LONGEST_FOLD
