"""Held-out test passages that leaked into documents.

A document and an item are linked if, case ignored and everything but letters
and digits left out, they share ``WINDOW`` consecutive characters.  A window is
contained in a document only if all of its shingles are, so the prefix of a
window that the join needs is one token: its rarest shingle.

1. The shingles (hashes of ``SHINGLE`` characters) that items hold are counted in
   all documents, in one scan for all items: by slots of ``SLOT_BITS`` bits of
   the hash, so a count is never too low and a shingle that no document holds is
   nearly always known to be absent.
2. Shingles are ordered by that frequency, and the rarest of each window is
   kept, with its place in the item.
3. The documents are scanned for these tokens.  A hit carries the ``WINDOW``
   characters around it; hits too close to both ends of a text to hold a window
   are dropped (length and position bound).
4. Hits and item postings are joined on the token, and the windows over the
   shared shingle are compared character by character: the result is exact,
   whatever the hashes do.

Scale: texts are not shuffled; what is moved is slot counts and hits.  What is
sent to every task is a bitmap of fixed size (``2 ** SLOT_BITS`` bits) for the
counting, and at most ``TOKEN_BLOCK`` prefix tokens for the search.  Only tokens
that documents hold are searched for; if they are more than a block, the
documents are searched once per block.  A token that is frequent in the
documents is split by AQE in the join.

Edge cases (tested): null and empty texts match nothing; an item of fewer than
``WINDOW`` letters and digits has no passage of that length and cannot match by
definition; lengths are those after case folding, which may lengthen a text up to
``LONGEST_FOLD`` times; repeated documents are reported under each id; a text
given twice under one id counts once; case folding follows Unicode, so a letter
whose upper case has two characters matches it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.session import Scratch, column, table

WINDOW = 60
SHINGLE = 20
#: Bits of a hash by which shingles are counted, and prefix tokens searched for in one scan.
SLOT_BITS = 26
TOKEN_BLOCK = 4_000_000
#: Slots that a task sums up before it passes them on.
_HELD = 4_000_000
#: Characters that one character can fold to (Unicode's full case folding).
LONGEST_FOLD = 3
_END = 1  # stands between texts; no letter or digit has this code
_MASK_BITS = 22


@lru_cache(maxsize=1)
def _fold_table() -> tuple[np.ndarray, frozenset[int]]:
    """For each code point the folded letter or digit, 0 for what is left out; and those that fold to several."""
    out, several = np.zeros(0x110000, dtype=np.uint32), set()
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = "".join(x for x in ch.casefold() if x.isalnum())
            if len(low) == 1:
                out[c] = ord(low)
            elif low:
                several.add(c)
    return out, frozenset(several)


@lru_cache(maxsize=1)
def _several() -> dict[str, str]:
    return {chr(c): chr(c).casefold() for c in _fold_table()[1]}


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts in a row, each text ended by ``_END``; and where each begins."""
    table_, more = _fold_table(), _several()
    joined = "\x00".join("" if t is None else t for t in texts) + "\x00"
    for ch, low in more.items():
        if ch in joined:
            joined = joined.replace(ch, low)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = codes == 0
    # A NUL inside a text would look like an end; it is left out like any other sign.
    if int(ends.sum()) != len(texts):
        return normalise([None if t is None else t.replace("\x00", " ") for t in texts])
    mapped = table_[0][codes]
    mapped[ends] = _END
    kept = mapped[mapped != 0]
    stops = np.flatnonzero(kept == _END)
    return kept, np.concatenate([[0], stops[:-1] + 1]).astype(np.int64)


def shingle_hashes(codes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of the ``width`` characters from each place (polynomial, built by doubling)."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h, span, out, done = (codes.astype(np.uint64) + np.uint64(0x1234567)) * np.uint64(0xBF58476D1CE4E5B9), 1, None, 0
        while True:
            if width & span:
                out = h[:n].copy() if out is None else out * _pow(base, span) + h[done : done + n]
                done += span
            if span * 2 > width:
                break
            h = h[:-span] * _pow(base, span) + h[span:]
            span *= 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _pow(base: np.uint64, e: int) -> np.uint64:
    return np.uint64(pow(int(base), e, 1 << 64))


def _inside(codes: np.ndarray, width: int) -> np.ndarray:
    """For each place whether ``width`` characters from it lie within one text."""
    ends = np.flatnonzero(codes == _END)
    ok = np.ones(max(0, len(codes) - width + 1), dtype=bool)
    for back in range(width):
        at = ends - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


class _Lookup:
    """Membership in a sorted array of hashes, behind a bitmap that turns most away."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.mask = np.zeros(1 << _MASK_BITS, dtype=bool)
        self.mask[self.sorted >> np.uint64(64 - _MASK_BITS)] = True

    def places(self, hashes: np.ndarray, ok: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.mask[hashes >> np.uint64(64 - _MASK_BITS)] & ok)
        if not len(at) or not len(self.sorted):
            return at[:0]
        near = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == hashes[at]]


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _slice(codes: np.ndarray, lo: int, hi: int) -> str:
    return codes[lo:hi].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _context(codes: np.ndarray, start: int, stop: int, at: int, window: int, pad: str) -> str:
    """The characters of one text (start to stop) that a window over the shingle at ``at`` can take, padded to full length."""
    lo, hi = at - (window - SHINGLE), at + window
    return pad * max(0, start - lo) + _slice(codes, max(lo, start), min(hi, stop)) + pad * max(0, hi - stop)


_PARTS = 1 << 18


def _chunks(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list]]:
    """Batches of bounded length, so that one very long text does not multiply the memory of a batch."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _PARTS:
            yield ids[lo : i + 1], texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def _item_shingles(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, texts in _chunks(b["item_id"].tolist(), b["text"].tolist()):
                codes, starts = normalise(texts)
                hashes, ok = shingle_hashes(codes), _inside(codes, SHINGLE)
                stops = np.concatenate([starts[1:] - 1, [len(codes) - 1]])
                for i, lo, hi in zip(ids, starts, stops):
                    if hi - lo < window:
                        continue
                    at = np.arange(lo, hi - SHINGLE + 1)
                    at = at[ok[at]]
                    if not len(at):
                        continue
                    yield pd.DataFrame({"item_id": i, "form": int(np.bitwise_xor.reduce(_signed(hashes[at] + at.astype(np.uint64)))), "pos": (at - lo).astype(np.int32), "token": _signed(hashes[at]), "context": [_context(codes, lo, hi, a, window, "\x03") for a in at]})

    return run


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _pack_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The slots of one stretch of the bitmap as bytes."""
    for b in batches:
        out = []
        for at in b["slots"]:
            bits = np.zeros(_STRETCH, dtype=np.uint8)
            bits[np.asarray(at, dtype=np.int64)] = 1
            out.append(np.packbits(bits).tobytes())
        yield pd.DataFrame({"stretch": b["stretch"], "bits": out})


_STRETCH = 1 << 15


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """Which slots the items' shingles take: fixed size, put together from stretches of it."""
    slot = F.shiftrightunsigned("token", 64 - SLOT_BITS)
    taken = shingles.select(slot.alias("slot")).distinct().groupBy((F.col("slot") / _STRETCH).cast("int").alias("stretch")).agg(F.collect_list(F.pmod("slot", F.lit(_STRETCH)).cast("int")).alias("slots"))
    out = np.zeros((1 << SLOT_BITS) // 8, dtype=np.uint8)
    for r in taken.mapInPandas(_pack_bits, "stretch int, bits binary").toLocalIterator():
        at = r["stretch"] * _STRETCH // 8
        out[at : at + _STRETCH // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _frequencies(bitmap):
    def flush(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(found), return_counts=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken, found, held = np.frombuffer(bitmap.value, dtype=np.uint8), [], 0
        for b in batches:
            for _, texts in _chunks(b["text"].tolist(), b["text"].tolist()):
                codes, _ = normalise(texts)
                h = shingle_hashes(codes)
                if not len(h):
                    continue
                slot = _slots(h)
                hit = (taken[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool) & _inside(codes, SHINGLE)
                if hit.any():
                    found.append(slot[hit])
                    held += len(found[-1])
                if held >= _HELD:
                    slots, n = flush(found)
                    yield pd.DataFrame({"slot": slots, "n": n})
                    found, held = [], 0
        if found:
            slots, n = flush(found)
            yield pd.DataFrame({"slot": slots, "n": n})

    return run


def _hits(hashes, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = _Lookup(hashes.value)
        for b in batches:
            for ids, texts in _chunks(b["doc_id"].tolist(), b["text"].tolist()):
                codes, starts = normalise(texts)
                h = shingle_hashes(codes)
                if not len(h):
                    continue
                at = lookup.places(h, _inside(codes, SHINGLE))
                doc = np.searchsorted(starts, at, side="right") - 1
                stops = np.concatenate([starts[1:] - 1, [len(codes) - 1]])
                keep = stops[doc] - starts[doc] >= window
                at, doc = at[keep], doc[keep]
                if not len(at):
                    continue
                yield pd.DataFrame({"doc_id": pd.Series([ids[d] for d in doc], dtype=b["doc_id"].dtype), "token": _signed(h[at]), "context": [_context(codes, starts[d], stops[d], a, window, "\x02") for a, d in zip(at, doc)]})

    return run


def _tokens(df: DataFrame) -> np.ndarray:
    """Distinct tokens of a block; their number is bounded by the block."""
    return df.select("token").distinct().toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64)


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, token_block: int = TOKEN_BLOCK) -> DataFrame:
    """(doc_id, item_id) for every document that holds ``window`` characters of an item."""
    if window < SHINGLE:
        raise ValueError(f"a window takes at least {SHINGLE} characters")
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    # Only texts that cannot be long enough even when folded are left out here.
    long = F.length("text") * LONGEST_FOLD >= window
    docs = documents.select("doc_id", "text").where(long)
    wanted = items.select("item_id", "text").where(long).dropDuplicates()
    parts = max(1, min(8, int(spark.conf.get("spark.sql.shuffle.partitions")))) if wanted.limit(1001).count() <= 1000 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    shingles = scratch.save(wanted.repartition(parts, "item_id", "text").mapInPandas(_item_shingles(window), "item_id bigint, form bigint, pos int, token bigint, context string"), "shingles")
    bitmap = spark.sparkContext.broadcast(_bitmap(shingles).tobytes())
    counts = docs.select("text").mapInPandas(_frequencies(bitmap), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("item_id", "form").orderBy("pos").rowsBetween(Window.currentRow, window - SHINGLE)
    ranked = shingles.withColumn("slot", F.shiftrightunsigned("token", 64 - SLOT_BITS)).join(counts, "slot", "left").withColumn("rank", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "pos", "context"))
    rarest = ranked.withColumn("best", F.min("rank").over(over)).withColumn("last", F.max("pos").over(Window.partitionBy("item_id", "form")))
    # Only places that begin a whole window choose a token; one no document holds cannot match.
    prefix = scratch.save(rarest.where((F.col("pos") + window - SHINGLE <= F.col("last")) & (F.col("best.n") > 0)).select("item_id", "best.token", "best.context").distinct(), "prefix")
    blocks = max(1, -(-prefix.select("token").distinct().count() // token_block))
    found = None
    for block in range(blocks):
        mine = prefix if blocks == 1 else prefix.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == block)
        tokens = spark.sparkContext.broadcast(_tokens(mine))
        hits = docs.mapInPandas(_hits(tokens, window), f"doc_id {dict(docs.dtypes)['doc_id']}, token bigint, context string")
        # The postings are as few as the items' windows; if Spark finds them too large to send, AQE splits a frequent token's hits.
        posts = mine.select("item_id", "token", F.col("context").alias("item_context"))
        same = F.exists(F.sequence(F.lit(1), F.lit(window - SHINGLE + 1)), lambda k: F.substring("context", k, F.lit(window)) == F.substring("item_context", k, F.lit(window)))
        pairs = hits.join(posts, "token").where(same).select("doc_id", "item_id")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def p9_found(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_items(spark, sf_dir):
    """For each item whether it is long enough to be found, in how many documents it stands, and in how many sources' documents."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")
    hits = leaks(documents, items).join(documents.select("doc_id", column("source")).distinct(), "doc_id").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("source").alias("n_sources"))

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "n_letters": [len(normalise([t])[0]) - 1 for t in b["text"]]})

    listed = items.select("item_id", "text").mapInPandas(lengths, "item_id bigint, n_letters int").groupBy("item_id").agg(F.max("n_letters").alias("n_letters"))
    return listed.join(hits, "item_id", "left").select("item_id", (F.col("n_letters") >= WINDOW).alias("long_enough"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
