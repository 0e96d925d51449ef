"""Texts into containers of fixed capacity, in tokens of a public tokenizer.

Bulk-synchronous best fit.  Texts are tokenized once; a text above the capacity
is cut into full pieces and a rest, every other text stays whole.  Texts are
spread over shards of about ``SHARD_TEXTS`` by a hash of their row, so each shard
has the same mix of sizes.  In a superstep every shard works on its own, on the
executors: its pieces are sorted by size and its gaps by room, both kept run-length
encoded, and a band of sizes after the other is swept over the gaps, largest first.
Each piece takes the successor of its size among the gaps that no larger piece
took (ranks within a run settle who takes which), gaps are updated, and the sweep
is repeated until no piece of the band fits; what is left opens containers.

A shard settles its well-filled containers.  Its ``AGAIN`` least-filled ones it
opens again; their pieces go, with those of ``FAN`` neighbouring shards, to a shard
of the next superstep, and so on until one shard is left, which settles all.

Scale: a task holds one shard's (row, size) pairs or ``FAN`` times ``AGAIN``
containers; the runs it sweeps are bounded by the sizes and gaps there are, at most
some times the capacity.  Texts move in one shuffle of (id, size); what goes on to
the next superstep is a vanishing part.  Nothing is broadcast, and the driver sees
one number per shard, how many containers it filled.

Edge cases (tested): null and empty texts have no tokens and take no place
(container -1, offset 0); a text of exactly the capacity fills a container;
every piece of a split text keeps its order; ids may repeat, each row is its own
text.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.session import Scratch, collect_bounded, table

#: Byte-level BPE for many languages; the folder is a parameter of ``token_counts``.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokenizer that belongs to this vocabulary (a fixed value of its file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split for the standard library's engine; letters are word characters that are no digits.
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+""")
_REMEMBER = 400_000
#: Texts of a shard, shards that are merged in the next superstep, and containers a shard opens again (if filled less than this).
SHARD_TEXTS = 200_000
FAN, AGAIN, FILLED = 32, 8, 0.999


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """Characters that the two engines put into different classes; texts with them take the slow path."""
    ranges, lo, last = [], None, None
    for c in range(0x80, 0x110000):
        ch = chr(c)
        # Numbers that are no decimal digits, and blanks that only one engine sees.
        if (ch.isalnum() and not ch.isalpha() and not ch.isdecimal()) or (ch.isspace() and ch in "\x1c\x1d\x1e\x1f\x85"):
            if lo is None:
                lo = c
            elif c != last + 1:
                ranges.append((lo, last))
                lo = c
            last = c
    ranges.append((lo, last))
    return re.compile("[\x1c-\x1f" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


class Counter_:
    """Token counts; merges never cross a pre-token, so counts of pre-tokens add up."""

    def __init__(self, vocabulary: str):
        self.enc, self.known = _encoding(vocabulary), {}

    def slow(self, text: str) -> int:
        return len(self.enc.encode_ordinary(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not text.isascii() and _odd().search(text) or text.isascii() and any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.slow(text)
        known, n = self.known, 0
        for piece in _FAST.findall(text):
            got = known.get(piece)
            if got is None:
                got = self.slow(piece)
                if len(piece) <= 40:
                    if len(known) >= _REMEMBER:
                        known.clear()
                    known[piece] = got
            n += got
        return n


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter_(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.fromiter((counter.count(t) for t in b["text"]), dtype=np.int64, count=len(b))})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens bigint")


def plan_rounds(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over runs: (size, first rank, count, first container, offset) for runs of equal pieces.

    ``sizes`` maps each size in 1..capacity to its number of pieces.
    """
    left = {s: n for s, n in sizes.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    # gap -> runs of (first container, count)
    gaps: dict[int, list[tuple[int, int]]] = {}
    opened, out = 0, []

    def place(size: int, run: tuple[int, int], gap: int, later: dict) -> None:
        first, n = run
        out.append((size, taken[size], n, first, capacity - gap))
        taken[size] += n
        left[size] -= n
        if gap > size:
            later.setdefault(gap - size, []).append(run)

    hi = capacity
    while left:
        hi = max(left)
        lo = hi // 2  # the band (lo, hi]
        band = sorted((s for s in left if s > lo), reverse=True)
        while band:
            # A sweep: each gap takes one piece at most, larger pieces choose first.
            later: dict[int, list[tuple[int, int]]] = {}
            order, moved = sorted(gaps), False
            for s in band:
                at = bisect_left(order, s)
                while left[s] and at < len(order):
                    gap = order[at]
                    runs = gaps.get(gap)
                    while runs and left[s]:
                        first, n = runs.pop()
                        use = min(n, left[s])
                        if use < n:
                            runs.append((first + use, n - use))
                        place(s, (first, use), gap, later)
                        moved = True
                    if runs:
                        break
                    gaps.pop(gap, None)
                    at += 1
            for gap, runs in later.items():
                gaps.setdefault(gap, []).extend(runs)
            band = [s for s in band if left[s]]
            if band and not moved:
                # Nothing fits any more: the largest open containers, as many as their volume needs.
                volume = sum(s * left[s] for s in band)
                need = max(1, -(-volume // capacity))
                for s in band:
                    use = min(left[s], need)
                    if not use:
                        break
                    place(s, (opened, use), capacity, gaps)
                    opened, need = opened + use, need - use
                band = [s for s in band if left[s]]
        left = {s: n for s, n in left.items() if n}
    return out


def _shard(capacity: int, last: bool):
    """Pack one shard's rests; containers are numbered from 0, those to be opened again get -1."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["size"].to_numpy(dtype=np.int64)
        order = np.lexsort((rows["row"].to_numpy(), size))
        kinds, first, counts = np.unique(size[order], return_index=True, return_counts=True)
        placed = plan_rounds({int(s): int(n) for s, n in zip(kinds, counts) if s > 0}, capacity)
        box, offset = np.full(len(size), -1, dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        begin = dict(zip(kinds.tolist(), first.tolist()))
        for s, rank, n, container, off in placed:
            at = order[begin[s] + rank : begin[s] + rank + n]
            box[at], offset[at] = np.arange(container, container + n), off
        again = np.zeros(len(size), dtype=bool)
        held = box >= 0
        if held.any():
            filled = np.bincount(box[held], weights=size[held])
            number = np.arange(len(filled))
            if not last:
                least = np.argsort(filled, kind="stable")[:AGAIN]
                open_ = np.zeros(len(filled), dtype=bool)
                open_[least[filled[least] < FILLED * capacity]] = True
                again[held] = open_[box[held]]
                number = np.where(open_, -1, np.cumsum(~open_) - 1)
            box[held] = number[box[held]]
        full = rows["n_full"].to_numpy(dtype=np.int64)
        start = int(box.max(initial=-1)) + 1 + np.cumsum(full) - full
        return pd.DataFrame({"doc_id": rows["doc_id"], "row": rows["row"], "shard": rows["shard"], "size": size, "n_full": full, "box": box, "offset": offset, "full_box": start, "again": again})

    return run


def pack(documents: DataFrame, capacity: int, vocabulary: str = VOCABULARY, counts: DataFrame | None = None, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """(doc_id, piece, n_tokens, container, offset) for every piece of every text."""
    if capacity < 1:
        raise ValueError("a container takes at least one token")
    scratch = Scratch(documents.sparkSession, "packing")
    sized = (counts if counts is not None else token_counts(documents, vocabulary)).select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.floor(F.col("n_tokens") / capacity).cast("bigint").alias("n_full"), (F.col("n_tokens") % capacity).alias("size"),
    )
    sized = scratch.save(sized, "sized")
    kind = dict(sized.dtypes)["doc_id"]
    schema = f"doc_id {kind}, row bigint, shard bigint, size bigint, n_full bigint, box bigint, offset bigint, full_box bigint, again boolean"
    # Two shards at the least, so that every size of input takes the same path.
    shards = max(2, -(-sized.count() // shard_texts))
    todo = sized.where("size > 0 or n_full > 0").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    settled, base, level = [], 0, 0
    while True:
        last = shards == 1
        done = scratch.save(todo.groupBy("shard").applyInPandas(_shard(capacity, last), schema), f"step{level}")
        # One row per shard: how many containers it settled.
        most = F.greatest(F.max("box") + 1, F.max(F.col("full_box") + F.col("n_full")))
        starts = []
        for shard, n in sorted((r["shard"], r["n"]) for r in done.groupBy("shard").agg(most.alias("n")).collect()):
            starts.append((shard, base))
            base += n
        offsets = documents.sparkSession.createDataFrame(starts, "shard bigint, base bigint")
        settled.append(done.join(offsets, "shard"))
        if last:
            break
        shards, level = -(-shards // FAN), level + 1
        # Full pieces are settled; only the rests of containers opened again go on.
        todo = done.where("again").select("doc_id", "row", F.floor(F.col("shard") / FAN).alias("shard"), "size", F.lit(0).cast("bigint").alias("n_full"))
    pieces = None
    for n, part in enumerate(settled):
        whole = part.where("n_full > 0").select("doc_id", F.posexplode(F.sequence(F.col("base") + F.col("full_box"), F.col("base") + F.col("full_box") + F.col("n_full") - 1)).alias("piece", "container"))
        whole = whole.select("doc_id", "piece", F.lit(capacity).cast("bigint").alias("n_tokens"), "container", F.lit(0).cast("bigint").alias("offset"))
        rest = part.where("size > 0 and not again").select("doc_id", "row", F.col("size").alias("n_tokens"), (F.col("base") + F.col("box")).alias("container"), "offset")
        # A rest is the piece after its text's full ones, which were settled in the first step.
        rest = rest.join(settled[0].select("row", "n_full"), "row") if n else part.where("size > 0 and not again").select("doc_id", "row", F.col("size").alias("n_tokens"), (F.col("base") + F.col("box")).alias("container"), "offset", "n_full")
        rest = rest.select("doc_id", F.col("n_full").cast("int").alias("piece"), "n_tokens", "container", "offset")
        pieces = whole.unionByName(rest) if pieces is None else pieces.unionByName(rest)
    empty = sized.where("size = 0 and n_full = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(-1).cast("bigint").alias("container"), F.lit(0).cast("bigint").alias("offset"))
    return pieces.unionByName(empty)


def _capacity(spark, sf_dir: str, budget: str) -> int:
    return table(spark, sf_dir, "pack_budget").where(F.col("budget_id") == budget).first()["capacity_tokens"]


def p8_pack(spark, sf_dir):
    """Every piece of every text with its container and offset, for the standard budget."""
    return pack(table(spark, sf_dir, "documents"), _capacity(spark, sf_dir, "standard"))


def p8_fill(spark, sf_dir):
    """For each budget: containers used, the fewest that could do, and the share of their room that is filled."""
    counts = Scratch(spark, "fill").save(token_counts(table(spark, sf_dir, "documents")), "counts")
    out = None
    for b in collect_bounded(table(spark, sf_dir, "pack_budget"), 1000, "the budgets"):
        packed = pack(counts, b["capacity_tokens"], counts=counts).where("container >= 0")
        room = F.lit(b["capacity_tokens"])
        one = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
        one = one.select(F.lit(b["budget_id"]).alias("budget_id"), room.alias("capacity_tokens"), "containers", "tokens", F.ceil(F.col("tokens") / room).alias("lower_bound"), F.round(F.col("tokens") / (F.col("containers") * room), 6).alias("filled"))
        out = one if out is None else out.unionByName(one)
    return out
