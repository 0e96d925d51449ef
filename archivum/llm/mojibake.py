"""Text that was decoded with the wrong character encoding: found, and restored where it can be.

Round-trip repair.  A garbled passage is written back to bytes under a candidate
legacy encoding and strictly decoded as the encoding that was meant.  That is
repeated for nested layers, and every step is kept only if a garbling cost drops.

The cost is counted in bits: how unlikely each character above ASCII is between
the classes of its neighbours, by counts over all documents and by what writing
looks like in general (a letter among letters of its own script; letters of the
languages the documents are in are likelier than others).

Two kinds of steps:

* to UTF-8: runs of characters whose bytes form multi-byte UTF-8 sequences, of
  any script.  What comes out must cost less than the sequence did.
* between single-byte encodings, word by word.  Every byte string decodes, so
  more is asked: the cost must drop by ``GAIN_BITS``, and at least one character
  that came out must stand between neighbours between which the documents hold it,
  in at least ``SEEN`` different ways of writing; none may stand where it is never seen
  unless the others are.  So writing the documents do not know (another language
  in the same alphabet) is left alone and never turned into other wrong text.

A U+FFFD left by a decoder marks a passage that is changed but cannot be
restored: strict decoding of its bytes is what failed before.

Scale: one scan gathers each text's contexts, of which the distinct ones are
shuffled and summed up, one scan repairs.  Contexts are kept for characters that
a legacy encoding can produce and by script for all others, so their number is
bounded by the encodings, whatever the texts hold.  Texts are not shuffled; each
word that holds no character above ASCII is skipped, and repeated words are
decided once per batch.

Texts that hold the same contexts equally often count once, so copies of a
garbled text, also with other words in ASCII, do not make it normal; and
characters that are not expected in their place earn at most ``EARNED_BITS``,
however many there are.

The layers end by themselves: a UTF-8 step shortens the text, any other lowers
its cost.

Edge cases (tested): null and empty texts are not affected; a text may hold
several passages garbled in different ways; a garbled text may be a third of all
rows; pure ASCII is never touched;
invisible characters (no-break space, soft hyphen, zero-width space) are no sign
of garbling by themselves.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivum.session import collect_bounded, table

#: Encodings in which bytes may have been read by mistake.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "cp866", "koi8-r", "iso8859-2", "iso8859-15", "iso8859-5", "mac_cyrillic")
#: (meant, read as) between single-byte encodings.
PAIRS = tuple(
    (meant, wrong)
    for family in (("cp1252", "mac_roman", "cp850", "cp437"), ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"))
    for meant in family
    for wrong in (*family, *(("cp1252", "cp1250", "latin-1", "mac_roman", "cp850", "cp437") if "cp1251" in family else ("cp1250", "cp1251", "koi8-r", "cp866", "iso8859-2")))
    if wrong != meant
)
#: Bits by which a word's cost has to drop in either kind of step, and the weight of the prior against the counts.
GAIN_BITS = 6.0
DROP_BITS = 5.0
PRIOR_WEIGHT = 3000.0
#: Bits that counts may take off the prior cost of a character that is not expected in its place.
EARNED_BITS = 5.0
#: Different texts that must hold a character between its neighbours before a single-byte step may bring it about.
SEEN = 2
#: Bound by construction: characters of the encodings and scripts, times the classes of their neighbours.
MAX_CONTEXTS = 2_000_000
_UNEXPECTED, _FOREIGN = 1e-4, 1 / 2000

_LATIN = set("éèêëàâäáãåçñóôöòõúùûüíìîïßœæøÿýÉÈÊËÀÂÄÁÃÅÇÑÓÔÖÒÕÚÙÛÜÍÌÎÏŒÆØ")
_CYRILLIC = {chr(c) for c in range(0x410, 0x450)} | {"ё", "Ё"}
_SIGNS = set("’‘“”„«»–—‑…°±€·•¿¡£§©®™ºª½¼¾²³×÷№µ")
_INVISIBLE = set("\xa0\xad​‌‍⁠﻿  ")
EXPECTED = _LATIN | _CYRILLIC | _SIGNS | _INVISIBLE
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_SPLIT = " \t\r\n\f\v"


@lru_cache(maxsize=None)
def _high(encoding: str) -> tuple[str, ...]:
    """The characters of bytes 128 to 255; an undefined byte stands for its control character."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return tuple(out)


@lru_cache(maxsize=None)
def _to_byte(encoding: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_high(encoding), 128)))}


@lru_cache(maxsize=None)
def _translation(meant: str, wrong: str) -> dict[int, int | None]:
    """What each character read as ``wrong`` is under ``meant``; undefined bytes are left out."""
    out = {}
    for c, b in _to_byte(wrong).items():
        try:
            out[ord(c)] = ord(bytes([b]).decode(meant))
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _sequences(encoding: str) -> re.Pattern:
    """Runs of characters that are multi-byte UTF-8 sequences when written in ``encoding``."""
    high = _high(encoding)
    some = lambda lo, hi: "[" + "".join(re.escape(c) for c in high[lo - 128 : hi - 127]) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}})+")


@lru_cache(maxsize=1)
def _tracked() -> frozenset[str]:
    """Characters with contexts of their own: expected ones, and what bytes can be read as."""
    return frozenset(EXPECTED | {c for e in WRONG for c in _high(e)} | {"\ufffd"})


@lru_cache(maxsize=100_000)
def script(c: str) -> str:
    """The script of a letter or mark, by the first word of its name; the empty string for anything else."""
    if unicodedata.category(c)[0] not in "LM":
        return ""
    word = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    # Kana and ideographs are written together, and marks go with any letter.
    return {"HIRAGANA": "CJK", "KATAKANA": "CJK", "BOPOMOFO": "CJK", "COMBINING": ""}.get(word, word)


def _named(c: str) -> str:
    """The character itself, or for those that no legacy encoding can produce one of their script."""
    if c in _tracked():
        return c
    name = script(c)
    return _stands_for(name) if name else "\u2bd1" if unicodedata.category(c)[0] in "NPSZ" else "\ue000"


@lru_cache(maxsize=1_000)
def _stands_for(name: str) -> str:
    # A private character per script; scripts are about as many as Unicode lists.
    return chr(0xE100 + sum(ord(x) * 31**i for i, x in enumerate(name)) % 0x1000)


def _utf8_once(word: str, encoding: str) -> tuple[str, int]:
    """The word with its sequences strictly decoded, and how many characters came out."""
    to_byte, n = _to_byte(encoding), 0

    def decode(m: re.Match) -> str:
        nonlocal n
        try:
            got = bytes(to_byte[c] for c in m.group()).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m.group()
        if any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in got):
            return m.group()
        n += len(got)
        return got

    return _sequences(encoding).sub(decode, word), n


@lru_cache(maxsize=100_000)
def _kind(c: str) -> str:
    """The class of a neighbour."""
    if c == "":
        return " "
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c in _SPLIT else c
    if c in _INVISIBLE:
        return " "
    if c.isalpha() or script(c):
        name = script(c)
        kind = "c" if name == "CYRILLIC" else "l" if name == "LATIN" else ""
        return (kind.upper() if c.isupper() else kind) or _stands_for(name)
    return "s"


def contexts(word: str) -> list[str]:
    """Each character above ASCII between the classes of its neighbours."""
    return [(_kind(word[i - 1]) if i else " ") + _named(c) + (_kind(word[i + 1]) if i + 1 < len(word) else " ") for i, c in enumerate(word) if c > "\x7f"]


def close_contexts(word: str) -> list[str]:
    """Each expected character above ASCII between its neighbours as they are (letters folded), where these are letters."""
    near = lambda c: c.lower()[:1] if c.isalpha() and (c < "\x80" or c in EXPECTED) else _kind(c)
    return [near(word[i - 1] if i else "") + c.lower()[:1] + near(word[i + 1] if i + 1 < len(word) else "") for i, c in enumerate(word) if c > "\x7f" and c in EXPECTED and c not in _INVISIBLE]


@lru_cache(maxsize=50_000)
def _both(word: str) -> tuple[list[str], list[str]]:
    return contexts(word), close_contexts(word)


def _letters(kind: str) -> bool:
    return kind in "aAlLcC" or "\ue100" <= kind < "\uf100"


@lru_cache(maxsize=100_000)
def _prior(context: str) -> float:
    """How likely a character is in its context before anything is counted: expected writing in its place, or not."""
    before, c, after = context
    if c in _INVISIBLE:
        return 1.0
    if "\ue100" <= c < "\uf100":
        # Letters of a script that no legacy encoding here holds: at home among their like.
        like = "aAlL" if c == _stands_for("LATIN") else "cC" if c == _stands_for("CYRILLIC") else c
        return _FOREIGN if all(k in like or not _letters(k) for k in (before, after)) else _UNEXPECTED
    if c not in EXPECTED:
        if c == "\u2bd1":
            return _UNEXPECTED
        if unicodedata.category(c) in ("Cc", "Co", "Cn") or c == "�" or "─" <= c <= "▟":
            return 1e-6
        name = script(c)
        like = {"LATIN": "aAlL", "CYRILLIC": "cC"}.get(name, _stands_for(name) if name else "")
        if name and not any(_letters(k) and k not in like or k == "0" for k in (before, after)) and not (c.isupper() and before and before in "alc"):
            return _FOREIGN
        return _UNEXPECTED
    if c.isalpha():
        mixed = "aAlL" if c in _CYRILLIC else "cC"
        out_of_place = "0" in (before, after) or before in mixed or after in mixed or c.isupper() and before in "alc" or c.islower() and after in "ALC" and before not in "ALC"
    elif c in "¡¿":
        out_of_place = after not in "aAlL" or before in "aAlL"
    else:
        out_of_place = c not in "’‑·" and before in "aAlLcC" and after in "aAlLcC"
    return _UNEXPECTED if out_of_place else 1 / 200


def _misplaced(word: str, got: str) -> int | None:
    """Characters of a decoded word that are not in their place; None if one of them cannot be another layer's garbling either."""
    before, n = set(word), 0
    for c, context in zip((c for c in got if c > "\x7f"), contexts(got)):
        if c not in before and c in _INVISIBLE and c != "\xa0":
            n += 1
        elif c not in before and _prior(context) <= _UNEXPECTED:
            # A sign of any kind may stand anywhere (an emoji, a CJK full stop), a letter or mark may not.
            if c not in _tracked() and (script(c) or unicodedata.category(c)[0] in "CM"):
                return None
            n += 1
    return n


class CostModel:
    """Bits of a character in its context: counts over all documents, smoothed by the prior."""

    def __init__(self, counts: dict[str, int]):
        """``counts``: contexts, and close contexts behind a ``+``."""
        self.close = {k[1:]: n for k, n in counts.items() if len(k) == 4}
        self.counts, self.around = {k: n for k, n in counts.items() if len(k) == 3}, Counter()
        for k, n in self.counts.items():
            self.around[k[0] + k[2]] += n

    def bits(self, context: str) -> float:
        c = context[1]
        if c in _INVISIBLE:
            return 0.0
        prior = _prior(context)
        p = (self.counts.get(context, 0) + PRIOR_WEIGHT * prior) / (self.around.get(context[0] + context[2], 0) + PRIOR_WEIGHT)
        if prior <= _FOREIGN:
            p = min(p, max(prior, _UNEXPECTED) * 2**EARNED_BITS if prior > 1e-6 else prior * 2**EARNED_BITS)
        return -math.log2(max(p, 1e-9))

    def cost(self, word: str) -> float:
        return sum(map(self.bits, contexts(word)))

    def known(self, word: str) -> bool:
        """Whether the documents write a word's characters above ASCII between these neighbours."""
        seen = [self.close.get(k, 0) >= SEEN for k in close_contexts(word)]
        return 2 * sum(seen) > len(seen)


def words_of(text: str) -> Iterator[tuple[int, int]]:
    """Where the words (split at ASCII white space) with a character above ASCII are."""
    at, n = 0, len(text)
    while m := _NOT_ASCII.search(text, at):
        i = m.start()
        lo = max(text.rfind(s, at, i) for s in _SPLIT) + 1
        lo = max(lo, at)
        hi = min((x for s in _SPLIT if (x := text.find(s, i, i + 400)) >= 0), default=-1)
        if hi < 0:
            hi = min((x for s in _SPLIT if (x := text.find(s, i)) >= 0), default=n)
        yield lo, hi
        at = hi


class Repairer:
    """Decides words and whole texts; words are remembered within bounds."""

    def __init__(self, counts: dict[str, int], limit: int = 50_000):
        self.model, self.limit = CostModel(counts), limit
        self.steps: dict[str, dict] = {}

    def options(self, word: str) -> dict[tuple[str, str], tuple[float, str]]:
        """Every step for a word: (meant, wrong) to (bits gained, result).

        A step that gains 0 is not taken for this word's sake, only along with other words of the text.
        """
        known = self.steps.get(word)
        if known is not None:
            return known
        out, cost = {}, self.model.cost(word)
        for wrong in WRONG:
            got, n = _utf8_once(word, wrong)
            if n and got != word and (odd := _misplaced(word, got)) is not None:
                # Fewer characters, each of them explained by two or more bytes.
                drop = cost - self.model.cost(got)
                if drop >= DROP_BITS:
                    out["utf-8", wrong] = (drop + 12.0 * n - 8.0 * odd, got)
                elif drop > -2 * GAIN_BITS:
                    out["utf-8", wrong] = (0.0, got)
        if cost > GAIN_BITS and "�" not in word:
            for meant, wrong in PAIRS:
                got = word.translate(_translation(meant, wrong))
                # Invisible characters cost nothing, so none may come out of a step.
                if got != word and all(c in EXPECTED and (c == w or c not in _INVISIBLE) for w, c in zip(word, got) if c > "\x7f"):
                    gain = cost - self.model.cost(got)
                    if gain >= GAIN_BITS / 2:
                        out[meant, wrong] = (gain if gain >= GAIN_BITS and self.model.known(got) else 0.0, got)
        if len(self.steps) >= self.limit:
            self.steps.clear()
        self.steps[word] = out
        return out

    def repair(self, text: str | None) -> tuple[str | None, int, int, list[str]]:
        """(text as it was, words changed, words lost to U+FFFD, steps taken)."""
        if not text or text.isascii():
            return text, 0, 0, []
        spans = list(words_of(text))
        words = [text[a:b] for a, b in spans]
        changed, taken = set(), []
        while True:
            gains: Counter = Counter()
            found = [self.options(w) for w in words]
            for f in found:
                for step, (gain, _) in f.items():
                    if gain > 0:
                        gains[step] += gain
            if not gains:
                break
            # One passage was read one way: the step that explains most goes first, and takes along what it may have changed too.
            step = max(gains, key=lambda s: (gains[s], s))
            for i, f in enumerate(found):
                if step in f:
                    words[i] = f[step][1]
                    changed.add(i)
            taken.append(f"{step[1]}>{step[0]}")
        lost = sum("�" in w for w in words)
        if changed:
            parts, at = [], 0
            for (a, b), w in zip(spans, words):
                parts += [text[at:a], w]
                at = b
            text = "".join(parts) + text[at:]
        return text, len(changed), lost, taken


def _makeups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The contexts of each text in order (three characters each), how often it holds them, and its close contexts."""
    for b in batches:
        out = set()
        for t in b["text"]:
            if t and not t.isascii():
                held, close = Counter(), set()
                for lo, hi in words_of(t):
                    some, near = _both(t[lo:hi])
                    held.update(some)
                    close.update(near)
                keys = sorted(held)
                out.add(("".join(keys), ",".join(str(held[k]) for k in keys), "".join(sorted(close))))
        if out:
            yield pd.DataFrame(list(out), columns=["contexts", "ns", "close"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for b in batches:
        for keys, ns, close in zip(b["contexts"], b["ns"], b["close"]):
            for i, n in enumerate(ns.split(",")):
                total[keys[3 * i : 3 * i + 3]] += int(n)
            for i in range(0, len(close), 3):
                total["+" + close[i : i + 3]] += 1
    if total:
        yield pd.DataFrame({"context": list(total), "n": list(total.values())})


def context_counts(documents: DataFrame) -> DataFrame:
    """(context, n) over all documents; those with the same contexts equally often count once.  Close contexts stand behind a ``+``."""
    makeups = documents.select("text").mapInPandas(_makeups, "contexts string, ns string, close string").distinct()
    return makeups.mapInPandas(_count, "context string, n bigint").groupBy("context").agg(F.sum("n").alias("n"))


def repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, n_words, n_lost, steps) for every affected document."""
    # Contexts are bounded by the characters the documents use, not by their number.
    counts = {r[0]: r[1] for r in collect_bounded(context_counts(documents), MAX_CONTEXTS, "the context model")}
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixer = Repairer(shared.value)
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"].tolist(), b["text"]):
                text, changed, lost, steps = fixer.repair(t)
                if changed or lost:
                    out.append((i, text, changed, lost, steps))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "restored", "n_words", "n_lost", "steps"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, restored string, n_words int, n_lost int, steps array<string>")


def p10_found(spark, sf_dir):
    return repaired(table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark, sf_dir):
    """The affected documents with their text as it was, and whether all of it could be restored."""
    df = repaired(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "restored", (F.col("n_lost") == 0).alias("whole"), "n_words", F.array_join("steps", ",").alias("steps"))
