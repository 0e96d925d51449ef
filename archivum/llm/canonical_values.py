"""Freely typed values mapped to the entries of a reference list, or to none.

Symmetric-delete lookup.  Every label is entered under all strings that up to
``EDITS`` deletions leave of it; a typed value is looked up under its own
deletions, so any label within ``EDITS`` edits (insertion, deletion,
substitution, swap) is found without comparing the value with the
list.  Candidates are ranked by a weighted Damerau-Levenshtein distance (look-
alikes and doubled letters are cheap), then by how often the label itself stands
in the data.

What is looked up are the windows of a value's words that are about as long as a
label, without blanks: numbering, brackets, separators, notes before or after a
label and misplaced blanks do not matter.  A label's words may be rotated ("risk:
low"), abbreviated ("Spec. sold by the publ.") or cut off at the end.  A value
that names two different labels, be it the second one by its peculiar words only
("medium - low risk"), means none; so does one that names nothing.

Scale: the dictionary is made of a reference list of at most ``MAX_LABELS``
entries and sent to every executor; rows are mapped where they are, each
distinct value of a batch once.  Only (table, row id, result) is shuffled, to
count rows delivered twice once.

Edge cases (tested): null and placeholder values are not reported, nor are exact
labels; an empty reference list maps everything to none; a row whose scope has
no labels (unknown or null question) is none; values of any length are looked up
whole, words beyond a label's length cost nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.functions.text import is_missing
from archivum.session import collect_bounded, table

EDITS = 2
MAX_LABELS = 20_000
NONE = "none"
#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKE = str.maketrans("аеорсухіјѕһԁԛԝвнкмтαορυνικτ", "aeopcyxijshdqwbhkmtaopuvikt")
#: Digits typed for letters.
DIGIT_FOR = {"0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_WORD = re.compile(r"[^\W_]+")


def clean(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold().translate(LOOK_ALIKE)


def deletions(s: str, n: int) -> set[str]:
    """What up to ``n`` deletions leave of a string."""
    out = {s}
    if n >= 1:
        out.update(s[:i] + s[i + 1 :] for i in range(len(s)))
    if n >= 2:
        out.update(s[:i] + s[i + 1 : j] + s[j + 1 :] for i, j in combinations(range(len(s)), 2))
    for k in range(3, min(n, len(s)) + 1):
        for gone in combinations(range(len(s)), k):
            out.add("".join(c for i, c in enumerate(s) if i not in gone))
    return out


def _alike(a: str, b: str) -> bool:
    return b in DIGIT_FOR.get(a, "") or a in DIGIT_FOR.get(b, "")


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance, edits between swapped letters included; doubled letters and look-alikes count less."""
    if abs(len(a) - len(b)) > 2 * most:
        return most + 1
    rows = [[j * 1.0 for j in range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        x, above, row, match = a[i - 1], rows[-1], [i * 1.0], 0
        drop = 0.6 if i > 1 and x == a[i - 2] else 1.0
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            add = 0.6 if j > 1 and y == b[j - 2] else 1.0
            swap = 0.0 if x == y else 0.2 if _alike(x, y) else 1.0
            best = min(above[j] + drop, row[j - 1] + add, above[j - 1] + swap)
            k = seen.get(y, 0)
            if k and match:
                # a[k] and b[match] change places around what is between them.
                best = min(best, rows[k - 1][match - 1] + (i - k - 1) + 0.8 + (j - match - 1))
            if x == y:
                match = j
            row.append(best)
        seen[x] = i
        rows.append(row)
    return rows[-1][-1]


class Dictionary:
    """Labels by scope, under their deletions."""

    def __init__(self, labels: list[tuple[str, str, str, int]], edits: int = EDITS):
        """``labels``: (scope, reference id, label, frequency)."""
        self.edits = edits
        self.exact: dict[str, set[str]] = defaultdict(set)
        self.forms: dict[str, list[tuple[str, str, int]]] = defaultdict(list)
        self.words: dict[str, list[tuple[str, list[str], str]]] = defaultdict(list)
        self.under: dict[str, dict[str, list[int]]] = defaultdict(lambda: defaultdict(list))
        for scope, ref, label, n in labels:
            self.exact[scope].add(label)
            words = _WORD.findall(clean(label))
            if not words:
                continue
            self.words[scope].append((ref, words, " ".join(words)))
            for turn in range(len(words)):
                form = "".join(words[turn:] + words[:turn])
                at = len(self.forms[scope])
                self.forms[scope].append((ref, form, n))
                for d in deletions(form, self._allowed(form)):
                    self.under[scope][d].append(at)
        #: The words of each label that no other label of its scope has.
        self.own: dict[str, list[tuple[str, set[str]]]] = {}
        for scope, listed in self.words.items():
            count = Counter(w for _, words, _ in listed for w in set(words))
            self.own[scope] = [(ref, {w for w in words if count[w] == 1}) for ref, words, _ in listed]
        #: Lengths that a window may have, and forms that it may equal: (-frequency, reference id).
        self.lengths: dict[str, set[int]] = {}
        self.equal: dict[str, dict[str, tuple[int, str]]] = {}
        for scope, forms in self.forms.items():
            self.lengths[scope] = {len(f[1]) + k for f in forms for k in range(-edits, edits + 1)}
            self.equal[scope] = {}
            for ref, form, n in forms:
                self.equal[scope][form] = min(self.equal[scope].get(form, (-n, ref)), (-n, ref))
        self.under = {k: dict(v) for k, v in self.under.items()}
        self.known: dict[tuple[str, str], str] = {}

    def _allowed(self, form: str) -> int:
        """Edits for a string of this length: short ones must not turn into each other."""
        return self.edits if len(form) >= 7 else 1 if len(form) >= 4 else 0

    def near(self, scope: str, s: str) -> list[tuple[float, int, str]]:
        """Labels within reach of a string: (distance, -frequency, reference id), best first."""
        under, forms, seen, out = self.under[scope], self.forms[scope], set(), []
        for d in deletions(s, self.edits):
            for at in under.get(d, ()):
                if at not in seen:
                    seen.add(at)
                    ref, form, n = forms[at]
                    allowed = self._allowed(form)
                    cost = weighted_distance(s, form, allowed)
                    if cost <= allowed:
                        out.append((cost, -n, ref))
        return sorted(out)

    def find(self, scope: str, value: str) -> str:
        """The reference id that a typed value means, or ``NONE``."""
        if scope not in self.lengths:
            return NONE
        text = clean(value)
        words = [(m.group(), m.end()) for m in _WORD.finditer(text)]
        lengths, equal, long = self.lengths[scope], self.equal[scope], max(self.lengths[scope])
        windows, hits = [], []
        for i in range(len(words)):
            joined = ""
            for j in range(i, len(words)):
                joined += words[j][0]
                if len(joined) > long:
                    break
                if len(joined) in lengths:
                    windows.append((joined, i, j))
                    if joined in equal:
                        hits.append((0.0, *equal[joined], i, j))
        # Beside a label that stands there as it is, only windows apart from it can say something else.
        sure = min(hits, default=None)
        for joined, i, j in windows:
            if joined not in equal and (sure is None or i > sure[4] or j < sure[3]) and (got := self.near(scope, joined)):
                hits.append((*got[0], i, j))
        if hits:
            best = min(hits)
            for h in hits:
                if h[2] != best[2] and (h[3] > best[4] or h[4] < best[3]):
                    return NONE
            rest = [w for n, (w, _) in enumerate(words) if not best[3] <= n <= best[4]]
            return NONE if self._names_other(scope, best[2], rest) else best[2]
        return self._shortened(scope, text, words)

    def _names_other(self, scope: str, ref: str, rest: list[str]) -> bool:
        """Whether the words beside a label hold every word that is peculiar to another label."""
        return any(other != ref and own and all(any(w == x or len(x) > 4 and weighted_distance(w, x, 1.0) <= 1.0 for w in rest) for x in own) for other, own in self.own[scope])

    def _shortened(self, scope: str, text: str, words: list[tuple[str, int]]) -> str:
        """A label with words cut by a full stop, or cut off at its end."""
        plain = [w for w, _ in words]
        while plain and plain[0].isdigit():
            plain, words = plain[1:], words[1:]
        found = set()
        joined = " ".join(plain)
        for ref, label, whole in self.words[scope]:
            if len(plain) == len(label) and any(w != x for w, x in zip(plain, label)):
                cut = [text[e : e + 1] == "." for _, e in words]
                if all(w == x or (c and len(w) >= 2 and x.startswith(w)) for w, x, c in zip(plain, label, cut)):
                    found.add(ref)
            if len(label) > 1 and len(joined) >= max(4, 0.4 * len(whole)) and whole.startswith(joined):
                found.add(ref)
        return found.pop() if len(found) == 1 else NONE

    def match(self, scope: str | None, value: str) -> str:
        key = (scope or "", value)
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            got = self.known[key] = self.find(*key)
        return got


def canonical(rows: DataFrame, labels: DataFrame, placeholders: list[str], edits: int = EDITS) -> DataFrame:
    """(source_table, row_id, reference_id) for every typed value that is neither missing nor a label.

    ``rows``: source_table, row_id, scope, value.  ``labels``: scope, reference_id, label.
    """
    listed = labels.where("scope is not null and reference_id is not null and label is not null").select("scope", "reference_id", "label").distinct()
    literal = listed.select("scope", F.col("label").alias("value"), F.lit(True).alias("literal")).distinct()
    # How often each label stands in the data as it is: a map-side sum over all rows.
    often = rows.join(F.broadcast(literal) if _few(literal) else literal, ["scope", "value"]).groupBy("scope", "value").agg(F.count("*").alias("n"))
    known = collect_bounded(listed.join(often.withColumnRenamed("value", "label"), ["scope", "label"], "left").select("scope", "reference_id", "label", F.coalesce("n", F.lit(0)).alias("n")), MAX_LABELS, "the reference list")
    shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in known])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = Dictionary(shared.value, edits)
        for b in batches:
            keep = [v not in book.exact.get(s, ()) for s, v in zip(b["scope"], b["value"])]
            b = b[keep]
            if b.empty:
                continue
            yield pd.DataFrame({"source_table": b["source_table"], "row_id": b["row_id"], "reference_id": [book.match(s, v) for s, v in zip(b["scope"], b["value"])]})

    typed = rows.where(~is_missing(F.col("value"), placeholders)).select("source_table", "row_id", "scope", "value")
    return typed.mapInPandas(run, "source_table string, row_id bigint, reference_id string").distinct()


def _few(df: DataFrame) -> bool:
    """The labels are counted before they are sent anywhere."""
    return df.limit(MAX_LABELS + 1).count() <= MAX_LABELS


def _rows(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    def typed(name: str, tag: str, row_id: str, scope: Column, value: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(tag).alias("source_table"), F.col(row_id).alias("row_id"), scope.alias("scope"), F.col(value).alias("value"))

    rows = typed("institution_policy_overlay", "overlay", "overlay_id", F.lit("risk_level"), "local_risk_level").unionByName(typed("question_response", "response", "response_id", F.col("question_id"), "answer_text"))
    labels = table(spark, sf_dir, "risk_level").select(F.lit("risk_level").alias("scope"), F.col("level_id").alias("reference_id"), "label").unionByName(
        table(spark, sf_dir, "framework_answer").select(F.col("question_id").alias("scope"), F.concat_ws("/", "question_id", "answer_id").alias("reference_id"), "label")
    )
    tokens = [r[0] for r in collect_bounded(table(spark, sf_dir, "null_token").where("token is not null"), 10_000, "the null tokens")]
    return rows, labels, tokens


def p5_found(spark, sf_dir):
    return canonical(*_rows(spark, sf_dir))


def p5_misses(spark, sf_dir):
    """Values that mean no entry, and how many rows have them."""
    rows, labels, tokens = _rows(spark, sf_dir)
    none = canonical(rows, labels, tokens).where(F.col("reference_id") == NONE).select("source_table", "row_id")
    typed = rows.select("source_table", "row_id", "scope", F.lower(F.trim("value")).alias("typed")).distinct()
    return typed.join(none, ["source_table", "row_id"]).groupBy("source_table", "scope", "typed").agg(F.count("*").alias("n_rows"))
