"""Scalar normalisation of registry values as Column builders (all inside generated code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivum.functions.text import strip

#: Identifier kinds in the order of authority; the strong ones form identity (fixed values).
STRONG_KINDS = ("puid", "loc", "nara")
#: Source types whose identifiers of a kind are verified (fixed values).
VERIFIED_FROM = {
    "puid": ("pronom_registry", "pronom_droid_xml"),
    "loc": ("loc_fdd_xml",),
    "nara": ("nara_digital_preservation_framework", "nara_lod", "nara_json", "nara", "nara_preservation_csv"),
    "wikidata": ("wikidata",),
}
#: Semantic risk levels from least to most concern (fixed values).
LEVEL_RANK = {"minimal": 0, "low": 1, "moderate": 2, "high": 3, "critical": 4}
#: Rank of a scope, 0 being most specific (fixed values); what is not listed ranks 5.
SCOPE_RANK = {"exact_format": 0, "format_version": 0, "institutional_format": 0, "format_family": 1, "format_group": 2, "content_type": 3, "contextual": 4}
#: Words of names that stand for more than one version (fixed values).
BROAD_MARKERS = ("family", "generic", "unspecified", "all versions", "multiple versions")
#: Version tokens in names: dotted numbers, year letters, profile parts such as a-1b, year ranges (a fixed value).
VERSION_TOKEN = r"(?i)\b(\d+\.\d+(?:\.\d+)?|\d{2,4}[a-z]|(?:pdf|iso)?/?[a-z]-\d+[a-z]?|\d{2,4}-\d{2,4})\b"


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def extension(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^\.+", ""), r"\s+", "")


def identifier(kind: Column, value: Column) -> Column:
    v = strip(value)
    return F.when(kind == "extension", extension(value)).when(kind.isin("mime", "loc"), F.lower(v)).when(kind == "wikidata", F.upper(v)).otherwise(v)


def is_verified(kind: Column, source_type: Column) -> Column:
    checks = [(kind == k) & source_type.isin(*types) for k, types in VERIFIED_FROM.items()]
    return F.coalesce(reduce(lambda a, b: a | b, checks), F.lit(False))


def slug(c: Column, length: int = 80) -> Column:
    dashes = lambda x: F.regexp_replace(x, "^-+|-+$", "")
    body = dashes(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"))
    return F.coalesce(F.nullif(dashes(F.substring(body, 1, length)), F.lit("")), F.lit("unnamed"))


def split_multi(c: Column) -> Column:
    """Values separated by ; , | or line ends; blanks dropped, null as none."""
    return F.coalesce(F.filter(F.transform(F.split(c, r"[;,|\n]+"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def version_tokens(c: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(VERSION_TOKEN), 1), F.lower))), F.array().cast("array<string>"))


def names_conflict(a: Column, b: Column) -> Column:
    x, y = version_tokens(a), version_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def versions_one_sided(a: Column, b: Column) -> Column:
    x, y = F.size(version_tokens(a)), F.size(version_tokens(b))
    return ((x > 0) & (y == 0)) | ((x == 0) & (y > 0))


def is_broad(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(BROAD_MARKERS)), F.lit(False))


def canonical_id(kind: Column, value: Column, name: Column) -> Column:
    """The canonical id of a group key; only verified ids keep their own namespace."""
    fallback = F.concat(F.lit("fmt-"), slug(F.coalesce(blank_to_null(name), value)))
    return (
        F.when(kind == "puid", F.concat(F.lit("puid-"), F.replace(value, F.lit("/"), F.lit("-")))).when(kind.isin("name", "name_ext", "source_record"), fallback)
        .otherwise(F.concat(kind, F.lit("-"), slug(value)))
    )


def puid_variants(c: Column) -> Column:
    """Spellings a reader may use for one PUID: as given, with the slash, and as an id."""
    low = F.lower(F.trim(c))
    space, number = F.regexp_extract(low, r"^(?:puid-)?([a-z-]*?)[/-](\d+)$", 1), F.regexp_extract(low, r"^(?:puid-)?([a-z-]*?)[/-](\d+)$", 2)
    known = number != ""
    return F.array_distinct(F.array_compact(F.array(low, F.when(known, F.concat(space, F.lit("/"), number)), F.when(known, F.concat(F.lit("puid-"), space, F.lit("-"), number)))))


def match_text(c: Column) -> Column:
    """For text rules: folded, underscores and dashes as blanks, runs as one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "_-", "  "), r"\s+", " "))


def match_value(c: Column) -> Column:
    """For coded values: trimmed and folded only."""
    return F.lower(strip(c))


def match_words(c: Column) -> Column:
    """For search: letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def semantic_level(c: Column) -> Column:
    """A level named by its id or label; null if it names none."""
    text = F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" ")), r"\s+concern$", ""))
    return F.when(text.isin("minimal", "lower risk"), "minimal").when(text == "medium", "moderate").when(text.isin(*LEVEL_RANK), text)


def three_band(c: Column) -> Column:
    text = F.lower(c)
    return F.when(text.contains("high"), "High").when(text.contains("moderate") | text.contains("medium"), "Moderate").when(text.contains("low"), "Low")


def rank_of(c: Column, ranks: dict[str, int], otherwise: int | None = None) -> Column:
    expr = F.lit(otherwise).cast("int")
    for name, rank in ranks.items():
        expr = F.when(c == name, F.lit(rank)).otherwise(expr)
    return expr


def first_of(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def try_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def alias_of(kind: str, c: Column) -> Column:
    prefix = f"{kind}-"
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), F.replace(c, F.lit("/"), F.lit("-"))))


def stable_hash(*cols: Column) -> Column:
    """SHA-256 over pipe-joined parts; null is the empty string, so parts never shift."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def parse_date(c: Column) -> Column:
    """ISO dates and times, 5 Jan 2024, 5 January 2024, 2024/01/05, RFC 2822; null if none fits."""
    t = F.trim(c)
    named = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(t)] + [F.try_to_timestamp(named, F.lit(f)) for f in ("d MMM yyyy", "d MMMM yyyy", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")]
    return F.coalesce(*tries)


def days_since(source: Column, observed: Column) -> Column:
    """Whole days, never negative; null if the source date is."""
    return F.when(source.isNotNull() & observed.isNotNull(), F.greatest(F.lit(0), F.datediff(observed, source)))


def native_band(c: Column) -> Column:
    """Band of a native rating that is higher for safer formats."""
    return F.when(c >= 23, "Low").when(c <= -23, "High").when(c.isNotNull(), "Moderate")


def native_gap(rating: Column, band: Column) -> Column:
    """How far a native rating is from the range of another band; 0 inside it."""
    gap = F.when(band == "Low", F.greatest(F.lit(0.0), 23 - rating)).when(band == "High", F.greatest(F.lit(0.0), rating + 23)).when(band == "Moderate", F.greatest(F.lit(0.0), F.abs(rating) - 22))
    return F.when(rating.isNotNull(), F.round(gap, 3))


def path_get(payload: Column, path: str, kind: str = "string") -> Column:
    """A dotted path into a VARIANT, longest key first: a.b.c may be stored under 'a.b' and 'c'."""
    parts = path.split(".")

    def splits(rest: list[str]) -> list[list[str]]:
        return [[]] if not rest else [[".".join(rest[:n]), *tail] for n in range(len(rest), 0, -1) for tail in splits(rest[n:])]

    quoted = ["$" + "".join(f'["{k}"]' for k in keys) for keys in splits(parts)] + ["$" + "".join(f'["{k}"]' for k in keys) for keys in splits(parts) if any("." in k for k in keys) for keys in [[k.replace(".", "．") for k in keys]]]
    return F.coalesce(*[F.try_variant_get(payload, p, kind) for p in quoted])


def text_rule(value: Column, equals_any=(), contains_any=(), contains_all=(), not_contains_any=()) -> Column:
    """True only if a positive condition is given and all given ones hold."""
    if not (equals_any or contains_any or contains_all):
        return F.lit(False)
    hay, norm = match_text(value), lambda s: " ".join(s.lower().replace("_", " ").replace("-", " ").split())
    ok = F.lit(True)
    if equals_any:
        ok = ok & F.regexp_replace(hay, "^[. ]+|[. ]+$", "").isin(*[norm(s).strip(". ") for s in equals_any])
    for s in contains_all:
        ok = ok & hay.contains(norm(s))
    if contains_any:
        ok = ok & reduce(lambda a, b: a | b, [hay.contains(norm(s)) for s in contains_any])
    for s in not_contains_any:
        ok = ok & ~hay.contains(norm(s))
    return ok


def has_word(text: Column, *tokens: str) -> Column:
    """Whether a guard token stands in the text as a whole word or phrase."""
    any_of = "|".join("".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in t.lower().replace("_", " ").replace("-", " ")) for t in tokens)
    return match_text(text).rlike(f"(?<![a-z0-9])(?:{any_of})(?![a-z0-9])")
