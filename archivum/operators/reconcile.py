"""Source records to canonical formats: authority-aware grouping with one-hop aliases.

Input rows of ``reconcile``: ``src_ord`` (total order), source_id, source_type,
source_record_id, record_role, name, category, description, version,
extensions, mime_types, puids, loc_ids, nara_ids (arrays).

Only identifiers verified by the authority that issues them form identity.  A
record that merely copies an id joins the group of its verified owner if that is
the only one and names do not contradict.  Aliases are followed exactly one hop.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions.normalize import STRONG_KINDS, canonical_id, extension, identifier, is_broad, is_verified, version_tokens
from archivum.session import Scratch

ID_FIELDS = {"extension": "extensions", "mime": "mime_types", "puid": "puids", "loc": "loc_ids", "nara": "nara_ids", "wikidata": "wikidata_ids"}


def identifier_claims(records: DataFrame) -> DataFrame:
    """(src_ord, kind, value, verified, pos): one row per logical claim; a verified copy wins over an unverified one."""
    def part(n: int, kind: str, field: str):
        verified = is_verified(F.lit(kind), F.col("source_type"))
        return F.transform(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda v, p: F.struct(F.lit(kind).alias("kind"), identifier(F.lit(kind), v).alias("value"), verified.alias("verified"), (F.lit(n * 100_000) + p).alias("pos")))

    # All kinds in one pass over the records.
    every = F.concat(*[part(n, kind, field) for n, (kind, field) in enumerate(ID_FIELDS.items()) if field in records.columns])
    rows = records.select("src_ord", F.explode(every).alias("c")).select("src_ord", "c.*")
    return rows.where("value is not null and value != ''").groupBy("src_ord", "kind", "value").agg(F.bool_or("verified").alias("verified"), F.min("pos").alias("pos"))


def group_keys(records: DataFrame, claims: DataFrame) -> DataFrame:
    """Add ``g_kind`` and ``g_value``: strongest verified id, else name with extensions, else name, else the record itself."""
    rank = F.when(F.col("kind") == "puid", 0).when(F.col("kind") == "loc", 1).otherwise(2)
    strong = claims.where(F.col("verified") & F.col("kind").isin(*STRONG_KINDS)).groupBy("src_ord").agg(F.min(F.struct(rank.alias("r"), "pos", "kind", "value")).alias("s"))
    name = F.nullif(F.trim(F.regexp_replace("name", r"\s+", " ")), F.lit(""))
    exts = F.array_sort(F.array_distinct(F.transform("extensions", extension)))
    joined = records.join(strong, "src_ord", "left").withColumn("name", name).withColumn("__e", exts)
    kind = F.when(F.col("s").isNotNull(), F.col("s.kind")).when(F.col("name").isNotNull() & (F.size("__e") > 0), "name_ext").when(F.col("name").isNotNull(), "name").otherwise("source_record")
    value = (
        F.when(F.col("s").isNotNull(), F.col("s.value")).when(F.col("name").isNotNull() & (F.size("__e") > 0), F.concat(F.lower("name"), F.lit("|"), F.array_join("__e", ",")))
        .when(F.col("name").isNotNull(), F.lower("name")).otherwise(F.concat_ws(":", F.coalesce("source_id", F.lit("")), F.coalesce("source_record_id", F.lit(""))))
    )
    weak = F.when(F.col("name").isNotNull() & (F.size("__e") > 0), F.concat(F.lower("name"), F.lit("|"), F.array_join("__e", ",")))
    return joined.withColumn("g_kind", kind).withColumn("g_value", value).withColumn("weak", weak).withColumn("g", F.concat_ws(":", "g_kind", "g_value")).drop("s", "__e")


def weak_aliases(keyed: DataFrame, claims: DataFrame) -> DataFrame:
    """(g, target): groups that share name and extensions with exactly one strong group, over two sources or more."""
    unverified = claims.where(~F.col("verified") & F.col("kind").isin(*STRONG_KINDS)).select("src_ord").distinct().withColumn("u", F.lit(True))
    per = keyed.where("weak is not null").join(unverified, "src_ord", "left").groupBy("weak", "g").agg(F.min("g_kind").alias("k"))
    spread = keyed.where("weak is not null").groupBy("weak").agg(F.count_distinct("source_id").alias("n_sources"))
    strong = F.when(F.col("k").isin(*STRONG_KINDS), F.col("g"))
    about = per.groupBy("weak").agg(F.count("*").alias("n"), F.count(strong).alias("n_strong"), F.max(strong).alias("target")).join(spread, "weak")
    hit = per.join(about.where("n > 1 and n_strong = 1 and n_sources > 1").select("weak", "target"), "weak").where("g != target").select("g", "target")
    # A group with a copied id is left to the rule for copied ids.
    copied = keyed.join(unverified, "src_ord", "left_semi").select("g").distinct()
    return hit.join(copied, "g", "left_anti").groupBy("g").agg(F.min("target").alias("target"))


def claimed_aliases(keyed: DataFrame, claims: DataFrame) -> DataFrame:
    """(g, target): groups whose copied ids have one verified owner, at the strongest kind that has any."""
    mine = claims.join(keyed.select("src_ord", "g"), "src_ord")
    owners = mine.where("verified").groupBy("kind", "value").agg(F.max_by("g", "src_ord").alias("target"))
    rank = F.when(F.col("kind") == "puid", 0).when(F.col("kind") == "loc", 1).otherwise(2)
    hits = mine.where(~F.col("verified") & F.col("kind").isin(*STRONG_KINDS)).join(owners, ["kind", "value"]).where("g != target").select("g", "target", "kind", rank.alias("r")).distinct()
    best = hits.withColumn("least", F.min("r").over(Window.partitionBy("g"))).where("r = least").groupBy("g").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"), F.min("kind").alias("kind")).where("n = 1")
    # Names: what matters of a group are its distinct sets of version tokens.
    toks = keyed.select("g", F.array_join(version_tokens(F.col("name")), " ").alias("t"), is_broad(F.col("name")).alias("b")).groupBy("g").agg(
        F.bool_or("b").alias("broad"), F.bool_or(F.col("t") == "").alias("bare"), F.count_distinct(F.when(F.col("t") != "", F.col("t"))).alias("n_t"), F.max("t").alias("t")
    )
    left, right = toks.alias("a"), toks.alias("z")
    both = best.join(left, F.col("a.g") == best["g"]).join(right, F.col("z.g") == best["target"]).where(~((F.col("kind") == "puid") & (F.col("a.broad") | F.col("z.broad"))))
    agree = (F.col("a.n_t") == 0) & (F.col("z.n_t") == 0) | (F.col("a.n_t") == 1) & (F.col("z.n_t") == 1) & (F.col("a.t") == F.col("z.t")) & ~F.col("a.bare") & ~F.col("z.bare")
    return both.where(agree).select(best["g"], best["target"])


class Reconciled(NamedTuple):
    """Formats as one row each; what belongs to them as rows of their own, so no format is ever gathered."""

    formats: DataFrame
    members: DataFrame
    identifiers: DataFrame


def reconcile(records: DataFrame) -> DataFrame:
    """(canonical_id, preferred_name, category, n_records, n_sources) of all identity records."""
    return reconciled(records).formats


def reconciled(records: DataFrame) -> Reconciled:
    """Formats (canonical_id, preferred_name, category, n_records, n_sources), members (canonical_id, src_ord, source_id, source_record_id) and identifiers (canonical_id, kind, value)."""
    scratch = Scratch(records.sparkSession, "reconcile")
    base = records.where("record_role is null or record_role != 'evidence_only'")
    # Both are read several times below; written once they are not worked out again.
    claims = scratch.save(identifier_claims(base), "claims")
    keyed = scratch.save(group_keys(base, claims).select("src_ord", "source_id", "source_record_id", "name", "category", "g", "g_kind", "g_value", "weak"), "keyed")
    claimed, weak = claimed_aliases(keyed, claims), weak_aliases(keyed, claims)
    alias = scratch.save(claimed.withColumn("p", F.lit(0)).unionByName(weak.withColumn("p", F.lit(1))).groupBy("g").agg(F.min_by("target", "p").alias("target")), "alias")
    # Exactly one hop: a target's own alias is not followed.
    grouped = keyed.join(alias, "g", "left").withColumn("final", F.coalesce("target", "g"))
    own = F.col("final") == F.col("g")
    kind = F.substring_index("final", ":", 1)
    value = F.expr("substring(final, length(substring_index(final, ':', 1)) + 2)")
    first = lambda c: F.min_by(F.col(c), F.when(F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull(), F.struct((~own).alias("x"), F.col("src_ord").alias("y"))))
    folded = grouped.groupBy("final").agg(first("name").alias("preferred_name"), first("category").alias("category"), F.count("*").alias("n_records"), F.count_distinct("source_id").alias("n_sources"))
    folded = scratch.save(folded.withColumn("canonical_id", canonical_id(kind, value, F.col("preferred_name"))), "folded")
    members = grouped.join(folded.select("final", "canonical_id"), "final").select("canonical_id", "src_ord", "source_id", "source_record_id")
    ids = claims.where(F.col("verified") | ~F.col("kind").isin(*STRONG_KINDS)).join(members.select("src_ord", "canonical_id"), "src_ord").select("canonical_id", "kind", "value").distinct()
    return Reconciled(folded.select("canonical_id", "preferred_name", "category", "n_records", "n_sources"), members, ids)


def collisions(ids: DataFrame) -> DataFrame:
    """Identifier values owned by more than one canonical id."""
    return ids.groupBy("kind", "value").agg(F.count_distinct("canonical_id").alias("n_owners"), F.min("canonical_id").alias("first_owner"), F.max("canonical_id").alias("last_owner")).where("n_owners > 1")


def validate_registry(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """(rule, subject, n): duplicate ids, missing names, and strong ids with several owners."""
    repeated = registry.groupBy("canonical_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("canonical_id").alias("subject"), "n")
    nameless = registry.where("preferred_name is null or trim(preferred_name) = ''").groupBy("canonical_id").agg(F.count("*").alias("n")).select(F.lit("missing_name").alias("rule"), F.col("canonical_id").alias("subject"), "n")
    overlap = collisions(ids.where(F.col("kind").isin(*STRONG_KINDS))).select(F.lit("strong_id_overlap").alias("rule"), F.concat_ws(":", "kind", "value").alias("subject"), F.col("n_owners").alias("n"))
    return repeated.unionByName(nameless).unionByName(overlap)
