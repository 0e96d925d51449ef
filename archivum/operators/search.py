"""Finding formats: resolution in tiers, ranked search, fuzzy shortlists, natural order of ids."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.session import Scratch

from archivum.functions.normalize import match_words, puid_variants

#: Priority of a match tier (fixed values).
TIERS = {"canonical_id": 100, "verified_authority_id": 95, "authority_id": 90, "exact_name": 85, "mime": 80, "extension": 70, "alias": 50}
SHORT_LIST, MAX_AMBIGUOUS = 20, 10


def lookup_keys(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """(tier, key, canonical_id): everything a format can be found by.

    registry(canonical_id, preferred_name); ids(canonical_id, kind, value, verified).
    """
    strong = F.col("kind").isin("puid", "loc", "nara")
    tier = F.when(strong & F.col("verified"), "verified_authority_id").when(strong, "authority_id").when(F.col("kind") == "mime", "mime").when(F.col("kind") == "extension", "extension")
    own = registry.select(F.lit("canonical_id").alias("tier"), F.lower("canonical_id").alias("key"), "canonical_id")
    named = registry.where("preferred_name is not null").select(F.lit("exact_name").alias("tier"), match_words(F.col("preferred_name")).alias("key"), "canonical_id")
    by_id = ids.select(tier.alias("tier"), F.lower(F.trim("value")).alias("key"), "canonical_id").where("tier is not null")
    alias = ids.where(strong).select(F.lit("alias").alias("tier"), F.concat(F.col("kind"), F.lit("-"), F.replace(F.lower(F.trim("value")), F.lit("/"), F.lit("-"))).alias("key"), "canonical_id")
    return own.unionByName(named).unionByName(by_id).unionByName(alias).where("key != ''").distinct()


def resolve(terms: DataFrame, keys: DataFrame, term: str = "term") -> DataFrame:
    """(term, tier, priority, canonical_id, n_matches, ambiguous, rank): only the best tier of a term survives; at most ten are shown, the total is kept."""
    spelled = terms.select(term, F.explode(F.array_distinct(F.array_union(F.array(F.lower(F.trim(term)), match_words(F.col(term))), puid_variants(F.col(term))))).alias("key")).where("key != ''")
    hits = spelled.join(keys, "key").select(term, "tier", F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.col("tier")].alias("priority"), "canonical_id").distinct()
    best = hits.withColumn("top", F.max("priority").over(Window.partitionBy(term))).where("priority = top").groupBy(term, "priority", "canonical_id").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy(term)
    ranked = best.withColumn("n_matches", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("canonical_id")))
    return ranked.where(F.col("rank") <= MAX_AMBIGUOUS).select(term, "tier", "priority", "canonical_id", "n_matches", (F.col("n_matches") > 1).alias("ambiguous"), "rank")


def search_score(name: Column, query: str) -> Column:
    """2 for the name itself, 1 for a name that contains it, null otherwise."""
    q, n = F.lit(" ".join("".join(c if c.isalnum() else " " for c in query.lower()).split())), match_words(name)
    return F.when(n == q, 2).when(n.contains(q), 1)


def search(registry: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Ranked search: exact before contains, then by label."""
    hits = registry.withColumn("score", search_score(F.col("preferred_name"), query)).where("score is not null")
    return hits.select("canonical_id", "preferred_name", "score").dropDuplicates(["canonical_id"]).orderBy(F.desc("score"), F.lower("preferred_name"), "canonical_id").limit(limit)


def family_score(name: Column, family: Column, query: str) -> Column:
    """Explicit family metadata beats names: 4 family, 3 name, 2 name starts with, 1 contains."""
    q = F.lit(" ".join("".join(c if c.isalnum() else " " for c in query.lower()).split()))
    n, f = match_words(name), match_words(family)
    return F.when(f == q, 4).when(n == q, 3).when(n.startswith(F.concat(q, F.lit(" "))), 2).when(n.contains(q), 1)


def _fuzzy(query: str):
    tokens = [t for t in query.split() if len(t) >= 2]

    def one(cand: str) -> float:
        if cand == query:
            return 1.0
        best = SequenceMatcher(None, query, cand).ratio()
        if len(cand.replace(" ", "")) >= 3 and cand in query or len(query.replace(" ", "")) >= 3 and query in cand:
            best = max(best, 0.88)
        theirs = [t for t in cand.split() if len(t) >= 2]
        both = set(tokens) & set(theirs)
        if theirs and both:
            if set(theirs) <= set(tokens):
                best = max(best, 0.96 if len(set(theirs)) == 1 else 0.92)
            else:
                best = max(best, 0.55 + 0.25 * len(both) / len(set(theirs)) + 0.10 * len(both) / len(set(tokens)))
        return min(best, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            yield pd.DataFrame({"canonical_id": b["canonical_id"], "preferred_name": b["preferred_name"], "score": [one(n or "") for n in b["words"]]})

    return run


def shortlist(registry: DataFrame, query: str, k: int = SHORT_LIST) -> DataFrame:
    """Top k names by a fuzzy score; long queries accept lower scores.  The ranking is the feature, so it is cut at k."""
    words = " ".join("".join(c if c.isalnum() else " " for c in query.lower()).split())
    floor = 0.10 if len(words.split()) >= 4 else 0.25
    scored = registry.select("canonical_id", "preferred_name", match_words(F.col("preferred_name")).alias("words")).mapInPandas(_fuzzy(words), "canonical_id string, preferred_name string, score double")
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), F.lower("preferred_name"), "canonical_id").limit(k)


def preferred_by_puid(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """The canonical id a PUID stands for: its own id before others, one with a single PUID before many, then the last id."""
    puids = ids.where("kind = 'puid'").select("canonical_id", "value").distinct()
    single = puids.groupBy("canonical_id").agg((F.count("*") == 1).alias("single"))
    w = Window.partitionBy("value").orderBy(F.col("canonical_id").startswith("puid-").desc(), F.desc("single"), F.desc("canonical_id"))
    best = puids.join(single, "canonical_id").withColumn("n", F.row_number().over(w)).where("n = 1").select("value", "canonical_id")
    return best.join(registry.select("canonical_id", "preferred_name"), "canonical_id", "left")


def puid_order(c: Column) -> list[Column]:
    """Natural order: name space, then number."""
    return [F.regexp_extract(c, r"^([^/]*)/", 1), F.regexp_extract(c, r"/(\d+)$", 1).try_cast("int")]


def references(df: DataFrame, partition: list[str], order: list, most: int | None = None) -> DataFrame:
    """Reference numbers E001, E002, ... (E1000 after E999) in a stable order; with ``most`` only the first ones."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    if most is not None:
        numbered = numbered.where(F.col("__n") <= most)
    return numbered.withColumn("reference", F.format_string("E%03d", "__n")).drop("__n")


def places(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``place``, 1 for the first row in order: ranges are numbered where they are and moved on by what lies before them."""
    spark = df.sparkSession
    scratch = Scratch(spark, "places")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.save(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    # One row per range, of which there are as many as partitions.
    sizes = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())
    starts = F.create_map(*[F.lit(x).cast("bigint") for n, (k, _) in enumerate(sizes) for x in (k, sum(c for _, c in sizes[:n]))]) if sizes else F.create_map(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("place", (local + F.element_at(starts, F.col("__range").cast("bigint"))).cast("bigint")).drop("__range")
