"""Files whose schema drifts: one typed table out of all of them, and each change reported.

Rescue-column ingestion.  Every header is mapped to a logical field; values that
fit the target type go to the typed column, everything else (unknown fields,
values of another type, payloads that are no object) is kept as JSON in
``_rescued``.  Later, ``promote`` turns a rescued field into a typed column and
``replay`` converts rescued values of approved fields (``replay_fields``: all at once), both without reading the
files again.  What each header was (its field, its type) is kept per row in
``_seen``, and which were typed in ``_typed``; ``changes`` reports drift from
the first of the ingested table, without looking at the payloads again.

Scale: mapping, casting, promoting and replaying are row-wise.  Rows delivered
twice are found by one shuffle by (file, row); a report does not need that, as
repeated rows add nothing to it.  ``changes`` groups by file and field after a
map-side combine.

The header map is a reference list of bounded size (``MAX_HEADERS``) and becomes
part of the plan as a literal.

Edge cases (tested): a null value makes its field present but has no type; a
payload that is null or no JSON object yields a row with only ``_rescued``; rows
delivered twice count once (if they differ, the one whose payload sorts last); a file without rows lacks every field; two headers
of one field in a row are taken in the order of preference, the others rescued;
a fraction or a boolean is no whole number and stays rescued;
a field with integers and fractions is a double, with any other mix a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivum.functions.text import header_key
from archivum.session import collect_bounded, table

MAX_HEADERS = 10_000

#: Target schema of the policy rows.
POLICY_SCHEMA = {
    "institution_format_id": "string", "name": "string", "extensions": "string", "mime_types": "string", "category": "string", "description": "string",
    "risk_level": "string", "preservation_action": "string", "preferred_tools": "string", "holdings_count": "bigint",
}


def header_map(field_map: DataFrame) -> Column:
    """Header key to (logical field, preference), as a map literal."""
    best: dict[str, tuple[str, int]] = {}
    for field, key, pref in sorted(collect_bounded(field_map.select("logical_field", header_key(F.col("header")), "preference"), MAX_HEADERS, "the header map"), key=lambda r: (r[2] is None, r[2], r[0])):
        best.setdefault(key, (field, pref if pref is not None else 1 << 30))
    if not best:
        return F.from_json(F.lit("{}"), "map<string,struct<field:string,pref:int>>")
    return F.create_map(*[x for k, (f, p) in best.items() for x in (F.lit(k), F.struct(F.lit(f).alias("field"), F.lit(p).alias("pref")))])


def json_type(v: Column) -> Column:
    """string, integer, double, boolean, array or object; null for a JSON null."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", "string").when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "double")
        .when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def with_fields(rows: DataFrame, field_map: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``__f``: one (field, key, header, pref, type, value) for each header of the payload."""
    known = header_map(field_map)
    entries = F.map_entries(F.from_json(F.col(payload), "map<string,variant>"))

    def one(e: Column) -> Column:
        key = header_key(e["key"])
        hit = F.element_at(known, key)
        return F.struct(
            F.coalesce(hit["field"], key).alias("field"), key.alias("key"), e["key"].alias("header"), F.coalesce(hit["pref"], F.lit(1 << 30)).alias("pref"), json_type(e["value"]).alias("type"), e["value"].alias("value"),
        )

    return rows.withColumn("__f", F.transform(entries, one))


def as_kind(v: Column, kind: str) -> Column:
    """A scalar as ``kind`` through its text, so nothing is cut off; null if it does not cast."""
    return F.try_variant_get(v, "$", "string").try_cast(kind)


def each_row_once(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per (file_id, row_no); of differing ones the one whose payload sorts last."""
    keys, rest = ["file_id", "row_no"], [c for c in rows.columns if c not in ("file_id", "row_no")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(payload)).alias("__r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__r.`{c}`") for c in rows.columns])


def ingest(rows: DataFrame, field_map: DataFrame, schema: dict[str, str], payload: str = "payload", once: bool = True) -> DataFrame:
    """Enforce ``schema``; what does not fit is preserved in ``_rescued`` (a JSON object of header to value).

    ``_seen`` lists the headers of the row (logical field, header key, type of the value, header), ``_typed`` those whose value went to a typed column.
    """
    df = with_fields(each_row_once(rows, payload) if once else rows, field_map, payload)

    # The kind a field should have is looked up once per header, not tried field by field.
    kinds = F.create_map(*[F.lit(x) for kv in schema.items() for x in kv]) if schema else F.create_map(F.lit(""), F.lit(""))

    def fits(x: Column) -> Column:
        kind, scalar = F.element_at(kinds, x["field"]), ~x["type"].isin("array", "object", "string")
        ok = (kind == "string") & (x["type"] == "string")
        for other in sorted(set(schema.values()) - {"string"}):
            ok = ok | (kind == other) & scalar & as_kind(x["value"], other).isNotNull()
        return ok

    fitting = F.transform(F.filter("__f", fits), lambda x: F.struct(x["field"].alias("field"), x["pref"].alias("pref"), x["key"].alias("key"), x["header"].alias("header"), F.variant_get(x["value"], "$", "string").alias("text")))
    out = df.withColumn("__s", F.array_sort(fitting))

    def first(field: str) -> Column:
        return F.get(F.filter("__s", lambda x: x["field"] == field), F.lit(0))

    for field in schema:
        out = out.withColumn(f"__{field}", first(field))
    taken = F.array_compact(F.array(*[F.col(f"__{f}.header") for f in schema])) if schema else F.array().cast("array<string>")
    out, used = out.withColumn("__used", taken), F.col("__used")
    rest = F.filter("__f", lambda x: ~F.array_contains(used, x["header"]) & x["type"].isNotNull())
    rescued = F.when(F.col("__f").isNull(), F.when(F.col(payload).isNotNull(), F.to_json(F.create_map(F.lit("_payload"), F.col(payload))))).when(
        F.size(rest) > 0, F.to_json(F.map_from_entries(F.transform(rest, lambda x: F.struct(x["header"], x["value"]))))
    )
    seen = F.transform("__f", lambda x: F.struct(x["field"].alias("field"), x["key"].alias("key"), x["type"].alias("type"), x["header"].alias("header")))
    return out.select(*[c for c in rows.columns if c != payload], *[F.col(f"__{f}.text").try_cast(k).alias(f) for f, k in schema.items()], rescued.alias("_rescued"), seen.alias("_seen"), used.alias("_typed"))


def _rescued_map() -> Column:
    return F.from_json(F.col("_rescued"), "map<string,variant>")


def _left_over(keep) -> Column:
    left = F.map_filter(_rescued_map(), keep)
    return F.when(F.size(left) > 0, F.to_json(left))


def promote(df: DataFrame, header: str, name: str, kind: str) -> DataFrame:
    """Approve a rescued field: its values that fit ``kind`` move to the typed column ``name``."""
    want = header_key(F.lit(header))
    mine = F.map_filter(_rescued_map(), lambda k, v: (header_key(k) == want) & as_kind(v, kind).isNotNull())
    value = as_kind(F.get(F.map_values(mine), F.lit(0)), kind)
    taken = F.get(F.map_keys(mine), F.lit(0))
    return df.withColumn("__v", value).withColumn("_rescued", F.when(taken.isNull(), F.col("_rescued")).otherwise(_left_over(lambda k, v: k != taken))).withColumnRenamed("__v", name)


def replay(df: DataFrame, field_map: DataFrame, field: str, kind: str = "string") -> DataFrame:
    """Convert rescued values of an approved field that is still null: arrays become ';'-joined text, scalars text."""
    return replay_fields(df, field_map, {field: kind})


def replay_fields(df: DataFrame, field_map: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``replay`` of several fields, each with its own type; of several headers the first that converts in order of preference."""
    known = header_map(field_map)

    def one(e: Column) -> Column:
        key, kind = header_key(e["key"]), F.schema_of_variant(e["value"])
        hit = F.element_at(known, key)
        many = F.array_join(F.try_variant_get(e["value"], "$", "array<string>"), ";")
        text = F.when(kind.startswith("ARRAY"), many).when(~kind.startswith("OBJECT"), F.try_variant_get(e["value"], "$", "string"))
        return F.struct(F.coalesce(hit["field"], key).alias("field"), F.coalesce(hit["pref"], F.lit(1 << 30)).alias("pref"), key.alias("key"), e["key"].alias("header"), text.alias("text"))

    def first(field: str, kind: str) -> Column:
        mine = F.filter("__r", lambda x: (x["field"] == field) & x["text"].try_cast(kind).isNotNull())
        return F.when(F.col(field).isNull(), F.get(F.array_sort(F.transform(mine, lambda x: F.struct(x["pref"].alias("pref"), x["key"].alias("key"), x["header"].alias("header"), x["text"].alias("text")))), F.lit(0)))

    columns = df.columns
    df = df.withColumn("__r", F.transform(F.map_entries(_rescued_map()), one))
    for field, kind in schema.items():
        df = df.withColumn(f"__{field}", first(field, kind))
    taken = F.array_compact(F.array(*[F.col(f"__{f}.header") for f in schema]))
    value = {f: F.coalesce(f, F.col(f"__{f}.text").try_cast(k)).alias(f) for f, k in schema.items()}
    rescued = F.when(F.size(taken) > 0, _left_over(lambda k, v: ~F.array_contains(taken, k))).otherwise(F.col("_rescued")).alias("_rescued")
    return df.select(*[rescued if c == "_rescued" else value.get(c, F.col(c)) for c in columns])


def profiles(ingested: DataFrame) -> DataFrame:
    """One row per file and field: its headers and its type over all ingested rows of the file."""
    seen = ingested.select("file_id", F.explode("_seen").alias("f")).select("file_id", "f.field", "f.key", "f.type")
    kinds = ["string", "integer", "double", "boolean", "array", "object"]
    flags = [F.max(F.when(F.col("type") == k, 1).otherwise(0)).alias(f"__{k}") for k in kinds]
    per = seen.groupBy("file_id", "field").agg(F.array_sort(F.collect_set("key")).alias("headers"), *flags)
    n = sum((F.col(f"__{k}") for k in kinds), F.lit(0))
    kind = F.when(n == 1, F.coalesce(*[F.when(F.col(f"__{k}") == 1, k) for k in kinds])).when((n == 2) & (F.col("__integer") == 1) & (F.col("__double") == 1), "double").when(n > 1, "string")
    return per.select("file_id", "field", "headers", kind.alias("type"))


def changes(ingested: DataFrame, files: DataFrame) -> DataFrame:
    """Added, removed, renamed and retyped fields of each file against the previous one of its feed."""
    order = Window.partitionBy("feed_id").orderBy("delivered_at", "file_id")
    listed = files.groupBy("file_id").agg(F.max(F.struct("delivered_at", "feed_id")).alias("f")).select("file_id", "f.*").withColumn("seq", F.row_number().over(order)).withColumn("next_file", F.lead("file_id").over(order))
    seen = profiles(ingested).join(listed, "file_id")
    w = Window.partitionBy("feed_id", "field").orderBy("seq")
    seen = seen.withColumn("__kept", F.lag("seq").over(w).eqNullSafe(F.col("seq") - 1)).withColumn("__stretch", F.sum(F.when(F.col("__kept"), 0).otherwise(1)).over(w))
    since_added = Window.partitionBy("feed_id", "field", "__stretch").orderBy("seq")
    before = F.last("type", ignorenulls=True).over(since_added.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("__before", before).withColumn("__was", F.lag("headers").over(w)).withColumn("__last", ~F.lead("seq").over(w).eqNullSafe(F.col("seq") + 1))
    found = F.array_compact(F.array(
        F.when(~F.col("__kept") & (F.col("seq") > 1), F.struct("file_id", F.lit("added").alias("change_kind"))),
        F.when(F.col("__kept") & (F.col("__was") != F.col("headers")), F.struct("file_id", F.lit("renamed").alias("change_kind"))),
        F.when(F.col("__kept") & (F.col("__before") != F.col("type")), F.struct("file_id", F.lit("retyped").alias("change_kind"))),
        F.when(F.col("__last") & F.col("next_file").isNotNull(), F.struct(F.col("next_file").alias("file_id"), F.lit("removed").alias("change_kind"))),
    ))
    return seen.select("field", F.explode(found).alias("c")).select("c.file_id", F.col("field").alias("field_name"), "c.change_kind")


def p2_found(spark, sf_dir):
    ingested = ingest(table(spark, sf_dir, "policy_file_row"), table(spark, sf_dir, "field_map"), POLICY_SCHEMA, once=False)
    return changes(ingested, table(spark, sf_dir, "policy_file"))


def p2_table(spark, sf_dir):
    """The one table of all rows: rescued values of all approved fields replayed, two new fields promoted."""
    fields = table(spark, sf_dir, "field_map")
    df = replay_fields(ingest(table(spark, sf_dir, "policy_file_row"), fields, POLICY_SCHEMA), fields, POLICY_SCHEMA).drop("_seen", "_typed")
    return promote(promote(df, "Audit Year", "audit_year", "int"), "Encrypted", "encrypted", "boolean")


def p2_rescued(spark, sf_dir):
    """For each file and field how many rows have it, and how many of them kept it as rescued JSON on ingestion."""
    ingested = ingest(table(spark, sf_dir, "policy_file_row"), table(spark, sf_dir, "field_map"), POLICY_SCHEMA)
    seen = ingested.select("file_id", "_typed", F.explode("_seen").alias("f")).where("f.type is not null")
    return seen.groupBy("file_id", F.col("f.field").alias("field_name")).agg(F.count("*").alias("n_values"), F.count_if(~F.array_contains("_typed", F.col("f.header"))).alias("n_rescued"))
