import datetime as dt
import json

from archivum.operators import drift

MAP = [("name", "Format Title", 1), ("name", "Known As", 2), ("risk_level", "Level of Risk", 1), ("holdings_count", "Holdings", 1)]
SCHEMA = {"name": "string", "risk_level": "string", "holdings_count": "bigint"}


def tables(spark, files):
    rows, listed = [], []
    for n, payloads in enumerate(files, 1):
        listed.append((f"f{n}", "feed", dt.datetime(2024, n, 1)))
        rows += [(f"f{n}", k, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for k, p in enumerate(payloads)]
    return (
        spark.createDataFrame(rows, "file_id string, row_no int, payload string, field string"),
        spark.createDataFrame(listed, "file_id string, feed_id string, delivered_at timestamp_ntz"),
        spark.createDataFrame(MAP, "logical_field string, header string, preference int"),
    )


def changes(spark, *files):
    rows, listed, fields = tables(spark, files)
    return sorted(tuple(r) for r in drift.changes(drift.ingest(rows.drop("field"), fields, SCHEMA, once=False), listed).select("file_id", "field_name", "change_kind").collect())


def test_added_removed_renamed_retyped(spark):
    got = changes(
        spark,
        [{"Format Title": "a", "Level of Risk": "low", "Shelf": 1}],
        [{" format-title*": "a", "Level of Risk": 3, "Shelf": 1.5}, {"Shelf": 2}],
        [{"Known As": ["a"], "Level of Risk": None}],
        [{"Known As": ["a"], "Level of Risk": "low", "Shelf": True}],
        [],
    )
    assert got == sorted([
        ("f2", "risk_level", "retyped"), ("f2", "shelf", "retyped"), ("f3", "name", "renamed"), ("f3", "name", "retyped"), ("f3", "shelf", "removed"),
        ("f4", "risk_level", "retyped"), ("f4", "shelf", "added"), ("f5", "name", "removed"), ("f5", "risk_level", "removed"), ("f5", "shelf", "removed"),
    ])


def test_first_file_reports_nothing(spark):
    assert changes(spark, [{"A": 1}]) == []


def test_ingest_keeps_every_value(spark):
    rows, _, fields = tables(spark, [[{"Format Title": "x", "Holdings": "many", "Audit Year": 2020}, {"Known As": ["p", "q"], "Holdings": 7}, "no json", None, {}]])
    got = {r["row_no"]: r for r in drift.ingest(rows.unionByName(rows), fields, SCHEMA).collect()}
    assert len(got) == 5 and got[0]["field"] == "clash"
    assert (got[0]["name"], got[0]["holdings_count"], json.loads(got[0]["_rescued"])) == ("x", None, {"Holdings": "many", "Audit Year": 2020})
    assert got[1]["name"] is None and got[1]["holdings_count"] == 7 and json.loads(got[1]["_rescued"]) == {"Known As": ["p", "q"]}
    assert json.loads(got[2]["_rescued"]) == {"_payload": "no json"} and got[3]["_rescued"] is None and got[4]["_rescued"] is None


def test_promote_and_replay_empty_the_rescue_column(spark):
    rows, _, fields = tables(spark, [[{"Known As": ["p", "q"], "Level of Risk": 3, "Audit Year": 2020}]])
    df = drift.replay(drift.replay(drift.ingest(rows, fields, SCHEMA), fields, "name"), fields, "risk_level")
    got = drift.promote(df, "audit_YEAR", "year", "int").first()
    assert (got["name"], got["risk_level"], got["year"], got["_rescued"]) == ("p;q", "3", 2020, None)


def test_fractions_and_booleans_in_a_whole_number_field_stay_rescued(spark):
    payloads = [{"Holdings": 1756.25}, {"Holdings": True}, {"Holdings": 1756}, {"Holdings": 10**19}]
    rows, _, fields = tables(spark, [payloads])
    got = {r["row_no"]: (r["holdings_count"], r["_rescued"] and json.loads(r["_rescued"])) for r in drift.ingest(rows, fields, SCHEMA).collect()}
    assert got == {0: (None, payloads[0]), 1: (None, payloads[1]), 2: (1756, None), 3: (None, payloads[3])}


def test_promote_cuts_no_fraction_off(spark):
    rows, _, fields = tables(spark, [[{"Audit Year": 2020.5}, {"Audit Year": "2021"}, {"Audit Year": 2022}]])
    got = {r["row_no"]: (r["year"], r["_rescued"] and json.loads(r["_rescued"])) for r in drift.promote(drift.ingest(rows, fields, SCHEMA), "Audit Year", "year", "int").collect()}
    assert got == {0: (None, {"Audit Year": 2020.5}), 1: (2021, None), 2: (2022, None)}


def test_table_replays_every_approved_field(spark, tmp_path):
    headers = {f: f"The {f}" for f in drift.POLICY_SCHEMA}
    fields = [(f, h, 1) for f, h in headers.items()] + [("holdings_count", "Items", 2)]
    drifted = {h: ["p", "q"] for h in headers.values()} | {"The institution_format_id": 49785, "The risk_level": 4.5, "The holdings_count": "many", "Items": "5759", "Shelf": "s"}
    kept = {"The holdings_count": "1756.25", "The name": {"a": 1}}
    rows = [("f1", 0, json.dumps(drifted)), ("f1", 1, json.dumps(kept)), ("f1", 2, json.dumps({"The name": "typed", "Items": True}))]
    for name, data, schema in [("policy_file_row", rows, "file_id string, row_no int, payload string"), ("field_map", fields, "logical_field string, header string, preference int")]:
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["row_no"]: r.asDict() for r in drift.p2_table(spark, str(tmp_path)).collect()}
    want = dict.fromkeys(drift.POLICY_SCHEMA, "p;q") | {"institution_format_id": "49785", "risk_level": "4.5", "holdings_count": 5759}
    assert {f: got[0][f] for f in drift.POLICY_SCHEMA} == want and json.loads(got[0]["_rescued"]) == {"The holdings_count": "many", "Shelf": "s"}
    assert all(got[1][f] is None for f in drift.POLICY_SCHEMA) and json.loads(got[1]["_rescued"]) == kept
    assert got[2]["name"] == "typed" and json.loads(got[2]["_rescued"]) == {"Items": True}


def test_empty_tables(spark):
    rows, listed, fields = tables(spark, [[{"A": 1}]])
    assert drift.changes(drift.ingest(rows.limit(0), fields.limit(0), SCHEMA), listed).count() == 0
    assert drift.ingest(rows.limit(0), fields, SCHEMA).count() == 0


def test_of_two_payloads_of_one_row_the_last_in_order_counts(spark):
    rows = spark.createDataFrame([("f", 1, '{"Format Title": "a"}', 1), ("f", 1, '{"Format Title": "b"}', 2), ("f", 1, None, 3)], "file_id string, row_no int, payload string, extra int")
    fields = spark.createDataFrame(MAP, "logical_field string, header string, preference int")
    assert [(r["name"], r["extra"]) for r in drift.ingest(rows, fields, SCHEMA).collect()] == [("b", 2)]


def test_seen_says_what_became_of_each_header(spark):
    rows, _, fields = tables(spark, [[{"Format Title": "x", "Known As": "y", "Holdings": "many", "Shelf": None}]])
    row = drift.ingest(rows, fields, SCHEMA).first()
    assert {(x["field"], x["key"], x["type"]) for x in row["_seen"]} == {("name", "formattitle", "string"), ("name", "knownas", "string"), ("holdings_count", "holdings", "string"), ("shelf", "shelf", None)}
    assert row["_typed"] == ["Format Title"]
