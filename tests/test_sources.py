import io
import json
import zipfile

import pytest

from archivum.plans.api import Registry, Request, RequestError
from archivum.sinks import writers
from archivum.sources import adapters, files
from archivum.streaming import landing


def put(folder, **named):
    for name, data in named.items():
        (folder / name.replace("__", ".")).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def zipped(**named):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in named.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def rows(df):
    return {r["source_record_id"]: r for r in df.collect()}


def test_snapshots_change_by_content(spark, tmp_path):
    path = put(tmp_path, a__txt="one", b__txt="two")
    first = files.snapshots(spark, path, "s")
    assert all(r["changed"] for r in first.collect())
    before = spark.createDataFrame([(r["uri"], r["sha256"].upper() if "a.txt" in r["uri"] else "0") for r in first.collect()], "uri string, sha256 string")
    assert {r["uri"][-5:]: r["changed"] for r in files.snapshots(spark, path, "s", before).collect()} == {"a.txt": False, "b.txt": True}


def test_pronom_json_and_zip(spark, tmp_path):
    doc = json.dumps({"formatName": "Alpha", "version": "1.0", "identifiers": [{"identifierType": "PUID", "identifierText": "fmt/7"}, {"identifierType": "MIME", "identifierText": "a/b"}], "extensions": ["al"]})
    path = put(tmp_path, z__zip=zipped(one__json=doc, broken__json="{"), fmt_8__json=json.dumps({"formatName": "Beta"}))
    got = rows(adapters.read(spark, "pronom_registry", path, "pronom"))
    assert got["fmt/7"]["mime_types"] == ["a/b"] and got["fmt/8"]["name"] == "Beta" and len(got) == 2


def test_droid_xml_any_namespace(spark, tmp_path):
    xml = "<r xmlns='urn:x'><deep><FileFormat Name='Alpha' Version='2' PUID='fmt/1' MIMEType='a/b, c/d'><Extension>al</Extension></FileFormat></deep><FileFormat Name='no id'/></r>"
    got = rows(adapters.read(spark, "pronom_droid_xml", put(tmp_path, d__xml=xml), "droid"))
    assert got["fmt/1"]["name"] == "Alpha 2" and got["fmt/1"]["extensions"] == ["al"] and got["fmt/1"]["mime_types"] == ["a/b", "c/d"]


def test_loc_xml_skips_related_subtrees(spark, tmp_path):
    xml = "<FDD id='fdd1' titleName='Alpha'><extension>al</extension><relationships><puid>fmt/9</puid></relationships><puid>fmt/1</puid><note>see fmt/5 and Q42</note><disclosure>Open.</disclosure><factor name='Adoption'>Wide.</factor></FDD>"
    path = put(tmp_path, fdd1__xml=xml)
    plain, reviewed = rows(adapters.read(spark, "loc_fdd_xml", path, "loc"))["fdd1"], rows(adapters.read(spark, "loc_fdd_xml_reviewed", path, "loc"))["fdd1"]
    assert plain["puids"] == ["fmt/1", "fmt/5"] and reviewed["puids"] == ["fmt/1"] and reviewed["source_type"] == "loc_fdd_xml"
    assert json.loads(plain["native"])["factors"] == {"adoption": "Wide.", "disclosure": "Open."}
    assert json.loads(reviewed["native"]) == {"context_ids": ["Q42", "fmt/5"], "factors": {"adoption": "Wide."}}


def test_crosswalk_variants(spark, tmp_path):
    path = put(tmp_path, a__csv="FDD,Format Title,PUID,Wikidata QID\nfdd1,Alpha,fmt/1 fmt/2,Q7\n", b__csv="Filename,LC_Unique_ID,LC_Short_Name,LC_Long_Name,PRONOM_PUID,PRONOM_Note,Wikidata_Title_ID,Wikidata_Note\nx.xml,fdd2,B,Beta,fmt/3,not fmt/4,Q8,\n")
    got = rows(adapters.read(spark, "loc_crosswalk_csv", path, "x"))
    assert got["fdd1"]["puids"] == ["fmt/1", "fmt/2"] and got["fdd2"]["puids"] == ["fmt/3"] and got["fdd2"]["wikidata_ids"] == ["Q8"] and got["fdd1"]["record_role"] == "evidence_only"


def test_nara_companion_files_override(spark, tmp_path):
    path = put(tmp_path, plans__csv="NARA Format ID,Format Name,Category,NARA Total\nNF1,Alpha,Text,5\n", risk_matrix__csv="NARA Format ID,Format Name,NARA Total,1.1: open?\nNF1,,-30,yes\n")
    got = rows(adapters.read(spark, "nara_digital_preservation_framework", path, "nara"))["NF1"]
    native = json.loads(got["native"])
    assert got["name"] is None and got["category"] == "Text" and native["hazard"] == {"rating": -30.0, "band": "High", "direction": "higher_is_safer"} and native["rubric"] == {"1.1: open?": "yes"}


def test_endangered_list_front_matter(spark, tmp_path):
    got = rows(adapters.read(spark, "endangered_list", put(tmp_path, a__md="---\ntitle: Old Tapes\nclassification: Critically Endangered\ncategory: media\nextensions:\n  - ot\n---\nBody text\n", b__md="no header"), "list"))
    assert json.loads(got["a"]["native"]) == {"native_label": "Critically Endangered", "semantic_level": "critical", "scope_type": "content_type"} and got["a"]["extensions"] == ["ot"] and len(got) == 1


def test_institution_xlsx(spark, tmp_path):
    cells = [["Policy of the archive"], [], ["Record No", "Kind of Object", "File Suffixes", "Local Risk"], ["7", "Alpha Text", "al;be", "High Risk"], ["", "12", "", ""]]
    shared = sorted({c for r in cells for c in r if c})
    sheet = "".join(f"<row r='{n}'>" + "".join(f"<c r='{chr(65 + k)}{n}' t='s'><v>{shared.index(c)}</v></c>" for k, c in enumerate(r) if c) + "</row>" for n, r in enumerate(cells, 1))
    book = zipped(**{"xl/sharedStrings__xml": "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>", "xl/worksheets/sheet1__xml": f"<worksheet><sheetData>{sheet}</sheetData></worksheet>"})
    got = rows(adapters.read(spark, "institution_xlsx", put(tmp_path, p__xlsx=book), "inst"))
    assert got["7"]["extensions"] == ["al", "be"] and json.loads(got["7"]["native"])["institution_policy"]["local_risk_level"] == "High Risk" and len(got) == 1


def test_packages_graph_and_lists(spark, tmp_path):
    (tmp_path / "p").mkdir()
    got = rows(adapters.read(spark, "standard_json", put(tmp_path / "p", a__json=json.dumps({"records": [{"id": "1", "name": "A", "puids": ["fmt/2"], "identifiers": {"puid": ["fmt/1"]}}, {"name": "B"}]})), "pkg"))
    assert got["1"]["puids"] == ["fmt/1"] and got["record-2"]["name"] == "B"
    eav = spark.createDataFrame([("Q10", "mime", "b/b"), ("Q10", "mime", "a/a"), ("Q10", "mime", "a/a"), ("Q9", "label", "Nine"), ("Q9", "x", " ")], "qid string, predicate string, value string")
    merged = adapters.merge_statements(eav)
    assert [r["qid"] for r in merged.orderBy("place").collect()] == ["Q9", "Q10"] and rows(adapters.graph_records(merged, "g"))["Q10"]["mime_types"] == ["a/a", "b/b"]
    (tmp_path / "w").mkdir()
    ids = files.id_list(spark, put(tmp_path / "w", w__csv="puid,label,notes\nfmt/1,A,\nFMT/1,B,x\nfmt/2,,\n"))
    assert sorted((r["id"], r["label"]) for r in ids.collect()) == [("fmt/1", "A"), ("fmt/2", "")]
    with pytest.raises(KeyError):
        adapters.read(spark, "odd", "x", "y")


def test_sinks_round_trip(spark, tmp_path):
    import sqlite3

    df = spark.createDataFrame([("f1", "A", ["x", "y"]), ("f2", None, [])], "canonical_id string, preferred_name string, extensions array<string>")
    store = writers.TableStore(spark, f"file://{tmp_path}/store")
    store.write("t", df)
    store.upsert("t", spark.createDataFrame([("f2", "B", ["z"]), ("f3", "C", None)], df.schema), ["canonical_id"])
    assert sorted((r[0], r[1]) for r in store.read("t").collect()) == [("f1", "A"), ("f2", "B"), ("f3", "C")]
    assert store.query("t", extensions=None).count() == 1 and store.query("t", canonical_id="f1").count() == 1 and store.read("none") is None
    writers.write_csv(df, f"{tmp_path}/csv")
    assert {r["canonical_id"]: r["extensions"] for r in spark.read.option("header", "true").csv(f"{tmp_path}/csv").collect()} == {"f1": "x;y", "f2": None}
    writers.write_json(df, f"{tmp_path}/json", single=True)
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    empty = spark.createDataFrame([], "canonical_id string, preferred_name string, category string, hazard_band string")
    writers.write_sqlite({"formats": empty.unionByName(df.select("canonical_id", "preferred_name"), allowMissingColumns=True)}, f"{tmp_path}/r.sqlite")
    assert sqlite3.connect(f"{tmp_path}/r.sqlite").execute("select count(*) from formats").fetchone() == (2,)
    assert "| f1 | A |" in writers.markdown_report("R", {"S": df.select("canonical_id", "preferred_name")}) and "<td>f1</td>" in writers.html_report("R", {"S": df})


def test_landing_stream_equals_batch(spark, tmp_path):
    schema = "canonical_id string, criterion_id string, source_id string, source_record_id string, rule_id string, institution_id string, value string, observed_at timestamp"
    (tmp_path / "in").mkdir()
    line = {"canonical_id": "f", "criterion_id": "c", "source_id": "s", "source_record_id": "1", "rule_id": "r", "value": "x", "observed_at": "2024-01-01T00:00:00Z"}
    put(tmp_path / "in", a__json="\n".join(json.dumps(x) for x in (line, line, line | {"source_record_id": "2"})))
    store = writers.TableStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        landing.merge_batches(landing.read_claims(spark, str(tmp_path / "in"), schema), store, "claims", f"{tmp_path}/ck").awaitTermination()
    assert sorted((r["source_record_id"], r["current"]) for r in store.read("claims").collect()) == [("1", True), ("2", True)]


def test_requests(spark):
    mk = spark.createDataFrame
    reg = Registry(
        mk([("f1", "Alpha", "Text"), ("f2", "Alpha Two", "Text"), ("f3", "Beta", "Image")], "canonical_id string, preferred_name string, category string"), mk([], "canonical_id string, kind string, value string, verified boolean"),
        mk([("f1", "s", "high", "exact_format"), ("f3", "s", "low", "exact_format")], "canonical_id string, source_id string, semantic_level string, scope_type string"), mk([("f1", "q1", "yes", None), ("f1", "q2", "no", "other")], "canonical_id string, field string, value string, institution_id string"),
        mk([("q1", 1.0, True), ("q2", 1.0, False)], "question_id string, weight double, critical boolean"), mk([("q1", "q1"), ("q2", "q2")], "question_id string, field string"), mk([("q1", "yes", 1.0), ("q2", "no", 0.0)], "question_id string, answer_id string, points double"),
    )
    run = lambda **k: reg.execute(Request.parse(k)).collect()
    assert [(r["canonical_id"], r["level"]) for r in run(action="assess_format", format="alpha")] == [("f1", "high")]
    assert {r["question_id"]: r["status"] for r in run(action="assess_format_questions", format="f1")} == {"q1": "derived", "q2": "missing_evidence"}
    assert {r["question_id"]: r["status"] for r in run(action="assess_format_questions", format="f1", institution_id="other")}["q2"] == "derived"
    assert [r["canonical_id"] for r in run(action="search_formats", query="Alpha")] == ["f1", "f2"] and len(run(action="assess_format_family", query="text")) == 2
    assert [r["canonical_id"] for r in run(action="list_at_risk_formats", levels=["high"])] == ["f1"] and len(run(action="list_assessment_questions")) == 2
    assert len(run(action="list_evidence_gaps")) == 5 and [r["canonical_id"] for r in run(action="plan_evidence_remediation", limit=1)] == ["f2"]
    for bad in ({"action": "odd"}, {"action": "search_formats"}, {"action": "list_evidence_gaps", "limit": 0}, {"action": "list_evidence_gaps", "x": 1}):
        with pytest.raises(RequestError):
            Request.parse(bad)


def test_registry_exports_bridges_and_releases(spark, tmp_path):
    for n, doc in enumerate(([{"canonical_id": "a", "preferred_name": "A", "identifiers": {"puid": ["fmt/1"]}}], {"formats": [{"canonical_id": "b"}]}, {"c": {"name": "C"}})):
        put(tmp_path, **{f"r{n}__json": json.dumps(doc)})
    got = rows(adapters.read(spark, "registry_json", str(tmp_path), "r"))
    assert set(got) == {"a", "b", "c"} and got["a"]["puids"] == ["fmt/1"]
    (tmp_path / "b").mkdir()
    path = put(tmp_path / "b", b__json=json.dumps({"rules": [{"fdd_id": "fdd1", "puid": "fmt/1", "review_status": "approved_by_policy"}, {"fdd_id": "fdd2", "puid": "fmt/2", "review_status": "draft"}]}), e__csv="source_record_id,format_name,criterion_id,value\n1,A,c1,x\n1,A,c2,y\n")
    assert set(rows(adapters.read(spark, "approved_bridge_json", path, "b"))) == {"fdd1:fmt/1"}
    assert len(json.loads(rows(adapters.read(spark, "institution_evidence_csv", path, "e"))["1"]["native"])["evidence"]) == 2
    rel = spark.createDataFrame([("v1", "2024-01-01", "p1"), ("v2", "2024-02-01", "p2")], "release string, released_on string, path string")
    assert [adapters.select_release(rel, *a).first()["path"] for a in ((), ("v1",), ("v1", "v2"), ("v9",))] == ["p2", "p1", "p2", "p2"]


def test_unreadable_files_are_listed(spark, tmp_path):
    import io
    import zipfile

    from archivum.sources import files

    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("in.json", "{bad")
        z.writestr("ok.xml", "<a/>")
    for name, data in {"a.json": b"{", "b.json": b'{"x": 1}', "c.xml": b"<a>", "d.csv": b"\xff\xfe\x00", "e.xlsx": b"PK\x03\x04broken", "f.zip": box.getvalue(), "g.jsonl": b'{"a": 1}\n\n{"b": 2}\n'}.items():
        (tmp_path / name).write_bytes(data)
    got = {(r["path"].rsplit("/", 1)[-1], r["member"]) for r in files.rejects(spark, str(tmp_path)).collect()}
    assert got == {("a.json", ""), ("c.xml", ""), ("d.csv", ""), ("e.xlsx", ""), ("f.zip", "in.json")}


def test_numbers_of_records_restart_with_each_source(spark):
    rows = [(s, f"r{n:03d}", "x") for s in ("a", "b") for n in range(120)] + [("b", "r000", "w"), ("c", None, None)]
    got = adapters.ordered(spark.createDataFrame(rows, "source_id string, source_record_id string, name string"))
    by = {(r["source_id"], r["source_record_id"], r["name"]): r["src_ord"] for r in got.collect()}
    assert by["a", "r000", "x"] == "a:000000000001" and by["a", "r119", "x"] == "a:000000000120" and by["b", "r000", "w"] == "b:000000000001" and by["b", "r001", "x"] == "b:000000000003" and by["c", None, None] == "c:000000000001"
