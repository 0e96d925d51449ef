import json

from archivum.functions import documents


def test_paths_and_hashes(spark):
    deep = {"a": {"b": {"c": {"d": {"e": 1}}}}, "l": [{"x": 1}, {"y": 2}], "n": None}
    rows = [(1, json.dumps(deep)), (2, json.dumps({"k": [1, {"z": 1, "t": 5}], "t": 1})), (3, json.dumps({"t": 9, "k": [{"t": 7, "z": 1}, 1]})), (4, "no json"), (5, None), (6, json.dumps({"k": [1, {"z": 2}]})), (7, "[]")]
    df = spark.createDataFrame(rows, "id int, doc string")
    got = {r["id"]: r for r in df.select("id", documents.field_paths(df["doc"]).alias("p"), documents.document_hash(df["doc"], ("t",)).alias("h")).collect()}
    assert got[1]["p"] == ["a", "a.b", "a.b.c", "a.b.c.d", "l", "l.x", "l.y", "n"]
    assert got[2]["h"] == got[3]["h"] != got[6]["h"] and got[4]["h"] is None and got[5]["p"] is None and got[7]["p"] == []
