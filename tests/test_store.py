"""The snapshot store end to end."""

from pyspark.sql import functions as F

from graphloom.sources.store import GraphStore


def test_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    cols = "uid string, label string, project_name string, qualified_name string, file_path string, name string, content_hash string, visibility string, docstring string"
    rows = [("p:m", "Module", "p", "m", "m.py", "m", "1", "public", None), ("p:m.f", "Callable", "p", "m.f", "m.py", "f", "1", "public", "reads the table"), ("p:m.g", "Callable", "p", "m.g", "m.py", "g", "1", "private", None)]
    n = spark.createDataFrame(rows, cols)
    e = spark.createDataFrame([("p:m", "p:m.f", "DEFINES"), ("p:m.g", "p:m.f", "CALLS")], "from_uid string, to_uid string, rel_type string")
    assert {r.change for r in store.upsert(n, e).collect()} == {"added"}
    assert {r.change for r in store.upsert(n, e).collect()} == {"unchanged"} and store.edges.count() == 2
    changed = store.upsert(n.where("name <> 'g'").withColumn("content_hash", F.lit("2")), e.limit(1))
    assert {(r.uid, r.change) for r in changed.collect()} == {("p:m", "modified"), ("p:m.f", "modified"), ("p:m.g", "deleted")}
    store.merge_project("p", mode="full")
    store.merge_project("p", files=1)
    assert store.entity("p").first().props == {"mode": "full", "files": "1"}
    store.merge_packages("p", [("a", "a"), ("a.b", "a/b")])
    assert [r.uid for r in store.neighbours("p:a", "CONTAINS").collect()] == ["p:a.b"]
    store.link_imports(spark.createDataFrame([(1, "p", "a.b.x", "p:m"), (2, "p", "numpy.linalg", "p:m")], "import_id int, project_name string, target string, from_uid string"))
    assert {r.to_uid for r in store.edges.where("rel_type = 'IMPORTS'").collect()} == {"p:a.b", "p:ext/numpy"}
    store.set_package_versions(spark.createDataFrame([("numpy", "2.0")], "package string, version string"))
    assert store.entity("p:ext/numpy").first().version == "2.0"
    assert store.search("f", 3, scope="p").first().uid == "p:m.f" and store.search("reads table", 3).count() == 1
    assert store.analyse("structure").count() >= 4 and store.status().where("project_name = 'p'").first().entities == store.nodes.count()
    reopened = GraphStore(spark, f"file://{tmp_path}/graph")
    reopened.delete_files("p", ["m.py"])
    assert reopened.nodes.where("file_path = 'm.py'").count() == 0
    reopened.delete_project("p")
    assert reopened.nodes.count() == 0 and reopened.edges.count() == 0 and store.nodes.count() > 0
