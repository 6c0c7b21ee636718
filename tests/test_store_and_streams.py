import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.sources import files
from quarry.store import Store
from quarry.streaming import feeds


def test_store_versions_upserts_and_deletes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    frame = lambda rows: spark.createDataFrame(rows, "id long, project_id long, v string")
    store.write("t", frame([(1, 1, "a"), (2, 2, "b")]))
    held = store.read("t")
    store.upsert("t", frame([(2, 2, None), (3, 1, "c")]), ["id"], keep_old=True)
    assert {(r.id, r.v) for r in store.read("t").collect()} == {(1, "a"), (2, "b"), (3, "c")} and held.count() == 2
    store.insert_new("t", frame([(3, 1, "z"), (4, 1, "d")]), ["id"])
    assert {r.v for r in store.read("t").collect()} == {"a", "b", "c", "d"}
    store.delete_project(1, ["t", "missing"])
    assert [r.id for r in store.read("t").collect()] == [2]
    with pytest.raises(KeyError):
        store.read("none")


def test_delete_files_removes_what_hangs_on_them(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("nodes", spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, project_id long, file_path string"))
    store.write("edges", spark.createDataFrame([(1, 2), (2, 2)], "source_node_id long, target_node_id long"))
    store.delete_files(1, spark.createDataFrame([("a",)], "file_path string"))
    assert [r.id for r in store.read("nodes").collect()] == [2] and [tuple(r) for r in store.read("edges").collect()] == [(2, 2)]


def test_walk_and_history(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "target").mkdir()
    (root / ".gitignore").write_text("target/\n")
    (root / "src/a.rs").write_text("fn a() {}\n")
    (root / "target/b.rs").write_text("fn b() {}\n")
    (root / "src/bad.py").write_bytes(b"\xff\xfe")
    (root / "notes.md").write_text("x")
    assert {(r.file_path, r.language) for r in files.walk_files(spark, str(root)).collect()} == {("src/a.rs", "rust")}
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, env=os.environ)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "first")
    (root / "src/a.rs").write_text("fn a() { }\n")
    run("commit", "-qam", "fix: second")
    history = files.git_log(spark, str(root)).collect()
    assert [(r.message, r.file_path, r.change_type) for r in history] == [("fix: second", "src/a.rs", "modified"), ("first", None, None)]
    nodes = spark.createDataFrame([(1, f"{root}/src/a.rs"), (2, "/x/sa.rs")], "id long, file_path string")
    assert [(r.node_id) for r in files.suffix_links(files.git_log(spark, str(root)), nodes).collect()] == [1]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 05:00:00"), (1, "2024-01-03 00:00:00")], "node_id long, t string").select("node_id", F.col("t").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def result(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {(r.node_id, r.accesses) for r in result(feeds.access_counts(stream()), "counts", "complete")} == {(1, 3), (2, 1)}
    closed = {(str(r.start), r.node_id, r.accesses) for r in result(feeds.activity(stream(), "1 day", "1 day"), "windows", "append")}
    assert ("2024-01-01 00:00:00", 1, 2) in closed
    assert any(r.accesses == 2 for r in result(feeds.sessions(stream()), "runs", "append"))
    store = Store(spark, f"file://{tmp_path}/s")
    states = spark.createDataFrame([(1, "a", "1"), (1, "b", "1")], "project_id long, file_path string, content_hash string")
    states.write.parquet(f"{tmp_path}/states")
    feeds.refresh_states(spark.readStream.schema(states.schema).parquet(f"{tmp_path}/states"), store).awaitTermination()
    assert store.read("file_states").count() == 2 and {r.status for r in store.read("file_states_changes").collect()} == {"new"}


def test_bounded_memory(spark, tmp_path):
    rows = spark.createDataFrame([("o", f"k{i % 5}", str(i), i) for i in range(8)], "owner string, key string, value string, ts long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = feeds.recent_notes(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), 3).writeStream.format("memory").queryName("notes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(r.size for r in spark.table("notes").collect()) == 3


def test_methods_are_no_control_statements():
    from quarry.sources.extract import entities

    text = "public class A {\n    A(int x) {\n        this.x = x;\n    }\n    public Map<String, List<Integer>> all(int a) throws E, F {\n        if (a > 1) {\n            foreach (var q in z) {\n            }\n        } else if (b) {\n        }\n        return new B() {\n        };\n    }\n    private static int one() {\n        return 1;\n    }\n}\n"
    for language in ("java", "csharp"):
        assert [(e[0], e[1]) for e in entities(text, language)] == [("class", "A"), ("method", "A"), ("method", "all"), ("method", "one")]
    packed = "class A{void f(int a){if(a){g();}}}" + "x" * 2100 + ";function h(b){return b}"
    assert {e[1] for e in entities(packed, "javascript")} >= {"A", "h"}
