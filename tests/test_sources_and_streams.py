"""Source trees, stored graphs, journals and streams."""

import json

from graphloom.operators import etl as E
from graphloom.operators import search as S
from graphloom.sources import files as FS
from graphloom.sources import tables as TB
from graphloom.streaming import journal as ST


def test_source_tree(spark, tmp_path):
    for path, text in {"app.ts": "export function go() {\n}\nclass A {\n}\n", "README.md": "# T\n\n## Part\n", "node_modules/x.ts": "no", "a/b.py": "def f():\n  pass\n", "pic.png": "x", "empty.ts": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = FS.read_files(spark, str(tmp_path)).cache()
    assert {r.path for r in files.collect()} == {"app.ts", "README.md", "a/b.py"}  # Spark skips empty files
    assert {(r.path, r.name, r.type) for r in E.symbols(files).collect()} == {("app.ts", "go", "function"), ("app.ts", "A", "class"), ("a/b.py", "f", "function")}
    assert [(r.title, r.level) for r in E.headings(files).orderBy("line").collect()] == [("T", 1), ("Part", 2)]
    first = E.changed_files(files, spark.createDataFrame([], "path string, content_hash string"))
    assert first.count() == 3
    assert E.changed_files(files, first).count() == 0


def test_units(spark):
    paths = ["one/.git/HEAD", "one/a.ts", "one/sub/.git/HEAD", "one/sub/b.ts", "docs/x.md", "loose.md"]
    rows = FS.units(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {(r.unit, r.kind, r.files) for r in rows} == {("one", "git-repo", 1), ("one/sub", "git-repo", 1), ("docs", "folder", 1), (".", "loose", 1)}
    assert {(r.kind, r.units) for r in FS.unit_summary(FS.units(spark.createDataFrame([(p,) for p in paths], "path string"))).collect()} == {("git-repo", 2), ("folder", 1), ("loose", 1)}


def test_stored_graph(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "file", 1)], "id string, label string, type string, updated_at long")
    TB.write_graph({"nodes": nodes}, str(tmp_path / "g"))
    tables = TB.read_graph(spark, str(tmp_path / "g"))
    assert tables["nodes"].count() == 1 and tables["edges"].count() == 0
    TB.register_views(tables)
    assert TB.run_query(spark, "SELECT id FROM nodes WHERE type = :t", {"t": "file"}).collect()[0].id == "a"
    old = spark.createDataFrame([("p", "P")], "id string, name string")
    assert TB.migrate(old, "persons", 2).first().asDict() == {"id": "p", "name": "P", "role": "contributor", "is_primary": False}
    TB.export_graph({"nodes": nodes}, str(tmp_path / "j"))


def test_journal_and_streams(spark, tmp_path):
    lines = [{"seq": i, "ts": f"2024-01-01T00:{i:02d}:00Z", "type": "tool_call", "session_id": f"s{i % 2}", "tool": "get" if i % 3 else "put", "ok": i != 4, "duration_ms": i} for i in range(10)]
    folder = tmp_path / "journal"
    folder.mkdir()
    (folder / "one.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert ST.read_journal(spark, str(folder)).count() == 10
    stream = ST.journal_stream(spark, str(folder))
    q = ST.live_tool_stats(stream).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.tool, r["count"], r.errors) for r in spark.table("live").collect()} == {("get", 6, 1), ("put", 4, 0)}
    q = ST.sample_calls(stream).writeStream.outputMode("append").format("memory").queryName("sampled").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sampled").count() == 4
    q = ST.live_sessions(stream).writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    seen = []
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "x.md").write_text("# x\n")
    q = ST.watch(spark, str(tree), str(tmp_path / "c4"), lambda df: seen.extend(r.content for r in df.collect()))
    q.processAllAvailable()
    q.stop()
    assert seen == ["# x\n"]


def test_file_arm_and_intents(spark):
    schema = "id string, node_id string, file_path string, start_line int, content string, updated_at long"
    chunks = spark.createDataFrame([("c1", "n", "src/optimizer.ts", 1, "x", 1), ("c2", "n", "src/optimizer.ts", 9, "y", 1), ("c3", "n", "src/other.ts", 1, "z", 1)], schema)
    for question, hits in (("optimizations please", ["c1"]), ("optimizer", ["c1"]), ("quantum entanglement", [])):
        assert [r.key for r in S.file_search(chunks, question).collect()] == hits
    assert S.intent("what breaks if I remove it")[2] == 0.6 and S.intent("where is it")[3] == 0.5 and S.intent("hello") == S.DEFAULT_INTENT
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, rank int")
    b = spark.createDataFrame([("c", 1), ("d", 2)], "key string, rank int")
    assert [r.key for r in S.rank_fusion([a, b], 10).collect()] == ["c", "a", "b", "d"]


def test_journal_rotation_and_corrupt_tables(spark, tmp_path):
    import pytest

    event = lambda i: spark.createDataFrame([(i, "tool_call", "x" * 2000)], "seq long, type string, text string")
    path = f"file://{tmp_path}/log"
    for i in range(3):
        ST.append_journal(event(i), path, most=3000)
    assert {r.seq for r in ST.read_journal(spark, path + ".1").collect()} == {0, 1}
    assert {r.seq for r in ST.read_journal(spark, path + ".1", path).collect()} == {0, 1, 2}
    (tmp_path / "g" / "nodes").mkdir(parents=True)
    (tmp_path / "g" / "nodes" / "part-0.parquet").write_text("no table at all, but long enough to be read")
    with pytest.raises(Exception):
        TB.read_graph(spark, str(tmp_path / "g"))
    with pytest.warns(UserWarning):
        assert TB.read_graph(spark, str(tmp_path / "g"), keep_corrupt=True)["nodes"].count() == 0


def test_watch_loop(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.md").write_text("# a\n" * 150)
    embed = lambda c: F.array(F.length(c).cast("float"))
    store = str(tmp_path / "store")
    q = ST.index_as_it_changes(spark, str(tmp_path / "tree"), str(tmp_path / "c"), store, embed, 1)
    q.processAllAvailable()
    (tmp_path / "tree" / "b.md").write_text("# b\n")
    q.processAllAvailable()
    q.stop()
    chunks = spark.read.parquet(f"{store}/chunks")
    assert {(r.file_path.split("/")[-1], r.start_line) for r in chunks.collect()} == {("a.md", 1), ("a.md", 109), ("b.md", 1)}
    assert spark.read.parquet(f"{store}/vectors").count() == 3
    assert sorted((r.files, r.chunks) for r in spark.read.json(f"{store}/journal").collect()) == [(1, 1), (1, 2)]
