"""Relations by patterns, labels by zoom, words of decisions, and graph documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import activity as AC
from graphloom.operators import labels as LB
from graphloom.operators import relations as R
from graphloom.operators.etl import symbols
from graphloom.sources import document as DOC
from graphloom.sources.tables import SCHEMAS

FILES = "path string, content string"


def edges_of(spark, files, nodes):
    known = spark.createDataFrame([(f, label, f"{t}::{f}::{label}", t, k) for k, (f, label, t) in enumerate(nodes)], "file string, label string, id string, type string, seq int")
    rows = R.code_relations(spark.createDataFrame(files, FILES), known).collect()
    assert all((r.weight, r.extraction_method, r.confidence) == (1.0, "pattern", R.CONFIDENCE[r.relation]) for r in rows)
    return sorted((r.source, r.relation, r.target) for r in rows)


def test_extends_one_edge_no_stub(spark):
    text = "class Base {}\nclass Child extends Base {}\nclass Other extends Missing {}\n"
    assert edges_of(spark, [("a.ts", text)], [("a.ts", n, "class") for n in ("Base", "Child", "Other")]) == [("class::a.ts::Child", "extends", "class::a.ts::Base")]
    assert edges_of(spark, [("a.ts", text)], [("a.ts", "Child", "class"), ("b.ts", "Base", "class")]) == []  # names of other files do not count
    assert edges_of(spark, [("a.js", text)], [("a.js", n, "class") for n in ("Base", "Child")]) == []


def test_calls_uses_and_scopes(spark):
    text = """import { x } from './x';
export interface Shape<T> {
  size: Other;
  f(): Named {
  }
}
export abstract class Box<T> extends Base<T> implements Shape<T>, Named {
  run(a: Shape): void {
    helper(a); // later(a)
    this.other.helper2(1);
    if (a) { return "later(a)"; }
  }
}
export async function helper(a: Box): Promise<Shape> {
  return later(a) as Named;
}
function later(a) {
  return helper2(new Box(a));
}
later(start);
"""
    nodes = [("x.ts", n, "class") for n in ("Box", "Base")] + [("x.ts", n, "interface") for n in ("Shape", "Named", "Other")] + [("x.ts", n, "function") for n in ("helper", "helper2", "later", "run")]
    box, helper, later, shape = "class::x.ts::Box", "function::x.ts::helper", "function::x.ts::later", "interface::x.ts::Shape"
    assert edges_of(spark, [("x.ts", text)], nodes) == sorted([
        (box, "extends", "class::x.ts::Base"), (box, "implements", shape), (box, "implements", "interface::x.ts::Named"),
        (box, "calls", helper), (box, "calls", "function::x.ts::helper2"), (helper, "calls", later), (later, "calls", "function::x.ts::helper2"), ("file::x.ts", "calls", later),
        (shape, "uses", "interface::x.ts::Other"), (shape, "uses", "interface::x.ts::Named"), (box, "uses", shape), (helper, "uses", box), (helper, "uses", shape), (helper, "uses", "interface::x.ts::Named"),
    ])


def laminar(r, low, high, out, path):
    """Random blocks inside and beside each other."""
    at = low
    while at <= high and r.random() < 0.8:
        a = r.randint(at, high)
        b = r.randint(a, high)
        out.append((path, a, b, f"b{len(out)}"))
        if b - a > 1 and r.random() < 0.8:
            laminar(r, a + 1, b, out, path)
        at = b + 1
    return out


def test_innermost_against_all_pairs(spark):
    r = random.Random(2)
    blocks = [x for k in range(12) for x in laminar(r, 1, 60, [], f"f{k}")]
    places = [(f"f{k}", line, "p") for k in range(14) for line in range(0, 64)]
    got = R.innermost(spark.createDataFrame(blocks, "path string, line int, end_line int, id string"), spark.createDataFrame(places, "path string, line int, what string"))
    want = {}
    for path, line, _ in places:
        held = [b for b in blocks if b[0] == path and b[1] <= line <= b[2]]
        want[path, line] = min(held, key=lambda b: b[2] - b[1])[3] if held else None
    # blocks of equal extent may stand for each other
    same = {(b[0], b[3]): (b[1], b[2]) for b in blocks}
    rows = got.collect()
    assert len(rows) == len(places)
    assert all(same.get((x.path, x.scope)) == same.get((x.path, want[x.path, x.line])) for x in rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_labels_by_zoom(spark, seed):
    r = random.Random(seed)
    kinds = ["decision", "file", "folder", "odd", None]
    rows = [(f"n{i:04d}", f"label {i}", r.choice(kinds), r.choice([None, 0, 3, 40]), r.choice([None, 1.0, 7.0, 9.0, 20.0])) for i in range(900)]
    zooms, chosen = [0.3, 0.55, 0.8, 0.85, 2.0, 9.0], ["n0003", "n0007", "gone"]
    found = LB.labels_by_zoom(spark.createDataFrame(rows, "id string, label string, type string, degree int, radius double"), zooms, chosen)
    want = []
    for z in zooms:
        if z < 0.55:
            continue
        scored = []
        for i, _, kind, degree, radius in rows:
            w = LB.PRIORITY.get(kind, 1)
            if i in chosen:
                scored.append((0, 0, i, None))
            elif not (z < 0.85 and w < 3) and (radius or 0) * z >= 6:
                scored.append((1, -w * (1 + (degree or 0) / 10), i, round(w * (1 + (degree or 0) / 10) * (0.5 + z), 6)))
        want += [(z, k + 1, x[2], x[3]) for k, x in enumerate(sorted(scored)[: min(160, int(40 * z + 0.5))])]
    assert sorted((x.zoom, x.place, x.id, x.score) for x in found.collect()) == sorted(want)


def test_decision_commits(spark):
    import re

    r = random.Random(4)
    syllables = ["tab", "lo", "ren", "der", "gra", "ph", "in", "dex"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    text = lambda n: r.choice([" ", ", ", "-"]).join(r.choice([word(), word(), "with", "Update"]) for _ in range(n))
    decisions = [(f"d{i}", text(3), text(5)) for i in range(25)] + [("none", None, None), ("half", None, "rendering graphs")]
    commits = [(i, text(6).upper()) for i in range(100)] + [(100, None)]
    got = AC.decision_commits(spark.createDataFrame(decisions, "id string, label string, content string"), spark.createDataFrame(commits, "seq int, subject string"))
    recent = sorted(commits, reverse=True)[:60]
    want = []
    for i, label, content in decisions:
        words = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", f"{label or ''} {content or ''}".lower()) if len(w) >= 4 and w not in AC.COMMON))[:6]
        useful = [w for w in words if 0 < sum(w in (s or "").lower() for _, s in recent) <= 30]
        scored = [(-sum(w in (s or "").lower() for w in useful), -k) for k, s in recent]
        want += [(i, -k, -h) for h, k in sorted(scored)[:5] if h]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len({x[0] for x in want}) > 10


def test_document_round_trip(spark, tmp_path):
    tables = {
        "nodes": spark.createDataFrame([("n1", 'a "label", {x}', "file", "b\nc", 5), ("n2", "é", "adr", None, None)], "id string, label string, type string, content string, updated_at long"),
        "edges": spark.createDataFrame([("n1", "n2", "r", 2.5), ("n2", "n1", "r", None)], "source string, target string, relation string, weight double"),
        "chunks": spark.createDataFrame([], "id string, node_id string, start_line int"),
    }
    DOC.export_document(tables, f"{tmp_path}/out", 'my "space"', 7)
    (file,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt"]
    doc = json.loads(file.read_text())  # one document, as any reader would read it
    assert (doc["version"], doc["workspaceId"], doc["exportedAt"], doc["chunks"], doc["communities"]) == (1, 'my "space"', 7, [], [])
    assert doc["nodes"][0] == {"id": "n1", "label": 'a "label", {x}', "type": "file", "content": "b\nc", "updatedAt": 5}
    back = DOC.import_document(spark, f"{tmp_path}/out")
    assert set(back) == set(DOC.PARTS)
    for name, rows in tables.items():
        assert sorted(map(str, back[name].select(rows.columns).collect())) == sorted(map(str, rows.collect()))
        assert back[name].filter("extra IS NOT NULL").count() == 0
        assert [f.name for f in back[name].schema][:-1] == [f.name for f in DOC.parsed(SCHEMAS[name])]


def test_foreign_document(spark, tmp_path):
    doc = {
        "version": 9, "later": {"x": 1},
        "nodes": [
            {"id": "a", "label": "A", "source_file": "f.ts", "updatedAt": "2024-01-02T03:04:05Z", "createdAt": 12, "metadata": {"k": [1, "z"]}, "color": "red", "deep": {"q": None}},
            {"id": "b", "sourceFile": "g.ts", "source_file": "no", "community": "7", "metadata": "text", "updated_at": 3, "churnRate": 0.5, "label": None},
            {"label": "no id"}, {},
        ],
        "edges": [{"source": "a", "target": "b", "relation": "r", "weight": 2}, {"source": "a"}],
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    back = DOC.import_document(spark, str(tmp_path / "doc.json"))
    a, b = back["nodes"].orderBy("id").collect()
    assert (a.label, a.source_file, a.updated_at, a.created_at) == ("A", "f.ts", 1704164645000, 12)
    assert json.loads(a.metadata) == {"k": [1, "z"]} and a.extra == {"color": "red", "deep": '{"q":null}'}
    assert (b.source_file, b.community, b.metadata, b.updated_at, b.churn_rate, b.label, b.extra) == ("g.ts", 7, "text", 3, 0.5, None, None)
    assert [(e.source, e.target, e.weight) for e in back["edges"].collect()] == [("a", "b", 2.0)]
    assert back["chunks"].count() == 0
    (tmp_path / "bad.json").write_text("{no json")
    with pytest.raises(Exception, match="MALFORMED|INVALID|parse"):
        DOC.import_document(spark, str(tmp_path / "bad.json"))["nodes"].select(F.count("id")).collect()


def test_blocks_of_a_long_file(spark):
    """The work for a file grows with its blocks, not with their square."""
    import time

    n = 6000
    text = "".join(f"class A{k} {{\n  run() {{\n  }}\n}}\n" for k in range(n))
    files = spark.createDataFrame([("a.ts", text)], "path string, content string")
    began = time.time()
    found = R.nested(symbols(files).select("path", "line", "end_line", F.col("name").alias("id"))).collect()
    assert sorted((x.line, x.end_line, x.id, x.parent) for x in found) == [(4 * k + 1, 4 * k + 4, f"A{k}", None) for k in range(n)]
    assert time.time() - began < 30
    inner = spark.createDataFrame([("f", 1, 9, "a"), ("f", 2, 5, "b"), ("f", 2, 3, "c"), ("f", 4, 4, "d"), ("f", 7, 8, "e"), ("f", 12, 12, "g")], "path string, line int, end_line int, id string")
    assert {x.id: x.parent for x in R.nested(inner).collect()} == {"a": None, "b": "a", "c": "b", "d": "b", "e": "a", "g": None}


def test_document_by_lines(spark, tmp_path):
    """A document of many lines is read by many tasks; of others, any form is read."""
    rows = spark.range(3000).selectExpr("concat('n', id) AS id", "'{\"x\": [' AS label", "'], , {' AS content")
    DOC.export_document({"nodes": rows, "edges": rows.selectExpr("id AS source", "'n1' AS target")}, f"{tmp_path}/out", "w", 1)
    (file,) = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".txt"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found, whole = DOC.by_lines(spark, f"{tmp_path}/out")
        assert not whole and {x.part: x["count"] for x in found.groupBy("part").count().collect()} == {"nodes": 3000, "edges": 3000}
        assert found.rdd.getNumPartitions() > 5
        (tmp_path / "both").mkdir()
        (tmp_path / "both/a.json").write_bytes(file.read_bytes())
        (tmp_path / "both/b.json").write_text(json.dumps({"nodes": [{"id": "one"}], "edges": []}, indent=1))
        back = DOC.import_document(spark, f"{tmp_path}/both")
        assert back["nodes"].filter("label = '{\"x\": [' AND content = '], , {'").count() == 3000 and back["nodes"].count() == 3001 and back["edges"].count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_document_in_pieces(spark, tmp_path, monkeypatch):
    """A document that is more than a task should write is written by many, in the same order."""
    nodes = spark.range(3000).selectExpr("concat('n', id % 900) AS id", "concat('{\u2028', id % 2) AS label", "'], , {' AS content").union(spark.createDataFrame([("n1", None, None)] * 2, "id string, label string, content string"))
    edges = spark.range(2000).selectExpr("concat('n', id % 3) AS source", "concat('n', id) AS target")
    tables = {"nodes": nodes, "edges": edges}
    DOC.export_document(tables, f"{tmp_path}/one", "w", 1)
    monkeypatch.setattr(DOC, "BYTES", 20_000)
    DOC.export_document(tables, f"{tmp_path}/many", "w", 1)
    (one,) = (tmp_path / "one").glob("*.txt")
    files = sorted((tmp_path / "many").glob("piece=*/*.txt"))
    count = {k: sum(f.parent.name == f"piece={k}" for f in files) for k in ("02", "05", "08")}
    assert count["02"] > 4 and count["05"] > 2 and count["08"] == 0 and all(f.stat().st_size < 60_000 for f in files)
    text = "".join(f.read_text() for f in files)
    doc = json.loads(text)  # the files in order are the one document
    assert [(x["id"], x.get("label")) for x in doc["nodes"]] == [(x["id"], x.get("label")) for x in json.loads(one.read_text())["nodes"]]
    assert len(text.split("\n")) == len(one.read_text().split("\n")) and [x["id"] for x in doc["nodes"]] == sorted(x["id"] for x in doc["nodes"])
    for at in ("one", "many"):
        back = DOC.import_document(spark, f"{tmp_path}/{at}")
        for name, rows in tables.items():
            assert sorted(map(str, back[name].select(rows.columns).collect())) == sorted(map(str, rows.collect()))
            # no row is dealt by the name of its file, which would bring all of a document to one task
            plan = back[name]._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "hashpartitioning(file" not in plan and plan.count("parseJson") == 1
        assert back["chunks"].count() == 0
    for lost in (tmp_path / "many/piece=12").iterdir():
        lost.unlink()
    with pytest.raises(ValueError, match="no whole document"):
        DOC.import_document(spark, f"{tmp_path}/many")
