"""What a task keeps must not grow with all rows: plans of the queries that did, and their results."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from __spark_entry__ import queries
from pyspark.sql import functions as F

from graphloom.operators import activity as AC
from graphloom.operators import etl as E
from graphloom.operators import graph as G
from graphloom.operators import merge as M
from graphloom.operators import relations as R
from graphloom.plans import canonical, kept
from graphloom.sources import tables


def planned(rows) -> str:
    return re.sub(r"#\d+L?", "", rows._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("last", [60, 130])
def test_decision_commits_are_not_rows(spark, last):
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    decisions = [(k % 50, " ".join(words[(k * j + j) % 60] for j in range(1, 5)), None) for k in range(80)]  # ids repeat
    commits = [(k, " ".join(words[(k * j + 3 * j) % 60] + "s" for j in range(1, 4))) for k in range(200)]
    want = {}
    recent = commits[-last:]
    useful = {w: [s for s, t in recent if w in t] for w in words}
    for i, label, _ in decisions:
        for w in dict.fromkeys(label.split()):
            if 0 < len(useful[w]) * 2 <= len(recent):
                want.setdefault(i, Counter()).update(useful[w])
    want = {(i, s, n) for i, c in want.items() for s, n in sorted(c.items(), key=lambda x: (-x[1], -x[0]))[:5]}
    got = AC.decision_commits(spark.createDataFrame(decisions, "id int, label string, content string"), spark.createDataFrame(commits, "seq int, subject string"), last)
    assert {tuple(r) for r in got.collect()} == want
    # decisions are dealt by id before they meet words, and no row is kept for each decision and commit
    assert "hashpartitioning(id, seq" not in planned(got) and "REPARTITION_BY_COL" in planned(got)


def test_two_paths_of_edges_in_both_ways(spark):
    rows = [(f"n{k % 7}", f"n{(k * k + 3) % 11}", r, 1.0) for k in range(60) for r in ("owns", "generated", "other")] + [("n3", "n5", "owns", 2.0), ("n5", "n3", "owns", 1.0)]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, weight double")
    around = {}
    for s, t, r, _ in rows:
        if s != t and r != "other":
            around.setdefault(s, set()).add(t)
            around.setdefault(t, set()).add(s)
    got = G.two_paths(edges, ["owns", "generated"])
    assert {tuple(r) for r in got.collect()} == {(m, len(x) * (len(x) - 1) // 2) for m, x in around.items() if len(x) > 1}
    # pairs are dealt to many tasks before they are put together: nothing is kept where they are read
    text = planned(got)
    assert text.rindex("REPARTITION_BY_NUM") > text.rindex("HashAggregate")
    some = spark.createDataFrame([("n3",), ("n5",), ("n5",), ("none",)], "id string")
    paths = G.paths_through(edges, ["owns", "generated"], some)
    assert sorted(map(tuple, paths.collect())) == sorted((a, m, b) for m in ("n3", "n5") for a in around[m] for b in around[m] if a < b)


def test_paths_through_reads_only_what_is_asked(spark):
    sums = spark.range(100).select(F.col("id") % 10, F.col("id") % 7).toDF("s", "t").groupBy("s", "t").count()
    edges = sums.select(F.concat(F.lit("s"), "s").alias("source"), F.concat(F.lit("t"), "t").alias("target"), F.lit("owns").alias("relation"))
    text = planned(G.paths_through(edges, ["owns"], spark.createDataFrame([("t3",)], "id string")))
    assert text.rindex("LeftSemi") > text.rindex("HashAggregate")  # below the sums


def test_components_put_ever_fewer_pairs_together(spark, monkeypatch):
    written = []

    def cut(df, name="step"):
        out = tables.cut(df, name)
        if name == "pairs":
            written.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", cut)
    chain = [(f"p{k}", f"p{k + 1}", "x", 1.0) for k in range(400) if k % 100] + [("loop", "loop", "x", 1.0), ("gone", "p3", "x", 1.0)]
    ids = [f"p{k}" for k in range(401)] + ["loop", "alone"]
    nodes = spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string")
    first = lambda k: min(f"p{j}" for j in range(401) if (j - 1) // 100 == (k - 1) // 100)
    want = {i: first(int(i[1:])) if i[0] == "p" else i for i in ids}
    for local in (20, 1000):
        written.clear()
        rows = G.components(nodes, spark.createDataFrame(chain, "source string, target string, relation string, weight double"), local).collect()
        assert {r.id: r.component for r in rows} == want and len(rows) == len(ids)
        # chains are about halved by each round, and none follows the last few edges
        assert written[-1] <= local and all(b < 0.8 * a for a, b in zip(written, written[1:])) and (len(written) > 2) == (local == 20)


def test_communities_find_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for part in batches:
            seen.add(len(part))
            yield part

    rows = [(f"p{k}", f"p{k + 1}") for k in range(50)] + [("p3", "p2"), ("p4", "p4"), ("x", "gone")]
    edges = spark.createDataFrame(rows, "source string, target string").mapInPandas(count, "source string, target string")
    nodes = spark.createDataFrame([(f"p{k}",) for k in range(51)] + [("x",)], "id string")
    assert [tuple(r) for r in G.communities(nodes, edges).collect()] == [("p0", 51, 50, 1.0)]
    assert seen.value == len(rows)


def test_new_edges_are_kept_in_as_many_tasks_as_asked_for(spark):
    rows = [(f"n{k % 7}", f"n{k % 11}", "r" if k % 3 else "s", 9.0, k) for k in range(200)]
    new = spark.createDataFrame(rows, "source string, target string, relation string, weight double, seq int")
    old = spark.createDataFrame(sorted({r[:4] for r in rows if r[0] == "n3"}), "source string, target string, relation string, weight double")
    keys = ["source", "target", "relation"]
    cases = [
        lambda n: AC.merge_first(old, new.drop("seq"), keys, n),
        lambda n: M.add_edges(old, new, n),
        lambda n: M.stubs(spark.createDataFrame([("n3",)], "id string"), new, n),
    ]
    for case in cases:
        assert sorted(map(tuple, case(31).collect())) == sorted(map(tuple, case(None).collect()))
        text = planned(case(31))  # dealt before anything is kept, and by no other shuffle of the new rows
        assert ", 31), REPARTITION_BY_NUM" in text and text.rindex("REPARTITION_BY_NUM") > text.rindex("Aggregate")


def test_line_items_are_put_together_where_they_are_dealt(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    whole = canonical.load(spark, data, "edges")
    before = {n: sorted(map(tuple, queries()[n](spark, data).collect())) for n in ("jn1_neighbor_counts", "mrg6_import_graph")}
    assert canonical.item_tasks(spark, data) is None and "31)" not in planned(whole)
    monkeypatch.setattr(canonical, "ITEMS", 100)
    assert canonical.item_tasks(spark, data) == min(canonical.TASKS, -(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 100))
    monkeypatch.setattr(canonical, "TASKS", 31)
    edges = canonical.load(spark, data, "edges")
    assert edges.schema == whole.schema and Counter(map(tuple, edges.collect())) == Counter(map(tuple, whole.collect()))
    # the line items are dealt twice, once for each branch, and nothing of them is dealt again after that
    some = planned(edges.filter("relation IN ('references', 'generated')"))
    assert some.count(", 31), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in some
    for name, rows in before.items():
        got = queries()[name](spark, data)
        assert sorted(map(tuple, got.collect())) == rows
        dealt = ["id"] if name == "jn1_neighbor_counts" else ["id", "source, target, relation"]
        assert all(f"hashpartitioning({keys}, 31), REPARTITION_BY_NUM" in planned(got) for keys in dealt)
        # no ends are kept in the tasks of a plain shuffle (the chunks of the import are none)
        assert name != "jn1_neighbor_counts" or not re.search(r"hashpartitioning\((id|source|target)\b[^()]*, (?!31\b)\d+\), ENSURE_REQUIREMENTS", planned(got))


def test_symbols_look_at_each_line_once(spark):
    r = random.Random(5)
    some = ["class A%d {", "export function f%d(x) {", "function _g%d() {", "interface I%d {", "def p%d():", "}", "  }", ")", "});", "},", "} // no", "x(%d)", "", "  y", "\t}", " class B%d {", "type T%d struct {"]
    text = lambda n: "\n".join(x % k if "%" in x else x for k, x in enumerate(r.choices(some, [3, 3, 1, 2, 2, r.random(), 2, 1, 1, 1, 1, 30, 9, 9, 2, 1, 2], k=n)))
    files = [(f"d{k}/a.{end}", text(n)) for k, (end, n) in enumerate([("ts", 700), ("js", 90), ("py", 300), ("go", 200), ("md", 50), ("TS", 40)] * 3)] + [("bare.ts", "class Z {" + "\n x" * 300), ("none.ts", "")]
    want = []
    for path, content in files:
        all_ = content.split("\n")
        for k, line in enumerate(all_):
            fit = next(((kind, m[1]) for end, kind, p in E.SYMBOLS if re.search(end, path) and (m := re.search(p, line))), None)
            if fit and not re.match("[_0-9]", fit[1]):
                close = next((j for j in range(k + 1, min(k + 120, len(all_))) if re.search(r"^[)}]\s*[;,]?\s*$", all_[j])), min(k + 60, len(all_) - 1))
                want.append((path, *fit, k + 1, close + 1, "\n".join(all_[k : close + 1])[:4000]))
    got = E.symbols(spark.createDataFrame(files, "path string, content string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 200
    # no definition looks at the lines behind it: patterns are for single lines, none is inside a function on lists
    assert "RLIKE" in planned(got) and not re.search(r"lambdafunction\([^\n]*(RLIKE|regexp)", planned(got))


def test_relations_are_found_in_one_sweep(spark):
    r = random.Random(6)
    blocks = [(f"f{f}", a, a + r.randint(0, 4), f"b{f}_{a}") for f in range(5) for a in range(1, 60, 5) if r.random() < 0.8]
    places = [(f"f{f}", line, "w") for f in range(6) for line in range(0, 66)]
    got = R.holding(spark.createDataFrame(blocks, "path string, line int, end_line int, id string"), spark.createDataFrame(places, "path string, line int, what string"))
    want = [(*p, next((b[3] for b in blocks if b[0] == p[0] and b[1] <= p[1] <= b[2]), None)) for p in places]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    # the blocks of a file are no list, and symbols at hand are not looked for again
    files = spark.createDataFrame([("a.ts", "class A {\n  run() {\n    b(1);\n  }\n}\nfunction b(x: A) {\n}\n")], "path string, content string")
    known = spark.createDataFrame([("a.ts", "A", "c", "class", 1), ("a.ts", "A", "i", "interface", 0), ("a.ts", "b", "f", "function", 6)], "file string, label string, id string, type string, seq int")
    defined = tables.cut(E.symbols(files), "symbols")
    rows = R.code_relations(files, known, defined)
    assert {(x.source, x.relation, x.target) for x in rows.collect()} == {("i", "calls", "f"), ("f", "uses", "i")}
    text = planned(rows)
    assert "collect_list" not in text and "ArrowEvalPython" not in text


def test_code_files_are_dealt_by_their_parts(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, kept.scoped_files(spark, data).collect()))
    monkeypatch.setattr(kept, "PARTS_A_TASK", 10)
    files = kept.scoped_files(spark, data)
    assert files.rdd.getNumPartitions() == -(-spark.read.parquet(f"{data}/part.parquet").count() // 10) and sorted(map(tuple, files.collect())) == whole
