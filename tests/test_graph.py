"""Literal graphs and answers, and random graphs against brute force."""

import random

import pytest

from graphloom.operators import graph as G
from graphloom.operators import merge as M

EDGES = [("A", "B", "imports"), ("B", "C", "imports"), ("D", "E", "depends_on"), ("D", "F", "depends_on"), ("E", "G", "depends_on"), ("F", "G", "depends_on")]


def edges(spark, rows):
    return spark.createDataFrame([(s, t, r, 1.0) for s, t, r in rows], "source string, target string, relation string, weight double")


def nodes(spark, ids):
    return spark.createDataFrame([(i, i, "file", i) for i in ids], "id string, label string, type string, content string")


def ids(df):
    return {r[0] for r in df.select("id").collect()}


def test_chain_and_diamond(spark):
    e = edges(spark, EDGES)
    assert [r.id for r in G.shortest_path(e, "A", "C").orderBy("position").collect()] == ["A", "B", "C"]
    assert G.shortest_path(e, "A", "missing").count() == 0
    assert ids(G.dependencies(e, "A", False)) == {"B"} and ids(G.dependencies(e, "A")) == {"B", "C"}
    assert ids(G.dependents(e, "G")) == {"D", "E", "F"}
    depth = {r.id: r.depth for r in G.topological(e, nodes(spark, "ABCDEFG")).collect()}
    assert depth == {"C": 0, "B": 1, "A": 2, "G": 0, "E": 1, "F": 1, "D": 2}
    assert G.cycles(e).count() == 0


def test_cycles_and_self_loops(spark):
    e = edges(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("b", "a", "x"), ("d", "d", "x"), ("e", "a", "x")])
    assert {r.cycle for r in G.cycles(e, 5).collect()} == {"a>b>c", "a>b", "d"}
    assert ids(G.dependents(e, "d", False)) == {"d"} and ids(G.dependents(e, "d")) == set()
    depth = {r.id: r.depth for r in G.topological(e, nodes(spark, "abcdef")).collect()}
    assert depth["f"] == 0 and all(depth[x] is None for x in "abcde")


def test_impact(spark):
    e = edges(spark, [("controller", "service", "imports"), ("service", "utils", "imports"), ("service", "db", "imports"), ("server", "controller", "imports")])
    row = G.removal_impact(e, "utils").first()
    assert (row.direct, row.indirect, row.affected, row.grade) == (1, 2, 3, "MODERATE") and 0 < row.risk <= 1
    alone = G.removal_impact(e, "nothing").first()
    assert (alone.affected, alone.risk, alone.grade) == (0, 0.0, "low")


def test_components(spark):
    n = nodes(spark, "abcd")
    found = {r.id: r.component for r in G.components(n, edges(spark, [("a", "b", "x"), ("b", "c", "x"), ("d", "d", "x")])).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d"}
    rows = G.communities(nodes(spark, "abcxy"), edges(spark, [("a", "b", "r"), ("b", "a", "r"), ("b", "c", "r"), ("a", "c", "r"), ("a", "a", "r"), ("x", "y", "r")])).collect()
    assert {(r.component, r.members, r.internal_edges, r.cohesion) for r in rows} == {("a", 3, 3, 1.5), ("x", 2, 1, 1.0)}
    assert G.components(n.limit(0), edges(spark, EDGES).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_paths(spark, seed):
    r = random.Random(seed)
    rows = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}", float(r.randint(0, 9))) for _ in range(30)]
    e = spark.createDataFrame([(s, t, "x", w) for s, t, w in rows], "source string, target string, relation string, weight double")
    best = {"n0": 0.0}
    for _ in range(12):
        for s, t, w in rows:
            if s in best and best[s] + w < best.get(t, 1e9):
                best[t] = best[s] + w
    assert {x.id: x.distance for x in G.shortest_paths(e, "n0").collect()} == best
    for end, distance in best.items():
        path = G.shortest_path(e, "n0", end).orderBy("position").collect()
        assert path[0].id == "n0" and path[-1].id == end and path[-1].distance == distance
        break


def test_principal_axes(spark):
    v = spark.createDataFrame([(f"c{i}", [float(i), float(i % 2), 0.0, 1.0]) for i in range(5)], "chunk_id string, vector array<float>")
    rows = G.principal_axes(v).collect()
    assert len(rows) == 5 and all(0 <= x.x <= 1 and 0 <= x.y <= 1 for x in rows) and len({x.x for x in rows}) == 5
    assert G.principal_axes(v.limit(2)).count() == 0


def test_latest_wins(spark):
    schema = "id string, label string, updated_at long"
    local = spark.createDataFrame([("a", "old", 10), ("b", "here", 5), ("c", "only", 1)], schema)
    remote = spark.createDataFrame([("a", "new", 20), ("b", "there", 5), ("d", "far", 9)], schema)
    assert {(r.id, r.label) for r in M.merge_latest(local, remote).collect()} == {("a", "new"), ("b", "here"), ("c", "only"), ("d", "far")}
    e = "source string, target string, relation string, weight double"
    merged = M.merge_edges(spark.createDataFrame([("A", "B", "r", 0.5), ("B", "C", "r", 1.0)], e), spark.createDataFrame([("A", "B", "r", 1.0), ("C", "D", "r", 1.0)], e))
    assert {(r.source, r.target, r.weight) for r in merged.collect()} == {("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0)}


def test_stubs(spark):
    e = edges(spark, [("repo::x", "person::me", "r"), ("file::src/a.ts", "decision::9", "r")])
    rows = {r.id: (r.label, r.type) for r in M.stubs(nodes(spark, []), e).collect()}
    assert rows == {"repo::x": ("x", "repo"), "person::me": ("me", "person"), "file::src/a.ts": ("a.ts", "file"), "decision::9": ("9", "adr")}


def test_file_mentions(spark):
    from graphloom.operators import joins as J

    texts = [(1, "See src/main.ts."), (2, "MAIN.TS, too"), (3, "domain.ts or main.tsx"), (4, "open app/[id].tsx now"), (5, "Die Datei Über uns.md!"), (6, "a--b"), (7, None), (8, "main.ts2 xmain.ts"), (9, "the-main.ts-file"), (None, "(main.ts)"), (10, "id tsx")]
    files = [(1, "src/main.ts"), (2, "app/[id].tsx"), (3, "docs/Über uns.md"), (4, "x/--"), (5, "main"), (6, None), (7, "dir/")]
    got = J.file_mentions(spark.createDataFrame(texts, "text_id long, content string"), spark.createDataFrame(files, "file_id long, path string")).collect()
    want = {(1, 1), (2, 1), (9, 1), (None, 1), (4, 2), (5, 3), (6, 4), (1, 5), (2, 5), (3, 5), (8, 5), (9, 5), (None, 5)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_cycles_of_five(spark):
    """Every simple cycle of a random graph up to five nodes, in the registered default."""
    import itertools
    import random

    r = random.Random(4)
    pairs = {(r.choice("abcdefgh"), r.choice("abcdefgh")) for _ in range(26)}
    want = [">".join(c) for n in range(1, 6) for c in itertools.permutations("abcdefgh", n) if c[0] == min(c) and all((x, y) in pairs for x, y in zip(c, c[1:] + c[:1]))]
    got = [x.cycle for x in G.cycles(spark.createDataFrame(sorted(pairs), "source string, target string")).collect()]
    assert sorted(got) == sorted(want) and {x.count(">") for x in got} == {0, 1, 2, 3, 4}


def test_paths_and_positions(spark):
    e = edges(spark, [("p", "m", "decided"), ("m", "f", "affects"), ("m", "g", "affects"), ("m", "m", "affects"), ("x", "y", "other"), ("f", "h", "affects")])
    got = {(r.a, r.middle, r.b) for r in G.paths_through(e, ["decided", "affects"], nodes(spark, ["m", "f"])).collect()}
    assert got == {("f", "m", "g"), ("f", "m", "p"), ("g", "m", "p"), ("h", "f", "m")}
    assert {(r.middle, r.paths) for r in G.two_paths(e, ["decided", "affects"]).collect()} == {("m", 3), ("f", 1)}
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", (i * 37) % 101) for i in range(100)]
    found = M.positions(spark.createDataFrame(rows, "key string, seq long"), "key", ["seq"]).collect()
    groups = {}
    for k, s in rows:
        groups.setdefault(k, []).append(s)
    assert {(r.key, r.seq, r.position) for r in found} == {(k, s, n) for k, v in groups.items() for n, s in enumerate(sorted(v))}


def test_long_path_and_components_of_a_chain(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}", "imports") for i in range(60)]
    e = edges(spark, rows)
    path = G.shortest_path(e, "n000", "n060").orderBy("position").collect()
    assert [r.id for r in path] == [f"n{i:03d}" for i in range(61)] and [r.distance for r in path] == [float(i) for i in range(61)]
    n = nodes(spark, [f"n{i:03d}" for i in range(61) if i != 30])  # a missing node joins nothing
    labels = {r.id: r.component for r in G.components(n, e).collect()}
    assert labels == {f"n{i:03d}": "n000" if i < 30 else "n031" for i in range(61) if i != 30}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_random_components(spark, seed):
    r = random.Random(seed)
    names = [f"v{i}" for i in range(60)]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(45)]
    label = {x: x for x in names}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert {x.id: x.component for x in G.components(nodes(spark, names), edges(spark, [(a, b, "x") for a, b in pairs])).collect()} == label


def test_symbol_ends(spark):
    from graphloom.operators import etl as E

    text = "\n".join(["class A {", "  f() {", "  }", "] // no end", "};", "function g(", "  a,", ")", "interface Long {", *["  x: 1;"] * 70, "export class _No {", "}"])
    files = spark.createDataFrame([("a.ts", text), ("b.py", "def f():\n  pass\n\nclass C:\n  x = 1\n"), ("c.md", "class A {\n}"), ("e.ts", None)], "path string, content string")
    got = {(r.path, r.name, r.line, r.end_line, r.content.count("\n") + 1) for r in E.symbols(files).collect()}
    assert got == {("a.ts", "A", 1, 5, 5), ("a.ts", "g", 6, 8, 3), ("a.ts", "Long", 9, 81, 73), ("b.py", "f", 1, 6, 6), ("b.py", "C", 4, 6, 3)}
    long = spark.createDataFrame([("d.ts", "function f() {\n" + "y" * 9000 + "\n}")], "path string, content string")
    assert len(E.symbols(long).first().content) == 4000


def test_whole_components_in_a_task(spark):
    """Long chains, cycles and ends that are no nodes: by one task and by rounds alike,
    and as brute force says."""
    r = random.Random(1)
    pairs = {(f"{c}{b}", f"{c}{a}") for c in "pq" for a in range(14) for b in range(a + 1, 15) if b == a + 1 or r.random() < 0.1}
    pairs |= {("x1", "x2"), ("x2", "x1"), ("x3", "x1"), ("y1", "y1"), ("y2", "y1"), ("z1", "gone"), ("lost", "p0"), ("p0", "s")}
    ids = sorted({x for p in pairs for x in p} - {"gone", "lost"}) + ["alone"]
    e = edges(spark, [(s, t, "x") for s, t in sorted(pairs)] * 2)
    depth = {}
    for _ in ids:
        depth |= {i: 1 + max((depth[t] for s, t in pairs if s == i), default=-1) for i in ids if all(t in depth for s, t in pairs if s == i)}
    for local in (1000, 20):
        got = G.topological(e, nodes(spark, ids), local).collect()
        assert {x.id: x.depth for x in got} == {i: depth.get(i) for i in ids} and len(got) == len(ids)
    for way, most in ((False, None), (True, 11)):
        both = pairs | ({(t, s) for s, t in pairs} if way else set())
        want, front = {"p14": 0}, {"p14"}
        for hop in range(1, (most or 99) + 1):
            front = {t for s, t in both if s in front} - set(want)
            want |= dict.fromkeys(front, hop)
        chain = [(s, t, "x") for s, t in sorted(both)]
        for local in (1000, 0):
            got = G.reach(edges(spark, chain), "p14", most, local=local).collect()
            assert {x.id: x.distance for x in got} == want and len(got) == len(want)


def test_rings_end_with_most(spark):
    e = edges(spark, [(f"n{k}", f"n{k + 1}", "x") for k in range(14)])
    got = {x.id: x.ring for x in G.ring_layout(nodes(spark, [f"n{k}" for k in range(15)]), e, "n0", most=12).collect()}
    assert got == {f"n{k}": k if 0 < k <= 12 else 3 for k in range(15)}


def test_contributors_of_all_commits(spark):
    from graphloom.operators import index as I

    commits = spark.range(1, 2102).selectExpr("'r' AS repo", "id AS seq", "'n' AS name", "'' AS email")
    assert [x.commits for x in I.contributors(commits, None).collect()] == [2101] and [x.commits for x in I.contributors(commits).collect()] == [2000]
