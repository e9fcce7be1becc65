"""A whole index run over a small tree: both orders, a second run, and a killed one."""

import pytest

from graphloom.operators import indexing as IX
from graphloom.sources import files as FS

TREE = {
    "src/app.ts": "import { Base } from './lib/base';\nexport class App extends Local {\n  run() {\n    helper(1);\n  }\n}\nclass Local {}\nfunction helper(a) {\n  return a;\n}\n",
    "src/lib/base.ts": "export class Base {\n}\n",
    "README.md": "# Hello\n\n## Setup\n",
    "todo.md": "# Tasks\n- [ ] mend app.ts soon\n- [x] nothing named\n",
    "docs/adr/1.md": "# Use base\n\n## Status\n\nAccepted\n\n## Context\n\nSee src/lib/base.ts for more.\n\n## Decision\n\nWe do.\n",
    "docs/adr/2.md": "# Drop it\n\n## Status\n\nAccepted, supersedes [one](./1.md)\n\n## Context\n\nNew facts.\n\n## Decision\n\nNo more.\n",
}
FILES = "path string, content string"


def edges(graph):
    return {(r.source, r.relation, r.target) for r in graph["edges"].collect() if not r.target.startswith("task::")} | {(r.source, r.relation, "task") for r in graph["edges"].collect() if r.target.startswith("task::")}


CODE = {
    ("folder::src", "contains", "file::src/app.ts"), ("folder::src", "contains", "folder::src/lib"), ("folder::src/lib", "contains", "file::src/lib/base.ts"),
    ("folder::docs", "contains", "folder::docs/adr"), ("folder::docs/adr", "contains", "file::docs/adr/1.md"), ("folder::docs/adr", "contains", "file::docs/adr/2.md"),
    ("file::src/app.ts", "contains", "class::src/app.ts::App"), ("file::src/app.ts", "contains", "class::src/app.ts::Local"), ("file::src/app.ts", "contains", "function::src/app.ts::helper"),
    ("file::src/lib/base.ts", "contains", "class::src/lib/base.ts::Base"),
    ("file::src/app.ts", "imports", "file::src/lib/base.ts"), ("class::src/app.ts::App", "extends", "class::src/app.ts::Local"), ("class::src/app.ts::App", "calls", "function::src/app.ts::helper"),
    ("workspace::root", "contains", "adr::docs/adr/1.md"), ("workspace::root", "contains", "adr::docs/adr/2.md"), ("adr::docs/adr/1.md", "decides", "file::src/lib/base.ts"), ("adr::docs/adr/2.md", "supersedes", "adr::docs/adr/1.md"),
    ("adr::docs/adr/2.md", "decides", "file::docs/adr/1.md"),  # it names the file
}
TASK = {("file::src/app.ts", "tracked_by", "task")}


def without_headings(found):
    return {e for e in found if not e[2].startswith("heading::")}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(TREE.items()), FILES)


def test_both_orders(spark, files, tmp_path):
    usual = f"file://{tmp_path}/usual"
    assert IX.run_index(files, usual) == list(IX.ORDER)
    graph = IX.read_index(spark, usual)
    assert without_headings(edges(graph)) == CODE | TASK
    assert {(r.label, r.type) for r in graph["nodes"].collect() if r.type in ("adr", "task", "class", "heading")} == {
        ("Use base", "adr"), ("Drop it", "adr"), ("mend app.ts soon", "task"), ("nothing named", "task"), ("App", "class"), ("Local", "class"), ("Base", "class"),
        ("Hello", "heading"), ("Setup", "heading"), ("Tasks", "heading"), *((t, "heading") for t in ("Use base", "Drop it", "Status", "Context", "Decision")),
    }
    assert {(r.adr_node_id, r.code_node_id) for r in graph["adr_links"].collect()} == {("adr::docs/adr/1.md", "file::src/lib/base.ts"), ("adr::docs/adr/2.md", "file::docs/adr/1.md")}
    assert graph["chunks"].count() == len(TREE)

    strict = f"file://{tmp_path}/strict"
    assert IX.run_index(files, strict, strict=True) == list(IX.STRICT)
    assert without_headings(edges(IX.read_index(spark, strict))) == CODE  # tasks were read before the code
    IX.run_index(files, strict, strict=True)
    assert without_headings(edges(IX.read_index(spark, strict))) == CODE | TASK
    # a second run over other files keeps what is not indexed again
    more = spark.createDataFrame([("src/app.ts", "class Only {\n}\n"), ("new.ts", "import './src/app'")], FILES)
    IX.run_index(more, strict)
    graph = IX.read_index(spark, strict)
    assert CODE | TASK | {("file::new.ts", "imports", "file::src/app.ts"), ("file::src/app.ts", "contains", "class::src/app.ts::Only")} == without_headings(edges(graph))
    assert [r.content for r in graph["chunks"].filter("file_path = 'src/app.ts'").collect()] == ["class Only {\n}\n"]


def test_a_killed_run_goes_on(spark, files, tmp_path):
    store = f"file://{tmp_path}/store"

    def killed(*_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        IX.run_index(files, store, stages=IX.STAGES | {"adr": killed})
    assert IX.read_index(spark, store) == {}  # nothing of it is in the graph
    assert IX.run_index(files, store) == ["adr", "relations"]
    assert without_headings(edges(IX.read_index(spark, store))) == CODE | TASK
    with pytest.raises(KeyboardInterrupt):
        IX.run_index(files, store, stages=IX.STAGES | {"relations": killed})
    other = files.filter("path <> 'todo.md'")
    assert IX.run_index(other, store) == list(IX.ORDER)  # other files: from the start


def test_indexable_names(spark):
    names = ["a.ts", "a.d.ts", "package-lock.json", "x/pnpm-lock.yaml", "x/my-lock.json", "Cargo.lock", "lock.json", "a.min.js", "x/a.D.TS", "node_modules/a.ts", "a.png", "lockd.ts", "a.yaml"]
    found = FS.indexable(spark.createDataFrame([(n,) for n in names], "path string"))
    assert {r.path for r in found.collect()} == {"a.ts", "lock.json", "a.min.js", "x/a.D.TS", "lockd.ts", "a.yaml"}
