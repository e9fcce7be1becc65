"""Re-index of some files as a delta: rows to retract and rows to add.

An index is a set of tables over files (path, content). A change of some files touches
the rows of these files, the folders that they alone hold, the imports that now go to
another file, and the components around these; everything else stays as it is, and the
result is what an index of all files would be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.etl import chunked, headings, specifiers, symbols
from graphloom.operators.graph import components
from graphloom.operators.index import MODULES
from graphloom.operators.joins import CANDIDATE_ENDS, path_prefixes, resolve_imports, walked
from graphloom.sources.tables import cut

#: Tables of an index with the columns that tell their rows apart.
KEYS = {
    "files": ["path"], "nodes": ["id"], "contains": ["target"], "folders": ["folder"], "chunks": ["path", "start_line"],
    "specs": ["path", "pos"], "imports": ["source", "target"], "components": ["id"],
}

Delta = dict[str, tuple[DataFrame, DataFrame]]


def file_id(path) -> F.Column:
    return F.concat(F.lit("file::"), path)


def folder_of(path) -> F.Column:
    """The folder that holds path, null at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def own_rows(files: DataFrame) -> dict[str, DataFrame]:
    """The rows that depend on a file alone: its record, its node and those of its
    headings and symbols, what it contains, its chunks and its import specifiers."""
    path = F.col("path")
    heads = headings(files.filter(path.rlike(r"(?i)\.(md|mdx|markdown)$")))
    defined = symbols(files).groupBy("path", "type", "name").agg(F.min("line").alias("line"))
    symbol_id = F.concat_ws("::", "type", "path", "name")
    node = lambda rows, key, label, kind: rows.select(key.alias("id"), label.alias("label"), kind.alias("type"), "path")
    nodes = (
        node(files, file_id(path), F.element_at(F.split(path, "/"), -1), F.lit("file"))
        .unionByName(node(heads, F.col("id"), F.col("title"), F.lit("heading")))
        .unionByName(node(defined, symbol_id, F.col("name"), F.col("type")))
    )
    inside = lambda rows, key: rows.select(file_id(path).alias("source"), key.alias("target"), "path")
    held = files.select(F.concat(F.lit("folder::"), folder_of(path)).alias("source"), file_id(path).alias("target"), "path").filter("source IS NOT NULL")
    return {
        "files": files.select("path", F.sha1("content").alias("content_hash")),
        "nodes": nodes,
        "contains": held.unionByName(inside(heads, F.col("id"))).unionByName(inside(defined, symbol_id)),
        "chunks": chunked(files),
        "specs": specifiers(files.filter(path.rlike(MODULES))).select("path", "spec", "pos"),
    }


def folder_counts(paths: DataFrame, sign: int = 1) -> DataFrame:
    """(folder, files): how many of the paths lie below each folder, at any depth."""
    return path_prefixes(paths).groupBy(F.col("prefix").alias("folder")).agg((F.count(F.lit(1)) * sign).alias("files"))


def folder_rows(folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of folders and the edges from the folders above them."""
    key = F.concat(F.lit("folder::"), "folder")
    nodes = folders.select(key.alias("id"), F.element_at(F.split("folder", "/"), -1).alias("label"), F.lit("folder").alias("type"), F.lit(None).cast("string").alias("path"))
    above = folders.select(F.concat(F.lit("folder::"), folder_of(F.col("folder"))).alias("source"), key.alias("target"), F.lit(None).cast("string").alias("path"))
    return nodes, above.filter("source IS NOT NULL")


def import_edges(specs: DataFrame, paths: DataFrame) -> DataFrame:
    found = resolve_imports(specs, paths)
    return found.select(file_id(F.col("source")).alias("source"), file_id(F.col("target")).alias("target"))


def build(files: DataFrame) -> dict[str, DataFrame]:
    """The index of all files (path, content), each path once."""
    out = own_rows(files)
    out["folders"] = folder_counts(files.select("path"))
    nodes, edges = folder_rows(out["folders"])
    out["nodes"], out["contains"] = out["nodes"].unionByName(nodes), out["contains"].unionByName(edges)
    out["imports"] = import_edges(out["specs"], files.select("path"))
    out["components"] = components(files.select(file_id(F.col("path")).alias("id")), out["imports"])
    return out


def differences(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to retract from old and what to add to get new; rows in both stay. No row
    is twice in either."""
    new = new.select(*old.columns)
    return old.subtract(new), new.subtract(old)


def changed_imports(index: dict[str, DataFrame], specs: DataFrame, gone: DataFrame, come: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import edges to retract and to add, where files (path) came and went and specs
    is the table after the change. A file's imports are looked up anew if it was
    touched, or if one of the paths that its specifiers may stand for came or went."""
    moved = gone.select("path").unionByName(come.select("path")).select(F.col("path").alias("candidate"))
    ends = F.explode(F.array(*map(F.lit, CANDIDATE_ENDS)))
    tries = index["specs"].select("path", F.array_join(walked(F.col("path"), F.col("spec")), "/").alias("base")).select("path", "base", ends.alias("end"))
    led = tries.withColumn("candidate", F.concat("base", "end")).join(moved, "candidate", "left_semi").select("path")
    sources = cut(led.unionByName(touched.select("path")).distinct(), "sources")
    paths = index["files"].select("path").join(gone.select("path"), "path", "left_anti").unionByName(come.select("path"))
    new = import_edges(specs.join(sources, "path", "left_semi"), paths)
    old = index["imports"].join(sources.select(file_id(F.col("path")).alias("source")), "source", "left_semi").select("source", "target")
    return differences(old, new)


def repaired(old: DataFrame, edges: DataFrame, gone: DataFrame, come: DataFrame, less: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels to retract and to add, for components old (id, component), the edges after
    the change, nodes (id) that went and came, and edges that went and came.

    A component that lost a node or an edge may have fallen apart: its nodes are taken
    one by one. One that only gained edges is a single node, by its least id. All others
    are not looked at.
    """
    ends = lambda rows: rows.select(F.explode(F.array("source", "target")).alias("id"))
    opened = cut(old.join(gone.unionByName(ends(less)).distinct(), "id", "left_semi").select("component").distinct(), "opened")
    left = old.join(opened, "component", "left_semi").select("id", "component").join(gone, "id", "left_anti")
    # edges inside what was opened, and those that came
    inner = edges.join(left.select(F.col("id").alias("source")), "source", "left_semi").join(left.select(F.col("id").alias("target")), "target", "left_semi")
    known = old.join(opened, "component", "left_anti").join(ends(more).distinct(), "id", "left_semi").select("id", F.col("component").alias("as"))
    known = cut(known.unionByName(left.select("id", F.col("id").alias("as"))).unionByName(come.select("id", F.col("id").alias("as"))), "asnodes")
    named = lambda c: known.select(F.col("id").alias(c), F.col("as").alias(f"{c}_as"))
    links = inner.select("source", "target").unionByName(more.select("source", "target")).join(named("source"), "source").join(named("target"), "target")
    found = components(known.select(F.col("as").alias("id")), links.select(F.col("source_as").alias("source"), F.col("target_as").alias("target")))
    # nodes that were opened or came have labels of their own, the others through their component
    single = found.join(left.select("id").unionByName(come.select("id")), "id", "left_semi")
    whole = old.join(opened, "component", "left_anti").join(found.select(F.col("id").alias("component"), F.col("component").alias("now")), "component").filter("now <> component")
    before = old.join(opened, "component", "left_semi").select("id", "component").unionByName(whole.select("id", "component"))
    return differences(before, single.unionByName(whole.select("id", F.col("now").alias("component"))))


def delta(index: dict[str, DataFrame], changed: DataFrame, deleted: DataFrame | None = None) -> Delta:
    """For each table of the index the rows to retract and the rows to add, after files
    (path, content) were written and paths deleted. Files whose content is as it was,
    and deleted ones that the index does not have, change nothing; a path that is both
    written and deleted is written. An empty content is a file without rows of its own
    but its node."""
    known = index["files"]
    new = changed.join(known.select("path", F.col("content_hash").alias("was")), "path", "left").filter(~F.sha1("content").eqNullSafe(F.col("was")))
    new = cut(new.select("path", "content", F.col("was").isNull().alias("came")), "written")
    gone = known.select("path").limit(0) if deleted is None else known.select("path").join(deleted.select("path"), "path", "left_semi").join(changed.select("path"), "path", "left_anti")
    gone, come = cut(gone, "gone"), new.filter("came").select("path")
    touched = new.select("path").unionByName(gone)
    added = own_rows(new.select("path", "content"))
    out: Delta = {}
    for name, rows in added.items():
        old = index[name].join(touched, "path", "left_semi").select(*index[name].columns)
        out[name] = differences(old, rows.select(*old.columns))

    counts = folder_counts(come).unionByName(folder_counts(gone, -1)).groupBy("folder").agg(F.sum("files").alias("by")).filter("by <> 0")
    both = cut(counts.join(index["folders"], "folder", "left").select("folder", F.col("files").alias("old"), (F.coalesce("files", F.lit(0)) + F.col("by")).alias("new")), "folders")
    out["folders"] = (both.filter("old IS NOT NULL").select("folder", F.col("old").alias("files")), both.filter("new > 0").select("folder", F.col("new").alias("files")))
    for k, which in enumerate(("new <= 0", "old IS NULL AND new > 0")):
        for name, rows in zip(("nodes", "contains"), folder_rows(both.filter(which).select("folder"))):
            pair = list(out[name])
            pair[k] = pair[k].unionByName(rows.select(*pair[k].columns))
            out[name] = tuple(pair)

    specs = applied(index["specs"], out["specs"], KEYS["specs"])
    less, more = changed_imports(index, specs, gone, come, touched)
    out["imports"] = less, more = cut(less, "less"), cut(more, "more")
    edges = applied(index["imports"], out["imports"], KEYS["imports"])
    ids = lambda rows: rows.select(file_id(F.col("path")).alias("id"))
    out["components"] = repaired(index["components"], edges, ids(gone), ids(come), less, more)
    return out


def applied(table: DataFrame, change: tuple[DataFrame, DataFrame], keys: list[str]) -> DataFrame:
    """The table without the retracted rows and with the added ones."""
    less, more = change
    return table.join(less.select(*keys), keys, "left_anti").select(*table.columns).unionByName(more.select(*table.columns))


def reindexed(index: dict[str, DataFrame], changed: DataFrame, deleted: DataFrame | None = None) -> dict[str, DataFrame]:
    """The index after the change; see ``delta``."""
    changes = delta(index, changed, deleted)
    return {name: applied(rows, changes[name], KEYS[name]) for name, rows in index.items()}
