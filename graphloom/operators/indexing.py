"""A whole index run: stages over the files of a workspace, in an order, with restart.

Each stage reads the files and what the graph holds by then, and makes rows of nodes,
edges, chunks or links. Its rows are published as a version of the run's own tables
before the next stage begins, so a run that was killed goes on at the first stage whose
rows are not there; the graph itself changes once, at the end, as one version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import delta as D
from graphloom.operators.etl import symbols
from graphloom.operators.index import index_decisions, index_relations, task_mentions
from graphloom.operators.relations import code_relations
from graphloom.sources import versions as V
from graphloom.sources.tables import cut

# The task lists at the root, and where decision records lie.
TASK_LISTS = ["todo.md", "TODO.md", "tasks.md", "TASKS.md"]
RECORDS = r"(^|/)docs/adr/[^/]+\.md$"
#: Tables of the graph: what tells rows apart, their columns, and whether a later row
#: takes the place of an earlier one (or the earlier one stays).
TABLES = {
    "nodes": (["id"], "id string, label string, type string, source_file string, content string", True),
    "edges": (["source", "target", "relation"], "source string, target string, relation string, weight double, confidence double", False),
    "chunks": (["file_path", "start_line"], "file_path string, start_line int, end_line int, content string", True),
    "adr_links": (["adr_node_id", "code_node_id"], "adr_node_id string, code_node_id string", False),
}
#: The order of stages, and the one in which tasks are read before the code they name.
ORDER = ("code", "todos", "adr", "relations")
STRICT = ("todos", "code", "adr", "relations")

Rows = dict[str, DataFrame]


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """rows with the columns of the graph's table, nulls where they have none."""
    schema = rows.sparkSession.createDataFrame([], TABLES[name][1]).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def put_together(name: str, parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, of each key that of the last part (or of the first one)."""
    keys, _, last = TABLES[name]
    rows = None
    for k, part in enumerate(parts):
        part = shaped(part, name).withColumn("__of", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    others = [c for c in rows.columns if c not in keys]
    best = (F.max_by if last else F.min_by)(F.struct(*others), F.struct("__of", *[c for c in others if c != "__of"]))
    return rows.groupBy(*keys).agg(best.alias("__r")).select(*keys, "__r.*").drop("__of")


def code_stage(files: DataFrame, graph: Rows) -> Rows:
    """Nodes of files, folders, headings and symbols, what contains what, and chunks."""
    own = D.own_rows(files)
    nodes, edges = D.folder_rows(D.folder_counts(files.select("path")))
    contains = own["contains"].unionByName(edges).withColumns({"relation": F.lit("contains"), "weight": F.lit(1.0), "confidence": F.lit(1.0)})
    return {"nodes": own["nodes"].unionByName(nodes).withColumnRenamed("path", "source_file"), "edges": contains, "chunks": own["chunks"].withColumnRenamed("path", "file_path")}


def todo_stage(files: DataFrame, graph: Rows) -> Rows:
    """Tasks of the task lists, and the files that they name among those the graph has."""
    known = graph["nodes"].filter("type = 'file'").select("id", F.col("source_file").alias("path"))
    nodes, edges = task_mentions(files.filter(F.col("path").isin(TASK_LISTS)), known)
    return {"nodes": nodes, "edges": edges}


def adr_stage(files: DataFrame, graph: Rows) -> Rows:
    """Decision records, and the files that they name."""
    known = graph["nodes"].filter("type = 'file'").select("id", F.col("source_file").alias("path"))
    older = F.regexp_extract("content", r"(?i)supersedes[^\n(]*\(([^)\s]+\.md)\)", 1)
    records = files.filter(F.col("path").rlike(RECORDS)).withColumn("supersedes", F.when(older != "", older))
    nodes, edges, links = index_decisions(records, known)
    return {"nodes": nodes, "edges": edges, "adr_links": links}


def relation_stage(files: DataFrame, graph: Rows) -> Rows:
    """Imports between files, and extends, implements, calls and uses inside them."""
    imports, _ = index_relations(files)
    defined = cut(symbols(files), "symbols")
    known = defined.select(F.col("path").alias("file"), F.col("name").alias("label"), F.concat_ws("::", "type", "path", "name").alias("id"), "type", F.col("line").alias("seq"))
    return {"edges": imports.unionByName(code_relations(files, known, defined).drop("extraction_method"))}


STAGES: dict[str, Callable[[DataFrame, Rows], Rows]] = {"code": code_stage, "todos": todo_stage, "adr": adr_stage, "relations": relation_stage}


def run_index(files: DataFrame, store: str, strict: bool = False, stages: dict[str, Callable[[DataFrame, Rows], Rows]] | None = None) -> list[str]:
    """Index files (path, content; each path once) into the graph at ``store``/graph, and
    return the stages that ran.

    The usual order reads tasks after the code that they name; ``strict`` reads them
    before, so that a first run finds none of the files they name and a second run does.
    Rows of the graph stay; new nodes and chunks take the place of old ones of their key,
    new edges and links are added. All chunks of a file that is indexed are replaced.

    A stage whose rows are there from a run that was cut short, over the same files and
    in the same order, is not run again.
    """
    spark = files.sparkSession
    stages, order = stages or STAGES, STRICT if strict else ORDER
    graph_at, run_at = f"{store}/graph", f"{store}/run"
    sums = files.agg(F.count(F.lit(1)).alias("files"), F.sum(F.xxhash64("path", "content").cast("decimal(20,0)")).alias("sum"))
    base = max(V.versions(spark, graph_at), default=0)
    mark = sums.select("files", F.col("sum").cast("string").alias("sum"), F.lit(" ".join(order)).alias("order"), F.lit(base).alias("base"))
    made = V.read_version(spark, run_at)
    if "mark" not in made or made["mark"].collect() != mark.collect():
        V.clean(spark, run_at, keep=0, grace_ms=-1)
        V.publish(spark, run_at, {"mark": mark}, 0)
        made = V.read_version(spark, run_at)
    empty = {name: spark.createDataFrame([], schema) for name, (_, schema, _) in TABLES.items()}
    graph = empty | V.read_version(spark, graph_at, base)
    ran = []

    def so_far(done: list[str]) -> Rows:
        return {name: put_together(name, [graph[name], *[made[f"{s}_{name}"] for s in done if f"{s}_{name}" in made]]) for name in TABLES}

    for k, stage in enumerate(order):
        if f"{stage}_done" in made:
            continue
        rows = stages[stage](files, so_far(list(order[:k])))
        rows = {f"{stage}_{name}": put_together(name, [r]) for name, r in rows.items()} | {f"{stage}_done": spark.range(1)}
        V.publish(spark, run_at, rows, max(V.versions(spark, run_at)))
        made = V.read_version(spark, run_at)
        ran.append(stage)
    paths = cut(files.select(F.col("path").alias("file_path")), "paths")
    graph["chunks"] = graph["chunks"].join(paths, "file_path", "left_anti")
    V.publish(spark, graph_at, so_far(list(order)), base)
    V.clean(spark, run_at, keep=0, grace_ms=-1)
    return ran


def read_index(spark: SparkSession, store: str) -> Rows:
    """The graph of the last run that came to its end."""
    return V.read_version(spark, f"{store}/graph")
