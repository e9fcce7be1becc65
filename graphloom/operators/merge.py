"""Upserts, deletes and last-write-wins merging, as joins over whole tables.

Every writer takes the old rows and the new ones and returns the table that
results, so a caller can write it with overwrite or into a versioned folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import cut, spread

# The type that an id prefix stands for when only the id is known.
STUB_TYPES = {
    "dependency": "dependency", "person": "person", "repo": "repo", "workspace": "workspace", "folder": "folder", "class": "class",
    "interface": "interface", "function": "function", "heading": "document", "decision": "adr", "memory": "agent_action", "task": "task",
}


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key, the one of greatest order."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("r"))
    return best.select(*keys, "r.*").select(*rows.columns)


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def upsert_nodes(old: DataFrame, new: DataFrame, tasks: int | None = None) -> DataFrame:
    """New rows replace old ones of their id but keep created_at; empty texts
    become null. Rows meet by id in ``tasks`` tasks, if given."""
    new = spread(new, tasks, "id")  # the old rows that meet them follow
    texts = [c for c in ("source_file", "content") if c in new.columns]
    new = new.withColumns({c: _filled(F.col(c)) for c in texts})
    kept = old.join(new.select("id"), "id", "left_anti")
    born = old.select("id", F.col("created_at").alias("born"))
    fresh = new.join(born, "id", "left").withColumn("created_at", F.coalesce("born", "created_at")).select(*old.columns)
    return kept.unionByName(fresh)


def stub_type(node_id: Column) -> Column:
    prefix = F.substring_index(node_id, "::", 1)
    named = F.create_map(*[F.lit(x) for kv in STUB_TYPES.items() for x in kv])
    return F.when(node_id.contains("::"), F.coalesce(F.try_element_at(named, prefix), F.lit("file"))).otherwise("file")


def stub_label(node_id: Column) -> Column:
    return F.substring_index(F.substring_index(node_id, "::", -1), "/", -1)


def add_edges(edges: DataFrame, new: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges that are not there yet, the first (seq) of each source, target and relation;
    new ones are kept by these in ``tasks`` tasks, if given."""
    keys = ["source", "target", "relation"]
    fresh = keep_first(spread(new, tasks, *keys), keys, "seq").join(edges.select(*keys), keys, "left_anti")
    return fresh.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def stubs(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(id, label, type) for edge ends without a node; ends are kept in ``tasks`` tasks, if given."""
    ends = spread(edges.select(F.explode(F.array("source", "target")).alias("id")), tasks, "id").distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").select("id", stub_label(F.col("id")).alias("label"), stub_type(F.col("id")).alias("type"))


def delete_file(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame, path: str) -> dict[str, DataFrame]:
    """The tables without a file's nodes and chunks, and what hangs on them."""
    gone = nodes.filter(F.col("source_file") == path).select(F.col("id").alias("gone"))
    less = lambda rows, c: rows.join(gone, rows[c] == F.col("gone"), "left_anti")
    kept = less(chunks.filter(F.col("file_path") != path), "node_id")
    return {
        "nodes": less(nodes, "id"),
        "edges": less(less(edges, "source"), "target"),
        "chunks": kept,
        "vectors": vectors.join(kept.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi"),
    }


def merge_latest(local: DataFrame, remote: DataFrame, key: str = "id", time: str = "updated_at") -> DataFrame:
    """Of each key the row updated last; the local one if the times are equal."""
    rows = local.withColumn("is_local", F.lit(1)).unionByName(remote.withColumn("is_local", F.lit(0)))
    others = [c for c in local.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.coalesce(F.col(time), F.lit(0)), F.col("is_local"))).alias("r"))
    return best.select(key, "r.*").select(*local.columns)


def merge_edges(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Of each source, target and relation the edge of greatest weight (null and 0
    count as 1); the local one if weights are equal."""
    rows = local.withColumn("side", F.lit(0)).unionByName(remote.withColumn("side", F.lit(1)))
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    order = F.struct((-weight).alias("w"), F.col("side"))
    return rows.groupBy("source", "target", "relation").agg(F.min_by("weight", order).alias("weight"))


def merge_stats(local: dict[str, DataFrame], remote: dict[str, DataFrame]) -> DataFrame:
    """One row: merged sizes, nodes of one id but different times, and the growth of
    the edge count over the larger side (edge_conflicts)."""
    keys = ["source", "target", "relation"]
    theirs = remote["nodes"].select("id", F.col("updated_at").alias("theirs"), F.lit(1).alias("r"))
    nodes = local["nodes"].select("id", "updated_at", F.lit(1).alias("l")).join(theirs, "id", "full").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if((F.col("l") == 1) & (F.col("r") == 1) & (F.col("updated_at") != F.col("theirs"))).alias("node_conflicts")
    )
    sides = local["edges"].select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).union(remote["edges"].select(*keys, F.lit(0), F.lit(1)))
    edges = sides.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r")).agg(F.count(F.lit(1)).alias("edges"), F.sum("l").alias("n_l"), F.sum("r").alias("n_r"))
    out = nodes.join(F.broadcast(edges))  # two single rows
    return out.select("nodes", "edges", "node_conflicts", (F.col("edges") - F.greatest("n_l", "n_r")).alias("edge_conflicts"))


def normalize_remote(rows: DataFrame, now: int) -> DataFrame:
    """Remote nodes as local ones: time as a number, digits or ISO text (else now),
    type file and label id where missing."""
    t = F.col("updated_at").cast("string")
    ms = F.coalesce(F.when(t.rlike("^[0-9]+$"), t.try_cast("long")), F.unix_millis(F.try_to_timestamp(t)), F.lit(now))
    return rows.select("id", F.coalesce(_filled(F.col("label")), "id").alias("label"), F.coalesce(_filled(F.col("type")), F.lit("file")).alias("type"), ms.alias("updated_at"))


def merge_databases(own: DataFrame, other: DataFrame, keys: list[str], replace: bool) -> DataFrame:
    """Rows of both: of a key the other's row (replace) or one's own (ignore)."""
    return (own.join(other.select(*keys), keys, "left_anti").unionByName(other)) if replace else own.unionByName(other.join(own.select(*keys), keys, "left_anti"))


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations that are not archived with their message counts, pinned first,
    then the latest."""
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
    rows = conversations.filter(~F.col("is_archived")).join(counts, "conv_id", "left")
    return rows.withColumn("message_count", F.coalesce("message_count", F.lit(0))).orderBy(F.desc("is_pinned"), F.desc("updated_at"), "conv_id")


def fork_conversation(messages: DataFrame, conv_id: int, new_id: int) -> DataFrame:
    """A conversation's messages under a new id."""
    return messages.filter(F.col("conv_id") == conv_id).withColumn("conv_id", F.lit(new_id).cast("long"))


def message_nodes(messages: DataFrame) -> DataFrame:
    """(id, label, sender) for agent messages: labels over 72 characters are cut."""
    label = F.when(F.length("text") > 72, F.concat(F.substring("text", 1, 72), F.lit("…"))).otherwise(F.col("text"))
    return messages.select(F.concat(F.lit("mesh::"), F.col("id").cast("string")).alias("id"), label.alias("label"), F.concat(F.lit("agent::"), F.col("from")).alias("sender"))


def message_rows(messages: DataFrame) -> dict[str, DataFrame]:
    """What agent messages (id, from, from_name, to, msg_type, urgency, thread_id, text, ts)
    add to the graph: nodes and chunks of the messages, a node for each agent, by its
    latest name (else its id), and a ``generated`` edge from agent to message. Messages
    whose text is blank are none."""
    rows = messages.filter(F.trim("text") != "")
    node, agent = F.concat(F.lit("mesh::"), F.col("id").cast("string")), F.concat(F.lit("agent:"), "from")
    label = F.when(F.length("text") > 72, F.concat(F.substring("text", 1, 72), F.lit("…"))).otherwise(F.col("text"))
    about = F.to_json(F.struct(F.col("msg_type").alias("type"), "thread_id", "from", "to", "urgency", "ts"), {"ignoreNullFields": "false"})
    own = rows.select(node.alias("id"), label.alias("label"), F.lit("agent_message").alias("type"), F.col("text").alias("content"), about.alias("metadata"), F.col("ts").alias("updated_at"))
    last = rows.groupBy("from").agg(F.max_by("from_name", F.when(F.col("from_name").isNotNull(), F.struct("ts", "id"))).alias("name"), F.max("ts").alias("updated_at"))
    agents = last.select(agent.alias("id"), F.coalesce("name", "from").alias("label"), F.lit("agent").alias("type"), F.lit(None).cast("string").alias("content"), F.to_json(F.struct(F.col("from").alias("session_id"))).alias("metadata"), "updated_at")
    chunks = rows.select(F.concat(F.lit("chunk:"), node).alias("id"), node.alias("node_id"), F.lit("mesh://messages").alias("file_path"), F.col("text").alias("content"), F.col("ts").alias("updated_at"))
    edges = rows.select(agent.alias("source"), node.alias("target"), F.lit("generated").alias("relation"), F.lit(1.0).alias("weight"))
    return {"nodes": own.unionByName(agents), "chunks": chunks, "edges": edges}


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds n, the number of a row within its first column's group."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by[0]).orderBy(*by[1:])))


def positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``position``, a row's number (from 0) within its key, in a total order. Rows
    are dealt by ranges of key and order, so a key that holds most rows is numbered by
    many tasks; counts for each key and range give the starts."""
    dealt = cut(rows.repartitionByRange(key, *order).withColumn("__range", F.spark_partition_id()), "positions")
    counts = dealt.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("__key"), F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range", key).orderBy(*order)) - 1
    joined = dealt.withColumn("__n", inside).join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__of")))
    return joined.select(*rows.columns, (F.col("__start") + F.col("__n")).alias("position"))
