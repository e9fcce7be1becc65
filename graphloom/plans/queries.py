"""The registered queries: operators over the canonical tables, each with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import filters as FL
from graphloom.operators import joins as J
from graphloom.operators import journal as JR
from graphloom.plans.canonical import BASE_MS, HOUR_MS, item_tasks, load, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = BASE_MS + 5000 * HOUR_MS
JOURNAL_AS_OF = 1_706_745_600_000  # 2024-02-01


def query(name: str, sql: str | None = None, *tables: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query; sql reads the named canonical tables and the views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_tables(sql, *tables, recursive=recursive)
        return f

    return add


def epoch_ms(column: str):
    """Milliseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [load(spark, d, n) for n in names]


# a community for every node that has one, by a rule both sides can state: a
# person, folder or repo belongs to its nation
GROUPED_SQL = (
    "grouped AS (SELECT 'customer::' || c_custkey AS id, c_name AS label, 'person' AS type, cast(c_nationkey as int) AS community, c_acctbal AS x FROM customer "
    "UNION ALL SELECT 'supplier::' || s_suppkey, s_name, 'folder', s_nationkey, s_acctbal FROM supplier "
    "UNION ALL SELECT 'nation::' || n_nationkey, n_name, 'repo', n_nationkey, 0.0 FROM nation)"
)


def grouped(spark: SparkSession, d: str) -> DataFrame:
    c, s, n = _t(spark, d, "customer", "supplier", "nation")
    row = lambda df, p, k, label, kind, com, x: df.select(
        F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("type"), F.col(com).cast("int").alias("community"), x.cast("double").alias("x")
    )
    return (
        row(c, "customer::", "c_custkey", "c_name", "person", "c_nationkey", F.col("c_acctbal"))
        .unionByName(row(s, "supplier::", "s_suppkey", "s_name", "folder", "s_nationkey", F.col("s_acctbal")))
        .unionByName(row(n, "nation::", "n_nationkey", "n_name", "repo", "n_nationkey", F.lit(0.0)))
    )


# ---- filters and projections


@query("flt1_get_node", "SELECT id, label, type, updated_at FROM nodes WHERE id = 'part::7'", "nodes")
def _(spark, d):
    return FL.get_node(load(spark, d, "nodes"), "part::7").select("id", "label", "type", "updated_at")


@query("flt2_changed_since", f"SELECT id, label, type, updated_at FROM nodes WHERE updated_at >= {AS_OF} ORDER BY updated_at DESC, id LIMIT 10", "nodes")
def _(spark, d):
    return FL.changed_since(load(spark, d, "nodes"), AS_OF).select("id", "label", "type", "updated_at")


@query(
    "flt3_delta_page",
    f"WITH probe AS (SELECT id, updated_at FROM nodes WHERE updated_at >= {AS_OF} ORDER BY updated_at DESC, id LIMIT 21), "
    "r AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, id) AS rank, count(*) OVER () AS total FROM probe) "
    "SELECT id, updated_at, cast(rank as int) AS rank, total > 20 AS has_more, max(updated_at) OVER () AS next_cursor FROM r WHERE rank <= 20",
    "nodes",
)
def _(spark, d):
    return FL.delta_page(load(spark, d, "nodes").select("id", "updated_at"), AS_OF)


@query("flt4_search_labels", "SELECT id, label, type, source_file FROM nodes WHERE contains(lower(label), 'an') OR contains(lower(id), 'an') ORDER BY id LIMIT 50", "nodes")
def _(spark, d):
    return FL.search_labels(load(spark, d, "nodes"), "An")


@query("flt5_of_types", "SELECT id, type, updated_at FROM nodes WHERE type IN ('repo', 'workspace') ORDER BY updated_at DESC, id LIMIT 50", "nodes")
def _(spark, d):
    return FL.of_types(load(spark, d, "nodes"), ["repo", "workspace"]).select("id", "type", "updated_at")


@query("flt6_list_repos", "SELECT id, label, cast(0 as int) AS fields FROM nodes WHERE type = 'repo'", "nodes")
def _(spark, d):
    rows = load(spark, d, "nodes").filter("type = 'repo'").withColumn("metadata", F.lit("not json"))
    return FL.list_repos(rows).select("id", "label", F.size("metadata").alias("fields"))


@query(
    "flt7_list_persons",
    "SELECT c_name AS name, c_mktsegment AS role, c_custkey = 3 AS is_primary FROM customer",
)
def _(spark, d):
    role = F.when(F.col("c_mktsegment") == "BUILDING", "owner").when(F.col("c_mktsegment") == "MACHINERY", "member").otherwise("other")
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment", role.alias("role"), (F.col("c_custkey") == 3).alias("is_primary"))
    return FL.list_persons(rows).select("name", F.col("c_mktsegment").alias("role"), "is_primary")


@query(
    "flt9_visible_edges",
    "SELECT e.relation, count(*) AS n FROM edges e WHERE source IN (SELECT id FROM nodes WHERE type IN ('repo', 'folder', 'workspace')) AND target IN (SELECT id FROM nodes WHERE type IN ('repo', 'folder', 'workspace')) GROUP BY 1",
    "nodes", "edges",
)
def _(spark, d):
    nodes, edges = _t(spark, d, "nodes", "edges")
    return FL.visible(nodes, edges, ["repo", "folder", "workspace"]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


MESSAGES_SQL = (
    "messages AS (SELECT event_id AS seq, cast(floor(epoch_us(ts) / 1000.0) as bigint) AS ts, event_type AS msg_type, cast(user_id as varchar) AS \"from\", "
    "cast(event_id as varchar) AS id, props AS thread_id FROM events)"
)


def messages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        F.col("event_id").alias("seq"), epoch_ms("ts").alias("ts"), F.col("event_type").alias("msg_type"), F.col("user_id").cast("string").alias("from"),
        F.lit(None).cast("string").alias("to"), F.col("event_id").cast("string").alias("id"), F.col("props").alias("thread_id"),
    )


@query("flt10_message_feed", f"WITH {MESSAGES_SQL} SELECT seq, msg_type, \"from\" FROM messages WHERE ts >= 1704500000000 AND msg_type = 'view' ORDER BY seq DESC LIMIT 100")
def _(spark, d):
    return FL.message_feed(messages(spark, d), since=1704500000000, kind="view").select("seq", "msg_type", "from")


@query("flt11_freshness", f"SELECT type, {AS_OF} - updated_at > 2592000000 AS stale, count(*) AS n FROM nodes GROUP BY 1, 2", "nodes")
def _(spark, d):
    return FL.with_freshness(load(spark, d, "nodes"), AS_OF).groupBy("type", "stale").agg(F.count(F.lit(1)).alias("n"))


# ---- joins


@query(
    "jn1_neighbors",
    "SELECT e.target AS neighbor, n.label AS neighbor_label, relation, 'out' AS direction FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'nation::3' "
    "UNION ALL SELECT e.source, n.label, relation, 'in' FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'nation::3'",
    "nodes", "edges",
)
def _(spark, d):
    return J.neighbors(*_t(spark, d, "nodes", "edges"), "nation::3").drop("id")


@query(
    "jn1_neighbor_counts",
    "SELECT type, relation, direction, count(*) AS n FROM (SELECT source AS id, relation, 'out' AS direction FROM edges UNION ALL SELECT target, relation, 'in' FROM edges) e JOIN nodes USING (id) GROUP BY 1, 2, 3",
    "nodes", "edges",
)
def _(spark, d):
    nodes, edges = _t(spark, d, "nodes", "edges")
    return J.neighbor_counts(nodes, edges, item_tasks(spark, d))


@query("jn2_embedded_chunks", "SELECT chunk_id, file_path, node_id, len(vector) AS width FROM vectors v JOIN chunks c ON c.id = v.chunk_id", "vectors", "chunks")
def _(spark, d):
    chunks, vectors = _t(spark, d, "chunks", "vectors")
    return J.embedded_chunks(chunks, vectors).select("chunk_id", "file_path", "node_id", F.size("vector").cast("long").alias("width"))


@query("jn3_embedded_communities", "SELECT chunk_id, c.node_id, coalesce(n.community, -1) AS community FROM vectors v JOIN chunks c ON c.id = v.chunk_id LEFT JOIN nodes n ON n.id = c.node_id", "vectors", "chunks", "nodes")
def _(spark, d):
    chunks, vectors, nodes = _t(spark, d, "chunks", "vectors", "nodes")
    return J.embedded_chunks(chunks, vectors, nodes).select("chunk_id", "node_id", F.coalesce("community", F.lit(-1)).alias("community"))


@query("jn4_unembedded", "SELECT id, file_path FROM chunks WHERE id NOT IN (SELECT chunk_id FROM vectors)", "vectors", "chunks")
def _(spark, d):
    return J.unembedded(*_t(spark, d, "chunks", "vectors")).select("id", "file_path")


@query(
    "jn5_people_near",
    f"SELECT DISTINCT p.id, p.label FROM nodes p JOIN edges e ON e.source = p.id JOIN nodes t ON t.id = e.target WHERE p.type = 'person' AND e.relation IN ('owns', 'contributes_to') AND t.updated_at BETWEEN {BASE_MS} AND {BASE_MS + 40 * HOUR_MS} ORDER BY p.id LIMIT 12",
    "nodes", "edges",
)
def _(spark, d):
    return J.people_near(*_t(spark, d, "nodes", "edges"), ["owns", "contributes_to"], BASE_MS, BASE_MS + 40 * HOUR_MS)


@query(
    "jn6_mentions",
    "SELECT t.doc_id AS text_id, f.n_nationkey AS file_id FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_.\\-]+')) AS word FROM documents) t "
    "JOIN (SELECT n_nationkey, ['the', 'die', 'la', 'une', 'zzz'][n_nationkey % 5 + 1] AS word FROM nation) f ON t.word = f.word",
)
def _(spark, d):
    docs, nation = _t(spark, d, "documents", "nation")
    name = F.get(F.array(*map(F.lit, ["The", "die", "la", "une", "zzz"])), F.col("n_nationkey") % 5)
    files = nation.select(F.col("n_nationkey").alias("file_id"), F.concat(F.lit("src/"), name).alias("path"))
    return J.mentions(docs.select(F.col("doc_id").alias("text_id"), F.col("text").alias("content")), files)


@query(
    "jn14_file_mentions",
    "SELECT DISTINCT t.doc_id AS text_id, f.id AS file_id FROM documents t JOIN (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation UNION SELECT 1000 + r_regionkey, lower(r_name) FROM region "
    "UNION SELECT * FROM (VALUES (2000, 'the'), (2001, 'of the'), (2002, 'in'), (2003, 'it''s')) v) f "
    "ON regexp_matches(lower(t.text), '(^|[^\\pL\\pN_])' || f.name || '($|[^\\pL\\pN_])')",
)
def _(spark, d):
    docs, nation, region = _t(spark, d, "documents", "nation", "region")
    path = lambda c: F.concat(F.lit("src/"), c).alias("path")
    files = nation.select(F.col("n_nationkey").cast("long").alias("file_id"), path(F.col("n_name")))
    files = files.union(region.select((F.col("r_regionkey") + 1000).cast("long"), path(F.col("r_name"))))
    files = files.union(spark.createDataFrame([(2000, "the"), (2001, "src/of the"), (2002, "in"), (2003, "a/it's")], "file_id long, path string"))
    return J.file_mentions(docs.select(F.col("doc_id").alias("text_id"), F.col("text").alias("content")), files)


@query(
    "jn10_package_dependencies",
    "WITH p AS (SELECT p_brand AS id, p_type AS package FROM part), r AS (SELECT id, min(package) AS package FROM p GROUP BY id) "
    "SELECT DISTINCT a.id AS source, b.id AS target FROM p a JOIN r b ON a.package = b.package WHERE a.id <> b.id",
)
def _(spark, d):
    repos = load(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min("p_type").alias("package"), F.collect_set("p_type").alias("deps"))
    return J.package_dependencies(repos)


@query(
    "jn11_missing_children",
    "SELECT 'repo::' || brand AS source, 'folder::' || path AS target FROM (SELECT DISTINCT p_brand AS brand, 'parts/' || p_brand || '/' || p_size AS path, p_size FROM part) x WHERE p_size % 3 <> 0",
)
def _(spark, d):
    part = load(spark, d, "part")
    folders = part.select(F.concat(F.lit("parts/"), "p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("path"), "p_size", "p_brand").distinct()
    folders = folders.withColumn("id", F.concat(F.lit("folder::"), "path"))
    repos = part.select(F.concat(F.lit("repo::"), "p_brand").alias("id"), F.concat(F.lit("parts/"), "p_brand").alias("rel_path")).distinct()
    edges = folders.filter("p_size % 3 = 0").select(F.concat(F.lit("repo::"), "p_brand").alias("source"), F.col("id").alias("target"))
    return J.missing_children(repos, folders.select("id", "path"), edges)


@query(
    "jn12_sizes_by_prefix",
    "SELECT u.id, u.rel_path, cast(CASE WHEN rel_path = '.' THEN (SELECT count(*) FROM nodes) ELSE (SELECT count(*) FROM nodes n WHERE starts_with(n.source_file, u.rel_path || '/')) END as bigint) AS node_count "
    "FROM (SELECT DISTINCT p_brand AS id, 'parts/' || p_brand AS rel_path FROM part UNION ALL SELECT 'all', '.') u",
    "nodes",
)
def _(spark, d):
    nodes, part = _t(spark, d, "nodes", "part")
    units = part.select(F.col("p_brand").alias("id"), F.concat(F.lit("parts/"), "p_brand").alias("rel_path")).distinct()
    return J.sizes_by_prefix(units.union(spark.sql("SELECT 'all' AS id, '.' AS rel_path")), nodes)


@query(
    "jn13_roster",
    "WITH l AS (SELECT session_id, tool AS name, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM journal WHERE ok) "
    "SELECT s.session_id, l.name, s.started FROM (SELECT session_id, min(ts) AS started FROM journal GROUP BY 1) s LEFT JOIN l ON l.session_id = s.session_id AND n = 1",
    "journal",
)
def _(spark, d):
    journal = load(spark, d, "journal")
    sessions = journal.select("session_id").distinct()
    starts = journal.groupBy("session_id").agg(F.min("ts").alias("started"))
    return J.roster(sessions, journal.filter("ok").select("session_id", F.col("tool").alias("name"), "seq"), starts)


# ---- aggregations

STATS = ("nodes", "edges", "chunks", "vectors")


@query("agg1_stats", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in STATS), *STATS)
def _(spark, d):
    return A.stats(**dict(zip(STATS, _t(spark, d, *STATS))))


@query("agg2_expertise", "SELECT type AS area, count(*) AS count FROM nodes GROUP BY 1", "nodes")
def _(spark, d):
    return A.expertise(load(spark, d, "nodes"))


CRITICALITY_SQL = "SELECT n.id, label, type, score FROM (SELECT target AS id, count(*) AS score FROM edges GROUP BY 1 ORDER BY score DESC, id LIMIT 10) t JOIN nodes n ON n.id = t.id"


@query("agg3_criticality", CRITICALITY_SQL, "nodes", "edges")
def _(spark, d):
    return A.criticality(*_t(spark, d, "nodes", "edges"))


@query(
    "agg4_community_overview",
    f"WITH {GROUPED_SQL}, c AS (SELECT community, type, count(*) AS n FROM grouped GROUP BY 1, 2) "
    "SELECT community AS id, cast(sum(n) as bigint) AS node_count, string_agg(type || '=' || n, ',' ORDER BY type) AS histogram, arg_min(type, struct_pack(a := -n, b := type)) AS dominant_type FROM c GROUP BY 1",
)
def _(spark, d):
    rows = A.community_overview(grouped(spark, d))
    pairs = F.transform(F.map_entries("type_histogram"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return rows.select("id", "node_count", F.array_join(pairs, ",").alias("histogram"), "dominant_type")


@query(
    "agg5_community_label",
    f"WITH {GROUPED_SQL}, w AS (SELECT community, unnest(regexp_split_to_array(lower(regexp_replace(label, '\\.[A-Za-z]+$', '')), '[-_ #]+')) AS word FROM grouped), "
    "c AS (SELECT community, word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY 1, 2) "
    "SELECT community, arg_min(word, struct_pack(a := -n, b := word)) AS word FROM c GROUP BY 1",
)
def _(spark, d):
    rows = grouped(spark, d).withColumn("label", F.translate("label", "#", " ")).withColumn("source_file", F.lit(None).cast("string"))
    return A.community_label(rows).select("community", "word")


@query("agg6_freshness", f"SELECT max(updated_at) AS last_updated, {AS_OF} - max(updated_at) > 2592000000 AS stale FROM nodes", "nodes")
def _(spark, d):
    return FL.with_freshness(load(spark, d, "nodes").agg(F.max("updated_at").alias("updated_at")), AS_OF).withColumnRenamed("updated_at", "last_updated")


DEGREES_SQL = "deg AS (SELECT n.id, n.type, coalesce(x.degree, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e GROUP BY 1) x USING (id))"


@query("agg7_degrees", f"WITH {DEGREES_SQL} SELECT id, degree FROM deg", "nodes", "edges")
def _(spark, d):
    return A.degrees(*_t(spark, d, "nodes", "edges"))


@query(
    "agg8_bundles",
    f"WITH {GROUPED_SQL} SELECT least(s.community, t.community) AS a, greatest(s.community, t.community) AS b, count(*) AS count FROM "
    "(SELECT DISTINCT 'supplier::' || l_suppkey AS source, 'customer::' || o_custkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey) e "
    "JOIN grouped s ON s.id = e.source JOIN grouped t ON t.id = e.target WHERE s.community <> t.community GROUP BY 1, 2",
)
def _(spark, d):
    lineitem, orders = _t(spark, d, "lineitem", "orders")
    sales = lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    edges = sales.select(F.concat(F.lit("supplier::"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("customer::"), F.col("o_custkey").cast("string")).alias("target")).distinct()
    return A.bundles(grouped(spark, d), edges)


PRIORITY_SQL = "CASE type WHEN 'decision' THEN 5 WHEN 'adr' THEN 4 WHEN 'workspace' THEN 4 WHEN 'repo' THEN 4 WHEN 'person' THEN 3 WHEN 'file' THEN 3 WHEN 'class' THEN 3 WHEN 'folder' THEN 2 WHEN 'document' THEN 2 ELSE 1 END"


@query(
    "agg9_community_top",
    f"WITH {GROUPED_SQL}, x AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e GROUP BY 1), "
    f"r AS (SELECT g.id, community, round({PRIORITY_SQL} * (1 + coalesce(degree, 0) / 10.0), 6) AS score FROM grouped g LEFT JOIN x USING (id)) "
    "SELECT community, arg_min(id, struct_pack(a := -score, b := id)) AS id FROM r GROUP BY 1",
    "edges",
)
def _(spark, d):
    return A.community_top(grouped(spark, d), load(spark, d, "edges"))


TOOL_SQL = (
    "tool_stats AS (WITH c AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY seq DESC) AS n FROM journal WHERE type = 'tool_call'), "
    "t AS (SELECT tool, count(*) AS count, count(*) FILTER (WHERE NOT ok) AS errors, arg_max(duration_ms, seq) AS last_ms FROM c GROUP BY 1), "
    "v AS (SELECT tool, list_sort(list(duration_ms)) AS v FROM c WHERE n <= 256 GROUP BY 1) "
    "SELECT tool, count, errors, last_ms, v[cast(floor((len(v) - 1) * 0.5) as int) + 1] AS p50_ms, v[cast(floor((len(v) - 1) * 0.95) as int) + 1] AS p95_ms FROM t JOIN v USING (tool))"
)


@query("agg10_tool_stats", f"WITH {TOOL_SQL} SELECT * FROM tool_stats", "journal")
def _(spark, d):
    return JR.tool_stats(load(spark, d, "journal"))


@query("agg11_journal_summary", "SELECT count(DISTINCT session_id) AS sessions, count(*) AS tool_calls, count(*) FILTER (WHERE NOT ok) AS errors, max(ts) AS last_activity, arg_max(tool, seq) AS last_tool FROM journal", "journal")
def _(spark, d):
    return JR.journal_summary(load(spark, d, "journal"))


@query(
    "agg12_session_rows",
    "WITH s AS (SELECT session_id, min(seq) AS start_seq, cast(session_id as bigint) % 50 AS pid FROM journal GROUP BY 1), "
    "c AS (SELECT j.session_id, count(*) AS tool_calls, arg_max(tool, seq) AS last_tool, max(ts) AS last_ts FROM journal j JOIN s USING (session_id) WHERE seq > start_seq GROUP BY 1) "
    "SELECT session_id, pid, CASE WHEN cast(session_id as bigint) % 3 = 0 THEN 'ended' WHEN pid % 2 = 0 THEN 'active' ELSE 'orphan' END AS state, coalesce(tool_calls, 0) AS tool_calls, last_tool, last_ts FROM s LEFT JOIN c USING (session_id)",
    "journal",
)
def _(spark, d):
    journal = load(spark, d, "journal")
    key = F.col("session_id").cast("long")
    starts = journal.groupBy("session_id").agg(F.min("seq").alias("start_seq")).withColumn("pid", key % 50)
    ended = journal.filter(key % 3 == 0).select("session_id").distinct()
    return JR.session_rows(journal, starts, ended, spark.range(0, 50, 2).select(F.col("id").alias("pid")))


@query(
    "agg13_session_tools",
    "SELECT session_id, string_agg(tool || '=' || n, ',' ORDER BY tool) AS tools FROM (SELECT session_id, tool, count(*) AS n FROM journal GROUP BY 1, 2) x GROUP BY 1",
    "journal",
)
def _(spark, d):
    pairs = F.transform(F.map_entries("tools"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return JR.session_tools(load(spark, d, "journal")).select("session_id", F.array_join(pairs, ",").alias("tools"))


@query(
    "agg14_identities",
    "SELECT session_id, arg_max(name, seq) FILTER (WHERE name IS NOT NULL) AS name, arg_max(model, seq) FILTER (WHERE model IS NOT NULL) AS model, max(ts) AS last_seen FROM "
    "(SELECT session_id, seq, ts, CASE WHEN tool = 'signup' THEN tool || seq END AS name, CASE WHEN ok THEN tool END AS model FROM journal) x GROUP BY 1",
    "journal",
)
def _(spark, d):
    rows = load(spark, d, "journal").withColumns({"name": F.when(F.col("tool") == "signup", F.concat("tool", F.col("seq").cast("string"))), "model": F.when(F.col("ok"), F.col("tool"))})
    return JR.identities(rows, ["name", "model"])


@query("agg15_threads", f"WITH {MESSAGES_SQL} SELECT coalesce(thread_id, id) AS key, count(*) AS n, max(ts) AS last_ts FROM messages GROUP BY 1")
def _(spark, d):
    return JR.threads(messages(spark, d))


@query("agg15_thread_items", f"WITH {MESSAGES_SQL} SELECT coalesce(thread_id, id) AS key, row_number() OVER (PARTITION BY coalesce(thread_id, id) ORDER BY seq, id) - 1 AS position, id FROM messages")
def _(spark, d):
    return JR.thread_items(messages(spark, d))


@query(
    "agg16_conflicts",
    f"WITH {MESSAGES_SQL}, f AS (SELECT DISTINCT thread_id FROM messages WHERE msg_type = 'error'), m AS (SELECT thread_id, id, \"from\" AS topic FROM messages WHERE thread_id IN (SELECT thread_id FROM f)) "
    "SELECT DISTINCT thread_id, id FROM m WHERE (thread_id, topic) IN (SELECT (thread_id, topic) FROM (SELECT thread_id, topic FROM m GROUP BY 1, 2 HAVING count(*) > 1) q)",
)
def _(spark, d):
    kind = F.when(F.col("msg_type") == "error", "code-conflict").otherwise(F.col("msg_type"))
    return JR.conflicts(messages(spark, d).withColumns({"msg_type": kind, "topics": F.array("from")}))


@query("agg19_metrics_text", f"WITH {TOOL_SQL} SELECT 'tool_' || k || '{{tool=\"' || tool || '\"}} ' || v AS line FROM (SELECT tool, unnest(['calls_total', 'errors_total', 'last_ms', 'p50_ms', 'p95_ms']) AS k, unnest([count, errors, last_ms, p50_ms, p95_ms]) AS v FROM tool_stats) x".replace("{{", "{").replace("}}", "}"), "journal")
def _(spark, d):
    return JR.metrics_text(JR.tool_stats(load(spark, d, "journal")))


@query("agg20_contributors", "SELECT n_name AS repo, o_custkey AS person, count(*) AS commits FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def _(spark, d):
    orders, customer, nation = _t(spark, d, "orders", "customer", "nation")
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return A.contributors(rows.select(F.col("n_name").alias("repo"), F.col("o_custkey").alias("person")))


@query("agg22_top_nodes", f"WITH {DEGREES_SQL} SELECT id, type, round({PRIORITY_SQL} * (1 + degree / 10.0), 6) AS score FROM deg ORDER BY score DESC, id LIMIT 25", "nodes", "edges")
def _(spark, d):
    return A.top_nodes(*_t(spark, d, "nodes", "edges"), 25)


@query(
    "agg23_centroids",
    f"WITH {GROUPED_SQL}, c AS (SELECT community, avg(x) AS x, avg(x * 2) AS y, count(*) AS members FROM grouped GROUP BY 1) "
    "SELECT community, round(x, 4) AS x, round(y, 4) AS y, members, round(least(64.0, 7 * sqrt(members)), 6) AS radius, row_number() OVER (ORDER BY members DESC, community) <= 10 AS labelled FROM c",
)
def _(spark, d):
    rows = A.centroids(grouped(spark, d).withColumn("y", F.col("x") * 2), 10)
    return rows.select("community", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "members", F.round("radius", 6).alias("radius"), "labelled")


@query(
    "src12_file_history",
    "WITH c AS (SELECT l_partkey AS file, l_suppkey AS author, cast(floor(epoch_us(l_shipdate) / 1000.0) as bigint) AS ts FROM lineitem), p AS (SELECT file, author, count(*) AS n, min(ts) AS a FROM c GROUP BY 1, 2) "
    "SELECT file, cast(sum(n) as bigint) AS commits, count(*) AS contributors, arg_min(author, struct_pack(a := a, b := author)) AS creator, arg_min(author, struct_pack(a := -n, b := author)) AS owner, "
    "cast(greatest(1.0, round((1000000000000 - min(a)) / 86400000)) as bigint) AS age_days FROM p GROUP BY 1",
)
def _(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), epoch_ms("l_shipdate").alias("ts"))
    return A.file_history(rows, 1_000_000_000_000).select("file", "commits", "contributors", "creator", "owner", "age_days")
