"""Registered queries: activity and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import activity as AC
from graphloom.plans.canonical import item_tasks, load
from graphloom.plans.queries import _t, epoch_ms, query


@query(
    "src9_agent_actions",
    "SELECT 'agent_action::' || left(cast(conv_id AS VARCHAR), 8) || '_' || turn || '_1' AS id, 'file::' || (conv_id % 3000) AS target FROM conversations WHERE role = 'assistant' AND conv_id % 3000 IN (SELECT p_partkey FROM part)",
)
def _(spark, d):
    conversations, part = _t(spark, d, "conversations", "part")
    target = (F.col("conv_id") % 3000).cast("string")
    call = lambda name: F.struct(F.lit(name).alias("name"), target.alias("target"))
    steps = conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("step"), F.array(call("read_file"), call("Write_to_file")).alias("calls"))
    return AC.agent_actions(steps, part.select(F.concat(F.lit("file::"), F.col("p_partkey").cast("string")).alias("id")))


@query(
    "snk12_decision_rows",
    "SELECT 'decision::' || n_nationkey AS source, 'file::docs/' || n_name AS target, 'documents' AS relation, n_name AS label FROM nation WHERE n_nationkey % 2 = 0",
)
def _(spark, d):
    nation = load(spark, d, "nation")
    rows = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("x").alias("text"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("docs/"), "n_name")).alias("path"), F.lit(1).alias("at"))
    nodes, edges = AC.decision_rows(rows)
    return edges.join(nodes.select(F.col("id").alias("source"), "label"), "source")


@query("snk12_memory_rows", "SELECT 'memory::' || doc_id AS id, substr(text, 1, 80) AS label, CASE WHEN lang = 'en' THEN 'fact' ELSE 'insight' END AS kind FROM documents")
def _(spark, d):
    docs = load(spark, d, "documents")
    return AC.memory_rows(docs.select(F.col("doc_id").alias("id"), "text", F.when(F.col("lang") == "en", "fact").otherwise("").alias("kind"), F.lit(1).alias("at"))).select("id", "label", "kind")


@query(
    "etl11_authorship_edges",
    "WITH p AS (SELECT 'file' || l_partkey AS file, 'person' || l_suppkey AS author, count(*) AS n, min(l_shipdate) AS a FROM lineitem GROUP BY 1, 2) "
    "SELECT author AS source, file AS target, 'owns' AS relation, cast(n AS DOUBLE) AS weight FROM p UNION ALL SELECT file, arg_min(author, struct_pack(a := epoch_us(a) // 1000, b := author)), 'created_by', 1.0 FROM p GROUP BY 1",
)
def _(spark, d):
    rows = load(spark, d, "lineitem").select(F.concat(F.lit("file"), F.col("l_partkey").cast("string")).alias("file"), F.concat(F.lit("person"), F.col("l_suppkey").cast("string")).alias("author"), epoch_ms("l_shipdate").alias("ts"))
    return AC.authorship_edges(rows)


@query("src16_stale_files", "SELECT count(*) AS stale FROM documents WHERE doc_id * 1000 > 300000")
def _(spark, d):
    return AC.stale_files(load(spark, d, "documents").select((F.col("doc_id") * 1000).alias("modified")), 300_000)


@query(
    "agg18_org_report",
    "WITH e AS (SELECT * FROM edges WHERE relation IN ('contributes_to', 'works_in', 'owns', 'depends_on')), c AS (SELECT id, cast(sum(o) AS BIGINT) AS n_out, cast(sum(i) AS BIGINT) AS n_in FROM (SELECT source AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) x GROUP BY 1) "
    "SELECT n.id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, n_out IS NOT NULL AS linked FROM nodes n LEFT JOIN c USING (id) WHERE n.type IN ('person', 'folder')",
    "nodes", "edges",
)
def _(spark, d):
    nodes, edges = _t(spark, d, "nodes", "edges")
    return AC.org_report(nodes.filter("type IN ('person', 'folder')"), edges)


@query(
    "gr17_commit_keywords",
    "WITH r AS (SELECT doc_id AS seq, lower(text) AS s FROM documents ORDER BY doc_id DESC LIMIT 60), w AS (SELECT unnest(['the', 'tion', 'zzzz', 'ableth', 'eaen', 'ingre']) AS word), "
    "h AS (SELECT seq, word FROM r JOIN w ON contains(s, word)), u AS (SELECT word FROM h GROUP BY 1 HAVING count(*) * 2 <= (SELECT count(*) FROM r)) "
    "SELECT seq, count(*) AS hits FROM h WHERE word IN (SELECT word FROM u) GROUP BY 1 ORDER BY hits DESC, seq DESC LIMIT 5",
)
def _(spark, d):
    commits = load(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("subject"))
    return AC.commit_keywords(["the", "tion", "zzzz", "ableth", "eaen", "ingre"], commits)


@query(
    "gr16_provenance_confidence",
    "SELECT p_partkey AS id, cast(round(0.2 * (p_size % 2) + 0.25 * (p_partkey % 2) + 0.2 * (p_partkey % 3 = 0)::int + 0.15 * (p_size % 5 = 0)::int + 0.1 * (p_partkey % 7 = 0)::int + 0.1, 2) AS DOUBLE) AS confidence FROM part",
)
def _(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = load(spark, d, "part").select(
        k.alias("id"), (s % 2 == 1).alias("content"), (k % 2 == 1).alias("who"), (k % 3 == 0).alias("files"), (s % 5 == 0).alias("commits"), (k % 7 == 0).alias("conversation"), F.lit(True).alias("related")
    )
    return AC.provenance_confidence(rows).select("id", "confidence")


@query("gr12_merge_first", "SELECT source, target, relation, weight FROM imports UNION ALL SELECT source, target, min(relation), 9.0 FROM edges WHERE relation = 'generated' AND (source, target) NOT IN (SELECT (source, target) FROM imports) GROUP BY 1, 2", "imports", "edges")
def _(spark, d):
    imports, edges = _t(spark, d, "imports", "edges")
    return AC.merge_first(imports, edges.filter("relation = 'generated'").withColumn("weight", F.lit(9.0)), ["source", "target", "relation"], item_tasks(spark, d))
