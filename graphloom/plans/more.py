"""Registered queries: search, graph, indexing, merging and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import aggregates as A
from graphloom.operators import etl as E
from graphloom.operators import graph as G
from graphloom.operators import joins as J
from graphloom.operators import journal as JR
from graphloom.operators import merge as M
from graphloom.operators import reports as R
from graphloom.operators import search as S
from graphloom.plans.canonical import DAY_MS, item_tasks, load
from graphloom.plans.queries import AS_OF, JOURNAL_AS_OF, _t, query

QUESTION = "where is the code for standard brushed part files"

# ---- search

FIRST, SECOND = S.INTENTS


@query(
    "sch1_classify",
    "SELECT item_id, CASE WHEN regexp_matches(lower(text), '{a}') THEN 0.2 WHEN regexp_matches(lower(text), '{b}') THEN 0.4 ELSE 0.35 END AS fts, "
    "CASE WHEN regexp_matches(lower(text), '{a}') THEN 0.6 ELSE 0.15 END AS graph FROM benchmark".format(a=FIRST[0], b=SECOND[0]),
)
def _(spark, d):
    rows = load(spark, d, "benchmark").withColumn("w", S.classify(F.col("text")))
    return rows.select("item_id", "w.fts", "w.graph")


TOKENS_SQL = "list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_\\-.]+'), lambda t: length(t) > 2)"


@query("sch2_tokens", f"SELECT item_id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM benchmark")
def _(spark, d):
    return load(spark, d, "benchmark").select("item_id", F.array_join(S.tokens(F.col("text")), " ").alias("tokens"))


def _fts(words: list[str], limit: int | None, n: int) -> str:
    hit = " OR ".join(f"lower(content) LIKE '%{w}%'" for w in words)
    held = " + ".join(f"cast(contains(lower(content), '{w}') as int)" for w in words)
    some = f"SELECT * FROM chunks WHERE {hit}" + (f" ORDER BY id LIMIT {limit}" if limit else "")
    return f"SELECT id AS key, round(({held}) / (1 + ln(length(content)) / 10), 9) AS score FROM ({some}) c ORDER BY score DESC, key LIMIT {n}"


WORDS = "the thing ation_er"


@query("sch3_keyword_search", _fts(["the", "thing", "ation_er"], 50, 20), "chunks")
def _(spark, d):
    return S.keyword_search(load(spark, d, "chunks"), WORDS, 20).select("key", "score")


@query("sch3_keyword_search_all", _fts(["the", "thing", "ation_er"], None, 20), "chunks")
def _(spark, d):
    return S.keyword_search(load(spark, d, "chunks"), WORDS, 20, candidates=None).select("key", "score")


COSINE_SQL = (
    "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), "
    "sem AS (SELECT chunk_id AS key, round(list_sum(list_transform(list_zip(vector, q), lambda p: cast(p[1] as double) * p[2])) / (sqrt(list_sum(list_transform(vector, lambda x: cast(x as double) * x))) * sqrt(list_sum(list_transform(q, lambda x: cast(x as double) * x)))), 5) AS score FROM vectors, q)"
)


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return load(spark, d, "embeddings").filter("vec_id = 3").select("embedding").first()[0]


@query("sch4_semantic_search", f"WITH {COSINE_SQL} SELECT key, score FROM sem WHERE score > 0.25 ORDER BY score DESC, key LIMIT 10", "vectors")
def _(spark, d):
    found = S.semantic_search(*_t(spark, d, "chunks", "vectors"), _query_vector(spark, d), 10)
    return found.select("key", F.round("score", 5).alias("score"))


GRAPH_ARM = (
    "t AS (SELECT unnest(['brushed', 'nation::1', 'egypt']) AS token), "
    "dir AS (SELECT DISTINCT id FROM (SELECT n.id, row_number() OVER (PARTITION BY token ORDER BY n.id) AS k FROM nodes n JOIN t ON contains(lower(n.label), token) OR contains(lower(n.id), token)) x WHERE k <= 10), "
    "nb AS (SELECT target AS id FROM edges WHERE source IN (SELECT id FROM dir) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM dir)), "
    "garm AS (SELECT n.id AS key, max(s) AS score FROM (SELECT id, 1.0 AS s FROM dir UNION ALL SELECT id, 0.7 FROM nb) a JOIN nodes n USING (id) WHERE content IS NOT NULL GROUP BY 1)"
)


@query("sch5_graph_search", f"WITH {GRAPH_ARM} SELECT key, cast(score as double) AS score FROM garm ORDER BY score DESC, key LIMIT 15", "nodes", "edges")
def _(spark, d):
    return S.graph_search(*_t(spark, d, "nodes", "edges"), ["brushed", "nation::1", "egypt"], 15).select("key", "score")


@query(
    "sch6_file_search",
    "SELECT 'chunk::' || file_path AS key, round(1.0 / (1 + ln(len(string_split(file_path, '/')))), 9) AS score FROM (SELECT DISTINCT file_path FROM chunks) c "
    "WHERE list_contains(string_split(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]+$', ''), '_'), '117') ORDER BY score DESC, key LIMIT 8",
    "chunks",
)
def _(spark, d):
    return S.file_search(load(spark, d, "chunks"), "find 117").select("key", "score")


@query("sch8_recency", f"SELECT id, round(CASE WHEN {AS_OF} - updated_at < 0 THEN 1.0 ELSE greatest(0.5, 1 / (1 + ({AS_OF} - updated_at) / 2592000000.0)) END, 6) AS boost FROM nodes WHERE type IN ('person', 'document')", "nodes")
def _(spark, d):
    return load(spark, d, "nodes").filter("type IN ('person', 'document')").select("id", F.round(S.recency(F.col("updated_at"), AS_OF), 6).alias("boost"))


@query(
    "sch7_fuse",
    f"WITH fts AS ({_fts(['the', 'thing', 'ation_er'], 50, 10)}), {COSINE_SQL}, s AS (SELECT key, score FROM sem WHERE score > 0.25 ORDER BY score DESC, key LIMIT 10), "
    "arms AS (SELECT 0 AS arm, key, score / max(score) OVER () * 0.35 AS b FROM fts UNION ALL SELECT 1, key, score / max(score) OVER () * 0.35 FROM s), "
    f"w AS (SELECT arm, key, b * CASE WHEN {AS_OF} - c.updated_at < 0 THEN 1.0 ELSE greatest(0.5, 1 / (1 + ({AS_OF} - c.updated_at) / 2592000000.0)) END AS b FROM arms JOIN chunks c ON c.id = key) "
    "SELECT key, round(sum(b), 4) AS score FROM w GROUP BY 1",
    "vectors", "chunks",
)
def _(spark, d):
    chunks, vectors = _t(spark, d, "chunks", "vectors")
    arms = {"fts": S.keyword_search(chunks, WORDS, 10), "semantic": S.semantic_search(chunks, vectors, _query_vector(spark, d), 10)}
    return S.fuse(arms, S.DEFAULT_INTENT, AS_OF, 50).select("key", F.round("score", 4).alias("score"))


#: All arms of the flagship's question. File names are doc_<number>.md, which none of
#: its words or stems names, so the file arm gives nothing.
RETRIEVE_SQL = (
    f"WITH t AS (SELECT unnest({[w for w in S.tokenize(QUESTION)]!r}) AS token), "
    f"fts AS ({_fts([w for w in S.tokenize(QUESTION)], 50, 8)}), {COSINE_SQL.replace(', 5) AS score', ', 9) AS score')}, s AS (SELECT key, score FROM sem WHERE score > 0.25 ORDER BY score DESC, key LIMIT 8), "
    + GRAPH_ARM.split("AS token), ", 1)[1] + ", g AS (SELECT key, score FROM garm ORDER BY score DESC, key LIMIT 8), "
    "arms AS (SELECT 'fts' AS source, key, score / max(score) OVER () * 0.4 AS b FROM fts UNION ALL SELECT 'semantic', key, score / max(score) OVER () * 0.15 FROM s UNION ALL SELECT 'graph', key, score / max(score) OVER () * 0.15 FROM g), "
    "p AS (SELECT id AS key, node_id, file_path, updated_at FROM chunks UNION ALL SELECT id, id, source_file, updated_at FROM nodes), "
    f"w AS (SELECT source, arms.key, node_id, file_path, updated_at, cast(b as double) * CASE WHEN {AS_OF} - updated_at < 0 THEN 1.0 ELSE greatest(0.5, 1 / (1 + ({AS_OF} - updated_at) / 2592000000.0)) END AS b FROM arms JOIN p USING (key)) "
    "SELECT key, any_value(node_id) AS node_id, any_value(file_path) AS file_path, any_value(updated_at) AS updated_at, round(sum(b), 6) AS score, arg_max(source, b) AS source FROM w GROUP BY 1 ORDER BY score DESC, key LIMIT 8"
)


@query("sch9_retrieve", RETRIEVE_SQL, "nodes", "edges", "chunks", "vectors")
def retrieve(spark, d):
    """The flagship: all four arms and their fusion for one question."""
    nodes, edges, chunks, vectors = _t(spark, d, "nodes", "edges", "chunks", "vectors")
    return S.retrieve(nodes, edges, chunks, vectors, QUESTION, _query_vector(spark, d), AS_OF, 8).drop("content")


@query(
    "sch10_context_blocks",
    f"WITH f AS ({_fts(['the', 'thing', 'ation_er'], None, 20)}), r AS (SELECT row_number() OVER (ORDER BY f.score DESC, f.key) AS rank, content FROM f JOIN chunks c ON c.id = f.key), "
    "t AS (SELECT rank, sum(length(content)) OVER (ORDER BY rank) AS total FROM r) "
    "SELECT rank, cast(total as bigint) AS total FROM t WHERE rank < coalesce((SELECT min(rank) FROM t WHERE total > 6000), 1000000000)",
    "chunks",
)
def _(spark, d):
    found = S.keyword_search(load(spark, d, "chunks"), WORDS, 20, candidates=None)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long"))
    return S.context_blocks(ranked).select("rank", "total")


@query(
    "sch11_rank_fusion",
    "WITH a AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), b AS (SELECT o_custkey AS key, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey), "
    "u AS (SELECT 0 AS list, * FROM a WHERE rank <= 200 UNION ALL SELECT 1, * FROM b WHERE rank <= 200) "
    "SELECT key, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY 1 ORDER BY score DESC, min(struct_pack(l := list, r := rank)) LIMIT 30",
)
def _(spark, d):
    customer, orders = _t(spark, d, "customer", "orders")

    def top(rows: DataFrame, key: str, by) -> DataFrame:
        best = rows.select(F.col(key).alias("key"), by.alias("v")).orderBy(F.desc("v"), "key").limit(200)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("v"), "key")))

    spent = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return S.rank_fusion([top(customer, "c_custkey", F.col("c_acctbal")), top(spent, "o_custkey", F.col("total"))], 30)


@query("sch12_boost_active", "SELECT id AS key, file_path, cast(CASE WHEN file_path = 'src3/en/doc_23.md' THEN 1.25 ELSE 1.0 END AS DOUBLE) AS score FROM chunks", "chunks")
def _(spark, d):
    rows = load(spark, d, "chunks").select(F.col("id").alias("key"), "file_path", F.lit(1.0).alias("score"))
    return S.boost_active(rows, "src3/en/doc_23.md")


@query(
    "sch15_normalized",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)) / greatest(list_sum(list_transform(embedding, lambda x: cast(x as double) * x)), 1e-30), 6) AS size FROM embeddings",
)
def _(spark, d):
    rows = load(spark, d, "embeddings").select("vec_id", S.normalized(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("size"))


# ---- graph

IMPORTS = "imports"
START, TARGET = "part::1999", "part::3"


@query("gr2_dependencies", f"WITH RECURSIVE r AS (SELECT target AS id FROM imports WHERE source = '{START}' UNION SELECT i.target FROM imports i JOIN r ON i.source = r.id) SELECT id FROM r", IMPORTS, recursive=True)
def _(spark, d):
    return G.dependencies(load(spark, d, "imports"), START)


@query("gr3_dependents", f"WITH RECURSIVE r AS (SELECT source AS id FROM imports WHERE target = '{TARGET}' UNION SELECT i.source FROM imports i JOIN r ON i.target = r.id) SELECT id FROM r", IMPORTS, recursive=True)
def _(spark, d):
    return G.dependents(load(spark, d, "imports"), TARGET)


@query(
    "gr5_removal_impact",
    f"WITH RECURSIVE r AS (SELECT source AS id FROM imports WHERE target = '{TARGET}' UNION SELECT i.source FROM imports i JOIN r ON i.target = r.id), n AS (SELECT count(*) AS a FROM r), x AS (SELECT count(DISTINCT source) AS direct FROM imports WHERE target = '{TARGET}') "
    f"SELECT '{TARGET}' AS id, direct, a - direct AS indirect, a AS affected, round(CASE WHEN a = 0 THEN 0.0 ELSE least(1.0, 0.15 + 0.4 * log10(a)) END, 6) AS risk, CASE WHEN a = 0 THEN 'low' WHEN a <= 8 THEN 'MODERATE' ELSE 'HIGH' END AS grade FROM n, x",
    IMPORTS, recursive=True,
)
def _(spark, d):
    return G.removal_impact(load(spark, d, "imports"), TARGET)


@query(
    "gr1_shortest_paths",
    f"WITH RECURSIVE r AS (SELECT '{START}' AS id, cast(0 as double) AS distance UNION SELECT i.target, r.distance + i.weight FROM imports i JOIN r ON i.source = r.id) SELECT id, min(distance) AS distance FROM r GROUP BY 1",
    IMPORTS, recursive=True,
)
def _(spark, d):
    return G.shortest_paths(load(spark, d, "imports"), START).select("id", "distance")


@query(
    "gr1_shortest_path",
    f"WITH RECURSIVE r AS (SELECT '{START}' AS id, cast(0 as double) AS distance UNION SELECT i.target, r.distance + i.weight FROM imports i JOIN r ON i.source = r.id), dist AS (SELECT id, min(distance) AS distance FROM r GROUP BY 1), "
    "prev AS (SELECT t.id, min(i.source) AS before FROM dist t JOIN imports i ON i.target = t.id JOIN dist s ON s.id = i.source WHERE s.distance + i.weight = t.distance GROUP BY 1), "
    "path AS (SELECT id, 0 AS back FROM (SELECT id FROM dist ORDER BY distance DESC, id LIMIT 1) x UNION ALL SELECT prev.before, path.back + 1 FROM path JOIN prev ON prev.id = path.id) "
    "SELECT cast((SELECT max(back) FROM path) - back AS INT) AS position, id, distance FROM path JOIN dist USING (id)",
    IMPORTS, recursive=True,
)
def _(spark, d):
    imports = load(spark, d, "imports")
    far = G.shortest_paths(imports, START).orderBy(F.desc("distance"), "id").first()
    return G.shortest_path(imports, START, far.id)


TOPO_SQL = "topo AS (SELECT id, max(depth) AS depth FROM (SELECT id, 0 AS depth FROM nodes WHERE type = 'file' UNION ALL SELECT * FROM lp) x GROUP BY 1)"
LONGEST_SQL = "lp AS (SELECT source AS id, 1 AS depth FROM imports UNION SELECT i.source, lp.depth + 1 FROM imports i JOIN lp ON i.target = lp.id)"


@query("gr4_topological", f"WITH RECURSIVE {LONGEST_SQL}, {TOPO_SQL} SELECT * FROM topo", "imports", "nodes", recursive=True)
def _(spark, d):
    nodes, imports = _t(spark, d, "nodes", "imports")
    return G.topological(imports, nodes.filter("type = 'file'"))


@query("agg17_depth_histogram", f"WITH RECURSIVE {LONGEST_SQL}, {TOPO_SQL} SELECT depth, count(*) AS n FROM topo GROUP BY 1", "imports", "nodes", recursive=True)
def _(spark, d):
    nodes, imports = _t(spark, d, "nodes", "imports")
    return A.depth_histogram(G.topological(imports, nodes.filter("type = 'file'")))


@query(
    "gr14_layers",
    f"WITH RECURSIVE {LONGEST_SQL}, {TOPO_SQL} SELECT id, cast((row_number() OVER (PARTITION BY depth ORDER BY id) - 1) * 180.0 as double) AS x, cast(depth * 130.0 as double) AS y FROM topo",
    "imports", "nodes", recursive=True,
)
def _(spark, d):
    nodes, imports = _t(spark, d, "nodes", "imports")
    return G.layers(G.topological(imports, nodes.filter("type = 'file'")))


# sales between nations, a small dense graph with cycles
TRADE_SQL = "trade AS (SELECT DISTINCT 'nation::' || s_nationkey AS source, 'nation::' || c_nationkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"


def trade(spark: SparkSession, d: str) -> DataFrame:
    lineitem, orders, customer, supplier = _t(spark, d, "lineitem", "orders", "customer", "supplier")
    rows = lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    end = lambda c, a: F.concat(F.lit("nation::"), F.col(c).cast("string")).alias(a)
    return rows.select(end("s_nationkey", "source"), end("c_nationkey", "target")).distinct()


@query(
    "gr6_cycles",
    f"WITH {TRADE_SQL} SELECT 1 AS length, source AS cycle FROM trade WHERE source = target UNION ALL SELECT 2, a.source || '>' || a.target FROM trade a JOIN trade b ON a.target = b.source AND b.target = a.source WHERE a.source < a.target "
    "UNION ALL SELECT 3, a.source || '>' || a.target || '>' || b.target FROM trade a JOIN trade b ON a.target = b.source JOIN trade c ON b.target = c.source AND c.target = a.source WHERE a.source < a.target AND a.source < b.target AND a.target <> b.target",
)
def _(spark, d):
    return G.cycles(trade(spark, d), 3)


@query(
    "gr22_cycles_whole",
    f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT [source] AS path, target AS tip FROM trade WHERE target >= source "
    "UNION ALL SELECT list_append(path, tip), target FROM walk JOIN trade ON source = tip WHERE tip > path[1] AND NOT list_contains(path, tip) AND len(path) < 5 AND target >= path[1]) "
    "SELECT cast(len(path) as int) AS length, array_to_string(path, '>') AS cycle FROM walk WHERE tip = path[1]",
)
def _(spark, d):
    """All cycles up to the operator's own length."""
    return G.cycles(trade(spark, d))


COMPONENTS_SQL = (
    "e2 AS (SELECT source, target FROM imports WHERE relation = 'imports' UNION SELECT target, source FROM imports WHERE relation = 'imports'), "
    "rr AS (SELECT id, id AS other FROM nodes WHERE type = 'file' UNION SELECT rr.id, e2.target FROM rr JOIN e2 ON rr.other = e2.source), comp AS (SELECT id, min(other) AS component FROM rr GROUP BY 1)"
)


@query("gr7_components", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT id, component FROM comp", "imports", "nodes", recursive=True)
def _(spark, d):
    nodes, imports = _t(spark, d, "nodes", "imports")
    return G.components(nodes.filter("type = 'file'"), imports.filter("relation = 'imports'"))


@query(
    "gr9_communities",
    f"WITH RECURSIVE {COMPONENTS_SQL} SELECT c.component, c.members, coalesce(i.n, 0) AS internal_edges, round(coalesce(i.n, 0) / (c.members - 1), 6) AS cohesion FROM (SELECT component, count(*) AS members FROM comp GROUP BY 1 HAVING count(*) > 1) c "
    "LEFT JOIN (SELECT component, count(*) AS n FROM (SELECT DISTINCT least(source, target) AS id, greatest(source, target) AS other FROM e2) p JOIN comp USING (id) GROUP BY 1) i USING (component)",
    "imports", "nodes", recursive=True,
)
def _(spark, d):
    nodes, imports = _t(spark, d, "nodes", "imports")
    return G.communities(nodes.filter("type = 'file'"), imports.filter("relation = 'imports'"))


EGO_SQL = "h1 AS (SELECT target AS id FROM b WHERE source = 'nation::3'), h2 AS (SELECT target AS id FROM b WHERE source IN (SELECT id FROM h1)), dist AS (SELECT id, min(k) AS distance FROM (SELECT 'nation::3' AS id, 0 AS k UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) x GROUP BY 1)"
BOTH_SQL = "b AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges)"


@query("gr10_ego", f"WITH {BOTH_SQL}, {EGO_SQL} SELECT id, label, type, distance FROM dist JOIN nodes USING (id)", "nodes", "edges")
def _(spark, d):
    return G.ego(*_t(spark, d, "nodes", "edges"), "nation::3", 2)


@query(
    "gr11_trace",
    "SELECT e.target AS neighbor, n.label AS neighbor_label, relation, 'depends_on' AS direction FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'customer::7' "
    "UNION ALL SELECT e.source, n.label, relation, 'depended_by' FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'customer::7'",
    "nodes", "edges",
)
def _(spark, d):
    return G.trace(*_t(spark, d, "nodes", "edges"), "customer::7")


@query(
    "gr15_two_paths",
    "WITH e AS (SELECT DISTINCT target AS middle, source AS x FROM edges WHERE relation IN ('owns', 'generated') AND source <> target UNION SELECT source, target FROM edges WHERE relation IN ('owns', 'generated') AND source <> target) "
    "SELECT middle, cast(count(*) * (count(*) - 1) / 2 as bigint) AS paths FROM e GROUP BY 1 HAVING count(*) > 1",
    "edges",
)
def _(spark, d):
    return G.two_paths(load(spark, d, "edges"), ["owns", "generated"])


# The same iteration in SQL: the matrix of second moments as a list of rows, axes as lists.
AXES_SQL = (
    "x AS (SELECT chunk_id, list_transform(vector, lambda a: cast(a AS DOUBLE)) AS x FROM vectors), w AS (SELECT count(*) AS n, len(any_value(x)) AS w FROM x), "
    "u AS (SELECT chunk_id, unnest(x) AS a, unnest(range(1, w + 1)) AS i FROM x, w), mu AS (SELECT i, avg(a) AS m FROM u GROUP BY 1), "
    "c AS (SELECT u.chunk_id, u.i, a - m AS a FROM u JOIN mu USING (i)), s AS (SELECT p.i, q.i AS j, sum(p.a * q.a) AS s FROM c p JOIN c q USING (chunk_id) GROUP BY 1, 2), "
    "m AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS r FROM s GROUP BY 1) y), "
    "a1 AS (SELECT 0 AS t, list_transform(range(w), lambda i: 1 / sqrt(w)) AS v FROM w UNION ALL SELECT t + 1, list_transform(z, lambda e: e / sqrt(list_dot_product(z, z))) FROM (SELECT t, list_transform(m, lambda r: list_dot_product(r, v)) AS z FROM a1, m WHERE t < 25) y), "
    "f AS (SELECT v AS f FROM a1 WHERE t = 25), "
    "a2 AS (SELECT 0 AS t, list_transform(range(w), lambda i: CASE WHEN i % 2 = 1 THEN -1 ELSE 1 END / sqrt(w)) AS v FROM w UNION ALL SELECT t + 1, list_transform(z, lambda e: e / sqrt(list_dot_product(z, z))) "
    "FROM (SELECT t, list_transform(m, lambda r: list_dot_product(r, d)) AS z FROM (SELECT t, list_transform(list_zip(v, f), lambda e: e[1] - list_dot_product(v, f) * e[2]) AS d FROM a2, f WHERE t < 25) y, m) y), "
    "p AS (SELECT chunk_id, list_dot_product(x, f) AS a, list_dot_product(x, v) AS b FROM x, f, a2 WHERE t = 25)"
)


@query("gr18_principal_axes", f"WITH RECURSIVE {AXES_SQL} SELECT chunk_id, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 6) AS x, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 6) AS y FROM p", "vectors", recursive=True)
def _(spark, d):
    return G.principal_axes(load(spark, d, "vectors")).select("chunk_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "gr19_groups",
    "SELECT string_split(source_file, '/')[1] AS \"group\", type, count(*) AS n FROM nodes WHERE source_file IS NOT NULL GROUP BY 1, 2",
    "nodes",
)
def _(spark, d):
    rows = load(spark, d, "nodes").filter("source_file is not null")
    return rows.groupBy(F.get(F.split("source_file", "/"), 0).alias("group"), "type").agg(F.count(F.lit(1)).alias("n"))


# ---- indexing


@query(
    "etl1_chunked",
    "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), k AS (SELECT doc_id, lines, unnest(range(0, cast(floor((len(lines) - 1) / 8) as bigint) + 1)) * 8 AS s FROM l), "
    "c AS (SELECT doc_id, s, len(lines) AS n, array_to_string(list_slice(lines, s + 1, s + 10), chr(10)) AS content FROM k) "
    "SELECT doc_id, s + 1 AS start_line, least(s + 10, n) AS end_line, md5(content) AS content_md5 FROM c WHERE trim(replace(replace(content, chr(10), ''), chr(9), '')) <> ''",
)
def _(spark, d):
    files = load(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return E.chunked(files, 10, 2, 1_000_000).select(F.col("path").alias("doc_id"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("content_md5"))


@query("etl2_changed_files", "SELECT doc_id AS path, sha1(text) AS content_hash FROM documents WHERE length(text) > 0 AND NOT (lang = 'en' AND doc_id % 2 = 0)")
def _(spark, d):
    docs = load(spark, d, "documents")
    files = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    known = docs.filter("lang = 'en' AND doc_id % 2 = 0").select(F.col("doc_id").alias("path"), F.sha1("text").alias("content_hash"))
    return E.changed_files(files, known)


@query(
    "etl3_folder_chain",
    "WITH p AS (SELECT source AS a, source || '/' || lang AS b, source || '/' || lang || '/doc_' || doc_id || '.md' AS f FROM documents) "
    "SELECT DISTINCT 'folder::' || a AS source, 'folder::' || b AS target FROM p UNION ALL SELECT 'folder::' || b, 'file::' || f FROM p",
)
def _(spark, d):
    return E.folder_chain(load(spark, d, "chunks").select(F.col("file_path").alias("path")))


MARKDOWN_SQL = "md AS (SELECT n_nationkey AS k, 'docs/' || n_nationkey || '.md' AS path FROM nation)"


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Small files with every construct, one for each nation."""
    n = load(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    text = F.concat(
        F.lit("# Use nation "), "k", F.lit("\n\n## Status\n\nAccepted\n\n## Context\n\nNation "), "k", F.lit(" grows.\n\n## Decision\n\nWe trade.\n\n## Consequences\n\n- more ships\n- fewer carts\n\n"),
        F.lit("- [ ] open task "), "k", F.lit("\n- [x] done task\n  - [/] half task\n## Status\n"),
    )
    return n.select(F.concat(F.lit("docs/"), "k", F.lit(".md")).alias("path"), text.alias("content"))


@query(
    "etl4_headings",
    f"WITH {MARKDOWN_SQL}, h AS (SELECT path, k, unnest(['Use nation ' || k, 'Status', 'Context', 'Decision', 'Consequences']) AS title, unnest([1, 2, 2, 2, 2]) AS level, unnest([1, 23, 7, 11, 15]) AS line FROM md) "
    "SELECT 'heading::' || path || ':' || left(sha1(title), 8) AS id, path, level, title, line FROM h",
)
def _(spark, d):
    return E.headings(markdown(spark, d))


@query(
    "src10_checkbox_items",
    f"WITH {MARKDOWN_SQL}, t AS (SELECT path, unnest(['open task ' || k, 'done task', 'half task']) AS title, unnest(['todo', 'done', 'in_progress']) AS status, unnest([20, 21, 22]) AS line FROM md) "
    "SELECT 'task::' || md5(path || ':' || title) AS id, path, line, status, title FROM t",
)
def _(spark, d):
    return E.checkbox_items(markdown(spark, d))


@query("src11_decision_records", f"WITH {MARKDOWN_SQL} SELECT path, 'Use nation ' || k AS title, 'accepted' AS status, 'Nation ' || k || ' grows.' AS context, 'We trade.' AS decision, 'more ships,fewer carts,[ ] open task ' || k || ',[x] done task' AS consequences FROM md")
def _(spark, d):
    return E.decision_records(markdown(spark, d)).withColumn("consequences", F.array_join("consequences", ","))


def modules(spark: SparkSession, d: str) -> DataFrame:
    """A module for each part, which imports the part before it and one that is missing."""
    p = load(spark, d, "part").select("p_partkey")
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("import { x } from './m"), (k - 1).cast("string"), F.lit("';\nconst y = require(\"../src/gone"), k.cast("string"), F.lit("\");\nexport class Part"), k.cast("string"),
        F.lit(" {\n}\nexport function _hidden() {\n}\nasync function load"), k.cast("string"), F.lit("() {\n  return 1;\n}\n"),
    )
    return p.select(F.concat(F.lit("src/m"), k.cast("string"), F.lit(".ts")).alias("path"), text.alias("content"), k.alias("k"))


@query("etl5_symbols", "SELECT 'src/m' || p_partkey || '.ts' AS path, unnest(['class', 'function']) AS type, unnest(['Part' || p_partkey, 'load' || p_partkey]) AS name, unnest([3, 7]) AS line, unnest([4, 9]) AS end_line FROM part")
def _(spark, d):
    return E.symbols(modules(spark, d)).drop("content")


@query("etl7_specifiers", "SELECT 'src/m' || p_partkey || '.ts' AS path, unnest(['./m' || (p_partkey - 1), '../src/gone' || p_partkey]) AS spec, unnest([0, 1]) AS pos FROM part")
def _(spark, d):
    return E.specifiers(modules(spark, d))


@query("jn8_resolve_imports", "SELECT 'src/m' || p_partkey || '.ts' AS source, 'src/m' || (p_partkey - 1) || '.ts' AS target FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part)")
def _(spark, d):
    files = modules(spark, d)
    return J.resolve_imports(E.specifiers(files), files.select("path"))


@query(
    "jn9_resolve_symbols",
    "SELECT p_brand AS file, p_type AS label, 'even' AS preferred, arg_min(p_partkey, struct_pack(a := p_partkey % 2, b := p_partkey)) AS id FROM part GROUP BY 1, 2",
)
def _(spark, d):
    part = load(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd")
    symbols = part.select(F.col("p_brand").alias("file"), F.col("p_type").alias("label"), F.col("p_partkey").alias("id"), kind.alias("type"), F.col("p_partkey").alias("seq"))
    uses = symbols.select("file", "label", F.lit("even").alias("preferred")).distinct()
    return J.resolve_symbols(uses, symbols)


@query(
    "etl18_next_workers",
    "WITH m AS (SELECT s_suppkey AS id, s_suppkey * 100 AS elapsed_ms, s_suppkey % 7 + 1 AS workers, 6 AS most, 1 AS least, s_suppkey % 11 * 1.0 AS rate, s_suppkey % 9 * 1.0 AS before FROM supplier) "
    "SELECT id, cast(CASE WHEN elapsed_ms < 1000 THEN workers WHEN workers >= most THEN workers WHEN before <= 0 THEN workers + 1 WHEN rate / before >= 0.95 THEN workers + 1 WHEN rate / before < 0.7 AND workers > least THEN workers - 1 ELSE workers END as bigint) AS next FROM m",
)
def _(spark, d):
    k = F.col("s_suppkey")
    rows = load(spark, d, "supplier").select(k.alias("id"), (k * 100).alias("elapsed_ms"), (k % 7 + 1).alias("workers"), F.lit(6).alias("most"), F.lit(1).alias("least"), (k % 11).cast("double").alias("rate"), (k % 9).cast("double").alias("before"))
    return E.next_workers(rows).select("id", "next")


@query(
    "etl19_smoothed_rate",
    "WITH RECURSIVE o AS (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n, count(*) OVER (PARTITION BY session_id) AS c FROM (SELECT session_id, seq, cast(duration_ms as double) AS value FROM journal) j), "
    "r AS (SELECT session_id, n, c, value AS rate FROM o WHERE n = 1 UNION ALL SELECT o.session_id, o.n, o.c, 0.25 * o.value + 0.75 * r.rate FROM r JOIN o ON o.session_id = r.session_id AND o.n = r.n + 1) "
    "SELECT session_id, round(rate, 2) AS rate FROM r WHERE n = c",
    "journal", recursive=True,
)
def _(spark, d):
    rows = load(spark, d, "journal").select("session_id", "seq", F.col("duration_ms").cast("double").alias("value"))
    return E.smoothed_rate(rows, "session_id").select("session_id", F.round("rate", 2).alias("rate"))


# ---- merge and writers: the remote side is the local one, changed by rule


def _remote_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = load(spark, d, "nodes").filter("type IN ('person', 'folder', 'file')").select("id", "label", "type", "source_file", "content", "created_at", "updated_at")
    size = F.length("id")
    newer = {"label": F.concat(F.lit("r:"), "label"), "updated_at": F.col("updated_at") + (size % 3 - 1) * 1000, "created_at": F.col("created_at") + 7}
    return n, n.filter(size % 5 > 0).withColumns(newer)


@query(
    "mrg1_merge_nodes",
    "SELECT id, CASE WHEN r THEN 'r:' || label ELSE label END AS label, updated_at + CASE WHEN r THEN 1000 ELSE 0 END AS updated_at "
    "FROM (SELECT *, length(id) % 5 > 0 AND length(id) % 3 = 2 AS r FROM nodes WHERE type IN ('person', 'folder', 'file')) n",
    "nodes",
)
def _(spark, d):
    return M.merge_latest(*_remote_nodes(spark, d)).select("id", "label", "updated_at")


@query("mrg2_merge_edges", "SELECT source, target, relation, CASE WHEN weight > 3 THEN weight ELSE greatest(weight, cast(length(target) % 4 as double)) END AS weight FROM imports", "imports")
def _(spark, d):
    local = load(spark, d, "imports")
    return M.merge_edges(local, local.withColumn("weight", (F.length("target") % 4).cast("double")))


@query(
    "mrg4_merge_stats",
    "WITH l AS (SELECT id, updated_at, length(id) % 3 AS k FROM nodes) SELECT count(*) AS nodes, (SELECT count(*) FROM imports) AS edges, count(*) FILTER (WHERE k = 1) AS node_conflicts, cast(0 as bigint) AS edge_conflicts FROM l",
    "nodes", "imports",
)
def _(spark, d):
    nodes, imports = _t(spark, d, "nodes", "imports")
    k = F.length("id") % 3
    remote = nodes.filter(k > 0).withColumn("updated_at", F.col("updated_at") + F.when(k == 1, 5).otherwise(0))
    return M.merge_stats({"nodes": nodes, "edges": imports}, {"nodes": remote, "edges": imports.filter("relation = 'imports'")})


@query(
    "mrg5_normalize_remote",
    "SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_custkey ELSE c_name END AS label, CASE WHEN c_custkey % 3 = 0 THEN 'file' ELSE 'person' END AS type, "
    "CASE WHEN c_custkey % 5 = 0 THEN 99 ELSE 1700000000000 + c_custkey END AS updated_at FROM customer",
)
def _(spark, d):
    k = F.col("c_custkey")
    rows = load(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 4 != 0, F.col("c_name")).alias("label"), F.when(k % 3 == 0, "").otherwise("person").alias("type"),
        F.when(k % 5 != 0, (k + 1700000000000).cast("string")).alias("updated_at"),
    )
    return M.normalize_remote(rows, 99)


@query(
    "snk1_upsert_nodes",
    "SELECT 'person' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS label, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS content, c_custkey AS created_at FROM customer "
    "UNION ALL SELECT 'new' || n_nationkey, n_name, NULL, 5 FROM nation",
)
def _(spark, d):
    customer, nation = _t(spark, d, "customer", "nation")
    k = F.col("c_custkey")
    old = customer.select(F.concat(F.lit("person"), k.cast("string")).alias("id"), F.col("c_name").alias("label"), F.col("c_name").alias("content"), k.alias("created_at"))
    new = customer.filter(k % 2 == 0).select(F.concat(F.lit("person"), k.cast("string")).alias("id"), F.col("c_mktsegment").alias("label"), F.lit("").alias("content"), F.lit(5).cast("long").alias("created_at"))
    new = new.union(nation.select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")), "n_name", F.lit(""), F.lit(5).cast("long")))
    return M.upsert_nodes(old, new)


@query("snk2_add_edges", "SELECT source, target, relation, min(length(relation)) * 1.0 AS weight FROM edges WHERE (source, target, relation) NOT IN (SELECT (source, target, relation) FROM imports) GROUP BY 1, 2, 3", "edges", "imports")
def _(spark, d):
    edges, imports = _t(spark, d, "edges", "imports")
    new = edges.withColumns({"seq": F.col("weight"), "weight": F.length("relation").cast("double")})
    return M.add_edges(imports, new.select("source", "target", "relation", "weight", "seq"), item_tasks(spark, d)).select("source", "target", "relation", "weight")


@query(
    "snk2_stubs",
    "WITH x AS (SELECT DISTINCT source AS id FROM edges UNION SELECT target FROM edges) SELECT id, string_split(id, '::')[2] AS label, CASE string_split(id, '::')[1] WHEN 'person' THEN 'person' WHEN 'repo' THEN 'repo' ELSE 'file' END AS type FROM x WHERE string_split(id, '::')[1] <> 'part' OR id NOT IN (SELECT id FROM nodes WHERE type = 'file')",
    "nodes", "edges",
)
def _(spark, d):
    nodes, edges = _t(spark, d, "nodes", "edges")
    return M.stubs(nodes.filter("type = 'file'"), edges, item_tasks(spark, d))


@query(
    "snk6_delete_file",
    "WITH g AS (SELECT id FROM nodes WHERE source_file = (SELECT min(file_path) FROM chunks WHERE node_id = 'doc::5')) "
    "SELECT 'nodes' AS name, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE node_id NOT IN (SELECT id FROM g) "
    "UNION ALL SELECT 'vectors', count(*) FROM vectors WHERE chunk_id NOT IN (SELECT id FROM chunks WHERE node_id IN (SELECT id FROM g)) UNION ALL SELECT 'edges', count(*) FROM edges WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)",
    "nodes", "edges", "chunks", "vectors",
)
def _(spark, d):
    nodes, edges, chunks, vectors = _t(spark, d, "nodes", "edges", "chunks", "vectors")
    row = chunks.filter("node_id = 'doc::5'").select("file_path").first()
    return A.stats(**M.delete_file(nodes, edges, chunks, vectors, row[0]))


@query(
    "snk7_merge_databases",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'theirs' ELSE 'ours' END AS side FROM customer",
)
def _(spark, d):
    ids = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return M.merge_databases(ids.filter("id % 2 = 0 OR id % 3 > 0").withColumn("side", F.lit("ours")), ids.filter("id % 3 = 0").withColumn("side", F.lit("theirs")), ["id"], True)


@query(
    "snk13_message_nodes",
    "SELECT 'mesh::' || conv_id || '-' || turn AS id, CASE WHEN length(text) > 72 THEN substr(text, 1, 72) || '…' ELSE text END AS label, 'agent::' || role AS sender FROM conversations",
)
def _(spark, d):
    rows = load(spark, d, "conversations")
    return M.message_nodes(rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", F.col("role").alias("from")))


@query(
    "snk15_conversation_list",
    "SELECT conv_id, conv_id % 10 = 1 AS is_pinned, count(*) AS message_count FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1",
)
def _(spark, d):
    m = load(spark, d, "conversations")
    k = F.col("conv_id")
    conv = m.select("conv_id").distinct().withColumns({"is_archived": k % 7 == 0, "is_pinned": k % 10 == 1, "updated_at": k * 3})
    return M.conversation_list(conv, m).select("conv_id", "is_pinned", "message_count")


@query("snk15_fork_conversation", "SELECT cast(-1 as bigint) AS conv_id, turn, role, text FROM conversations WHERE conv_id = 3")
def _(spark, d):
    return M.fork_conversation(load(spark, d, "conversations"), 3, -1)


# ---- journal states and reports


@query("str3_idle_sessions", f"SELECT session_id, max(ts) AS last_active, {JOURNAL_AS_OF} - max(ts) > 1800000 AS ended FROM journal GROUP BY 1", "journal")
def _(spark, d):
    return JR.idle_sessions(load(spark, d, "journal"), JOURNAL_AS_OF)


@query(
    "str3_sessions_by_gap",
    "WITH g AS (SELECT session_id, ts, seq, coalesce(cast(ts - lag(ts) OVER w > 1800000 as int), 0) AS new FROM journal WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)), r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, seq) AS run FROM g) "
    "SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM r GROUP BY session_id, run",
    "journal",
)
def _(spark, d):
    return JR.sessions_by_gap(load(spark, d, "journal"))


@query("str7_sampled_calls", "SELECT session_id, tool, min(seq) AS seq FROM journal GROUP BY 1, 2", "journal")
def _(spark, d):
    return JR.sampled_calls(load(spark, d, "journal"))


@query("src8_journal_tail", "SELECT seq, tool, duration_ms FROM journal ORDER BY seq DESC LIMIT 100", "journal")
def _(spark, d):
    return JR.tail(load(spark, d, "journal")).select("seq", "tool", "duration_ms")


@query(
    "rpt2_digest",
    f"WITH c AS (SELECT * FROM nodes WHERE updated_at >= {AS_OF - 30 * DAY_MS} AND updated_at <= {AS_OF}), t AS (SELECT * FROM c ORDER BY updated_at DESC, id LIMIT 8), "
    "f AS (SELECT * FROM t ORDER BY updated_at DESC, substr(label, 1, 60) DESC, id DESC LIMIT 5), l AS (SELECT coalesce(string_agg(substr(label, 1, 60), ', ' ORDER BY updated_at DESC, substr(label, 1, 60) DESC, id DESC), '') AS labels FROM f) "
    "SELECT labels, (SELECT count(*) FROM c) AS changed, (SELECT count(DISTINCT type) FROM c) AS types, cast(ceil(length(labels) / 4.0) as bigint) AS tokens FROM l",
    "nodes",
)
def _(spark, d):
    return R.digest(load(spark, d, "nodes"), AS_OF, 8, 30 * DAY_MS)


@query("rpt3_briefing", f"SELECT id, updated_at, 'Updated ' || type || ' ''' || substr(label, 1, 50) || '''' AS line FROM nodes WHERE updated_at >= {AS_OF} ORDER BY updated_at DESC, id LIMIT 5", "nodes")
def _(spark, d):
    return R.briefing(load(spark, d, "nodes"), AS_OF)


@query("rpt1_envelope", "SELECT '{\"data\":{\"id\":\"' || id || '\",\"type\":\"' || type || '\"},\"source\":\"graph\",\"as_of\":1}' AS json FROM nodes WHERE type IN ('repo', 'workspace')", "nodes")
def _(spark, d):
    return R.envelope(load(spark, d, "nodes").filter("type IN ('repo', 'workspace')").select("id", "type"), "graph", 1)


@query(
    "rpt8_runtime_choice",
    "WITH c AS (SELECT s_suppkey AS id, s_suppkey AS pos, s_suppkey % 2 = 0 AS available, s_suppkey % 3 AS h, s_acctbal AS tps, s_suppkey % 100 AS success, s_suppkey % 5 = 0 AS capable FROM supplier), "
    "s AS (SELECT id, pos, cast(CASE WHEN available THEN 50 ELSE 0 END + CASE h WHEN 0 THEN 30 WHEN 1 THEN 15 ELSE 0 END + CASE WHEN success > 50 AND tps = (SELECT max(tps) FROM c WHERE success > 50) THEN 20 ELSE 0 END + CASE WHEN capable THEN 10 ELSE 0 END as int) AS score FROM c) "
    "SELECT id, pos, score FROM s ORDER BY score DESC, pos LIMIT 1",
)
def _(spark, d):
    k = F.col("s_suppkey")
    health = F.when(k % 3 == 0, "healthy").when(k % 3 == 1, "degraded").otherwise("down")
    return R.runtime_choice(load(spark, d, "supplier").select(k.alias("id"), k.alias("pos"), (k % 2 == 0).alias("available"), health.alias("health"), F.col("s_acctbal").alias("tps"), (k % 100).alias("success"), (k % 5 == 0).alias("capable")))


@query(
    "fn_labels_and_sizes",
    "SELECT p_partkey, regexp_extract(p, '[^/]*$') AS base, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN length(p_name) > 5 THEN substr(p_name, 1, 5) || '…' ELSE p_name END AS short, cast(ceil(length(p_name) / 4.0) as bigint) AS tokens, "
    "CASE WHEN p_partkey % 3000 < 60 THEN CASE WHEN p_partkey % 3000 < 1 THEN 'just now' ELSE (p_partkey % 3000) || 'm ago' END WHEN p_partkey % 3000 < 1440 THEN (p_partkey % 3000) // 60 || 'h ago' ELSE (p_partkey % 3000) // 1440 || 'd ago' END AS ago FROM (SELECT *, 'parts/' || p_brand || '/' || p_partkey || '.ts' AS p FROM part) x",
)
def _(spark, d):
    path = F.concat(F.lit("parts/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    ago = T.time_ago(F.lit(AS_OF) - (F.col("p_partkey") % 3000) * 60_000, AS_OF)
    return load(spark, d, "part").select("p_partkey", T.base_name(path).alias("base"), T.dir_name(path).alias("dir"), T.shortened(F.col("p_name"), 5).alias("short"), T.token_estimate(F.col("p_name")).alias("tokens"), ago.alias("ago"))

