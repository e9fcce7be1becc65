"""The engine's tables derived from the business tables.

One SQL text for each table serves both sides: Spark runs it over DataFrames, the
oracle puts it in front of its own statement as a common table expression. The
operators themselves are written twice, in Spark and in SQL.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2023-11-14 22:13:20 UTC in epoch milliseconds; updated_at counts hours from it.
BASE_MS = 1_700_000_000_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

_NODE = "cast(null as int) AS community, {base} + {key} * 3600000 AS created_at, {base} + {key} * 3600000 AS updated_at"


def _node(table: str, prefix: str, key: str, kind: str, label: str, path: str, content: str) -> str:
    stamp = _NODE.replace("{base}", str(BASE_MS)).replace("{key}", f"cast({key} as bigint)")
    return (
        f"SELECT '{prefix}::' || cast({key} as varchar(20)) AS id, {label} AS label, '{kind}' AS type, {path} AS source_file, "
        f"{content} AS content, {stamp} FROM {{{table}}}"
    )


_PATH = "source || '/' || lang || '/doc_' || cast(doc_id as varchar(20)) || '.md'"
_NONE = "cast(null as varchar(20))"

# the branches of the edges, and by what the line items of a branch are put together there
_ORDER, _PART = "'order::' || cast(l_orderkey as varchar(20))", "'part::' || cast(l_partkey as varchar(20))"
EDGES: list[tuple[str, list[str]]] = [
    ("SELECT 'region::' || cast(n_regionkey as varchar(20)) AS source, 'nation::' || cast(n_nationkey as varchar(20)) AS target, 'contains' AS relation, cast(1 as double) AS weight FROM {nation}", []),
    ("SELECT 'nation::' || cast(s_nationkey as varchar(20)), 'supplier::' || cast(s_suppkey as varchar(20)), 'contains', cast(1 as double) FROM {supplier}", []),
    ("SELECT 'customer::' || cast(c_custkey as varchar(20)), 'nation::' || cast(c_nationkey as varchar(20)), 'contributes_to', cast(1 as double) FROM {customer}", []),
    ("SELECT 'customer::' || cast(o_custkey as varchar(20)), 'order::' || cast(o_orderkey as varchar(20)), 'owns', o_totalprice FROM {orders}", []),
    (f"SELECT DISTINCT {_ORDER}, {_PART}, 'references', cast(1 as double) FROM {{lineitem}}", [_ORDER, _PART]),
    (f"SELECT 'supplier::' || cast(l_suppkey as varchar(20)), {_PART}, 'generated', cast(count(*) as double) FROM {{lineitem}} GROUP BY l_suppkey, l_partkey", ["l_suppkey", "l_partkey"]),
    ("SELECT source, target, relation, weight FROM {imports}", []),
]

SQL: dict[str, str] = {
    "nodes": " UNION ALL ".join(
        [
            _node("region", "region", "r_regionkey", "workspace", "r_name", _NONE, _NONE),
            _node("nation", "nation", "n_nationkey", "repo", "n_name", _NONE, "n_name"),
            _node("supplier", "supplier", "s_suppkey", "folder", "s_name", _NONE, _NONE),
            _node("part", "part", "p_partkey", "file", "p_name", "'parts/' || p_brand || '/' || cast(p_partkey as varchar(20)) || '.ts'", "p_type"),
            _node("customer", "customer", "c_custkey", "person", "c_name", _NONE, "c_mktsegment"),
            _node("orders", "order", "o_orderkey", "task", "'order ' || cast(o_orderkey as varchar(20))", _NONE, "o_orderpriority"),
            _node("documents", "doc", "doc_id", "document", "'doc ' || cast(doc_id as varchar(20))", _PATH, "text"),
        ]
    ),
    # chains of parts: a part imports the one before it of its brand and size,
    # and depends on the one before it of its type and size
    "imports": (
        "SELECT 'part::' || cast(p_partkey as varchar(20)) AS source, 'part::' || cast(before as varchar(20)) AS target, relation, "
        "cast(1 + pmod_(p_partkey, 5) as double) AS weight FROM ("
        "SELECT p_partkey, 'imports' AS relation, lag(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS before FROM {part} "
        "UNION ALL SELECT p_partkey, 'depends_on' AS relation, lag(p_partkey) OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) AS before FROM {part}"
        ") x WHERE before IS NOT NULL"
    ),
    "edges": " UNION ALL ".join(text for text, _ in EDGES),
    "chunks": (
        f"SELECT 'chunk::' || {_PATH} AS id, 'doc::' || cast(doc_id as varchar(20)) AS node_id, {_PATH} AS file_path, 1 AS start_line, "
        "cast(length(text) - length(replace(text, chr(10), '')) + 1 as int) AS end_line, text AS content, "
        f"{BASE_MS} + cast(doc_id as bigint) * {HOUR_MS} AS updated_at FROM {{documents}}"
    ),
    "vectors": "SELECT c.id AS chunk_id, e.embedding AS vector, e.vec_id, e.label FROM {embeddings} e JOIN {chunks} c ON c.node_id = 'doc::' || cast(e.vec_id as varchar(20))",
    "journal": (
        "SELECT event_id AS seq, epoch_ms_(ts) AS ts, 'tool_call' AS type, cast(user_id as varchar(20)) AS session_id, event_type AS tool, "
        "event_type <> 'error' AS ok, cast(floor(value) as bigint) AS duration_ms, props AS context FROM {events}"
    ),
}
_DIALECT = {
    "spark": {r"epoch_ms_\((\w+)\)": r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", r"pmod_\(([^,()]+), (\d+)\)": r"pmod(\1, \2)"},
    "duckdb": {r"epoch_ms_\((\w+)\)": r"cast(floor(epoch_us(\1) / 1000.0) as bigint)", r"pmod_\(([^,()]+), (\d+)\)": r"(\1 % \2)"},
}


def _text(name: str, dialect: str) -> str:
    text = SQL[name]
    for pattern, to in _DIALECT[dialect].items():
        text = re.sub(pattern, to, text)
    return text


#: Line items for each task that keeps rows by keys of their own, and the most tasks: up to 200
#: Spark writes a shuffle without holding rows.
ITEMS, TASKS = 300_000, 200


def item_tasks(spark: SparkSession, d: str) -> int | None:
    """Tasks for rows that are as many as the line items, None if a shuffle has enough."""
    tasks = min(TASKS, math.ceil(load(spark, d, "lineitem").count() / ITEMS))  # reads no column
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table, or a business table as it is. Only what a query selects
    is read: the projections are plain SQL that the optimizer prunes."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {i: load(spark, sf_dir, i) for i in dict.fromkeys(re.findall(r"\{(\w+)\}", SQL[name]))}
    tasks = item_tasks(spark, sf_dir) if name == "edges" else None
    if tasks is None:
        return spark.sql(_text(name, "spark"), **inputs)
    return reduce(DataFrame.union, [_branch(spark, text, keys, inputs, tasks) for text, keys in EDGES])


def _branch(spark: SparkSession, text: str, keys: list[str], inputs: dict[str, DataFrame], tasks: int) -> DataFrame:
    """A branch of the edges; its rows are dealt to tasks by what they are put together by,
    so they are kept where they arrive and not in as many tasks as a shuffle has."""
    own = {i: inputs[i] for i in re.findall(r"\{(\w+)\}", text)}
    if keys:
        own = {i: rows.repartition(tasks, *map(F.expr, keys)) for i, rows in own.items()}
    return spark.sql(text, **own)


def needs(name: str) -> list[str]:
    """Canonical tables that a canonical table reads, itself last."""
    found: list[str] = []
    for i in re.findall(r"\{(\w+)\}", SQL[name]):
        if i in SQL:
            found += [x for x in needs(i) if x not in found]
    return [*found, name]


def with_tables(statement: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text: the statement behind the canonical tables that it reads."""
    order = list(dict.fromkeys(x for n in names for x in needs(n)))
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', _text(n, 'duckdb'))})" for n in order]
    body = statement.strip()
    if not ctes:
        return body
    head = "WITH RECURSIVE " if recursive or body.upper().startswith("WITH RECURSIVE") else "WITH "
    match = re.match(r"WITH (RECURSIVE )?", body, re.I)
    return head + ", ".join(ctes) + (", " + body[match.end() :] if match else " " + body)
