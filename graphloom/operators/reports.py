"""Reports that agents and people read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.filters import changed_since

DAY_MS = 86_400_000


def digest(nodes: DataFrame, as_of: int, limit: int = 8, span_ms: int = DAY_MS) -> DataFrame:
    """One row: how many nodes changed in the span, the latest labels (60 characters
    of five of them) and the size of that text in tokens of four characters."""
    recent = nodes.filter((F.col("updated_at") >= as_of - span_ms) & (F.col("updated_at") <= as_of))
    latest = changed_since(recent, as_of - span_ms, limit)
    top = F.slice(F.sort_array(F.collect_list(F.struct("updated_at", F.substring("label", 1, 60).alias("label"), "id")), asc=False), 1, 5)
    text = F.array_join(F.transform(top, lambda x: x.label), ", ")
    counts = recent.agg(F.count(F.lit(1)).alias("changed"), F.count_distinct("type").alias("types"))
    return latest.agg(text.alias("labels")).join(F.broadcast(counts)).withColumn("tokens", F.ceil(F.length("labels") / 4).cast("long"))


def briefing(nodes: DataFrame, midnight: int, limit: int = 5) -> DataFrame:
    """The latest changes since midnight with a sentence for each."""
    rows = changed_since(nodes, midnight, limit)
    return rows.select("id", "updated_at", F.concat_ws(" ", F.lit("Updated"), "type", F.concat(F.lit("'"), F.substring("label", 1, 50), F.lit("'"))).alias("line"))


def envelope(rows: DataFrame, source: str, as_of: int, note: str | None = None) -> DataFrame:
    """Each row as JSON with its source and freshness."""
    data = F.struct(*[F.col(c) for c in rows.columns])
    return rows.select(F.to_json(F.struct(data.alias("data"), F.lit(source).alias("source"), F.lit(as_of).alias("as_of"), F.lit(note).alias("note"))).alias("json"))


def runtime_choice(candidates: DataFrame) -> DataFrame:
    """(id, score): 50 if available, 30 for good or 15 for fair health, 20 for the
    fastest with over 50 % success, 10 for the capability; the first of the
    fallback order (pos) wins a tie."""
    fastest = candidates.filter("success > 50").agg(F.max("tps").alias("best"))
    rows = candidates.join(F.broadcast(fastest))  # a single row
    score = (
        F.when(F.col("available"), 50).otherwise(0) + F.when(F.col("health") == "healthy", 30).when(F.col("health") == "degraded", 15).otherwise(0)
        + F.when((F.col("success") > 50) & (F.col("tps") == F.col("best")), 20).otherwise(0) + F.when(F.col("capable"), 10).otherwise(0)
    )
    return rows.select("id", "pos", score.alias("score")).orderBy(F.desc("score"), "pos").limit(1)


def workspace_context(tables: dict[str, DataFrame], workspace: str, team: str | None = None) -> DataFrame:
    """One row of sizes (nodes, edges, chunks) with the workspace, its team and
    whether there is anything in it."""
    counts = [tables[n].agg(F.count(F.lit(1)).alias(n)) for n in ("nodes", "edges", "chunks")]
    row = counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # single rows
    status = F.when(F.col("nodes") > 0, "ready").otherwise("empty")
    return row.select(F.lit(workspace).alias("workspace"), F.lit(team).cast("string").alias("team"), "nodes", "edges", "chunks", status.alias("status"))


def status_snapshot(journal: DataFrame, as_of: int, idle_ms: int = 1_800_000) -> DataFrame:
    """One row: sessions, those active within ``idle_ms``, tool calls and errors."""
    per = journal.groupBy("session_id").agg(
        F.max("ts").alias("last"), F.count_if(F.col("type") == "tool_call").alias("calls"), F.count_if((F.col("type") == "tool_call") & ~F.col("ok")).alias("errors")
    )
    active = F.count_if(F.lit(as_of) - F.col("last") <= idle_ms)
    return per.agg(F.count(F.lit(1)).alias("sessions"), active.alias("active_sessions"), F.sum("calls").alias("tool_calls"), F.sum("errors").alias("tool_errors"))


def session_list(journal: DataFrame, as_of: int, idle_ms: int = 1_800_000, keep: int = 40) -> DataFrame:
    """(session_id, last_active, ended): active sessions first, then by the latest;
    of the ended ones the last ``keep``."""
    per = journal.groupBy("session_id").agg(F.max("ts").alias("last_active")).withColumn("ended", F.lit(as_of) - F.col("last_active") > idle_ms)
    ended = per.filter("ended").orderBy(F.desc("last_active"), "session_id").limit(keep)
    return per.filter("not ended").unionByName(ended).orderBy("ended", F.desc("last_active"), "session_id")


def index_counts(files: DataFrame, known: DataFrame) -> DataFrame:
    """One row: indexed files, and how many of them differ from the stored hash or
    have none; files and known are (path, content_hash)."""
    rows = files.join(known.select("path", F.col("content_hash").alias("stored")), "path", "left")
    return rows.agg(F.count(F.lit(1)).alias("indexed"), F.count_if(~F.col("content_hash").eqNullSafe(F.col("stored"))).alias("dirty"))
