"""Analytics over the append-only journal of events, ordered by seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.merge import positions

RING = 256
IDLE_MS = 1_800_000


def tail(events: DataFrame, limit: int = 100) -> DataFrame:
    """The last events, in their order."""
    return events.orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def tool_stats(events: DataFrame, ring: int = RING) -> DataFrame:
    """Per tool: calls, errors, last duration, and the 50th and 95th percentile of
    the last ``ring`` durations by the index floor((n - 1) * q)."""
    calls = events.filter("type = 'tool_call'")
    totals = calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(~F.col("ok")).alias("errors"), F.max_by("duration_ms", "seq").alias("last_ms")
    )
    # Spark keeps a rank limit within a window's group while it sorts (window group limit)
    last = calls.withColumn("n", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("seq")))).filter(F.col("n") <= ring)
    sample = last.groupBy("tool").agg(F.sort_array(F.collect_list("duration_ms")).alias("v"))
    at = lambda q: F.element_at("v", (F.floor((F.size("v") - 1) * F.lit(q)) + 1).cast("int"))
    return totals.join(sample, "tool").select("tool", "count", "errors", "last_ms", at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def journal_summary(events: DataFrame) -> DataFrame:
    """One row: sessions, tool calls, errors, last activity and last tool."""
    call = F.col("type") == "tool_call"
    return events.agg(
        F.count_distinct("session_id").alias("sessions"),
        F.count_if(call).alias("tool_calls"),
        F.count_if(call & ~F.col("ok")).alias("errors"),
        F.max("ts").alias("last_activity"),
        F.max_by(F.when(call, F.col("tool")), F.when(call, F.col("seq"))).alias("last_tool"),
    )


def session_rows(events: DataFrame, starts: DataFrame, ended: DataFrame, alive: DataFrame) -> DataFrame:
    """Per session: calls after its start, last tool and time, and state: ended, or
    active if its process is alive, else orphan. starts (session_id, start_seq,
    pid), ended (session_id), alive (pid)."""
    after = events.join(starts.select("session_id", "start_seq"), "session_id").filter(F.col("seq") > F.col("start_seq"))
    calls = after.filter("type = 'tool_call'").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tool_calls"), F.max_by("tool", "seq").alias("last_tool"), F.max("ts").alias("last_ts")
    )
    rows = starts.join(calls, "session_id", "left").join(ended.select("session_id", F.lit(True).alias("over")), "session_id", "left")
    rows = rows.join(alive.select("pid", F.lit(True).alias("lives")), "pid", "left")
    state = F.when(F.col("over"), "ended").when(F.col("lives"), "active").otherwise("orphan")
    return rows.select("session_id", "pid", state.alias("state"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), "last_tool", "last_ts")


def session_tools(events: DataFrame) -> DataFrame:
    """(session_id, tools): calls by tool as a map."""
    counts = events.filter("type = 'tool_call'").groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))


def identities(events: DataFrame, fields: list[str]) -> DataFrame:
    """Per session: the last non-null value of each field, and last_seen."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return events.groupBy("session_id").agg(*last, F.max("ts").alias("last_seen"))


def threads(messages: DataFrame) -> DataFrame:
    """(key, n, last_ts): messages by thread, a message without one being its own."""
    key = F.coalesce("thread_id", "id")
    return messages.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


def thread_items(messages: DataFrame) -> DataFrame:
    """(key, position, id): the messages of each thread in order, a row each, so that
    a thread of any length is no more than many rows."""
    rows = messages.select(F.coalesce("thread_id", "id").alias("key"), "seq", "id")
    return positions(rows, "key", ["seq", "id"]).select("key", "position", "id")


def conflicts(messages: DataFrame) -> DataFrame:
    """(thread_id, id): in threads with a conflict message, the messages that share
    a topic (``topics``: files and branch) with another one."""
    flagged = messages.filter("msg_type = 'code-conflict'").select("thread_id").distinct()
    topics = messages.join(flagged, "thread_id", "left_semi").select("thread_id", "id", F.explode(F.array_distinct("topics")).alias("topic"))
    shared = topics.groupBy("thread_id", "topic").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return topics.join(shared, ["thread_id", "topic"], "left_semi").select("thread_id", "id").distinct()


def idle_sessions(events: DataFrame, as_of: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """(session_id, last_active, ended): ended after more than idle_ms without an event."""
    rows = events.groupBy("session_id").agg(F.max("ts").alias("last_active"))
    return rows.withColumn("ended", F.lit(as_of) - F.col("last_active") > idle_ms)


def sessions_by_gap(events: DataFrame, gap_ms: int = IDLE_MS) -> DataFrame:
    """(session_id, start_ts, end_ts, n): runs of events without a gap over gap_ms."""
    order = Window.partitionBy("session_id").orderBy("ts", "seq")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(order) > gap_ms).cast("int"), F.lit(0))
    runs = events.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("session_id", "run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n")).drop("run")


def sampled_calls(events: DataFrame) -> DataFrame:
    """The first call of every (session, tool)."""
    return events.filter("type = 'tool_call'").groupBy("session_id", "tool").agg(F.min("seq").alias("seq"))


def metrics_text(stats: DataFrame) -> DataFrame:
    """Lines of a text exposition of tool_stats."""
    line = lambda name, c: F.format_string(f'tool_{name}{{tool="%s"}} %d', F.regexp_replace("tool", '(["\\\\])', "\\\\$1"), F.col(c).cast("long"))
    names = [("calls_total", "count"), ("errors_total", "errors"), ("last_ms", "last_ms"), ("p50_ms", "p50_ms"), ("p95_ms", "p95_ms")]
    return stats.select(F.explode(F.array(*[line(*x) for x in names])).alias("line"))
