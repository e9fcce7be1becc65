"""Live state of the journal: rings of durations, idle sessions, and bursts of changes.

Each is an operator with state of its own for a key. Rows are put together in the map
tasks before they are dealt by key, so a tool or session that holds most events sends a
few rows from each batch of its task, and the state of a key has a fixed size (a ring),
or a row for each run of a session that is still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators.journal import IDLE_MS, RING

#: What a ring's rows and state hold: calls, errors, and the last calls by seq.
COUNTS = "count long, errors long, seqs array<long>, durations array<long>"


def live_tool_rings(events: DataFrame, ring: int = RING) -> DataFrame:
    """(tool, count, errors, last_ms, p50_ms, p95_ms) of every tool with new calls, in
    update mode: calls and errors so far, and the last duration and percentiles of the
    ``ring`` calls of greatest seq. Calls may come in any order and any division into
    batches; the last row of a tool is what ``tool_stats`` gives for all its calls. A
    missing duration keeps its place in the ring and is left out of percentiles; a
    null tool is a tool of its own."""

    def newest(seqs: np.ndarray, durations: list) -> tuple[list, list]:
        keep = np.argsort(seqs, kind="stable")[-ring:]
        return [int(seqs[k]) for k in keep], [durations[k] for k in keep]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tool, part in batch.groupby("tool", dropna=False, sort=False):
                durations = [None if pd.isna(x) else int(x) for x in part["duration_ms"]]
                # an unknown outcome is no error
                rows.append((None if pd.isna(tool) else tool, len(part), int((part["ok"] == False).sum()), *newest(part["seq"].to_numpy(), durations)))  # noqa: E712
            yield pd.DataFrame(rows, columns=["tool", "count", "errors", "seqs", "durations"])

    def merge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, errors, seqs, durations = state.get if state.exists else (0, 0, [], [])
        for part in parts:
            count, errors = count + int(part["count"].sum()), errors + int(part["errors"].sum())
            joined = [*durations, *(None if pd.isna(x) else int(x) for values in part["durations"] for x in values)]
            seqs, durations = newest(np.concatenate([np.array(seqs, np.int64), *map(np.asarray, part["seqs"])]), joined)
        state.update((count, errors, seqs, durations))
        known = sorted(x for x in durations if x is not None)
        at = lambda q: known[int((len(known) - 1) * q)] if known else None
        yield pd.DataFrame({"tool": [key[0]], "count": [count], "errors": [errors], "last_ms": [durations[-1]], "p50_ms": [at(0.5)], "p95_ms": [at(0.95)]}, dtype=object)

    calls = events.filter("type = 'tool_call'").select("tool", "seq", "ok", F.col("duration_ms").cast("long").alias("duration_ms"))
    return (
        calls.mapInPandas(gather, f"tool string, {COUNTS}")
        .groupBy("tool")
        .applyInPandasWithState(merge, "tool string, count long, errors long, last_ms long, p50_ms long, p95_ms long", COUNTS, "update", GroupStateTimeout.NoTimeout)
    )


def joined_runs(starts: np.ndarray, lasts: np.ndarray, counts: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs put together where one starts at most ``gap`` after the end of those before."""
    order = np.argsort(starts, kind="stable")
    starts, lasts, counts = starts[order], np.maximum.accumulate(lasts[order]), counts[order]
    new = np.flatnonzero(np.append(True, starts[1:] - lasts[:-1] > gap))
    return starts[new], np.append(lasts[new[1:] - 1], lasts[-1]), np.add.reduceat(counts, new)


def live_session_ends(events: DataFrame, idle_ms: int = IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """(session_id, start_ts, end_ts, n), in append mode: the runs of every session that
    ended because more than idle_ms went by without an event (session_id, ts in epoch
    milliseconds). Time is the watermark, the latest time seen less ``late``: a timer in
    the session's state ends it once the watermark is past, without another event of
    its own. Events that come later than that are left out; all others may come in any
    order, and the ends are the runs of ``sessions_by_gap`` that are over by then."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # all sessions of the batch at once: it may hold as many of them as events
            codes, names = pd.factorize(batch["session_id"], use_na_sentinel=False)
            ts = batch["ts"].to_numpy(np.int64)
            order = np.lexsort((ts, codes))
            codes, ts = codes[order], ts[order]
            first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (ts[1:] - ts[:-1] > idle_ms))[: len(ts)])
            last = np.append(first[1:], len(ts))[: len(first)] - 1
            session = pd.Series(names[codes[first]], dtype=object)
            yield pd.DataFrame({"session_id": session.where(session.notna(), None), "start": ts[first], "last": ts[last], "n": last - first + 1})

    def settle(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = [np.array(x, np.int64) for x in (state.get if state.exists else ([], [], []))]
        for part in parts:
            runs = joined_runs(*(np.concatenate([a, part[c].to_numpy(np.int64)]) for a, c in zip(runs, ("start", "last", "n"))), idle_ms)
        over = runs[1] + idle_ms < state.getCurrentWatermarkMs()
        left = [x[~over] for x in runs]
        if len(left[0]):
            state.update(tuple(x.tolist() for x in left))
            state.setTimeoutTimestamp(int(left[1].min()) + idle_ms)
        elif state.exists:
            state.remove()
        if over.any():
            yield pd.DataFrame({"session_id": [key[0]] * int(over.sum()), "start_ts": runs[0][over], "end_ts": runs[1][over], "n": runs[2][over]})

    rows = events.filter("ts IS NOT NULL").select("session_id", "ts").mapInPandas(gather, "session_id string, start long, last long, n long")
    rows = rows.withColumn("at", F.timestamp_millis("last")).withWatermark("at", late)
    return rows.groupBy("session_id").applyInPandasWithState(
        settle, "session_id string, start_ts long, end_ts long, n long", "starts array<long>, lasts array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def latest_ends(ends: DataFrame, most: int = 40) -> DataFrame:
    """The sessions that ended last, the newest first; of a session its last end."""
    last = ends.groupBy("session_id").agg(F.max_by(F.struct("start_ts", "end_ts", "n"), "end_ts").alias("r")).select("session_id", "r.*")
    return last.orderBy(F.desc("end_ts"), "session_id").limit(most)


# Folders and endings whose changes are no news. Hidden folders and files
# (with a dot in front) are left out as well.
QUIET_FOLDERS = ["node_modules", "dist", "out", "coverage"]
QUIET_ENDINGS = [".json", ".lock", ".db", ".log", ".tmp", ".sqlite"]


def worth_telling(path: Column, folders: list[str] = QUIET_FOLDERS, endings: list[str] = QUIET_ENDINGS) -> Column:
    """Whether a change of path (relative to the root) is news."""
    parts = F.split(path, "/")
    noisy = F.exists(parts, lambda p: p.startswith(".") | p.isin(folders))
    return ~noisy & ~F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)).isin(endings)


def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """(root, path) of the files that appear below root, paths relative to it. The file
    source tells of every path once; changes of known files come from a journal."""
    base = root.rstrip("/")
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(base)
    inside = F.substring_index("path", base.split("://")[-1] + "/", -1)
    return found.select(F.lit(base).alias("root"), inside.alias("path"))


def bursts(changes: DataFrame, quiet_ms: int = 600) -> DataFrame:
    """(root, burst, path), in append mode: the changes (root, path) of each root with
    the number of their burst, and a row without path once ``quiet_ms`` went by without
    another change of the root. Every change starts the timer anew; the state of a root
    is the number of its burst, whatever the burst's size."""

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates()

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (burst,) = state.get if state.exists else (0,)
        if state.hasTimedOut:
            state.update((burst + 1,))
            yield pd.DataFrame({"root": [key[0]], "burst": [burst], "path": [None]})
            return
        for part in parts:
            yield pd.DataFrame({"root": key[0], "burst": burst, "path": part["path"]})
        state.update((burst,))
        state.setTimeoutDuration(quiet_ms)

    news = changes.filter(worth_telling(F.col("path"))).select("root", "path")
    return (
        news.mapInPandas(once, "root string, path string")
        .groupBy("root")
        .applyInPandasWithState(number, "root string, burst long, path string", "burst long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    )


def on_quiet(changes: DataFrame, store: str, checkpoint: str, on_burst: Callable[[DataFrame], None], quiet_ms: int = 600, every: str = "100 milliseconds") -> StreamingQuery:
    """Calls on_burst with the paths (root, burst, path) of every burst that is over,
    each path once, in one call a micro-batch. Rows of open bursts wait in ``store``,
    which all executors share; a micro-batch that is repeated after a failure writes its
    own folder again and tells of its bursts again."""
    kind = "root string, burst long, path string"

    def on_batch(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch}")
        own = spark.read.schema(kind).parquet(f"{store}/batch={batch}")
        over = own.filter("path IS NULL").select("root", "burst")  # a row for each root at most
        if not over.isEmpty():
            waiting = spark.read.schema(kind).parquet(store).filter("path IS NOT NULL").select("root", "burst", "path")
            on_burst(waiting.join(F.broadcast(over), ["root", "burst"], "left_semi").distinct())

    found = bursts(changes, quiet_ms).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    return found.trigger(processingTime=every).foreachBatch(on_batch).start()
