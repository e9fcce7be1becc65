"""Streams with state: any division into batches, restarts, timers."""

import json
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import journal as JR
from graphloom.streaming import live as L

CALLS = "seq long, type string, tool string, ok boolean, duration_ms long"


def calls(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        tool = r.choice(["get", "get", "get", "put", "rare" if i < 9 else "list", None])
        rows.append((i, r.choice(["tool_call"] * 9 + ["start"]), tool, r.choice([True, True, False, None]), r.choice([None, r.randint(0, 999), r.randint(0, 5)])))
    return rows


def feed(folder, rows, name, columns):
    (folder / f"{name}.tmp").write_text("".join(json.dumps(dict(zip(columns, x))) + "\n" for x in rows))
    (folder / f"{name}.tmp").rename(folder / f"{name}.json")
    time.sleep(0.02)  # files go by their times


@pytest.mark.parametrize("ring,parts", [(256, 1), (4, 5), (1, 3)])
def test_rings_over_any_division(spark, tmp_path, ring, parts):
    rows = calls(700)
    shuffled = random.Random(parts).sample(rows, len(rows))
    columns = ["seq", "type", "tool", "ok", "duration_ms"]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(parts):
        feed(folder, shuffled[k::parts], k, columns)
    stream = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(str(folder))
    found = {}

    def last(df, batch):
        for x in df.collect():
            found[x.tool] = tuple(x)

    def run():
        L.live_tool_rings(stream, ring).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(last).start().awaitTermination()

    run()
    more = [(1000 + i, "tool_call", "get", False, i) for i in range(3)]
    feed(folder, more, "more", columns)
    run()  # from the checkpoint
    want = {x.tool: tuple(x) for x in JR.tool_stats(spark.createDataFrame([*rows, *more], CALLS).fillna("none", "tool"), ring).collect()}
    assert {k or "none": (k or "none", *v[1:]) for k, v in found.items()} == want


def brute_runs(events, gap):
    by = defaultdict(list)
    for s, ts in events:
        by[s].append(ts)
    out = []
    for s, times in by.items():
        runs = []
        for t in sorted(times):
            if runs and t - runs[-1][-1] <= gap:
                runs[-1].append(t)
            else:
                runs.append([t])
        out += [(s, x[0], x[-1], len(x)) for x in runs]
    return out


def test_joined_runs():
    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        times = [r.randint(0, 200) for _ in range(r.randint(1, 30))]
        parts = [sorted(times[k::3]) for k in range(3) if times[k::3]]
        one = lambda t: L.joined_runs(np.array(t), np.array(t), np.ones(len(t), int), 9)
        runs = [one(p) for p in parts]
        both = L.joined_runs(*(np.concatenate(x) for x in zip(*runs)), 9)
        assert list(zip(*(x.tolist() for x in both))) == [x[1:] for x in brute_runs([("s", t) for t in times], 9)]


def test_session_ends(spark, tmp_path):
    """Ends at each tick are those that the events so far say, over a restart too."""
    r, gap, late = random.Random(5), 1000, 300
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("session_id string, ts long").option("maxFilesPerTrigger", 1).json(str(folder))
    found, seen = [], []
    for tick in range(5):
        # out of order, and late by less than what the watermark waits for
        top = 100_000 + 4000 * tick
        events = [(r.choice(["a", "a", "a", "b", "c", f"t{tick}", None]), r.randint(top - late, top + 4000 - late)) for _ in range(60)] + [("end", top + 4000)]
        seen += events
        feed(folder, events, tick, ["session_id", "ts"])
        q = L.live_session_ends(stream, gap, f"{late} milliseconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).start().awaitTermination()
        clock = max(t for _, t in seen) - late
        assert sorted(found, key=str) == sorted((x for x in brute_runs(seen, gap) if x[2] + gap < clock), key=str)
    rows = spark.createDataFrame(found, "session_id string, start_ts long, end_ts long, n long")
    last = {}
    for s, a, b, n in found:
        last[s] = max(last.get(s, (0, 0, 0)), (b, a, n))
    want = sorted(((-b, str(s)) for s, (b, _, _) in last.items()))[:4]
    assert [(-x.end_ts, str(x.session_id)) for x in L.latest_ends(rows, 4).collect()] == want


def test_what_is_news(spark):
    paths = ["a.ts", "a/b.md", ".git/x.ts", "a/.hidden", "node_modules/x.ts", "a/dist/x.ts", "x.json", "x.LOCK", "dist.ts", "a.b/c", "no_ending"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").filter(L.worth_telling(F.col("path")))
    assert {x.path for x in rows.collect()} == {"a.ts", "a/b.md", "dist.ts", "a.b/c", "no_ending"}


def test_bursts(spark, tmp_path):
    """Five writes in half a second are one batch; what comes after a rest is another."""
    tree = tmp_path / "tree"
    (tree / "node_modules").mkdir(parents=True)
    told = []
    changes = L.file_changes(spark, str(tree))
    q = L.on_quiet(changes, str(tmp_path / "store"), str(tmp_path / "c"), lambda df: told.append(sorted((x.burst, x.path) for x in df.collect())), quiet_ms=4000)
    try:
        (tree / "warm.md").write_text("x")
        until = time.time() + 60
        while len(told) < 1 and time.time() < until:
            time.sleep(0.1)
        for k in range(5):
            (tree / f"f{k}.md").write_text("x")
            (tree / f"f{k}.json").write_text("x")
            (tree / "node_modules" / f"f{k}.md").write_text("x")
            time.sleep(0.1)
        while len(told) < 2 and time.time() < until:
            time.sleep(0.1)
        (tree / "second.md").write_text("x")
        while len(told) < 3 and time.time() < until:
            time.sleep(0.1)
    finally:
        q.stop()
    assert told == [[(0, "warm.md")], [(1, f"f{k}.md") for k in range(5)], [(2, "second.md")]]


def test_many_sessions_in_a_batch(spark, tmp_path):
    """Batches of as many sessions as events are put together at once, nulls too."""
    r = random.Random(8)
    events = [(None if k % 50 == 0 else f"s{r.randrange(4000)}", r.randint(0, 20_000)) for k in range(8000)]
    spark.createDataFrame([*events, ("end", 90_000)], "session_id string, ts long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id string, ts long").parquet(f"{tmp_path}/in")
    found = []
    L.live_session_ends(stream, 1000, "300 milliseconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).start().awaitTermination()
    assert sorted(found, key=str) == sorted(brute_runs(events, 1000), key=str)
