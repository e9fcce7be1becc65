"""Queries that run a stream over the journal to its end, beside batch statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.canonical import load
from graphloom.plans.queries import TOOL_SQL, query
from graphloom.sources.tables import fresh_path
from graphloom.streaming import live as L

#: Files of a micro-batch, at least, and rows of a file, at least, if there are more.
FILES, ROWS = 2, 1000


def as_stream(parts: list[DataFrame], label: str) -> DataFrame:
    """A stream of the given parts, one after the other, a micro-batch for each. A part
    has as many files as its input has tasks, none of them empty."""
    spark, path = parts[0].sparkSession, fresh_path(parts[0].sparkSession, label)
    files = max(FILES, min(parts[0].rdd.getNumPartitions(), *(part.count() // ROWS for part in parts)))
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def to_its_end(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """What the stream has put out once all of its input is read: its rows, and in
    ``batch`` the number of the micro-batch."""
    spark = stream.sparkSession
    out = fresh_path(spark, label)
    spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0)).write.parquet(f"{out}/none")
    put = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{batch}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, label)).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{out}/*")


@query("str5_live_tool_rings", f"WITH {TOOL_SQL} SELECT * FROM tool_stats", "journal")
def _(spark: SparkSession, d: str) -> DataFrame:
    journal = load(spark, d, "journal")
    # parts without any order, so that rings get their calls late and early
    rows = to_its_end(L.live_tool_rings(as_stream([journal.filter(F.pmod(F.hash("seq"), F.lit(4)) == k) for k in range(4)], "calls")), "update", "rings")
    last = rows.groupBy("tool").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("tool", "batch")]), "batch").alias("r"))
    return last.select("tool", "r.*")


LATE_MS = 600_000
ENDS_SQL = (
    "g AS (SELECT session_id, ts, seq, coalesce(cast(ts - lag(ts) OVER w > 1800000 as int), 0) AS new FROM journal WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, seq) AS run FROM g), "
    "ends AS (SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM r GROUP BY session_id, run "
    f"HAVING max(ts) + 1800000 < (SELECT max(ts) FROM journal) - {LATE_MS})"
)


def session_ends(spark: SparkSession, d: str) -> DataFrame:
    """Ends that a stream over the journal tells of, in four parts by time."""
    journal = load(spark, d, "journal").select("session_id", "ts")
    q = journal.approxQuantile("ts", [0.25, 0.5, 0.75], 0.01)
    bounds = [-(2**62), *q, 2**62]
    parts = [journal.filter((F.col("ts") >= int(a)) & (F.col("ts") < int(b))) for a, b in zip(bounds, bounds[1:])]
    return to_its_end(L.live_session_ends(as_stream(parts, "events"), late=f"{LATE_MS} milliseconds"), "append", "ends").drop("batch")


@query("str3_live_ends", f"WITH {ENDS_SQL} SELECT * FROM ends", "journal")
def _(spark: SparkSession, d: str) -> DataFrame:
    return session_ends(spark, d)


@query(
    "str3_latest_ends",
    f"WITH {ENDS_SQL}, l AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY end_ts DESC) = 1) SELECT * FROM l ORDER BY end_ts DESC, session_id LIMIT 40",
    "journal",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_ends(session_ends(spark, d))
