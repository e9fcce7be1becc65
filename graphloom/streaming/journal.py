"""The journal as a stream: file source, live counters, sessions and sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.etl import chunked
from graphloom.operators.store import backfill

SCHEMA = (
    "seq long, ts timestamp, type string, session_id string, client string, client_version string, mode string, pid long, tool string, ok boolean, "
    "duration_ms long, id string, `from` string, `to` string, msg_type string, urgency string, text string, thread_id string, in_reply_to string"
)


def journal_stream(spark: SparkSession, path: str, fmt: str = "json", schema: str = SCHEMA) -> DataFrame:
    """New journal files as they appear; lines that are no JSON are dropped."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    return (reader.option("mode", "DROPMALFORMED") if fmt == "json" else reader).format(fmt).load(path)


def read_journal(spark: SparkSession, *paths: str, schema: str = SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(list(paths)).filter("type is not null")


def live_tool_stats(events: DataFrame) -> DataFrame:
    """Running calls, errors and mean duration of every tool; state is one row for
    each tool."""
    calls = events.filter("type = 'tool_call'")
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("ok")).alias("errors"), F.avg("duration_ms").alias("avg_ms"))


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap; the watermark bounds the state."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("session_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def sample_calls(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first call of every session and tool within the watermark."""
    return events.filter("type = 'tool_call'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "tool"])


def watch(spark: SparkSession, path: str, checkpoint: str, on_batch: Callable[[DataFrame], None], every: str = "1 second") -> StreamingQuery:
    """Calls on_batch with the new files (path, content) of every interval, each
    path once. The interval stands for the debounce of a file watcher."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda df, _: on_batch(df.dropDuplicates(["path"]))).start()


def append_journal(events: DataFrame, path: str, most: int = 5 << 20) -> None:
    """Appends events as JSON lines. A journal of over ``most`` bytes is first moved
    to ``<path>.1``, in the place of an older one; ``read_journal`` takes both."""
    spark = events.sparkSession
    at, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.1"))
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(at) and files.getContentSummary(at).getLength() > most:
        files.delete(old, True)
        files.rename(at, old)
    events.write.mode("append").json(path)


def index_as_it_changes(spark: SparkSession, path: str, checkpoint: str, store: str, embed, width: int, every: str = "1 second") -> StreamingQuery:
    """The watch loop: new files (path, content) of every interval are cut to chunks,
    what has no vector yet is embedded, and an event says how much was done. Tables
    ``chunks`` and ``vectors`` and the journal grow below ``store``; a batch that is
    repeated after a failure writes its own folder again."""

    def on_batch(files: DataFrame, batch: int) -> None:
        rows = chunked(files.dropDuplicates(["path"]))
        chunks = rows.select(F.concat_ws("#", "path", "start_line").alias("id"), F.col("path").alias("file_path"), "start_line", "end_line", "content")
        chunks.write.mode("overwrite").parquet(f"{store}/chunks/batch={batch}")
        kept = files.sparkSession.read.parquet(f"{store}/chunks/batch={batch}")
        have = files.sparkSession.createDataFrame([], "chunk_id string")
        backfill(kept, have, embed, width).write.mode("overwrite").parquet(f"{store}/vectors/batch={batch}")
        event = kept.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"))
        event.select(F.lit(batch).alias("seq"), F.current_timestamp().alias("ts"), F.lit("index").alias("type"), "files", "chunks").write.mode("overwrite").json(f"{store}/journal/batch={batch}")

    found = spark.readStream.format("text").option("wholetext", True).load(path)
    rows = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(on_batch).start()
