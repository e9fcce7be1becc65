"""Sharding (operator 8): a Feistel permutation over global row numbers.

Every row gets a number in 0 .. n-1 that depends on the data alone; a keyed
Feistel network with cycle walking permutes these numbers, and the permuted
number gives shard (remainder) and slot (quotient). So shard and slot of any row
number can be computed without the data, and the counts of two shards differ by
one row at most (law ``rows``).

Row numbers without a global sort: rows fall into hash buckets by key, the
bucket sizes (one small row for each bucket) give offsets, and rows are numbered
inside their bucket. There are about sqrt(n) buckets of sqrt(n) rows, so neither
a bucket nor the list of offsets grows large.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.base import as_rows, cut, table

SHARDS = 40
SEED = 42
ROUNDS = 8
#: Steps of cycle walking in the plan. A step leaves the range with a chance of
#: (excess points / domain), under 1/sqrt(n); a walk that is still outside after
#: so many steps stops the job instead of giving a wrong row.
WALKS = 64


def feistel(number: Column, a: int, b: int, seed: int) -> Column:
    """A keyed permutation of 0 .. a*b-1: L in 0..a-1 and R in 0..b-1 take turns
    in being shifted by a hash of the other."""

    def turn(state: Column, k: Column) -> Column:
        left, right = state.getField("l"), state.getField("r")
        return F.when(
            k % 2 == 0,
            F.struct(F.pmod(left + F.pmod(F.xxhash64(right, k, F.lit(seed)), F.lit(a)), F.lit(a)).alias("l"), right.alias("r")),
        ).otherwise(
            F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(left, k, F.lit(seed)), F.lit(b)), F.lit(b)).alias("r"))
        )

    start = F.struct((number % F.lit(a)).alias("l"), F.call_function("div", number, F.lit(a)).alias("r"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s.getField("r") * F.lit(a) + s.getField("l")
    )


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number ``number`` (0 .. n-1) in the shuffled order."""
    a = max(1, isqrt(max(0, n - 1)) + 1)  # ceil(sqrt(n))
    b = max(1, -(-n // a))  # a*b >= n, with fewer than a points in excess
    excess = a * b - n
    first = feistel(number, a, b, seed)
    if not excess:
        return first
    walks = min(excess + 1, WALKS)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)), first, lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed))
    )
    return F.aggregate(
        F.array(walked), F.lit(0).cast("long"), lambda _, at: F.when(at < n, at).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    )


def shard(docs: DataFrame, keep: list[str] | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs' row (struct ``row``, or only its columns ``keep``) with size,
    text_crc32, law, shard, slot and grown_shard.

    A null text counts as empty (size 16, checksum 0); a null doc_id is a key
    like any other. Repeated rows are numbered one after the other, each has a
    slot of its own; rows of equal key and checksum go by their other columns, so
    reruns agree. An empty table gives no rows. Columns of the caller stay inside
    ``row`` and may have any name.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    n = docs.count()
    buckets = isqrt(n) + 1
    kept = F.struct(*[F.col("row").getField(c).alias(c) for c in keep or docs.columns])
    names = [c for c in keep or docs.columns if c not in ("doc_id", "text")]
    # maps have no hash, their text has
    others = [F.to_json(F.struct(F.col("row").getField(c))) if "map<" in docs.schema[c].dataType.simpleString() else F.col("row").getField(c) for c in names]
    tie = F.xxhash64(*others) if others else F.lit(0).cast("long")
    rows = as_rows(docs).select(
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.col("row.doc_id").alias("key"),
        tie.alias("tie"),
        kept.alias("row"),
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "tie", F.lit(seed)), F.lit(buckets)))
    # one row for each bucket, pre-aggregated: sqrt(n) of them
    sizes = rows.groupBy("bucket").count()
    before = F.sum("count").over(Window.orderBy("bucket")) - F.col("count")
    offsets = cut(sizes.select("bucket", before.alias("before")), "shard")
    inside = Window.partitionBy("bucket").orderBy(F.col("key").asc_nulls_first(), "text_crc32", "tie")
    placed = (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(offsets, "bucket")
        .withColumn("at", permuted(F.col("before") + F.col("rank") - 1, n, seed))
    )
    return placed.select(
        "row", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("at", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"at div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the text stays behind the exchange."""
    placed = shard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select("row.doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their shard and slot (nulls, repeated rows
    and empty tables as in ``shard``)."""
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return shard(docs, keep=own).select("row.*", "shard", "slot")
