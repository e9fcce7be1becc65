"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task turns into Python objects at once.
ROWS = 1000
#: White space of the contracts: a space and the controls 9 to 13.
SPACE_CLASS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken, in local mode only: on a
    cluster the executors could not read each other's files there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, below a folder of this application
    that is removed when the application ends."""
    own = f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"
    if own not in OWN:
        OWN.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what exists can be marked
        files.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


#: Folders that are marked for removal.
OWN: set[str] = set()
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: what follows is replayed
    from these files, not from the source, when an executor is lost. The shuffle
    files of the write are of no use afterwards and go at its end."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession, label)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written table at once that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def as_rows(df: DataFrame) -> DataFrame:
    """All columns of df packed in one struct ``row``, so that the columns an
    operator adds cannot clash with the ones that a caller brings."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    """The caller's columns again, in their order."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def utf8(array: pa.Array) -> pa.Array:
    """A string array as bytes, without a copy."""
    return array.cast(pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary())


def annotate(
    rows: DataFrame,
    added: T.StructType,
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
    column: str = "text",
) -> DataFrame:
    """Append columns that are computed from ``row.<column>``, one batch of
    Arrow rows at a time. make() is called once in each task; what it returns
    maps a batch of texts (bytes, None for null) to a list for each column.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*rows.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute, schema = make(), to_arrow_schema(added)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                whole = part.column(part.schema.get_field_index("row"))
                # flatten() takes a null struct and a slice's offset into account
                texts = utf8(whole.flatten()[whole.type.get_field_index(column)]).to_pylist()
                new = [pa.array(x, f.type) for x, f in zip(compute(texts), schema)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *schema.names])

    return rows.mapInArrow(run, out)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Adds to each row the sums over all rows before it, in a total order: rows are
    dealt by ranges of the order, which are written with their numbers; sums for
    each range (as many rows as ranges) give the ranges' own starts."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = {f"__{n}": c for n, c in sums.items()}
    dealt = cut(rows.withColumns(added).repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), label)
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"{c}_all") for c in added])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *[F.coalesce(F.sum(f"{c}_all").over(before), F.lit(0)).alias(f"{c}_start") for c in added])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = {n: F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) + F.col(f"__{n}_start") for n in sums}
    joined = dealt.join(F.broadcast(starts), "__range")  # one row for each range
    return joined.select(*rows.columns, *[c.alias(n) for n, c in whole.items()])


def minima(x: np.ndarray, width: int, valid: np.ndarray) -> np.ndarray:
    """Places where x is the least of ``width`` neighbours, for the windows of
    neighbours that are ``valid`` (one flag for each window, by its first place)."""

    def sliding(op, x, fill):
        blocks = np.full(-(-len(x) // width) * width, fill, np.uint64)
        blocks[: len(x)] = x
        blocks = blocks.reshape(-1, width)
        ahead, behind = op.accumulate(blocks, axis=1).ravel(), op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - width + 1
        return op(behind[:n], ahead[width - 1 : width - 1 + n])

    low = sliding(np.minimum, x, np.uint64(0xFFFFFFFFFFFFFFFF))
    low[~valid] = 0
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((sliding(np.maximum, np.concatenate([edge, low, edge]), np.uint64(0)) == x) & (x != 0))


class RunHashes:
    """Hashes of runs of numbers that stand one after the other: sums of the numbers
    by powers of an odd base, turned back to the run's start, then mixed."""

    def __init__(self, base: int):
        self.base = base
        self.powers = self.back = np.ones(1, np.uint64)

    def over(self, numbers: np.ndarray):
        """A function of (firsts, ends) of runs."""
        n = len(numbers)
        with np.errstate(over="ignore"):
            if len(self.powers) <= n:
                table = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))]))
                self.powers, self.back = table(self.base), table(pow(self.base, -1, 1 << 64))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(numbers * self.powers[:n], out=sums[1:])

        def hashes(low, high) -> np.ndarray:
            with np.errstate(over="ignore"):
                x = (sums[high] - sums[low]) * self.back[low]
                for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
                    x ^= x >> np.uint64(shift)
                    x *= np.uint64(factor)
                x ^= x >> np.uint64(32)
            return x

        return hashes
