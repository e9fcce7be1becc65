"""Tables of the graph: schemas, migration, readers, writers, and shared folders."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "nodes": "id string, label string, type string, source_file string, source_location string, content string, content_hash string, community int, "
    "churn_rate double, last_modified long, contributor_count int, metadata string, created_at long, updated_at long",
    "edges": "id long, source string, target string, relation string, weight double, confidence double, extraction_method string, metadata string",
    "chunks": "id string, node_id string, file_path string, start_line int, end_line int, content string, content_hash string, created_at long, updated_at long",
    "vectors": "chunk_id string, vector array<float>, dimension int",
    "communities": "id int, label string, node_count int, cohesion double, metadata string",
    "persons": "id string, name string, email string, role string, is_primary boolean",
    "adr_links": "adr_node_id string, code_node_id string",
}
#: Columns that a version of the schema added, with the value for older rows.
ADDED = {2: {"nodes": {"contributor_count": 0, "churn_rate": 0.0}}, 3: {"persons": {"role": "contributor", "is_primary": False}}}


#: Folders that are marked for removal.
OWN: set[str] = set()
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder of spark.checkpoint.dir, below a folder of this
    application that is removed when the application ends. Where it is unset, local
    mode takes a temporary folder; a cluster must set it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    own = f"{where}/graphloom/{spark.sparkContext.applicationId}"
    if own not in OWN:
        OWN.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what exists can be marked
        files.deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside go at its end."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder (with options of Parquet) and read it back. The
    shuffle files of the write are of no use afterwards and go at its end."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    with freed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys to that many tasks, so that each keeps few of them; as they are if None."""
    return rows if tasks is None else rows.repartition(tasks, *keys)


def migrate(rows: DataFrame, name: str, version: int) -> DataFrame:
    """Rows of an older schema version with the columns added since."""
    for v, tables in sorted(ADDED.items()):
        if v > version:
            for column, value in tables.get(name, {}).items():
                if column not in rows.columns:
                    rows = rows.withColumn(column, F.lit(value))
    return rows


def read_graph(spark: SparkSession, path: str, keep_corrupt: bool = False) -> dict[str, DataFrame]:
    """Every table below path; a missing one is empty with its schema. One that is no
    table of this kind is an error, or (``keep_corrupt``) left where it is and taken as
    empty, with a warning."""
    out = {}
    for name, schema in SCHEMAS.items():
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
            out[name].schema  # noqa: B018  resolves the path
        except Exception as e:
            missing = "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e)
            corrupt = "FAILED_READ_FILE" in str(e) or "CANNOT_READ_FILE_FOOTER" in str(e) or "is not a Parquet file" in str(e)
            if not missing and not (keep_corrupt and corrupt):
                raise
            if corrupt:
                warnings.warn(f"{path}/{name} cannot be read and is taken as empty", stacklevel=2)
            out[name] = spark.createDataFrame([], schema)
    return out


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Temporary views, so that spark.sql runs any query over the graph."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)


def run_query(spark: SparkSession, sql: str, args: list | dict | None = None) -> DataFrame:
    """A parameterised SQL query over the registered views."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def export_graph(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def import_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.schema(s).json(f"{path}/{n}") for n, s in SCHEMAS.items() if n in ("nodes", "edges", "chunks", "communities")}
