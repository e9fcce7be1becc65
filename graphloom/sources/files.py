"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never indexed and the kinds of files that are. A
# caller's own folders are added as a parameter.
SKIPPED = (
    ".git .hg .svn .next .nuxt .cache .venv venv .tox node_modules dist out build coverage .parcel-cache .turbo target __pycache__ "
    ".pytest_cache .ruff_cache .config-test"
).split()
INDEXED = (
    "ts tsx mts cts js jsx mjs cjs json jsonc md mdx markdown yaml yml toml sh py go rs rb java kt kts c h cpp hpp cs css scss html sql prisma "
    "graphql gql vue svelte"
).split()


# Files that a package manager writes, and endings of names that are no sources.
LOCKS = "package-lock.json yarn.lock pnpm-lock.yaml bun.lockb Cargo.lock poetry.lock".split()
NO_SOURCES = [".d.ts", "-lock.json"]


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified) of the indexable files below root, paths relative to
    it. Listing and reading are Spark's, so root may be in any store."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    # the scheme may be written in more than one way, so the root's last part tells
    path = F.regexp_replace("path", r"^.*?" + base.split("://")[-1].replace(".", r"\.") + "/", "")
    rows = found.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    return indexable(rows)


def indexable(files: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Files outside skipped folders and of an indexed kind, without lock files and
    declarations."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    made = name.isin(LOCKS)
    for ending in NO_SOURCES:
        made = made | F.endswith(name, F.lit(ending))
    return files.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, [*SKIPPED, *skipped]))) & end.isin(INDEXED) & ~made)


def units(paths: DataFrame, levels: int = 2) -> DataFrame:
    """(unit, kind, files) of a listing: a folder that holds .git (at most ``levels``
    deep) is a repository, other top folders are folders, root files are loose.
    Files count for the deepest repository above them."""
    roots = paths.filter(F.col("path").rlike(r"(^|/)\.git/")).select(F.regexp_extract("path", r"^(.*?)/?\.git/", 1).alias("repo")).distinct()
    roots = roots.filter(F.size(F.split("repo", "/")) <= levels)
    rows = paths.filter(~F.col("path").rlike(r"(^|/)\.git/")).withColumn("n", F.size(F.split("path", "/")))
    ups = F.transform(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(levels))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    above = rows.select("path", F.posexplode(ups).alias("depth", "repo")).join(roots, "repo")
    own = above.groupBy("path").agg(F.max_by("repo", "depth").alias("repo"))
    rows = rows.join(own, "path", "left")
    top = F.when(F.col("n") > 1, F.substring_index("path", "/", 1)).otherwise(".")
    kind = F.when(F.col("repo").isNotNull(), "git-repo").when(F.col("n") > 1, "folder").otherwise("loose")
    unit = F.coalesce(F.when(F.col("repo") == "", ".").otherwise(F.col("repo")), top)
    return rows.groupBy(unit.alias("unit"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def unit_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("units"), F.sum("files").alias("files"))
