"""Aggregations over the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed weights of node types in importance rankings; other types weigh 1.
TYPE_PRIORITY = {"decision": 5, "adr": 4, "workspace": 4, "repo": 4, "person": 3, "file": 3, "class": 3, "folder": 2, "document": 2}


def stats(**tables: DataFrame) -> DataFrame:
    """(name, n): the row count of every table."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def expertise(nodes: DataFrame) -> DataFrame:
    """(area, count): nodes by type."""
    return nodes.groupBy(F.col("type").alias("area")).agg(F.count(F.lit(1)).alias("count"))


def criticality(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The most pointed-at nodes. The limit comes before the join, so targets
    without a node drop out of the first ``limit``."""
    top = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return nodes.select("id", "label", "type").join(F.broadcast(top), "id")  # at most ``limit`` rows


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node, in and out together. Ends are counted before the
    nodes are joined, so the exchange holds a row for each node, not each edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def importance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, score): type priority times 1 + degree / 10."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv])[F.col("type")], F.lit(1))
    score = priority * (1 + F.col("degree") / 10)
    return nodes.select("id", "type").join(degrees(nodes, edges), "id").select("id", "type", F.round(score, 6).alias("score"))


def top_nodes(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    return importance(nodes, edges).orderBy(F.desc("score"), "id").limit(limit)


def community_overview(nodes: DataFrame) -> DataFrame:
    """(id, node_count, type_histogram, dominant_type) of every community."""
    parts = nodes.filter("community is not null").groupBy("community", "type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("type", "n")))
    best = F.min_by("type", F.struct((-F.col("n")).alias("n"), "type"))
    return parts.groupBy(F.col("community").alias("id")).agg(
        F.sum("n").alias("node_count"), F.map_from_entries(pairs).alias("type_histogram"), best.alias("dominant_type")
    )


def community_label(nodes: DataFrame) -> DataFrame:
    """(community, word, folder): the commonest long label word and folder."""
    words = nodes.select("community", F.explode(F.split(F.lower(F.regexp_replace("label", r"\.[A-Za-z]+$", "")), r"[-_ ]+")).alias("word")).filter(F.length("word") > 3)
    folder = F.coalesce(F.regexp_extract("source_file", "^(.*)/[^/]*$", 1), F.lit(""))

    def best(rows: DataFrame, c: str) -> DataFrame:
        counts = rows.groupBy("community", c).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("community").agg(F.min_by(c, F.struct((-F.col("n")).alias("n"), c)).alias(c))

    folders = best(nodes.select("community", folder.alias("folder")).filter("folder <> ''"), "folder")
    return best(words, "word").join(folders, "community", "left")


def bundles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, count): edges between each two communities. Edges are counted by the
    communities of their ends after one join for each end."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("community").alias(f"{c}_c"))
    both = edges.select("source", "target").join(side("source"), "source").join(side("target"), "target").filter("source_c <> target_c")
    return both.groupBy(F.least("source_c", "target_c").alias("a"), F.greatest("source_c", "target_c").alias("b")).agg(F.count(F.lit(1)).alias("count"))


def community_top(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, id): each community's most important member, first id on ties."""
    ranked = importance(nodes, edges).join(nodes.select("id", "community"), "id").filter("community is not null")
    return ranked.groupBy("community").agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("id"))


def centroids(points: DataFrame, labelled: int = 30) -> DataFrame:
    """(community, x, y, members, radius, labelled) from points (community, x, y)."""
    rows = points.groupBy("community").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("members"))
    radius = F.least(F.lit(64.0), 7 * F.sqrt(F.col("members")))
    top = rows.orderBy(F.desc("members"), "community").limit(labelled).select("community", F.lit(True).alias("labelled"))
    out = rows.withColumn("radius", radius).join(F.broadcast(top), "community", "left")  # ``labelled`` rows
    return out.withColumn("labelled", F.coalesce("labelled", F.lit(False)))


def contributors(commits: DataFrame) -> DataFrame:
    """(repo, person, commits)."""
    return commits.groupBy("repo", "person").agg(F.count(F.lit(1)).alias("commits"))


def file_history(commits: DataFrame, as_of: int) -> DataFrame:
    """Per file: commits, contributors, age in days (1 at least), commits a month,
    first author and most frequent author (first by name on ties)."""
    per = commits.groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    rows = per.groupBy("file").agg(
        F.sum("n").alias("commits"), F.count(F.lit(1)).alias("contributors"), F.min("a").alias("first_ts"), F.max("z").alias("last_ts"),
        F.min_by("author", F.struct("a", "author")).alias("creator"), F.min_by("author", F.struct((-F.col("n")).alias("n"), "author")).alias("owner"),
    )
    age = F.greatest(F.lit(1.0), F.round((F.lit(as_of) - F.col("first_ts")) / 86_400_000))
    return rows.withColumn("age_days", age.cast("long")).withColumn("churn", F.round(F.col("commits") / F.greatest(F.lit(1.0), age / 30), 6))


def depth_histogram(topo: DataFrame) -> DataFrame:
    return topo.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
