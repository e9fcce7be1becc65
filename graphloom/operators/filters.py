"""Projections, lookups and filters over nodes and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Age at which a row counts as stale.
STALE_MS = 30 * 86_400_000


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of this id; none if it is absent."""
    return nodes.filter(F.col("id") == node_id).limit(1)


def changed_since(nodes: DataFrame, since: int, limit: int = 10) -> DataFrame:
    """Nodes updated at or after since, newest first, by id within one time."""
    return nodes.filter(F.col("updated_at") >= since).orderBy(F.desc("updated_at"), "id").limit(limit)


def delta_page(nodes: DataFrame, since: int, limit: int = 20) -> DataFrame:
    """A page of changes with has_more and next_cursor, from one probe row beyond it."""
    probe = changed_since(nodes, since, limit + 1)
    # the probe has limit + 1 rows, so one window over it is small
    rank = F.row_number().over(Window.orderBy(F.desc("updated_at"), "id"))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    page = probe.withColumns({"rank": rank, "total": total}).filter(F.col("rank") <= limit)
    return page.withColumns(
        {"has_more": F.col("total") > limit, "next_cursor": F.max("updated_at").over(Window.partitionBy())}
    ).drop("total")


def search_labels(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose label or id holds text, in any case; without their content."""
    low = text.lower()
    hit = F.lower("label").contains(low) | F.lower("id").contains(low)
    return nodes.filter(hit).select("id", "label", "type", "source_file").orderBy("id").limit(limit)


def of_types(nodes: DataFrame, types: Sequence[str], limit: int = 50) -> DataFrame:
    """Nodes of the given types, newest first."""
    return nodes.filter(F.col("type").isin(list(types))).orderBy(F.desc("updated_at"), "id").limit(limit)


def list_repos(nodes: DataFrame) -> DataFrame:
    """Repositories with their metadata as a map; text that is no JSON object gives
    an empty one."""
    empty = F.create_map().cast("map<string,string>")
    meta = F.from_json(F.col("metadata"), "map<string,string>") if "metadata" in nodes.columns else F.lit(None)
    return nodes.filter(F.col("type") == "repo").withColumn("metadata", F.coalesce(meta, empty)).orderBy("id")


def list_persons(persons: DataFrame) -> DataFrame:
    """Primary person first, then owners, members and others, by name."""
    rank = F.when(F.col("role") == "owner", 0).when(F.col("role") == "member", 1).otherwise(2)
    return persons.withColumn("rank", rank).orderBy(F.desc("is_primary"), "rank", "name", "id").drop("rank")


def visible(nodes: DataFrame, edges: DataFrame, types: Sequence[str]) -> DataFrame:
    """Edges of which both ends are of a visible type."""
    seen = nodes.filter(F.col("type").isin(list(types))).select("id")
    return edges.join(seen, F.col("source") == F.col("id"), "left_semi").join(seen, F.col("target") == F.col("id"), "left_semi")


def message_feed(messages: DataFrame, since: int | None = None, agent: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """The last messages (1 to 500 of them) that match, in their order."""
    if since is not None:
        messages = messages.filter(F.col("ts") >= since)
    if agent is not None:
        messages = messages.filter((F.col("from") == agent) | (F.col("to") == agent))
    if kind is not None:
        messages = messages.filter(F.col("msg_type") == kind)
    return messages.orderBy(F.desc("seq")).limit(min(500, max(1, limit))).orderBy("seq")


def with_freshness(rows: DataFrame, as_of: int) -> DataFrame:
    """Adds stale: last updated over 30 days before as_of."""
    return rows.withColumn("stale", F.lit(as_of) - F.col("updated_at") > STALE_MS)
