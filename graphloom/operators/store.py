"""Writers and readers of the stored graph: replace by key, communities, persons,
links, imports, and what is still to be embedded or sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.merge import add_edges, keep_last, upsert_nodes


def file_hashes(nodes: DataFrame) -> DataFrame:
    """(id, content_hash) of file nodes that have a hash; changed files are found by
    an anti join with it."""
    return nodes.filter((F.col("type") == "file") & F.col("content_hash").isNotNull()).select("id", "content_hash")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Insert or replace: of the new rows of a key the last one (order) stands for
    whatever the key held."""
    fresh = keep_last(new, keys, order).select(*old.columns)
    return old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh)


def set_communities(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with the community of found (id, community); others keep their own."""
    rows = nodes.join(found.select("id", F.col("community").alias("found")), "id", "left")
    return rows.withColumn("community", F.coalesce("found", "community")).select(*nodes.columns)


def person_rows(persons: DataFrame) -> DataFrame:
    """Persons ready to be stored: the name is the id without its prefix where it is
    missing or empty, the role contributor, not primary."""
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.regexp_replace("id", "person::", ""))
    email = F.when(F.col("email") != "", F.col("email"))
    return persons.withColumns(
        {"name": name, "email": email, "role": F.coalesce("role", F.lit("contributor")), "is_primary": F.coalesce("is_primary", F.lit(False))}
    )


def links_of(links: DataFrame, node_id: str) -> DataFrame:
    """The code nodes that a decision record is linked to."""
    return links.filter(F.col("adr_node_id") == node_id).select("code_node_id")


def import_graph(local: dict[str, DataFrame], remote: dict[str, DataFrame], tasks: int | None = None) -> dict[str, DataFrame]:
    """The tables after an import: nodes are upserted, edges only added (a weight
    that changed does not land), chunks and communities replaced by id. Nodes and new edges
    are kept by their keys in ``tasks`` tasks, if given."""
    seq = lambda rows: rows.withColumn("seq", F.lit(0))
    edges = add_edges(local["edges"], seq(remote["edges"]), tasks).select(*local["edges"].columns)
    return {
        "nodes": upsert_nodes(local["nodes"], remote["nodes"], tasks),
        "edges": local["edges"].unionByName(edges),
        "chunks": replace_rows(local["chunks"], seq(remote["chunks"]), ["id"]),
        "communities": replace_rows(local["communities"], seq(remote["communities"]), ["id"]),
    }


def to_push(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, label, content, embedded): every chunk as the node that is sent to a
    server, with or without its vector."""
    have = vectors.select(F.col("chunk_id").alias("id"), F.lit(True).alias("has"))
    rows = chunks.join(have, "id", "left")
    return rows.select(
        F.concat(F.lit("chunk:"), "file_path").alias("id"), F.element_at(F.split("file_path", "/"), -1).alias("label"), "content", F.coalesce("has", F.lit(False)).alias("embedded")
    )


def backfill(chunks: DataFrame, vectors: DataFrame, embed, width: int) -> DataFrame:
    """(chunk_id, vector, dimension) for the chunks without a vector; embed is a
    vectorized function of a text column that gives arrays of ``width`` floats.
    Chunks without text are left out."""
    missing = chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti").filter(F.length(F.trim("content")) > 0)
    return missing.select(F.col("id").alias("chunk_id"), embed("content").alias("vector"), F.lit(width).alias("dimension"))
