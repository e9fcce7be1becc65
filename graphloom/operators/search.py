"""Hybrid retrieval: keyword, vector, graph and file-name search, and their fusion.

Every arm returns key, node_id, file_path, content, updated_at and score, limited
to its best rows, so that what the fusion sorts is small whatever the corpus holds.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns and arm weights of the two special intents, the default
# weights, candidate and score limits.
INTENTS = [
    ("trace|flow|impact|depends|breaks|removes?|calls?|imports?|architecture|relationship", (0.2, 0.2, 0.6, 0.0)),
    ("where is|find|locate|file|function|class|interface|code", (0.4, 0.15, 0.15, 0.5)),
]
DEFAULT_INTENT = (0.35, 0.35, 0.15, 0.15)
ARMS = ("fts", "semantic", "graph", "file")
CANDIDATES, PER_TOKEN, LEAST_COSINE, RRF_K, CONTEXT_CHARS = 50, 10, 0.25, 60, 6000
MONTH_MS = 30 * 86_400_000
COLUMNS = ["key", "node_id", "file_path", "content", "updated_at", "score"]


def classify(text: Column) -> Column:
    """The arm weights of a query as a struct (fts, semantic, graph, file)."""
    weights = lambda w: F.struct(*[F.lit(x).alias(n) for n, x in zip(ARMS, w)])
    low = F.lower(text)
    first, second = INTENTS
    return F.when(low.rlike(first[0]), weights(first[1])).when(low.rlike(second[0]), weights(second[1])).otherwise(weights(DEFAULT_INTENT))


def intent(query: str) -> tuple[float, ...]:
    return next((w for p, w in INTENTS if re.search(p, query.lower())), DEFAULT_INTENT)


def tokens(text: Column) -> Column:
    """Lower-case tokens of more than two characters, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^a-zA-Z0-9_\-.]+"), lambda t: F.length(t) > 2)


def tokenize(query: str) -> list[str]:
    return [t for t in re.split(r"[^a-zA-Z0-9_\-.]+", query.lower()) if len(t) > 2]


def keyword_search(chunks: DataFrame, query: str, limit: int = 8, candidates: int | None = CANDIDATES) -> DataFrame:
    """Chunks that hold a token (where _ stands for any character), the first
    ``candidates`` by id (None: all), scored by tokens over length."""
    words = tokenize(query)
    low = F.lower("content")
    likes = [low.contains(w) if "_" not in w else low.like(f"%{w}%") for w in words]
    held = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    rows = chunks.filter(reduce(Column.__or__, likes, F.lit(False)))
    if candidates is not None:
        rows = rows.orderBy("id").limit(candidates)
    score = held / (1 + F.log(F.length("content")) / 10)
    rows = rows.select(F.col("id").alias("key"), "node_id", "file_path", "content", "updated_at", F.round(score, 9).alias("score"))
    return rows.orderBy(F.desc("score"), "key").limit(limit)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a query vector, in double; null for another length or a zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = math.sqrt(sum(x * x for x in query))
    return F.when((F.size(vector) == len(query)) & (norm > 0) & F.lit(size > 0), dot / (norm * F.lit(size or 1.0)))


def semantic_search(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int = 8) -> DataFrame:
    """The chunks of greatest cosine above 0.25. The best vectors are found before
    their chunks are joined, so texts of other chunks are never moved."""
    near = vectors.select(F.col("chunk_id").alias("key"), F.round(cosine(F.col("vector"), query), 9).alias("score"))
    near = near.filter(F.col("score") > LEAST_COSINE).orderBy(F.desc("score"), "key").limit(limit)
    rows = chunks.select(F.col("id").alias("key"), "node_id", "file_path", "content", "updated_at")
    return rows.join(F.broadcast(near), "key").select(*COLUMNS)  # at most ``limit`` rows


def graph_search(nodes: DataFrame, edges: DataFrame, query: str | list[str], limit: int = 8) -> DataFrame:
    """Nodes that a token (of a question, or of a list) names (ten for each token, by id) score 1, their
    neighbours 0.7, those with content only."""
    words = list(dict.fromkeys(tokenize(query) if isinstance(query, str) else query))
    spark = nodes.sparkSession
    tokens_df = spark.createDataFrame([(w,) for w in words], "token string")  # the words of one query
    slim = nodes.select("id", F.lower("label").alias("low"), F.lower("id").alias("low_id"))
    named = slim.join(F.broadcast(tokens_df), F.contains("low", "token") | F.contains("low_id", "token"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy("id"))
    direct = named.withColumn("n", rank).filter(F.col("n") <= PER_TOKEN).select("id").distinct()
    # one pass over the edges, each taken from both of its ends
    pair = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
    ends = edges.select(F.inline(F.array(pair("source", "target"), pair("target", "source"))))
    beside = ends.join(F.broadcast(direct), "id").select(F.col("other").alias("id")).distinct()
    scored = direct.withColumn("score", F.lit(1.0)).union(beside.withColumn("score", F.lit(0.7)))
    scored = scored.groupBy("id").agg(F.max("score").alias("score"))
    rows = nodes.filter("content is not null").join(scored, "id")
    rows = rows.select(F.col("id").alias("key"), F.col("id").alias("node_id"), F.col("source_file").alias("file_path"), "content", "updated_at", "score")
    return rows.orderBy(F.desc("score"), "key").limit(limit)


# Word endings that the file arm takes off, in this order.
ENDINGS = ["izations?$", "ation$", "ings?$", "ed$", "es$", "s$"]


def stem(word: Column) -> Column:
    for ending in ENDINGS:
        word = F.regexp_replace(word, ending, "")
    return word


def file_search(chunks: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """One chunk (the first lines) of each file whose base name matches a token:
    1 for the word itself, 0.85 for its stem, 0.6 for a part of it; deeper paths
    score less. Paths are scored before chunks are joined."""
    words = list(dict.fromkeys(w for w in re.split(r"[^a-zA-Z0-9_\-]+", query.lower()) if len(w) > 2))
    name = F.lower(F.element_at(F.split("file_path", "/"), -1))
    paths = chunks.select("file_path").distinct().withColumn("name", name).withColumn("base", F.regexp_replace("name", r"\.[^.]+$", ""))
    paths = paths.withColumn("parts", F.array_distinct(F.concat(F.array("name", "base"), F.split("base", "[._-]+"))))
    paths = paths.withColumn("stems", F.array_distinct(F.transform("parts", stem)))  # once a file, not once a word

    def hit(word: str) -> Column:
        root = word
        for ending in ENDINGS:
            root = re.sub(ending, "", root)
        alike = lambda x: (x == root) | (F.left(x, F.lit(5)) == root[:5]) if len(root) >= 5 else x == root
        part = (F.col("base").contains(word) | F.contains(F.lit(word), F.col("base"))) if len(word) >= 4 else F.lit(False)
        return F.when(F.array_contains("parts", word), 1.0).when(F.exists("stems", alike), 0.85).when(part, 0.6).otherwise(0.0)

    best = paths.withColumn("best", F.array_max(F.array(F.lit(0.0), *map(hit, words)))).filter("best > 0")
    score = F.col("best") / (1 + F.log(F.size(F.split("file_path", "/"))))
    top = best.select("file_path", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "file_path").limit(limit)
    rows = chunks.join(F.broadcast(top), "file_path")  # at most ``limit`` paths
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))
    rows = rows.withColumn("n", first).filter("n = 1")
    return rows.select(F.col("id").alias("key"), "node_id", "file_path", "content", "updated_at", "score").orderBy(F.desc("score"), "key")


def recency(updated_at: Column, as_of: int) -> Column:
    """1 / (1 + age in months), 0.5 at least; 1 without a time or from the future."""
    age = F.lit(as_of) - updated_at
    return F.when(updated_at.isNull() | (age < 0), 1.0).otherwise(F.greatest(F.lit(0.5), 1 / (1 + age / MONTH_MS)))


def fuse(arms: dict[str, DataFrame], weights: tuple[float, ...], as_of: int, limit: int = 8) -> DataFrame:
    """Scores over the arm's best, times weight and recency, summed by key. The
    source is the last arm (in order) that gave more than all before it."""
    rows = None
    for n, (name, weight) in enumerate(zip(ARMS, weights)):
        if name in arms:
            arm = arms[name].select(*COLUMNS).withColumns({"arm": F.lit(n), "weight": F.lit(weight)})
            rows = arm if rows is None else rows.unionByName(arm)
    top = F.max("score").over(Window.partitionBy("arm"))
    share = F.when(top > 0, F.col("score") / top).otherwise(F.col("score"))
    rows = rows.withColumn("boost", share * F.col("weight") * recency(F.col("updated_at"), as_of))
    ordered = F.array_sort(F.collect_list(F.struct("arm", "boost")))
    names = F.array(*map(F.lit, ARMS))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("arm"))
    fold = lambda s, x: F.struct((s.sum + x.boost).alias("sum"), F.when((x.boost > s.sum) | (s.arm < 0), x.arm).otherwise(s.arm).alias("arm"))
    grouped = rows.groupBy("key").agg(
        F.aggregate(ordered, state, fold).alias("s"),
        F.min_by(F.struct("node_id", "file_path", "content", "updated_at"), "arm").alias("p"),
    )
    out = grouped.select("key", "p.*", F.round("s.sum", 6).alias("score"), F.get(names, F.col("s.arm")).alias("source"))
    return out.orderBy(F.desc("score"), "key").limit(limit)


def retrieve(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, as_of: int, limit: int = 8) -> DataFrame:
    """All arms and their fusion for one question."""
    arms = {
        "fts": keyword_search(chunks, query, limit),
        "graph": graph_search(nodes, edges, query, limit),
        "file": file_search(chunks, query, limit),
    }
    if vectors is not None and vector is not None:
        arms["semantic"] = semantic_search(chunks, vectors, vector, limit)
    return fuse(arms, intent(query), as_of, limit)


def context_blocks(ranked: DataFrame, chars: int = CONTEXT_CHARS) -> DataFrame:
    """Of rows (rank, content), those before the first that would pass ``chars``
    characters in all. The rows are a search result, so one window holds them."""
    total = F.sum(F.length("content")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = ranked.withColumn("total", total)
    over = F.min(F.when(F.col("total") > chars, F.col("rank"))).over(Window.partitionBy())
    return rows.withColumn("over", over).filter("over is null or rank < over").drop("over")


def rank_fusion(lists: list[DataFrame], limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank from 1); ties go to the
    list, then the rank, that came first."""
    rows = None
    for n, one in enumerate(lists):
        one = one.select("key", "rank", F.lit(n).alias("list"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy("key").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return out.orderBy(F.desc("score"), "first").limit(limit).select("key", "score")


def boost_active(results: DataFrame, path: str, by: float = 0.25) -> DataFrame:
    """Results in the active file score more."""
    score = F.col("score") + F.when(F.col("file_path") == path, by).otherwise(0.0)
    return results.withColumn("score", F.round(score, 6))


def normalized(vector: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(vector, lambda x: x.cast("double") / size)).otherwise(F.transform(vector, lambda x: x.cast("double")))



def related(chunks: DataFrame, vectors: DataFrame, query: list[float], limit: int = 5, chars: int = 300) -> DataFrame:
    """(file_path, content, score) of what is nearest in meaning, the text cut."""
    found = semantic_search(chunks, vectors, query, limit * 2).orderBy(F.desc("score"), "key").limit(limit)
    return found.select("file_path", F.substring("content", 1, chars).alias("content"), "score")


def search_memories(local: DataFrame, remote: DataFrame, limit: int = 8, active: str | None = None, by: float = 0.25) -> DataFrame:
    """(key, file_path, score, place): local and remote results (key, file_path,
    rank) fused by rank; what lies in, under or beside the active file goes first
    by its boosted score. Both lists are results of limited searches."""
    fused = rank_fusion([local, remote], limit)
    paths = local.select("key", "file_path").unionByName(remote.select("key", "file_path")).groupBy("key").agg(F.min("file_path").alias("file_path"))
    first = local.select("key", "rank", F.lit(0).alias("list")).unionByName(remote.select("key", "rank", F.lit(1).alias("list")))
    first = first.groupBy("key").agg(F.min(F.struct("list", "rank")).alias("first"))
    rows = fused.join(paths, "key").join(first, "key")
    boost = F.when(F.contains(F.lower(F.coalesce("file_path", F.lit(""))), F.lit((active or "").lower())) & F.lit(bool(active)), by).otherwise(0.0)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("score") + boost), "first"))  # at most ``limit`` rows
    return rows.select("key", "file_path", "score", place.alias("place"))
