"""Joins between nodes, edges, chunks, vectors and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import spread

#: Tasks, at least, that rows are dealt to before each is kept by a key of its own. Up to
#: 200 Spark writes a shuffle without holding rows.
TASKS = 200


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to many tasks, so that what one of them keeps stays small."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(TASKS, most), *keys)


def all_neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, neighbor, neighbor_label, relation, direction) for every edge end."""
    ends = nodes.select(F.col("id").alias("neighbor"), F.col("label").alias("neighbor_label"))
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbor"), "relation", F.lit("out").alias("direction"))
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("neighbor"), "relation", F.lit("in").alias("direction"))
    return out.unionByName(back).join(ends, "neighbor")


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Neighbours of one node. The filter reaches both scans of the edges."""
    mine = edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    return all_neighbors(nodes, mine).filter(F.col("id") == node_id)


def neighbor_counts(nodes: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """(type, relation, direction, n): how many edge ends of each kind the nodes of a
    type have. Ends are counted by id before they meet the nodes, in ``tasks`` tasks, if given."""
    end = lambda c, d: F.struct(F.col(c).alias("id"), "relation", F.lit(d).alias("direction"))
    ends = edges.select(F.inline(F.array(end("source", "out"), end("target", "in"))))
    counts = spread(ends, tasks, "id").groupBy("id", "relation", "direction").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(nodes.select("id", "type"), "id").groupBy("type", "relation", "direction").agg(F.sum("n").alias("n"))


def embedded_chunks(chunks: DataFrame, vectors: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Chunks with their vector and, given nodes, their node's community."""
    rows = chunks.join(vectors.select(F.col("chunk_id").alias("id"), "vector"), "id")
    rows = rows.select(F.col("id").alias("chunk_id"), "vector", "file_path", "content", "node_id")
    if nodes is None:
        return rows
    return rows.join(nodes.select(F.col("id").alias("node_id"), "community"), "node_id", "left")


def unembedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def people_near(nodes: DataFrame, edges: DataFrame, relations: list[str], since: int, until: int, limit: int = 12) -> DataFrame:
    """Persons tied to nodes that changed in a span of time."""
    near = nodes.filter(F.col("updated_at").between(since, until)).select(F.col("id").alias("target"))
    ties = edges.filter(F.col("relation").isin(relations)).join(near, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return nodes.filter(F.col("type") == "person").join(ties, "id", "left_semi").select("id", "label").orderBy("id").limit(limit)


def mentions(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(text_id, file_id) where a text names a file's base name as a word. Words
    are exploded and joined by equality, so no pair of text and file is compared;
    texts (text_id, content), files (file_id, path)."""
    words = texts.select("text_id", F.explode(F.array_distinct(F.split(F.lower("content"), r"[^a-z0-9_.\-]+"))).alias("word")).filter("word <> ''")
    named = files.select("file_id", F.lower(F.element_at(F.split("path", "/"), -1)).alias("word"))
    return words.join(named, "word").select("text_id", "file_id").distinct()


#: What parts the tokens of texts and names, and what may not stand beside a name's own letter or digit.
BETWEEN, INSIDE = r"[^\p{L}\p{N}_]+", r"[\p{L}\p{N}_]"


def file_mentions(texts: DataFrame, files: DataFrame) -> DataFrame:
    """(text_id, file_id) where a text holds a file's base name, in any case, and no
    letter or digit goes on at its ends: also before a full stop, behind a folder and
    with characters such as brackets, spaces or accents. Texts and names are cut into
    tokens in the same way; each name's longest token is joined by equality, and only
    names of more than that token are then looked for in the text. A name without any
    token is looked for in the runs between tokens in the same way."""
    lower = texts.select("text_id", F.lower("content").alias("content"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    named = files.select("file_id", name.alias("name")).filter("name <> ''").distinct()
    tokens = F.filter(F.split("name", BETWEEN), lambda t: t != "")
    named = named.withColumn("word", F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t)
    words = lower.select("text_id", F.explode(F.array_distinct(F.split("content", BETWEEN))).alias("word")).filter("word <> ''")
    pairs = words.join(named, "word").select("text_id", "file_id", "name", "word")
    sure = pairs.filter("name = word").select("text_id", "file_id")
    # the ends of a name are bounded only where they are a letter or digit
    quoted = F.regexp_replace("name", r"([^\p{L}\p{N}_])", r"\\$1")
    bound = lambda end, look: F.when(F.col("name").rlike(end), F.lit(look)).otherwise(F.lit(""))
    pattern = F.concat(bound("^" + INSIDE, f"(?<!{INSIDE})"), quoted, bound(INSIDE + r"\z", f"(?!{INSIDE})"))
    maybe = pairs.filter("name <> word").select(F.col("text_id").alias("id"), "file_id", "name").distinct()
    held = lower.join(maybe, F.col("text_id").eqNullSafe(F.col("id"))).filter(F.contains("content", "name") & F.regexp_like("content", pattern))
    # a name without any token lies inside a run of other characters: the runs' pieces of one
    # and two characters meet the names' first ones, and each hit is then looked at
    runs = F.array_distinct(F.regexp_extract_all("content", F.lit(BETWEEN), 0))
    other = lower.select("text_id", F.explode(runs).alias("run"))
    at = F.sequence(F.lit(1), F.length("run"))
    pieces = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substr("run", i, F.lit(1)), F.substr("run", i, F.lit(2))))))
    signs = named.filter("word is null").select("file_id", "name", F.substring("name", 1, 2).alias("piece"))
    odd = other.select("text_id", "run", F.explode(pieces).alias("piece")).join(signs, "piece").filter(F.contains("run", "name"))
    return sure.unionByName(held.select("text_id", "file_id")).unionByName(odd.select("text_id", "file_id")).distinct()


CANDIDATE_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]


def walked(path: Column, spec: Column) -> Column:
    """The parts of the path that a relative specifier in the file ``path`` stands for."""
    folder = F.array_join(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), "/")
    parts = F.filter(F.split(F.concat_ws("/", folder, spec), "/"), lambda p: (p != ".") & (p != ""))
    # '..' takes back the part before it
    return F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))),
    )


def resolve_imports(specs: DataFrame, files: DataFrame, most: int = 200) -> DataFrame:
    """(source, target): each relative specifier (path, spec, pos) of a file goes to
    the first of its candidate paths that is a file, other than the file itself."""
    tries = specs.filter(F.col("pos") < most).withColumn("base", F.array_join(walked(F.col("path"), F.col("spec")), "/"))
    ends = F.posexplode(F.array(*map(F.lit, CANDIDATE_ENDS))).alias("rank", "end")
    tries = tries.select("path", "spec", "base", ends).withColumn("candidate", F.concat("base", "end"))
    hits = tries.join(files.select(F.col("path").alias("candidate")), "candidate").filter("candidate <> path")
    best = hits.groupBy("path", "spec").agg(F.min_by("candidate", "rank").alias("target"))
    return best.select(F.col("path").alias("source"), "target").distinct()


def resolve_symbols(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """For uses (file, label, preferred), the symbol of that label in the same file:
    one of the preferred type first, then the first one (seq)."""
    joined = uses.join(symbols.select("file", "label", "id", "type", "seq"), ["file", "label"])
    rank = F.struct((F.col("type") != F.col("preferred")).alias("other"), F.col("seq"))
    return joined.groupBy("file", "label", "preferred").agg(F.min_by("id", rank).alias("id"))


def package_dependencies(repos: DataFrame) -> DataFrame:
    """(source, target) between repos (id, package, deps) by package name."""
    wants = repos.select(F.col("id").alias("source"), F.explode(F.array_distinct("deps")).alias("package"))
    has = repos.select(F.col("id").alias("target"), "package")
    return wants.join(has, "package").filter("source <> target").select("source", "target").distinct()


def path_prefixes(paths: DataFrame) -> DataFrame:
    """Adds each proper prefix (``prefix``) of ``path`` as a row of its own."""
    parts = F.split("path", "/")
    n = F.size(parts)
    prefixes = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return paths.withColumn("prefix", F.explode(prefixes))


def sizes_by_prefix(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, rel_path, node_count): nodes below each unit's path ('.': all nodes).
    Paths are exploded to their prefixes and joined by equality."""
    below = path_prefixes(nodes.filter("source_file is not null").select(F.col("source_file").alias("path")))
    counts = below.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    everything = nodes.agg(F.count(F.lit(1)).alias("total"))
    rows = units.join(counts, F.col("rel_path") == F.col("prefix"), "left").join(F.broadcast(everything))  # one row
    n = F.when(F.col("rel_path") == ".", F.col("total")).otherwise(F.coalesce("n", F.lit(0)))
    return rows.select("id", "rel_path", n.alias("node_count"))


def missing_children(repos: DataFrame, folders: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target) from a repo to the folders right below its path, where no
    such edge exists yet."""
    parent = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    right = folders.filter(F.col("path").contains("/")).select(F.col("id").alias("target"), parent.alias("rel_path"))
    pairs = repos.select(F.col("id").alias("source"), "rel_path").join(right, "rel_path").select("source", "target")
    return pairs.join(edges.select("source", "target"), ["source", "target"], "left_anti")


def roster(sessions: DataFrame, identities: DataFrame, starts: DataFrame) -> DataFrame:
    """Sessions with the latest identity and the start event, where known."""
    latest = identities.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))).filter("n = 1").drop("n", "seq")
    return sessions.join(latest, "session_id", "left").join(starts, "session_id", "left")
