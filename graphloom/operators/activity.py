"""Who did what: agent actions, decisions, memories, authorship and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import spread

# Relations of an organisation chart, and what marks a writing tool.
ORG_RELATIONS = ["contributes_to", "works_in", "owns", "depends_on"]
WRITING = "write|replace"


def agent_actions(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, target): writing tool calls of transcripts (conversation, step, calls
    array<struct<name, target>>) whose target file is a node."""
    calls = steps.select("conversation", "step", F.posexplode("calls").alias("pos", "call")).filter(F.lower("call.name").rlike(WRITING))
    action = F.concat_ws("_", F.concat(F.lit("agent_action::"), F.substring(F.col("conversation").cast("string"), 1, 8)), F.col("step").cast("string"), F.col("pos").cast("string"))
    rows = calls.select(action.alias("id"), F.concat(F.lit("file::"), "call.target").alias("target"))
    return rows.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target")


def decision_rows(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ``documents`` edges of decisions (id, title, text, path, at)."""
    node = F.concat(F.lit("decision::"), F.col("id").cast("string"))
    nodes = decisions.select(node.alias("id"), F.col("title").alias("label"), F.lit("adr").alias("type"), F.col("text").alias("content"), F.col("at").alias("updated_at"))
    edges = decisions.filter("path is not null").select(node.alias("source"), F.concat(F.lit("file::"), "path").alias("target"), F.lit("documents").alias("relation"))
    return nodes, edges


def memory_rows(memories: DataFrame) -> DataFrame:
    """Nodes of memories (id, text, kind, at): the label is the first 80 characters,
    the kind is insight where missing."""
    kind = F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit("insight"))
    return memories.select(
        F.concat(F.lit("memory::"), F.col("id").cast("string")).alias("id"), F.substring("text", 1, 80).alias("label"), F.lit("agent_action").alias("type"), kind.alias("kind"), F.col("at").alias("updated_at")
    )


def authorship_edges(blame: DataFrame) -> DataFrame:
    """``owns`` edges weighted by lines, and ``created_by`` edges to the author of the
    oldest line, from blame rows (file, author, ts)."""
    per = blame.groupBy("file", "author").agg(F.count(F.lit(1)).alias("lines"), F.min("ts").alias("first"))
    owns = per.select(F.col("author").alias("source"), F.col("file").alias("target"), F.lit("owns").alias("relation"), F.col("lines").cast("double").alias("weight"))
    first = per.groupBy("file").agg(F.min_by("author", F.struct("first", "author")).alias("author"))
    return owns.unionByName(first.select(F.col("file").alias("source"), F.col("author").alias("target"), F.lit("created_by").alias("relation"), F.lit(1.0).alias("weight")))


def stale_files(files: DataFrame, indexed_at: int) -> DataFrame:
    """(stale): files that changed after the index was built."""
    return files.agg(F.count_if(F.col("modified") > indexed_at).alias("stale"))


def org_report(persons: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in, linked) of every person over the organisation's relations."""
    some = edges.filter(F.col("relation").isin(ORG_RELATIONS))
    ends = some.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(some.select("target", F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    rows = persons.select("id").join(counts, "id", "left")
    return rows.select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"), F.col("n_out").isNotNull().alias("linked"))


def commit_keywords(words: list[str], commits: DataFrame, last: int = 60, limit: int = 5) -> DataFrame:
    """Of the last commits (seq, subject), those that hold most of a decision's words;
    words that more than half of them hold, or none, don't count."""
    recent = commits.orderBy(F.desc("seq")).limit(last)
    each = recent.select("seq", F.explode(F.array(*map(F.lit, words[:6]))).alias("word"), F.lower("subject").alias("subject"))
    hits = each.filter(F.contains("subject", "word")).select("seq", "word")
    total = recent.agg(F.count(F.lit(1)).alias("total"))
    useful = hits.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).filter("n * 2 <= total")  # one row
    ranked = hits.join(useful.select("word"), "word", "left_semi").groupBy("seq").agg(F.count(F.lit(1)).alias("hits"))
    return ranked.orderBy(F.desc("hits"), F.desc("seq")).limit(limit)


# Words of a decision that say nothing of it, and how its words are chosen.
COMMON = "the and for with fix feat from into when this that make made use using add added update updated".split()
LEAST_LETTERS, MOST_WORDS = 4, 6


def decision_words(decisions: DataFrame) -> DataFrame:
    """(id, words): the first six different words of four letters or more in label and
    content of each decision, without the common ones. Null texts are empty."""
    text = F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("content", F.lit(""))))
    words = F.filter(F.split(text, "[^a-z0-9]+"), lambda w: (F.length(w) >= LEAST_LETTERS) & ~w.isin(COMMON))
    return decisions.select("id", F.slice(F.array_distinct(words), 1, MOST_WORDS).alias("words"))


#: Bits of a number that stand for commits.
BITS = 63


def decision_commits(decisions: DataFrame, commits: DataFrame, last: int = 60, limit: int = 5) -> DataFrame:
    """(id, seq, hits): for each decision (id, label, content), any number of them, the
    ``limit`` of the last commits (seq, subject) that hold most of its words, then the
    latest. Words that more than half of these commits hold, or none, don't count.

    A word may stand inside a longer one. Both are runs of letters and digits, so it is
    enough to look into the log's words: an index of their four-letter pieces meets the
    decisions' words by the first four letters, and each hit is then looked at. A word
    brings the commits that hold it as bits, so a decision is a row for each of its words
    and not for each of the commits, and decisions are dealt by id before that."""
    dealt = decision_words(decisions).repartition("id")
    by_seq = Window.orderBy(F.desc("seq"))  # the last commits alone
    recent = commits.orderBy(F.desc("seq")).limit(last).withColumn("place", F.dense_rank().over(by_seq) - 1)
    runs = F.array_distinct(F.split(F.lower("subject"), "[^a-z0-9]+"))
    held = recent.select("place", F.explode(runs).alias("run")).filter(F.length("run") >= LEAST_LETTERS)
    at = F.sequence(F.lit(1), F.length("run") - LEAST_LETTERS + 1)
    pieces = held.select("run").distinct().select("run", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr("run", i, F.lit(LEAST_LETTERS))))).alias("piece"))
    asked = dealt.select(F.explode("words").alias("word")).distinct().withColumn("piece", F.substring("word", 1, LEAST_LETTERS))
    inside = asked.join(F.broadcast(pieces), "piece").filter(F.contains("run", "word")).select("word", "run")
    places = inside.join(F.broadcast(held), "run").groupBy("word").agg(F.collect_set("place").alias("places"))
    total = recent.agg(F.count(F.lit(1)).alias("total"))
    useful = places.join(F.broadcast(total)).filter(F.size("places") * 2 <= F.col("total"))  # one row
    groups = F.sequence(F.lit(0), F.lit((last - 1) // BITS))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p % BITS)
    bits = F.transform(groups, lambda g: F.aggregate(F.filter("places", lambda p: F.floor(p / BITS) == g), F.lit(0).cast("long"), lambda s, p: s + bit(p)))
    # words that stand in the last commits: no more than the parts of their words
    index = F.broadcast(useful.select("word", bits.alias("bits")))
    found = dealt.select("id", F.explode("words").alias("word")).join(index, "word").groupBy("id").agg(F.collect_list("bits").alias("b"))
    hits = lambda p: F.aggregate("b", F.lit(0).cast("long"), lambda n, x: n + F.getbit(F.get(x, F.floor(p / BITS).cast("int")), p % BITS))
    scored = F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda p: F.struct(hits(p).alias("hits"), (-p).alias("back")))
    best = F.slice(F.sort_array(F.filter(scored, lambda x: x.hits > 0), asc=False), 1, limit)
    seqs = recent.select((-F.col("place")).alias("back"), "seq").distinct()
    return found.select("id", F.inline(best)).join(F.broadcast(seqs), "back").select("id", "seq", "hits")


def provenance_confidence(rows: DataFrame) -> DataFrame:
    """Adds confidence from what is known of a decision (booleans content, who, files,
    commits, conversation, related)."""
    parts = {"content": 0.2, "who": 0.25, "files": 0.2, "commits": 0.15, "conversation": 0.1, "related": 0.1}
    score = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return rows.withColumn("confidence", F.round(score, 2))


# What ties a decision to files, and authors to files.
FILE_RELATIONS = ["documents", "affects", "implements", "changed", "generated", "references"]
AUTHOR_RELATIONS = ["created_by", "owns"]
DAY_MS = 86_400_000
MOST = {"who": 12, "file": 15, "commit": 8}


def _near(asked: DataFrame, rows: DataFrame, span: int) -> DataFrame:
    """(decision, then rows' columns) for rows (ts, ...) within ``span`` days of an
    asked decision (id, created_at). Both sides meet on days, so no pair far apart is
    compared."""
    days = F.sequence(F.floor(F.col("created_at") / DAY_MS) - span, F.floor(F.col("created_at") / DAY_MS) + span)
    spread = asked.select(F.col("id").alias("decision"), "created_at", F.explode(days).alias("day"))
    near = rows.withColumn("day", F.floor(F.col("ts") / DAY_MS)).join(spread, "day")
    return near.filter(F.abs(F.col("ts") - F.col("created_at")) <= span * DAY_MS).drop("day", "created_at")


def _latest(rows: DataFrame, most: int) -> DataFrame:
    """Of (decision, id, relation, ts) the ``most`` latest of each decision."""
    # Spark keeps a rank limit within a window's group while it sorts
    place = F.row_number().over(Window.partitionBy("decision").orderBy(F.desc("ts"), F.desc("id"), F.desc("relation")))
    each = rows.select("decision", "ts", "id", "relation").distinct().withColumn("place", place)
    return each.filter(F.col("place") <= most).select("decision", "id", "relation")


def provenance(asked: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame, messages: DataFrame, span: int = 14) -> DataFrame:
    """(decision, kind, id, relation): the evidence for each asked decision (id,
    created_at), which are nodes that a reader opens.

    who: persons and agents with an edge to it, else authors of files that changed
    within ``span`` days; file: files it points to, else files that changed then;
    commit and conversation: commits and messages (id, ts) of these days; task: tasks
    tied to it; related: the other decisions, earlier or later. Nodes have id, type,
    created_at and last_modified."""
    kind = nodes.select(F.col("id").alias("other"), "type")
    inward = edges.join(asked.select(F.col("id").alias("target")), "target").select(F.col("target").alias("decision"), F.col("source").alias("other"), "relation", F.lit("in").alias("way"))
    outward = edges.join(asked.select(F.col("id").alias("source")), "source").select(F.col("source").alias("decision"), F.col("target").alias("other"), "relation", F.lit("out").alias("way"))
    beside = inward.unionByName(outward).join(kind, "other")
    pick = lambda rows, name: rows.select("decision", F.lit(name).alias("kind"), F.col("other").alias("id"), "relation").distinct()
    who = pick(beside.filter((F.col("way") == "in") & F.col("type").isin("person", "agent")), "who")
    files = pick(beside.filter((F.col("way") == "out") & (F.col("type") == "file") & F.col("relation").isin(FILE_RELATIONS)), "file")
    tasks = pick(beside.filter("type = 'task'"), "task")
    without = lambda found: asked.join(found.select(F.col("decision").alias("id")), "id", "left_anti")
    changed = nodes.filter("type = 'file' AND last_modified IS NOT NULL").select("id", F.col("last_modified").alias("ts"))
    near_files = _near(without(files), changed, span).withColumn("relation", F.lit("modified-near-date"))
    then = _near(without(who), changed.withColumnRenamed("id", "target"), span)
    authors = edges.filter(F.col("relation").isin(AUTHOR_RELATIONS)).select("source", "target").join(then, "target").select("decision", F.col("source").alias("id"))
    authors = authors.join(nodes.filter("type = 'person'").select("id"), "id", "left_semi").distinct()
    named = lambda rows, name: rows.select("decision", F.lit(name).alias("kind"), "id", "relation")
    out = who.unionByName(files).unionByName(tasks)
    out = out.unionByName(named(_latest(authors.withColumns({"relation": F.lit("author-near-date"), "ts": F.lit(0)}), MOST["who"]), "who"))
    out = out.unionByName(named(_latest(near_files, MOST["file"]), "file"))
    out = out.unionByName(named(_latest(_near(asked, commits, span).withColumn("relation", F.lit("in-window")), MOST["commit"]), "commit"))
    out = out.unionByName(named(_near(asked, messages, span).withColumn("relation", F.lit("in-window")), "conversation"))
    other = nodes.filter((F.col("type") == "adr") | F.col("id").startswith("decision::")).select(F.col("id").alias("other"), F.col("created_at").alias("at"))
    relation = F.when(F.col("at") < F.col("created_at"), "earlier").otherwise("later")
    pairs = asked.join(other, F.col("id") != F.col("other")).select(F.col("id").alias("decision"), F.lit("related").alias("kind"), F.col("other").alias("id"), relation.alias("relation"))
    return out.unionByName(pairs)


def evidence_confidence(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, confidence) of asked decisions (id, content) from their evidence."""
    has = {c: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(c) for c, k in {"who": "who", "files": "file", "commits": "commit", "conversation": "conversation", "related": "related"}.items()}
    rows = asked.join(evidence.withColumnRenamed("id", "found").withColumnRenamed("decision", "id"), "id", "left").groupBy("id", "content").agg(*has.values())
    return provenance_confidence(rows.withColumn("content", F.coalesce(F.col("content") != "", F.lit(False)))).select("id", "confidence")


def merge_first(old: DataFrame, new: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Old rows and the new ones of keys that are not there yet, each once; new rows are
    kept by key in ``tasks`` tasks, if given."""
    return old.unionByName(spread(new, tasks, *keys).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))
