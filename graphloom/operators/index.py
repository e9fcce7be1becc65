"""Indexing as composed steps: decisions, tasks, identities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.etl import checkbox_items, decision_records, specifiers
from graphloom.operators.graph import communities
from graphloom.operators.joins import file_mentions, package_dependencies, resolve_imports

ROOT = "workspace::root"
# Fixed value: the endings of modules whose imports are followed.
MODULES = r"\.(ts|tsx|js|jsx|mjs|cjs)$"


def edge(rows: DataFrame, source, target, relation: str, weight=None, confidence: float = 1.0) -> DataFrame:
    """rows as edges (source, target, relation, weight, confidence)."""
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    return rows.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), weight.alias("weight"), F.lit(confidence).alias("confidence"))


def index_decisions(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and links of decision records (path, content, supersedes: the
    path of an older record beside it, or null), with the files (id, path) that
    they name: the root contains each record, a record decides the files it names
    and supersedes the record that it says."""
    found = decision_records(records).join(records.select("path", F.col("content").alias("text"), "supersedes"), "path")
    node = F.concat(F.lit("adr::"), "path")
    body = F.concat(F.lit("Title: "), "title", F.lit("\nStatus: "), "status", F.lit("\n\nContext:\n"), "context", F.lit("\n\nDecision:\n"), "decision")
    nodes = found.select(node.alias("id"), F.col("title").alias("label"), F.lit("adr").alias("type"), F.col("path").alias("source_file"), body.alias("content"))
    named = file_mentions(found.select(node.alias("text_id"), F.col("text").alias("content")), files.select(F.col("id").alias("file_id"), "path"))
    older = found.filter("supersedes is not null")
    # a/b/c.md and ../x.md: the folder, then the steps up
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
    steps = F.filter(F.split(F.concat_ws("/", folder, "supersedes"), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))),
    )
    edges = (
        edge(nodes, F.lit(ROOT), F.col("id"), "contains")
        .unionByName(edge(named, F.col("text_id"), F.col("file_id"), "decides", confidence=0.8))
        .unionByName(edge(older, node, F.concat(F.lit("adr::"), F.array_join(walked, "/")), "supersedes"))
    )
    return nodes, edges, named.select(F.col("text_id").alias("adr_node_id"), F.col("file_id").alias("code_node_id"))


def task_mentions(files: DataFrame, known: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Task nodes of the task lists (path, content) and ``tracked_by`` edges from the
    known files (id, path) that a task names: by base name (of ``least`` characters
    or more), or by the whole path, which ends with it."""
    items = checkbox_items(files)
    short = F.length("title") > 50
    nodes = items.select("id", F.when(short, F.concat(F.substring("title", 1, 50), F.lit("..."))).otherwise(F.col("title")).alias("label"), F.lit("task").alias("type"), F.col("path").alias("source_file"), F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location"), "status")
    titles = items.select(F.col("id").alias("text_id"), F.col("title").alias("content")).distinct()
    hits = file_mentions(titles, known.select(F.col("id").alias("file_id"), "path"))
    both = hits.join(titles, "text_id").join(known.select(F.col("id").alias("file_id"), "path"), "file_id")
    hits = both.filter((F.length(F.element_at(F.split("path", "/"), -1)) >= least) | F.contains(F.lower("content"), F.lower("path"))).select("file_id", "text_id").distinct()
    return nodes, edge(hits, F.col("file_id"), F.col("text_id"), "tracked_by")


def contributors(commits: DataFrame, most: int | None = 2000) -> DataFrame:
    """(repo, person, name, email, commits) from commits (repo, seq, name, email): of
    a repo's last ``most`` commits (None: of all), how many each person made. A person is
    known by the mail address, else by name."""
    key = F.coalesce(F.when(F.col("email") != "", F.col("email")), F.when(F.col("name") != "", F.col("name")))
    recent = commits
    if most is not None:
        total = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
        # seq counts up from 1 in a repo, so the last ones are found without sorting them
        recent = commits.join(total, "repo").filter(F.col("seq") > F.col("total") - most)
    rows = recent.select("repo", "seq", key.alias("key"), "name", "email").filter("key is not null")
    per = rows.groupBy("repo", "key").agg(F.count(F.lit(1)).alias("commits"), F.max_by(F.struct("name", "email"), "seq").alias("x"))
    return per.select("repo", F.concat(F.lit("person::"), "key").alias("person"), "x.name", "x.email", "commits")


# The files of a repository that tell of it.
ABOUT = r"^(?:(.*)/)?(\.git/config|\.git/HEAD|package\.json)$"


def repo_identities(files: DataFrame) -> DataFrame:
    """(repo, label, remote, branch, package, deps) of the repositories among files
    (path, content): a folder with .git/HEAD or .git/config ("." for the root). The
    address of the remote ``origin``, the branch (HEAD if none is checked out), the
    package's name, and what it needs, at work or to be built, each once. What is not
    there, or no JSON, is null; deps are then empty."""
    repo = F.coalesce(F.when(F.regexp_extract("path", ABOUT, 1) != "", F.regexp_extract("path", ABOUT, 1)), F.lit("."))
    about = files.filter(F.col("path").rlike(ABOUT)).select(repo.alias("repo"), F.regexp_extract("path", ABOUT, 2).alias("file"), "content")
    # a column for each kind of file, not a list of files
    rows = about.groupBy("repo").agg(*[F.max(F.when(F.col("file") == f, F.col("content"))).alias(c) for f, c in ((".git/config", "config"), (".git/HEAD", "head"), ("package.json", "json"))])
    rows = rows.filter("config IS NOT NULL OR head IS NOT NULL")
    remote = F.regexp_extract("config", r"(?s)\[remote \"origin\"\][^\[]*?\n\s*url\s*=\s*([^\n\r]+)", 1)
    branch = F.when(F.col("head").rlike(r"^ref: refs/heads/"), F.regexp_extract("head", r"^ref: refs/heads/([^\n\r]+)", 1)).otherwise(F.when(F.col("head").isNotNull(), F.lit("HEAD")))
    keys = lambda part: F.coalesce(F.map_keys(F.from_json(F.get_json_object("json", f"$.{part}"), "map<string, string>")), F.array().cast("array<string>"))
    named = F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.name", "variant"))
    name = F.when(named == "STRING", F.get_json_object("json", "$.name"))
    label = F.element_at(F.split("repo", "/"), -1)
    return rows.select("repo", label.alias("label"), F.when(remote != "", F.trim(remote)).alias("remote"), branch.alias("branch"), name.alias("package"), F.array_union(keys("dependencies"), keys("devDependencies")).alias("deps"))


def identity_graph(repos: DataFrame, people: DataFrame, user: str | None, root: str = ROOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, persons and edges from repos (id, label, package, deps) and people
    (repo, person, name, email, commits): the root contains repos, people contribute
    to them by commits, the primary user owns and works in the workspace, and repos
    depend on each other by package name."""
    spark = repos.sparkSession
    nodes = repos.select("id", "label", F.lit("repo").alias("type")).unionByName(spark.createDataFrame([(root, root.split("::")[-1], "workspace")], "id string, label string, type string"))
    primary = F.col("person") == (user or "")
    persons = people.groupBy("person").agg(F.min_by(F.struct("name", "email"), "repo").alias("x")).select(
        F.col("person").alias("id"), "x.name", "x.email", F.when(primary, "owner").otherwise("contributor").alias("role"), primary.alias("is_primary")
    )
    edges = edge(repos, F.lit(root), F.col("id"), "contains").unionByName(edge(people, F.col("person"), F.col("repo"), "contributes_to", F.col("commits")))
    edges = edges.unionByName(edge(package_dependencies(repos.filter("package is not null")), F.col("source"), F.col("target"), "depends_on"))
    if user is not None:
        one = spark.range(1)
        persons = persons.filter(~F.col("is_primary")).unionByName(one.select(F.lit(user).alias("id"), F.lit(user.removeprefix("person::")).alias("name"), F.lit(user.removeprefix("person::")).alias("email"), F.lit("owner").alias("role"), F.lit(True).alias("is_primary")))
        edges = edges.unionByName(edge(one, F.lit(user), F.lit(root), "works_in")).unionByName(edge(one, F.lit(user), F.lit(root), "contributes_to"))
    return nodes, persons, edges


def import_edges(files: DataFrame) -> DataFrame:
    """``imports`` edges between modules (path, content)."""
    modules = files.filter(F.col("path").rlike(MODULES))
    pairs = resolve_imports(specifiers(modules), files.select("path"))
    named = lambda c: F.concat(F.lit("file::"), c)
    return edge(pairs, named("source"), named("target"), "imports", confidence=0.9)


def index_relations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``imports`` edges between modules (path, content), and the communities of more
    than one module that they make."""
    edges = import_edges(files)
    modules = files.filter(F.col("path").rlike(MODULES))
    return edges, communities(modules.select(F.concat(F.lit("file::"), "path").alias("id")), edges)
