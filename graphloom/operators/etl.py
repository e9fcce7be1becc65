"""From files to chunks, folders, headings, symbols, imports and tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES, OVERLAP, MOST_CHUNKS = 120, 12, 800


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def chunked(files: DataFrame, size: int = LINES, overlap: int = OVERLAP, most: int = MOST_CHUNKS) -> DataFrame:
    """(path, start_line, end_line, content): windows of ``size`` lines that share
    ``overlap`` lines with the one before; blank ones are skipped, ``most`` kept."""
    step = size - overlap
    all_lines = files.select("path", lines(F.col("content")).alias("lines")).withColumn("n", F.size("lines"))
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step).cast("int")), lambda k: k * step)
    window = lambda s: F.struct((s + 1).alias("start_line"), F.least(s + size, F.col("n")).alias("end_line"), F.array_join(F.slice("lines", s + 1, size), "\n").alias("content"))
    some = F.filter(F.transform(starts, window), lambda c: F.trim(F.regexp_replace(c.content, r"[\n\t\r]", "")) != "")
    return all_lines.select("path", F.explode(F.slice(some, 1, most)).alias("c")).select("path", "c.*")


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, content_hash) of files that are not empty and whose hash is new."""
    hashed = files.filter(F.length("content") > 0).select("path", F.sha1("content").alias("content_hash"))
    return hashed.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def folder_chain(paths: DataFrame) -> DataFrame:
    """Distinct (source, target) containment edges: each folder to the next one,
    the last to the file; files at the root have none."""
    parts = F.split("path", "/")
    at = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    links = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.struct(
                F.concat(F.lit("folder::"), at(i)).alias("source"),
                F.when(i == F.size(parts) - 1, F.concat(F.lit("file::"), F.col("path"))).otherwise(F.concat(F.lit("folder::"), at(i + 1))).alias("target"),
            ),
        ),
    )
    return paths.select(F.inline(links)).distinct()


def headings(files: DataFrame, span: int = 30) -> DataFrame:
    """(id, path, level, title, line): markdown headings; of equal titles in a file,
    the last one."""
    each = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    found = each.filter(F.col("line").rlike(r"^#{1,6}\s+\S"))
    title = F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1)
    rows = found.select("path", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), title.alias("title"), (F.col("pos") + 1).alias("start"))
    last = rows.groupBy("path", "title").agg(F.max_by("level", "start").alias("level"), F.max("start").alias("line"))
    mark = F.substring(F.sha1("title"), 1, 8)
    return last.select(F.concat(F.lit("heading::"), "path", F.lit(":"), mark).alias("id"), "path", "level", "title", "line")


# File endings, kind and form of a definition at the start of a line,
# in the order of the rules.
SCRIPT = r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|vue|svelte)$"
SYMBOLS = [
    (SCRIPT, "function", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
    (SCRIPT, "class", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    (SCRIPT, "interface", r"^(?:export\s+)?interface\s+(\w+)"),
    (r"\.py$", "function", r"^(?:async\s+)?def\s+(\w+)"),
    (r"\.py$", "class", r"^class\s+(\w+)"),
    (r"\.go$", "function", r"^func\s+(\w+)"),
    (r"\.go$", "interface", r"^type\s+(\w+)\s+(?:interface|struct)"),
]


SYMBOL_LINES, SYMBOL_CHARS = (120, 60), 4000


def symbols(files: DataFrame) -> DataFrame:
    """(path, type, name, line, end_line, content): definitions at the start of a
    line, by the first rule that fits. A symbol ends at the next line, fewer than
    120 lines on, that is a closing ) or } alone, with ; or , behind it perhaps, and
    not deeper than the definition; else 60 lines on or at the end of the file. Its
    content has 4,000 characters at most.

    Each line is looked at once, for a definition or for what closes one: rules are bound to
    the start of a line, so a definition is not indented, nor is the line that closes it.
    The file's lines are joined again only to the definitions."""
    split = files.select("path", lines(F.col("content")).alias("all"))
    ends = list(dict.fromkeys(end for end, _, _ in SYMBOLS))
    each = split.select("path", *[F.col("path").rlike(end).alias(f"of{k}") for k, end in enumerate(ends)], F.posexplode("all").alias("pos", "line"), F.size("all").alias("n"))
    rule = F.coalesce(*[F.when(F.col(f"of{ends.index(end)}") & F.col("line").rlike(p), k) for k, (end, _, p) in enumerate(SYMBOLS)])
    marks = each.select("path", "pos", "n", rule.alias("rule"), F.col("line").rlike(r"^[)}]\s*[;,]?\s*$").alias("closing"), "line").filter("rule IS NOT NULL OR closing")
    by_rule = lambda value: F.coalesce(*[F.when(F.col("rule") == k, value(t, p)) for k, (_, t, p) in enumerate(SYMBOLS)])
    marks = marks.select("path", "pos", "n", "closing", by_rule(lambda t, p: F.lit(t)).alias("type"), by_rule(lambda t, p: F.regexp_extract("line", p, 1)).alias("name"))
    most, else_ = SYMBOL_LINES
    behind = Window.partitionBy("path").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.last(F.when(F.col("closing"), F.col("pos")), ignorenulls=True).over(behind)
    found = marks.withColumn("closed", closed).filter(F.col("name").rlike("^[^_0-9]"))
    end = F.when(F.col("closed") - F.col("pos") < most, F.col("closed")).otherwise(F.least(F.col("n") - 1, F.col("pos") + else_))
    here = found.groupBy("path").agg(F.collect_list(F.struct("type", "name", "pos", end.alias("end"))).alias("defs"))
    # texts are cut out while a file is one row: a row for each definition with the whole
    # file would grow with the square of the file
    text = lambda d: F.substring(F.array_join(F.slice("all", d.pos + 1, d.end - d.pos + 1), "\n"), 1, SYMBOL_CHARS)
    rows = split.join(here, "path").select("path", F.inline(F.transform("defs", lambda d: F.struct(d.type.alias("type"), d["name"].alias("name"), d.pos.alias("pos"), d.end.alias("end"), text(d).alias("content")))))
    return rows.select("path", "type", "name", (F.col("pos") + 1).alias("line"), (F.col("end") + 1).cast("int").alias("end_line"), "content")


# The four ways in which a module names another by a relative path.
SPECIFIERS = [
    r"(?:from|import)\s*\(\s*[\"'](\.\.?/[^\"']+)[\"']\s*\)",
    r"from\s+[\"'](\.\.?/[^\"']+)[\"']",
    r"import\s*[\"'](\.\.?/[^\"']+)[\"']",
    r"require\s*\(\s*[\"'](\.\.?/[^\"']+)[\"']\s*\)",
]


def specifiers(files: DataFrame) -> DataFrame:
    """(path, spec, pos): distinct relative import specifiers of each file."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), 1) for p in SPECIFIERS])))
    return files.select("path", F.posexplode(found).alias("pos", "spec"))


def checkbox_items(files: DataFrame) -> DataFrame:
    """(id, path, line, status, title) of task-list items."""
    each = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    item = r"^\s*-\s*\[([ xX/])\]\s+(.+)$"
    rows = each.filter(F.col("line").rlike(item))
    mark, title = F.regexp_extract("line", item, 1), F.trim(F.regexp_extract("line", item, 2))
    status = F.when(mark == " ", "todo").when(mark == "/", "in_progress").otherwise("done")
    task = F.concat(F.lit("task::"), F.md5(F.concat("path", F.lit(":"), title)))
    return rows.select(task.alias("id"), "path", (F.col("pos") + 1).alias("line"), status.alias("status"), title.alias("title"))


def decision_records(files: DataFrame) -> DataFrame:
    """(path, title, status, context, decision, consequences): markdown decision
    records by their headings. Each line belongs to the last heading above it; a
    record without a title, or with neither context nor decision, is none."""
    text = F.concat(F.lit("\n"), F.regexp_replace("content", "\r\n", "\n"), F.lit("\n## \n"))
    part = lambda name: F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)\n##[ \t]+{name}[^\n]*\n(.*?)(?=\n##[ \t])", 1), r"^\s+|\s+$", ""))
    rows = files.select(
        "path", F.trim(F.regexp_extract(text, r"\n#[ \t]+([^\n]+)", 1)).alias("title"),
        F.lower(F.regexp_extract(part("status"), r"^(\w+)", 1)).alias("status"), part("context").alias("context"), part("decision").alias("decision"),
        F.regexp_extract_all(part("consequences"), F.lit(r"(?m)^[-*][ \t]+(.+)$"), 1).alias("consequences"),
    )
    return rows.filter("title <> '' AND (context <> '' OR decision <> '')")


def next_workers(rows: DataFrame) -> DataFrame:
    """The pool size that follows from (elapsed_ms, workers, most, least, rate, before):
    rates are for one worker."""
    share = F.col("rate") / F.col("before")
    size = (
        F.when(F.col("elapsed_ms") < 1000, F.col("workers")).when(F.col("workers") >= F.col("most"), F.col("workers"))
        .when(F.col("before") <= 0, F.col("workers") + 1).when(share >= 0.95, F.col("workers") + 1)
        .when((share < 0.7) & (F.col("workers") > F.col("least")), F.col("workers") - 1).otherwise(F.col("workers"))
    )
    return rows.withColumn("next", size)


def smoothed_rate(rows: DataFrame, key: str, alpha: float = 0.25) -> DataFrame:
    """(key, rate): the exponentially weighted rate of (key, seq, value), oldest first.

    The rate is a weighted sum: a value counts alpha * (1 - alpha)^k if k follow it,
    the first one (1 - alpha)^k. Values with so many after them that their weight is
    below 1e-18 add nothing, so a key's last values are enough; each task keeps its
    own last ones before they meet, and a key of any size stays small."""
    last = math.ceil(math.log(1e-18) / math.log(1 - alpha))
    value = F.struct(F.col("seq"), F.col("value").cast("double").alias("value"))
    # the greatest rows of a key, by seq: parts of the keys first, then the keys
    part = rows.withColumn("__part", F.spark_partition_id())
    head = F.slice(F.sort_array(F.collect_list("v"), asc=False), 1, last)
    by_part = Window.partitionBy(key, "__part").orderBy(F.desc("seq"), F.desc("value"))
    kept = part.withColumn("__n", F.row_number().over(by_part)).filter(F.col("__n") <= last)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tops = kept.select(key, value.alias("v")).groupBy(key).agg(head.alias("v"))
    weight = lambda k, n: F.pow(F.lit(1 - alpha), k) * F.when(k == n - 1, 1.0).otherwise(alpha)
    terms = F.transform("v", lambda x, k: x.value * weight(k, F.col("n")))
    return tops.join(counts, key).select(key, F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 6).alias("rate"))
