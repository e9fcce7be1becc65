"""Relations between the symbols of a file, by patterns: what extends, implements, calls
and uses what. No parser: lines are read on their own, and a sweep over the lines of a
file says in which symbol's block each of them lies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.etl import lines, symbols

# Files that are read, words before a bracket that are no calls, and how
# sure each kind of edge is.
TYPED = r"(?i)\.tsx?$"
NO_CALLS = "if for while switch catch function return typeof await new super import require constructor with".split()
CONFIDENCE = {"extends": 0.8, "implements": 0.8, "calls": 0.7, "uses": 0.7}
NAME = r"[A-Za-z_$][\w$]*"


def around(lines: list[int], ends: list[int]) -> list[int | None]:
    """The place of the innermost block that is open where each one begins."""
    found, open_ = [], []
    for k, line in enumerate(lines):
        while open_ and ends[open_[-1]] < line:
            open_.pop()
        found.append(open_[-1] if open_ else None)
        open_.append(k)
    return found


def nested(blocks: DataFrame) -> DataFrame:
    """Blocks (path, line, end_line, id) with ``parent``, the innermost block that is open
    where one begins (of those that begin in one line, the longest is the outermost).
    One pass over a file's blocks in order, with a stack of the open ones."""

    @F.pandas_udf("array<int>")
    def parents(lines: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([around(a.tolist(), b.tolist()) for a, b in zip(lines, ends)], dtype=object)

    block = F.struct("line", (-F.col("end_line")).alias("to"), "id")
    rows = blocks.groupBy("path").agg(F.sort_array(F.collect_list(block)).alias("b"))
    ordered = rows.select("path", "b", parents(F.transform("b", lambda x: x.line), F.transform("b", lambda x: -x.to)).alias("p"))
    one = lambda b, p: F.struct(b.line.alias("line"), (-b.to).cast("int").alias("end_line"), b.id.alias("id"), F.get(F.col("b"), p).id.alias("parent"))
    return ordered.select("path", F.inline(F.zip_with("b", "p", one)))


def innermost(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """places (path, line, ...) with ``scope``, the id of the innermost block (path, line,
    end_line, id) that holds the line, or null. Blocks lie inside or beside each other.

    A sweep in the order of lines: where a block begins the scope is the block, behind
    its end it is the block around it, and a place takes the last scope before it."""
    inside = nested(blocks.withColumns({"line": F.col("line").cast("int"), "end_line": F.col("end_line").cast("int"), "id": F.col("id").cast("string")}))
    # several blocks may end in one line: what is around the one that began first goes on
    around = F.min_by(F.struct(F.col("parent").alias("scope")), F.struct("line", (-F.col("end_line")).alias("to")))
    after = inside.groupBy("path", (F.col("end_line") + 1).alias("at")).agg(around.alias("mark")).withColumn("kind", F.lit(0))
    begun = inside.groupBy("path", F.col("line").alias("at")).agg(F.min_by(F.struct(F.col("id").alias("scope")), "end_line").alias("mark")).withColumn("kind", F.lit(1))
    asked = places.select("path", F.col("line").cast("int").alias("at"), F.struct(*places.columns).alias("row"), F.lit(2).alias("kind"))
    rows = after.unionByName(begun).unionByName(asked, allowMissingColumns=True)
    sweep = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("last", F.last("mark", True).over(sweep)).filter("row IS NOT NULL").select("row.*", "last.scope")


def holding(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """As innermost, for blocks that lie beside each other, never inside: the last one that
    begins before a place holds it, or none does."""
    begun = blocks.select("path", F.col("line").alias("at"), F.struct("id", "end_line").alias("mark"), F.lit(0).alias("kind"))
    asked = places.select("path", F.col("line").alias("at"), F.struct(*places.columns).alias("row"), F.lit(1).alias("kind"))
    sweep = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = begun.unionByName(asked, allowMissingColumns=True).withColumn("last", F.last("mark", True).over(sweep)).filter("row IS NOT NULL")
    return rows.select("row.*", F.when(F.col("last.end_line") >= F.col("at"), F.col("last.id")).alias("scope"))


def scopes(defined: DataFrame) -> DataFrame:
    """The blocks of symbols (path, type, name, line, end_line, content): one that is
    closed in its own line ends there, all end before the next definition, as symbols
    are those at the start of a line."""
    first = F.split_part("content", F.lit("\n"), F.lit(1))
    opened, closed = F.regexp_count(first, F.lit(r"\{")), F.regexp_count(first, F.lit(r"\}"))
    own = F.when((opened > 0) & (opened == closed), F.col("line"))
    before = F.lead("line").over(Window.partitionBy("path").orderBy("line")) - 1
    # what a text says is found below the window, which then needs no texts
    return defined.withColumn("own", own).withColumn("end_line", F.least("end_line", "own", before)).drop("own")


def bare(line: Column) -> Column:
    """A line without comments, and strings without their text."""
    line = F.regexp_replace(line, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`", "''")
    return F.regexp_replace(F.regexp_replace(line, r"//.*$", ""), r"/\*.*?\*/|^\s*\*.*$", "")


def named_on_lines(files: DataFrame) -> DataFrame:
    """(path, line, relation, label): the calls and type uses of each line. A definition
    of a function or method is no call; the last name of a.b() is called."""
    each = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "raw"))
    # a line without any of these has neither calls nor types (a comment may part an 'as')
    each = each.filter(F.col("raw").rlike(r"[(:|&<,]|as|/\*"))
    # each step is a column, so that it is done once for a line
    each = each.select("path", (F.col("pos") + 1).alias("line"), bare(F.col("raw")).alias("text"))
    text = F.col("text")
    head = r"^\s*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*" + NAME + r"\s*(?:<[^>]*>)?\s*\([^()]*\)\s*(?::[^{;=]+)?\{.*$"
    is_method = text.rlike(head) & ~F.regexp_extract(text, rf"^\s*({NAME})", 1).isin(NO_CALLS)
    called = F.regexp_replace(F.regexp_replace(text, rf"\bfunction\s+{NAME}", "function"), r"\bnew\s+" + NAME, "new")
    each = each.select("path", "line", "text", is_method.alias("is_method"), called.alias("called"))
    called = F.when(F.col("is_method"), F.regexp_replace("called", r"^[^{]*\{", "")).otherwise(F.col("called"))
    calls = F.array_except(F.regexp_extract_all(called, F.lit(rf"({NAME})\s*(?:<[^<>()]*>)?\("), 1), F.array(*map(F.lit, NO_CALLS)))
    # a type stands behind a colon or 'as', or in a list or choice of types (that of a class's header is none)
    told = lambda before, after: F.regexp_extract_all(text, F.lit(rf"(?:{before})([A-Z][\w$]*)\b(?!\s*[{after}])"), 1)
    types = F.array_distinct(F.concat(told(r":\s*|\bas\s+", "(.'"), told(r"[|&<,]\s*", "({.'")))
    both = F.concat(F.transform(F.array_distinct(calls), lambda x: F.struct(F.lit("calls").alias("relation"), x.alias("label"))), F.transform(types, lambda x: F.struct(F.lit("uses").alias("relation"), x.alias("label"))))
    return each.select("path", "line", both.alias("both")).select("path", "line", F.inline("both"))


def code_relations(files: DataFrame, known: DataFrame, defined: DataFrame | None = None) -> DataFrame:
    """(source, target, relation, weight, confidence, extraction_method) of typed scripts
    (path, content): classes that extend and implement, and symbols that call and use,
    what the same file defines. known (file, label, id, type, seq) are the nodes of
    symbols, by the file's path; names without a node give no edge, so no stubs arise.
    What stands outside all blocks is said of the file. defined are the symbols of the
    files, where they are at hand."""
    files = files.filter(F.col("path").rlike(TYPED))
    defined = symbols(files) if defined is None else defined.filter(F.col("path").rlike(TYPED))
    header = F.regexp_replace(F.split_part("content", F.lit("{"), F.lit(1)), r"<[^<>]*>", "")
    classes = defined.filter("type = 'class'").select(F.col("path").alias("file"), F.col("name").alias("label"), header.alias("header"))
    base = F.array(F.regexp_extract("header", rf"\bextends\s+({NAME})(?![\w$.(])", 1))
    faces = F.transform(F.split(F.regexp_extract("header", r"\bimplements\s+([^{]*)", 1), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    pair = lambda names, relation, kind: F.transform(F.filter(names, lambda x: x.rlike(rf"^{NAME}$")), lambda x: F.struct(x.alias("to"), F.lit(relation).alias("relation"), F.lit(kind).alias("preferred")))
    wanted = classes.select("file", "label", F.inline(F.concat(pair(base, "extends", "class"), pair(faces, "implements", "interface"))))

    blocks = scopes(defined).select("path", "line", "end_line", F.col("name").alias("id"))
    used = holding(blocks, named_on_lines(files)).select(F.col("path").alias("file"), "relation", F.col("label").alias("to"), F.col("scope").alias("label")).distinct()
    rows = wanted.withColumn("own", F.lit("class")).unionByName(used.withColumns({"preferred": F.lit("any"), "own": F.lit("any")}))

    # of each label the node for each kind that may be asked for, as resolve_symbols finds it
    kinds = ["class", "interface", "any"]
    best = known.groupBy("file", "label").agg(*[F.min_by("id", F.struct((F.col("type") != kind).alias("other"), F.col("seq"))).alias(kind) for kind in kinds])
    chosen = lambda asked: F.coalesce(*[F.when(F.col(asked) == kind, F.col(f"found.{kind}")) for kind in kinds])
    ends = best.select("file", "label", F.struct(*kinds).alias("found"))
    rows = rows.join(ends.withColumnRenamed("label", "to"), ["file", "to"]).withColumn("target", chosen("preferred")).drop("found")
    rows = rows.join(ends, ["file", "label"], "left").withColumn("source", chosen("own"))
    start = F.when(F.col("own") == "class", F.col("source")).otherwise(F.coalesce("source", F.concat(F.lit("file::"), "file")))
    edges = rows.select(start.alias("source"), "target", "relation").filter("source IS NOT NULL").distinct()
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return edges.select("source", "target", "relation", F.lit(1.0).alias("weight"), F.element_at(sure, F.col("relation")).alias("confidence"), F.lit("pattern").alias("extraction_method"))
