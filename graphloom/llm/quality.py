"""Quality rules (operator 6): document rules and host-level verdicts.

All measures are built-in expressions on the document's own row; no text is
exchanged. Hosts are judged on the failures of all their documents, rule by rule:
failures are pre-aggregated by host, each rule's failure rate is shrunk by a beta
prior that is fitted to the hosts' rates of that rule by moments, and the verdicts,
one slim row for each host, are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.base import SPACE_CLASS, as_rows, cut, table, unpack

#: A document with fewer words fails.
MIN_WORDS = 50
#: A document fails if more than this share (percent) of its words stand in
#: repeated three-word windows.
MAX_REPEATED = 50
#: A host is refused if the shrunk failure rate of a rule is above this ...
MAX_HOST_RATE = 0.5
#: ... and lies so many posterior standard deviations above the mean of all hosts.
SURE = 2.0
#: Rules that are counted by host, each true where a document fails. The first two
#: make ``base_failed``; the others count for the host only.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeated": f"100 * n_repeat_words > {MAX_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",  # over one symbol in ten words
    "lines": "10 * n_dup_lines > 3 * n_lines",  # over three lines in ten stood there before
}
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """From ``words`` to n_repeat_words: words inside three-word windows that
    occur twice or more in the text.

    Hash and position of every window share one long, which sorts as a primitive
    array; neighbours with an equal hash part are candidates. Their windows are
    then compared in full (a second sort, of the candidates only), so a hash
    clash cannot count. Each step is a column of its own, as a lambda would
    compute an expression anew for every element.
    """
    n, word = F.size("words"), lambda i: F.get("words", i)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    # positions take 24 bits; in a text of more words every window is a candidate
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, 24).bitwiseOR(i.cast("long"))))
    same = lambda a, b: F.shiftrightunsigned(a, 24) == F.shiftrightunsigned(b, 24)
    hit = F.filter("packed", lambda x, i: same(x, F.get("packed", i + 1)) | same(x, F.get("packed", i - 1)))
    places = F.when(n < 1 << 24, F.transform(hit, lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))).otherwise(
        F.sequence(F.lit(0), n - 3)
    )
    window = lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i"))
    true = F.filter("full", lambda x, k: (x.w == F.get("full", k + 1).w) | (x.w == F.get("full", k - 1).w))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("to"))
    grow = lambda s, i: F.struct((s.n + F.least(F.lit(3), i + 3 - s.to)).alias("n"), (i + 3).alias("to"))
    none = F.array().cast("array<bigint>")
    return (
        rows.withColumn("packed", F.when(n < 4, none).otherwise(packed))
        .withColumn("places", F.when(F.size("packed") == 0, F.array().cast("array<int>")).otherwise(places))
        .withColumn("full", F.array_sort(F.transform("places", window)))
        .withColumn("at", F.sort_array(F.transform(true, lambda x: x.i)))
        .withColumn("n_repeat_words", F.aggregate("at", start, grow, lambda s: s.n))
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs' row (struct ``row``) with n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    filled = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    rows = with_repeated_words(as_rows(docs).withColumns({"words": words, "lines": filled}))
    failed = F.expr(RULES["short"]) | F.expr(RULES["repeated"])
    found = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    # the measures leave through a generator: a filter on them is not moved below
    # it, where the optimizer would write the lambdas above into each other
    names = [c for c in found.columns if c != "row"]
    once = found.select("row", F.explode(F.array(F.struct(*names))).alias("m")).select("row", "m.*")
    return once.withColumn("base_failed", failed)


def host_of(columns: list[str]) -> Column:
    """The host of a row: that of its ``url`` where there is one, else ``source``."""
    named = [F.lower(F.try_parse_url("row.url", F.lit("HOST")))] if "url" in columns else []
    return F.coalesce(*named, F.col("row.source").cast("string") if "source" in columns else F.lit(None).cast("string"))


def host_verdicts(found: DataFrame, most: float = MAX_HOST_RATE, sure: float = SURE) -> DataFrame:
    """(host, host_rule, host_rate, host_failed) from measured rows with their
    ``host``: host_rule is the rule of the highest shrunk rate, host_rate.

    A rule's prior has the mean of the hosts' rates and their variance, less what
    binomial noise adds to it, so hosts of few documents lean on the prior.
    """
    counts = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    hosts = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *counts)
    each = hosts.select(
        "host", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bad")) for r in RULES])).alias("x")
    ).select("host", "n", "x.*")
    rate = F.col("bad") / F.col("n")
    prior = each.groupBy("rule").agg(
        F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("one")
    )
    spread = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("one"), F.lit(1e-6))
    weight = F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(0.0)) + 1e-3
    prior = prior.select("rule", "m", weight.alias("w"))
    # one row for each rule
    shrunk = each.join(F.broadcast(prior), "rule").withColumn("rate", (F.col("bad") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w")))
    low = F.col("rate") - sure * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("w") + 1))
    bad = (F.col("rate") > most) & (low > F.col("m"))
    worst = F.max(F.struct(F.round("rate", 9).alias("rate"), F.col("rule")))
    return shrunk.groupBy("host").agg(worst.alias("x"), F.bool_or(bad).alias("host_failed")).select(
        "host", F.col("x.rule").alias("host_rule"), F.col("x.rate").alias("host_rate"), "host_failed"
    )


def judged(docs: DataFrame) -> DataFrame:
    """docs' row (struct ``row``) with the measures, base_failed, host, host_rule,
    host_rate, host_failed and kept.

    The measured rows are written once, so no text is measured twice. A null text
    has no words, so it fails. Rows with a null host form a host of their own.
    Repeated rows count as often as they occur. An empty table gives no rows. The
    caller's columns stay inside ``row`` under any name.
    """
    found = cut(measured(docs).withColumn("host", host_of(docs.columns)), "measured")
    # written, so that Spark knows their size before it plans the join with the texts
    hosts = cut(host_verdicts(found).withColumnRenamed("host", "of"), "hosts")
    both = found.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
    return both.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document. The measures are written once,
    without the texts, and joined with the host verdicts."""
    docs = table(spark, sf_dir, "documents")
    found = measured(docs).withColumn("host", host_of(docs.columns))
    slim = cut(found.selectExpr("row.doc_id as doc_id", "* except (row)"), "measures")
    hosts = cut(host_verdicts(slim).withColumnRenamed("host", "of"), "hosts")
    return slim.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rule", F.round("host_rate", 4).alias("host_rate"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the rules keep (null texts, nulls in other
    columns, repeated rows and empty tables as in ``judged``)."""
    return unpack(judged(docs).filter("kept"), docs.columns)
