"""Mixing sources to target weights (operator 2): subset-sum budget fitting.

A source's target is met by whole copies of all its documents plus a subset that
fills what remains. The subset is chosen by counts, not by documents: documents
are counted by exact length, a proportional part (every n-th in order of length) is
taken, and a bounded-knapsack dynamic programme over the counts left fits the
remaining budget; the part shrinks until no choice could fit it better. Seeded ranks then say which documents of a length are taken.

Ranks need no sort of a whole length group (one length may hold a third of all
rows, as copies do): documents fall into hash buckets, cut-off buckets follow from
pre-aggregated bucket counts, and rows are numbered in the cut-off bucket alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.base import SPACE_CLASS, as_rows, cut, running, table

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 42
#: Bits of the hash that make the buckets of a length group, for the seeded ranks.
BUCKET_BITS = 16
#: Rows of the knapsack's table that are kept at a time on the way back.
FAN = 8


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row for each source, whose names
    order as code points (see mixed() for nulls).

    Water filling: in order of size over weight, a source is full if its share of
    what the fuller ones leave is above ``most`` times its size. Sums of whole
    numbers decide, so the result is the one of resharing step by step. Sources are
    numbered and summed by ranges, so there may be as many as hosts.
    """
    large = lambda c: c.cast("decimal(28,0)")  # noqa: E731  whole numbers of more than 64 bits
    rows = running(sources, [F.col("source")], {"nth": F.lit(1).cast("long")}, "names")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("w", weight.cast("long")).withColumn("ratio", F.col("source_size") / F.col("w"))
    rows = running(rows.drop("nth"), [F.col("ratio"), F.col("source")], {"spent": F.col("source_size") * most, "w_before": F.col("w")}, "filling")
    total = sources.agg(F.sum("source_size").alias("all")).join(F.broadcast(rows.agg(F.sum("w").alias("w_all"))))  # one row
    rows = rows.join(F.broadcast(total)).withColumns({"left": F.col("all") - F.col("spent"), "w_left": F.col("w_all") - F.col("w_before")})
    full = large(F.col("source_size") * most) * F.col("w_left").cast("decimal(10,0)") <= large(F.col("left")) * F.col("w").cast("decimal(10,0)")
    rows = cut(rows.withColumn("full", full).select("source", "source_size", "w", "ratio", "left", "w_left", "full"), "full")
    # the level of the first source that is not full holds for all after it
    level = rows.filter("not full").agg(F.min(F.struct("ratio", "source", "left", "w_left")).alias("level"))
    share = F.col("level.left").cast("double") * F.col("w") / F.col("level.w_left")
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(share)
    return rows.join(F.broadcast(level)).select("source", "source_size", target.alias("target"))  # one row of level


def proportional(sizes: np.ndarray, counts: np.ndarray, budget: int, spare: int = 0) -> np.ndarray:
    """A part of the documents that leaves ``spare`` words of the budget or more (the
    largest size at least), in which each size has its share: of the documents in order
    of size, every n-th. Sums of the taken exceed the share by less than the largest
    size, which is left out before."""
    order = np.argsort(sizes)
    size, count = sizes[order], counts[order]
    total, largest = int((size * count).sum()), int(size.max(initial=0))
    share = max(0, budget - max(spare, largest)) / max(1, total)
    upto = np.minimum(np.floor(count.cumsum() * share).astype(np.int64), count.cumsum())
    take = np.zeros(len(sizes), np.int64)
    take[order] = np.diff(upto, prepend=0)
    return np.minimum(take, counts)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (> 0) to take, at most counts of each, so that
    their sum is the greatest that is not above budget."""
    # entries are 1, 2, 4, ... documents of a size, so that every count up to what is
    # there can be made; large ones first, they reach the budget in few steps
    entries: list[tuple[int, int, int]] = []
    for k in np.argsort(-sizes):
        size, part = int(sizes[k]), 1
        spare = min(int(counts[k]), budget // size)
        while spare > 0:
            n = min(part, spare)
            spare, part = spare - n, part * 2
            entries.append((int(k), n, n * size))
    take, mask, row = np.zeros(len(sizes), np.int64), (1 << budget + 1) - 1, 1
    # bit s of a row of the table tells whether the entries so far can sum up to s
    for done, (_, _, words) in enumerate(entries, 1):
        row |= row << words & mask
        if row >> budget & 1:
            entries = entries[:done]
            break

    def back(row: int, entries: list[tuple[int, int, int]], at: int) -> int:
        """Take what of the entries leads to the sum ``at``, from the sums in row; what
        is left of it. FAN rows are kept at a time, the rows between are made again."""
        if len(entries) == 1:
            k, n, words = entries[0]
            if row >> at & 1:
                return at  # without this entry
            take[k] += n
            return at - words
        step = -(-len(entries) // FAN)
        parts, rows = [entries[i : i + step] for i in range(0, len(entries), step)], [row]
        for part in parts[:-1]:
            row = rows[-1]
            for _, _, words in part:
                row |= row << words & mask
            rows.append(row)
        for part in reversed(parts):
            at = back(rows.pop(), part, at)
        return at

    if entries:
        back(1, entries, row.bit_length() - 1)
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (> 0) to take, at most counts of each, so that
    their sum is the greatest that is not above budget.

    A part in which each size has its share goes first, and the knapsack fills what is
    left, twice the largest size to begin with. If that does not meet the budget to the
    word, the part gives way to four times as much room, and so on: at the end the
    knapsack has the whole budget, so no choice could come nearer. Sizes are counted in
    their common divisor. The table has a bit for each word that is left."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    unit = int(np.gcd.reduce(sizes))
    sizes, budget = sizes // unit, min(budget // unit, int((sizes // unit * counts).sum()))
    spare = 2 * int(sizes.max())
    while True:
        part = proportional(sizes, counts, budget, spare) if spare < budget else np.zeros(len(sizes), np.int64)
        rest = budget - int((sizes * part).sum())
        more = knapsack(sizes, counts - part, rest)
        if not part.any() or int((sizes * more).sum()) == rest:
            return part + more
        spare *= 4


def plans(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, size, n, whole, part): of the n documents of a size, all are taken
    ``whole`` times and ``part`` of them once more. A source's group here is its
    list of distinct lengths (at most the root of twice its words), not its rows."""
    # dealt by a number of parts, so that small groups are not put together in one task
    parts = int(histogram.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = histogram.join(goals, "source").repartition(parts, "source")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = int(goal // total) if total else 0
        budget, part = int(round(goal - whole * total)), np.zeros(len(pdf), np.int64)
        some = pdf["size"].to_numpy() > 0
        if budget > 0:
            part[some] = fit(pdf["size"].to_numpy()[some], pdf["n"].to_numpy()[some], budget)
        return pdf[["source", "size", "n"]].assign(whole=whole, part=part)

    schema = "source string, size bigint, n bigint, whole int, part bigint"
    return joined.groupBy("source").applyInPandas(plan, schema)


def mixed(docs: DataFrame, keep: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """docs' row (struct ``row``, or only its columns ``keep``) with size,
    source_size, target, taken and times (how often the mix holds the row).

    A null text has size 0; documents of size 0 are never taken. A null source is
    a source of its own, last in the order of weights. Repeated rows are
    documents like any other and tie in the seeded order, where either may go
    first. An empty table gives no rows; a table without words has targets of 0.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    kept = F.struct(*[F.col("row").getField(c).alias(c) for c in keep or docs.columns])
    rows = as_rows(docs).select(
        kept.alias("row"),
        # a key without nulls that orders as the sources do, null last
        F.coalesce(F.concat(F.lit("0"), F.col("row.source")), F.lit("1")).alias("source"),
        F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")).cast("long").alias("size"),
        F.xxhash64(F.col("row.doc_id"), F.xxhash64("row.text"), F.lit(seed)).alias("h"),
    )
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    if keep is not None:
        rows = cut(rows, "sized")
    counts = cut(rows.groupBy("source", "size", "bucket").count(), "lengths")
    goals = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))), "targets")
    plan = cut(plans(counts.groupBy("source", "size").agg(F.sum("count").alias("n")), goals), "plan")
    # how many of a bucket go: all before the cut-off bucket, in it the rest of part
    within = Window.partitionBy("source", "size").orderBy("bucket")
    before = F.sum("count").over(within) - F.col("count")
    quota = F.least(F.greatest(F.col("part") - before, F.lit(0)), F.col("count"))
    quotas = counts.join(plan.drop("n"), ["source", "size"]).select("source", "size", "bucket", "whole", quota.alias("quota"))
    joined = rows.join(quotas, ["source", "size", "bucket"])
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h"))
    times = F.when(F.col("size") > 0, F.col("whole") + (rank <= F.col("quota")).cast("int")).otherwise(0)
    out = joined.withColumn("times", times).join(goals, "source")
    return out.select("row", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; texts are read once, for sizes."""
    found = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep=["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row as often as the mix takes it (null texts and
    sources, repeated rows and empty tables as in ``mixed``)."""
    found = mixed(docs).filter("times > 0")
    copies = found.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return copies.select("row.*")
