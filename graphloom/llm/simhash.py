"""SimHash near-dedup (operator 9): anchor-point covering.

Two 64-bit fingerprints that differ in 4 bits or fewer differ in 2 bits or fewer
in one of their 32-bit halves. In each half the code words of the [31, 26]
Hamming code are the anchors: a perfect code of covering radius 1 (the half's
top bit only takes part in the comparison). A point halfway between two halves at
distance 2 lies within 1 of either, and within the covering radius 1 of some
anchor, so both fingerprints lie within radius + 1 = 2 of that anchor. The
threshold is shared between both ends, which needs 15.5 anchors a half on
average instead of 156. Each distinct fingerprint goes to its anchors, and
fingerprints are compared inside each anchor's group only.

An anchor's group is not compared by all pairs: a search from one fingerprint
takes all that it reaches out of the rest, so a group of near copies collapses at
once, and it emits one star edge for each member. Groups over GROUP members
(counted beforehand) are salted into block pairs, each a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.base import annotate, as_rows, cut, table, unpack

BITS = 4
GROUP = 4096
#: Joins of tables that grow with the documents are said to be merges: a table under Spark's
#: limit of broadcasts would pass through the driver, where it takes several times its size.
JOIN = "merge"
WORDS = 4
SEED = 42


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return 0
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(line, seed)
    stop = np.fromiter(map(len, parts), np.int64, len(parts)).cumsum() + np.arange(len(parts))
    starts, stops = [0, *(stop[: n - 1] + 1).tolist()], stop[words - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = [digest(line[i:j], seed) for i, j in zip(starts[k : k + 65536], stops[k : k + 65536])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """Adds ``fp``, the fingerprint as a signed long."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda texts: [[signed(fingerprint(t)) for t in texts]]

    return annotate(rows, T.StructType([T.StructField("fp", T.LongType())]), make)


def anchors(fps: DataFrame) -> DataFrame:
    """(fp, anchor): every anchor within distance 2 in either half. The syndrome s
    of a half names the bit whose flip gives a code word (0: it is one); flipping
    bits u and u^s gives all code words at distance 2 (position 0: no bit)."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    parity = " + ".join(f"shiftleft(bit_count(x & {m}L) & 1, {k})" for k, m in enumerate(masks))
    halves = fps.select("fp", F.expr("posexplode(array(fp & 2147483647L, shiftrightunsigned(fp, 32) & 2147483647L)) as (half, x)"))
    flip = lambda u: f"shiftright(shiftleft(1L, {u}), 1)"
    near = f"transform(filter(sequence(0, 31), u -> u < (u ^ s) or (s = 0 and u = 0)), u -> x ^ {flip('u')} ^ {flip('(u ^ s)')})"
    return halves.withColumn("s", F.expr(parity)).select(
        "fp", F.explode(F.expr(near)).alias("code"), "half"
    ).select("fp", F.expr("shiftleft(cast(half as bigint), 31) | code").alias("anchor"))


def stars(group: np.ndarray, bits: int = BITS) -> tuple[list[int], list[int]]:
    """Edges (member, seed) that join what is linked inside one group."""
    if len(group) == 2:
        a, b = int(group[0]), int(group[1])
        return ([a], [b]) if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits else ([], [])
    ends: tuple[list[int], list[int]] = [], []
    rest = group.view(np.uint64)  # of a negative number, bitwise_count counts another's bits
    while len(rest) > 1:
        seed, front, rest = int(rest[:1].view(np.int64)[0]), rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = front[:64], front[64:]
            hit = (np.bitwise_count(rest[None, :] ^ some[:, None]) <= bits).any(axis=0)
            new, rest = rest[hit], rest[~hit]
            front = np.concatenate([front, new])
            ends[0].extend(new.view(np.int64).tolist())
            ends[1].extend([seed] * len(new))
    return ends


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of
    all pairs at distance 4 or less."""
    placed = anchors(fps)
    sizes = placed.groupBy("anchor").count().filter("count > 1")
    sized = placed.join(sizes.select("anchor", F.ceil(F.col("count") / group).cast("int").alias("blocks")).hint(JOIN), "anchor")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = sized.withColumn("mine", mine).select(
        "fp", "anchor", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    groups = (
        dealt.groupBy("anchor", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )

    @F.pandas_udf("struct<a: array<bigint>, b: array<bigint>>")
    def compare(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for many in column:
            found = [stars(np.asarray(x, np.int64)) for x in many]
            yield pd.DataFrame({"a": [x[0] for x in found], "b": [x[1] for x in found]})

    pairs = groups.select(compare("fps").alias("e"))
    return (
        pairs.select(F.explode(F.arrays_zip(F.col("e.a").alias("a"), F.col("e.b").alias("b"))).alias("p"))
        .select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list (a, b), root alike within a
    component. Each round hooks every node to the neighbour (or itself) of least
    random rank, contracts the edges and drops those inside a node: about half of
    the nodes go in a round, so the rounds grow with the logarithm. Every round is
    written to the shared folder, nothing is gathered on the driver."""
    found, turn = None, 0
    edges = cut(edges.filter("a <> b"), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = F.struct(F.xxhash64("b", F.lit(turn)), F.col("b"))
        own = F.struct(F.xxhash64("a", F.lit(turn)), F.col("a"))
        hooks = both.groupBy("a").agg(F.min(rank).getField("b").alias("b"), F.min(rank).alias("r"))
        hooks = hooks.select(F.col("a").alias("node"), F.when(F.col("r") < own, F.col("b")).otherwise(F.col("a")).alias("root"))
        hooks = cut(hooks, "hooks")
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")).hint(JOIN)  # noqa: E731, B023
        edges = cut(
            edges.join(to("a"), "a").join(to("b"), "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct(),
            "edges",
        )
        if found is None:
            found = hooks
        else:
            newer = hooks.select(F.col("node").alias("root"), F.col("root").alias("newer"))
            found = cut(found.join(newer.hint(JOIN), "root", "left").select("node", F.coalesce("newer", "root").alias("root")), "roots")
        turn += 1
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs' row (struct ``row``, or only its columns ``keep``) with fp, key (a
    hash of the text), root (the same for a component) and component_id, the
    smallest doc_id that links reach.

    A null or empty text, or one of white space, has fingerprint zero and is
    linked like any other. Repeated rows share a fingerprint, so a component.
    Rows with a null doc_id belong to components but never name one, unless a
    component has no other (then its id is null). An empty table gives no rows.
    """
    rows = with_fingerprint(as_rows(docs)).withColumn("key", F.xxhash64("row.text"))
    if keep:
        rows = rows.select(F.struct(*[F.col("row").getField(c).alias(c) for c in keep]).alias("row"), "fp", "key")
    rows = cut(rows, "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("row.doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"))).withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(roots.hint(JOIN), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.select("fp", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")).hint(JOIN), "root")
    return rows.join(named.hint(JOIN), "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    found = classes(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that of the smallest
    doc_id (of several texts under it, that of the least hash; of rows that share
    both, that of the least checksum of all columns). The slim classes decide,
    texts move once, in the join that keeps rows. Null texts have fingerprint
    zero, an empty table gives no rows, extra columns may have any name."""
    found = classes(docs, keep=["doc_id"])
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.col("key").alias("key")))
    stay = cut(found.groupBy("root").agg(first.alias("f")).select("f.id", "f.key"), "stay")
    same = lambda keys: F.col("row.doc_id").eqNullSafe(keys["id"]) & (F.xxhash64("row.text") == keys["key"])
    rows = as_rows(docs)
    chosen = rows.join(stay.hint(JOIN), same(stay), "left_semi")
    often = found.groupBy(F.col("row.doc_id").alias("id"), "key").count().filter("count > 1").drop("count")
    often = cut(often, "repeated")
    if not often.isEmpty():
        one = F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")  # partial, so a hot row stays small
        several = chosen.join(often.hint(JOIN), same(often), "left_semi").groupBy(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("key"))
        chosen = chosen.join(often.hint(JOIN), same(often), "left_anti").unionByName(several.agg(one).select("row"))
    return unpack(chosen, docs.columns)
