"""Filter interaction audit (operator 12): what five filters remove in any order.

Texts are scanned as Arrow buffers: numpy classes bytes, prefix sums of the classes
give words, capitals, symbols and code points of every document, and the sorted
hashes of a document's words, neighbours compared byte by byte, give its distinct
words. A document leaves the scan as a mask of the filters that it fails. Whether an
equal text has a smaller doc_id is a join of slim rows. All the rest is arithmetic on
masks: documents are counted by part, mask and label, at most 128 rows a part, and
what a filter removes after a set of others is a sum over masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.base import RunHashes, cut, table, utf8

FILTERS = "ABCDE"
#: A fails below so many words, B below so many distinct ones in 100 words, C above
#: so many capitals in 100 characters, D with any of these signs.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 50, 65, 5, "#$%&*|"
#: Bytes of text that are scanned together.
BLOCK = 4 << 20
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in SIGNS]] = True


class Scanner:
    """Counts of a batch of texts."""

    def __init__(self):
        self.hashes = RunHashes(0x9E3779B97F4A7C15 | 1)

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """words, distinct, capitals, signs and chars of every text."""
        whole = utf8(texts)
        kind = np.int64 if pa.types.is_large_binary(whole.type) else np.int32
        offsets = np.frombuffer(whole.buffers()[1], kind)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
        buffer = whole.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
        parts, first = [], 0
        while first < len(texts):  # as many texts as a block holds, one at least
            last = max(first + 1, int(offsets.searchsorted(offsets[first] + BLOCK, "right")) - 1)
            parts.append(self.block(data, offsets[first : last + 1]))
            first = last
        return {n: np.concatenate([p[n] for p in parts]) if parts else np.empty(0, np.int64) for n in ("words", "distinct", "capitals", "signs", "chars")}

    def block(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        n = len(offsets) - 1
        totals = {c: np.zeros(n, np.int64) for c in ("words", "capitals", "signs", "chars")}
        found = []
        start = int(offsets[0])
        while start < offsets[-1]:
            end = min(start + BLOCK, int(offsets[-1]))
            if end < offsets[-1]:  # inside a long text: go on to its next white space
                while end < offsets[-1] and not SPACES[data[end]]:
                    window = data[end : min(end + BLOCK, int(offsets[-1]))]
                    ahead = np.flatnonzero(SPACES[window])
                    end += int(ahead[0]) if len(ahead) else len(window)
            part = data[start:end]
            low = offsets.clip(start, end) - start  # where texts begin and end in the part
            sums = lambda flags: np.concatenate([[0], flags.cumsum()])
            solid = ~SPACES[part]
            begins, ends = solid.copy(), solid.copy()
            begins[1:] &= ~solid[:-1]
            ends[:-1] &= ~solid[1:]
            inner = low[(low > 0) & (low < len(part))]
            begins[inner] = solid[inner]  # a word ends with its text
            ends[inner - 1] = solid[inner - 1]
            for name, flags in (("words", begins), ("capitals", (part >= 65) & (part <= 90)), ("signs", SIGN[part]), ("chars", (part & 0xC0) != 0x80)):
                total = sums(flags)
                totals[name] += total[low[1:]] - total[low[:-1]]
            at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            found.append((low.searchsorted(at, "right") - 1, at + start, to - at, self.hashes.over(part.astype(np.uint64) + np.uint64(1))(at, to)))
            start = end
        totals["distinct"] = self.distinct(data, n, [np.concatenate(x) for x in zip(*found)]) if found else np.zeros(n, np.int64)
        return totals

    def distinct(self, data: np.ndarray, n: int, found: list[np.ndarray]) -> np.ndarray:
        """Distinct words of every text, from its sorted word hashes; neighbours of equal
        hash are compared in full, and a text with a clash is counted word by word."""
        text, at, size, hashes = found
        order = np.lexsort((hashes, text))
        text, at, size, hashes = text[order], at[order], size[order], hashes[order]
        same = np.flatnonzero((text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1]))
        out = np.bincount(text, minlength=n) - np.bincount(text[same + 1], minlength=n)
        clash = set(text[same[size[same] != size[same + 1]]])
        bounds = np.concatenate([[0], size[same].cumsum()])
        k = 0
        while k < len(same):  # BLOCK bytes of neighbours at once, one pair at least
            last = max(k + 1, int(bounds.searchsorted(bounds[k] + BLOCK, "right")) - 1)
            pairs, k = same[k:last], last
            pairs = pairs[size[pairs] == size[pairs + 1]]
            sizes = size[pairs]
            inside = np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
            unequal = data[np.repeat(at[pairs], sizes) + inside] != data[np.repeat(at[pairs + 1], sizes) + inside]
            clash.update(np.repeat(text[pairs], sizes)[unequal])
        for t in clash:
            some = np.flatnonzero(text == t)
            out[t] = len({data[at[i] : at[i] + size[i]].tobytes() for i in some})
        return out


def failures(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of filters A to D that each text fails, A in the lowest bit."""
    c = counts
    failed = (c["words"] < MIN_WORDS, 100 * c["distinct"] < MIN_DISTINCT * c["words"], 100 * c["capitals"] > MAX_CAPITALS * c["chars"], c["signs"] > 0)
    return sum(f.astype(np.int64) << k for k, f in enumerate(failed))


def masks(docs: DataFrame) -> DataFrame:
    """(part, doc_id, mask) of every row of docs, with the filters it fails as bits.

    A null text is empty; a null source is the part of the empty string. A null doc_id
    is smaller and larger than none, so it neither fails E nor makes others fail it.
    Of repeated rows none has a smaller doc_id. Texts are equal if 128 bits of two
    seeded XXH64 and the length are.
    """
    text = F.coalesce("text", F.lit(""))
    h = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(42), text).alias("b"), F.octet_length(text).alias("n"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), h.alias("h"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            failed = pa.array(failures(scanner(batch.column(3))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], failed], ["doc_id", "part", "h", "mask"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = cut(rows.mapInArrow(scan, f"doc_id {kind}, part string, h struct<a: bigint, b: bigint, n: int>, mask long"), "masks")
    # one row for each distinct text; the join's key has the doc_id too, so that copies spread
    least = slim.groupBy("h").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    later = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return slim.join(least, ["h", "doc_id"], "left").select("part", "doc_id", (F.col("mask") + later).alias("mask"))


def weights(spark: SparkSession) -> DataFrame:
    """(filter, before, mask, removed, kept, redundant, unique, orders): for each filter,
    set of filters before it and failure mask, what becomes of documents with that mask,
    and in how many orders this set comes before. 2,560 rows, whatever the data."""
    rows = []
    for f in range(5):
        for before in (s for s in range(32) if not s >> f & 1):
            orders = factorial(before.bit_count()) * factorial(4 - before.bit_count())
            for mask in range(32):
                fails, gone = mask >> f & 1, int(mask & before != 0)
                rows.append((f, before, mask, fails * (1 - gone), (1 - fails) * (1 - gone), fails * gone, int(mask == 1 << f), orders))
    return spark.createDataFrame(rows, "filter int, before int, mask long, removed int, kept_here int, redundant_here int, alone int, orders int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters, and step.

    A document has a label if any row of labels with its doc_id has it; rows without a
    doc_id have none. Every part has all 600 rows; an empty table gives none.
    """
    spark = docs.sparkSession
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masks(docs).join(known, "doc_id", "left")
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    counts = cut(rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good").alias("good"), count("toxic").alias("toxic")), "bymask")
    # at most 32 rows a part from here on
    total = lambda w, n="n": F.sum(F.col(w) * F.col(n))
    sets = (
        counts.join(F.broadcast(weights(spark)), "mask")
        .groupBy("part", "filter", "before", "orders")
        .agg(
            total("kept_here").alias("kept"), total("removed").alias("removed"), total("redundant_here").alias("redundant"), total("alone").alias("unique_fails"),
            total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"),
        )
    )
    sets = cut(sets, "sets")
    shapley = sets.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [("".join(p), k + 1, FILTERS.index(f), sum(1 << FILTERS.index(x) for x in p[:k])) for p in permutations(FILTERS) for k, f in enumerate(p)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")  # 600 rows
    found = sets.join(shapley, ["part", "filter"]).join(F.broadcast(orders), ["filter", "before"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source."""
    return audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


#: DuckDB statement of the query: every order and step over the failures of a part.
SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
least_id AS (SELECT t, min(doc_id) AS first FROM d GROUP BY 1),
f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
           || CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 5 * length(d.t) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > first THEN 'E' ELSE '' END AS fails
    FROM d JOIN least_id USING (t) LEFT JOIN l ON l.doc_id = d.doc_id
), m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
    SELECT a.c || b.c || c3.c || d4.c || e.c AS filter_order FROM c a, c b, c c3, c d4, c e
    WHERE len(list_distinct([a.c, b.c, c3.c, d4.c, e.c])) = 5
), s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, '[' || substr(filter_order, 1, step - 1) || '_]' AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) x),
r AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (WHERE NOT regexp_matches(fails, before) AND NOT contains(fails, own)), 0) AS kept,
           coalesce(sum(n) FILTER (WHERE NOT regexp_matches(fails, before) AND contains(fails, own)), 0) AS removed,
           coalesce(sum(n) FILTER (WHERE regexp_matches(fails, before) AND contains(fails, own)), 0) AS redundant,
           coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails,
           coalesce(sum(good) FILTER (WHERE NOT regexp_matches(fails, before) AND contains(fails, own)), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE NOT regexp_matches(fails, before) AND contains(fails, own)), 0) AS toxic_lost
    FROM m, s GROUP BY ALL
)
SELECT part, filter_order, cast(step AS INTEGER) AS step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed, cast(redundant AS BIGINT) AS redundant,
       cast(unique_fails AS BIGINT) AS unique_fails, cast(good_lost AS BIGINT) AS good_lost, cast(toxic_lost AS BIGINT) AS toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""
